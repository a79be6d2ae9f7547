"""Upkeep of the evidence ledger and what it says."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import ledger
from loomgraph.plans.registry import query

NOW = 5000
_COLS = "evidence_id, provider, run_id, path, invalidated_at, invalidation_reason"


def _shown(df):
    return df.select(*[c.strip() for c in _COLS.split(",")])


def _dead(sql: str, flag: str, reason: str) -> str:
    return f"""{sql} SELECT evidence_id, provider, run_id, path, CASE WHEN {flag} THEN {NOW} ELSE invalidated_at END AS invalidated_at, CASE WHEN {flag} THEN {reason} ELSE invalidation_reason END AS invalidation_reason FROM x"""


@query(_dead("WITH x AS (SELECT *, invalidated_at IS NULL AND (path IN ('src/f03.py', 'src/f25.py') OR replace(coalesce(file_path, ''), chr(92), '/') = 'src/f15.py') AS hit FROM <ledger>)", "hit", "'changed'"))
def evidence_stale_paths(t):
    paths = t.spark.createDataFrame([("src/f03.py",), ("src\\f25.py",), ("src/f15.py",)], "path string")
    return _shown(ledger.stale_on_paths(t("ledger"), paths, "changed", NOW))


@query(_dead("WITH x AS (SELECT *, invalidated_at IS NULL AND relation = 'uses' AS hit FROM <ledger>)", "hit", "'asked'"))
def evidence_invalidated(t):
    e = t("ledger")
    return _shown(ledger.invalidated(e, e.where("relation = 'uses'"), "asked", NOW))


_FRESH = "SELECT max(run_id) AS run_id FROM <ledger_runs> GROUP BY provider, project"


@query(_dead(f"""WITH f AS ({_FRESH}), k AS (SELECT provider, project, path, list(DISTINCT run_id) AS bb FROM <ledger> e JOIN (SELECT run_id, project FROM <ledger_runs>) r USING (run_id) WHERE run_id IN (SELECT run_id FROM f) AND path <> '' GROUP BY 1, 2, 3),
x AS (SELECT e.*, coalesce(bb IS NOT NULL AND NOT list_contains(bb, e.run_id) AND e.invalidated_at IS NULL, false) AS hit, list_min(bb) AS who FROM <ledger> e LEFT JOIN (SELECT run_id, project FROM <ledger_runs>) r ON r.run_id = e.run_id LEFT JOIN k ON k.provider = e.provider AND k.project = r.project AND k.path = e.path)""", "hit", "concat('superseded_by_run:', who)"))
def evidence_superseded_by_run(t):
    runs = t("ledger_runs")
    fresh = runs.groupBy("provider", "project").agg(F.max("run_id").alias("run_id")).select("run_id")
    return _shown(ledger.superseded_by_run(t("ledger"), runs, fresh, NOW))


@query("""SELECT evidence_id, coalesce(nullif(path, ''), nullif(file_path, '')) AS path, coalesce(nullif(file_path, ''), nullif(path, '')) AS file_path, coalesce(nullif(symbol, ''), nullif(src, '')) AS symbol, coalesce(nullif(target, ''), nullif(dst, '')) AS target FROM <ledger>""")
def evidence_aliases(t):
    return ledger.filled_evidence(t("ledger")).select("evidence_id", "path", "file_path", "symbol", "target")


@query("SELECT count(*) AS runs, (SELECT count(*) FROM <ledger> WHERE run_id NOT IN (SELECT run_id FROM <ledger_runs> WHERE project = '/b')) AS evidence FROM <ledger_runs> WHERE project <> '/b'")
def purge_provider_run(t):
    runs, rows = ledger.without_run(t("ledger_runs"), t("ledger"), t("ledger_runs").where("project = '/b'"))
    return runs.agg(F.count(F.lit(1)).alias("runs")).crossJoin(rows.agg(F.count(F.lit(1)).alias("evidence")))


_KEPT = "kr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY created_at DESC, run_id DESC) AS n FROM <ledger_runs>) WHERE n <= 10)"


@query(f"WITH {_KEPT} SELECT snapshot_id, root, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY captured_at DESC, snapshot_id DESC) AS n FROM <snapshots>) WHERE n <= 20 OR snapshot_id IN (SELECT snapshot_id FROM kr)")
def purge_history(t):
    return ledger.purged(t("ledger_runs"), t("snapshots"))[1]


@query("""SELECT provider, root, snapshot_id, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY provider, root ORDER BY captured_at DESC) AS n FROM (SELECT 'p' AS provider, root, snapshot_id, captured_at FROM <snapshots>)) WHERE n = 1""")
def binding_upsert(t):
    s = t("snapshots").select(F.lit("p").alias("provider"), "root", "snapshot_id", "captured_at")
    return ledger.upserted(s.where("captured_at % 2 = 0"), s.where("captured_at % 2 = 1"), ["provider", "root"], ["captured_at"])


@query("SELECT evidence_id, run_id, created_at FROM <ledger> WHERE provider = 'error' AND relation = 'calls' ORDER BY created_at DESC, evidence_id LIMIT 50")
def evidence_filter(t):
    return ledger.find_evidence(t("ledger"), 50, "error", relation="calls").select("evidence_id", "run_id", "created_at")


@query("SELECT DISTINCT provider, version, capability FROM <ledger_runs>")
def active_providers(t):
    return ledger.active_providers(t("ledger_runs"))


@query("SELECT run_id, provider, created_at, status FROM <ledger_runs> ORDER BY created_at DESC, run_id")
def provider_runs(t):
    return ledger.all_runs(t("ledger_runs")).select("run_id", "provider", "created_at", "status")


@query("SELECT r.run_id, status, (SELECT count(*) FROM <ledger> e WHERE e.run_id = r.run_id) AS evidence_rows FROM <ledger_runs> r WHERE created_at % 3 = 0")
def ledger_rows_for_runs(t):
    runs = t("ledger_runs")
    return ledger.rows_for_runs(runs, t("ledger"), runs.where("created_at % 3 = 0")).select("run_id", "status", "evidence_rows")


@query("SELECT provider, capability, arg_max(status, struct_pack(c := created_at, r := run_id)) AS status, max(created_at) AS created_at FROM <ledger_runs> GROUP BY 1, 2")
def latest_status_per_capability(t):
    return ledger.latest_status(t("ledger_runs"))


_UNION = """lv AS (SELECT * FROM <ledger> WHERE invalidated_at IS NULL AND run_id IN (SELECT run_id FROM <ledger_runs> WHERE status = 'ok' AND project = '/a')), tk AS (SELECT * FROM lv ORDER BY path NULLS FIRST, relation, src, dst, line_start NULLS FIRST, line_end NULLS FIRST, run_id, evidence_id LIMIT {0}),
kd AS (SELECT coalesce(path, '') AS path, CASE WHEN path IS NULL THEN 'unknown' ELSE 'python' END AS language, relation, lower(src) AS src, lower(dst) AS dst, coalesce(snapshot, '') AS snapshot, provider, line_start, line_end FROM tk),
g AS (SELECT path, language, relation, src, dst, snapshot, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, count(DISTINCT line_start) AS n, count(DISTINCT CASE WHEN line_start % 2 = 1 THEN line_start END) AS ok FROM kd GROUP BY 1, 2, 3, 4, 5, 6),
un AS (SELECT path, language, relation, src, dst, snapshot, providers, NOT (snapshot = '' OR path = '') AND n > 1 AS conflict, CASE WHEN snapshot = '' OR path = '' THEN 'UNBOUND' WHEN n > 1 AND ok = 1 THEN 'source_verified' WHEN n > 1 THEN 'CONFLICT' WHEN n = 1 AND ok = 1 THEN 'SUPPORTED' ELSE 'UNVERIFIED' END AS status FROM g
  UNION ALL SELECT '', '', '', '', '', '', '', true, 'UNVERIFIED' FROM (SELECT count(*) AS c FROM lv) WHERE c > {0})"""


def _union(t, limit=200_000):
    e = t("ledger")
    return ledger.union_evidence(e, t("ledger_runs"), "/a", e.where("line_start % 2 = 1"), limit=limit)


@query(f"WITH {_UNION.format(200_000)} SELECT * FROM un")
def union_evidence(t):
    return _union(t)


@query(f"WITH {_UNION.format(500)} SELECT * FROM un")
def union_evidence_cut(t):
    return _union(t, 500)


@query(f"""WITH {_UNION.format(500)}, rc AS (SELECT * FROM <ledger_runs> ORDER BY created_at DESC, run_id DESC LIMIT 200), ls AS (SELECT arg_max(status, struct_pack(c := created_at, r := run_id)) AS s FROM rc GROUP BY provider, capability)
SELECT (SELECT count(*) FROM <ledger_runs>) AS enumerated, least((SELECT count(*) FROM <ledger_runs>), 200) AS returned, (SELECT count(*) FROM <ledger_runs>) > 200 AS truncated, count(*) FILTER (path <> '') AS entries, count(*) FILTER (conflict) AS open_conflicts, count(*) FILTER (status <> 'SUPPORTED') AS unresolved,
  NOT (SELECT coalesce(bool_or(s <> 'ok'), false) FROM ls) AND count(*) FILTER (path = '' AND src = '' AND conflict) = 0 AS provider_ok FROM un""")
def ledger_health(t):
    return ledger.health(t("ledger_runs"), _union(t, 500))


_BUILTIN = """nd AS (SELECT id, path, line_start, concat(replace(path, '/', '.'), CASE WHEN kind = 'file' THEN '' ELSE concat('.', symbol) END) AS nm FROM <nodes>), bc AS (SELECT CASE WHEN relation <> 'defines' THEN s.nm END AS a, d.nm AS b, CASE relation WHEN 'calls' THEN 'CALLS' WHEN 'uses' THEN 'CALLS' WHEN 'extends' THEN 'INHERITS' WHEN 'imports' THEN 'IMPORTS' ELSE 'DEFINES' END AS rel,
  count(*) AS n, min(CASE WHEN relation <> 'defines' THEN s.line_start END) AS line FROM <edges> e JOIN nd s ON s.id = e.src JOIN nd d ON d.id = e.dst GROUP BY 1, 2, 3)"""


def _named(t):
    n = t("nodes")
    return n.withColumn("fqn", F.concat(F.replace("path", F.lit("/"), F.lit(".")), F.when(F.col("kind") == "file", F.lit("")).otherwise(F.concat(F.lit("."), "symbol"))))


def _flat(df, *more):
    return df.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.col("relation").alias("rel"), *more)


@query(f"WITH {_BUILTIN} SELECT * FROM bc")
def builtin_claims(t):
    return _flat(ledger.builtin_claims(t("edges"), _named(t)), "n", "line")


_EXTERNAL = """ex AS (SELECT s.nm AS a, d.nm AS b, CASE WHEN relation = 'uses' THEN 'INHERITS' ELSE 'CALLS' END AS rel, count(*) AS n, min(l.line_start) AS line, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM <ledger> l JOIN nd s ON s.id = l.src JOIN nd d ON d.id = l.dst
  WHERE invalidated_at IS NULL AND run_id IN (SELECT run_id FROM <ledger_runs>) GROUP BY 1, 2, 3)"""


def _claims(t):
    """Providers that speak in qualified names; some relate a pair otherwise than the graph."""
    n = _named(t).select("id", "fqn")
    e = t("ledger").join(n.select(F.col("id").alias("src"), F.col("fqn").alias("s")), "src").join(n.select(F.col("id").alias("dst"), F.col("fqn").alias("d")), "dst")
    e = e.select("evidence_id", "provider", "run_id", F.lit(None).cast("string").alias("symbol"), F.col("s").alias("src"), F.col("d").alias("dst"), F.lit(None).cast("string").alias("target"),
                 F.when(F.col("relation") == "uses", "extends").otherwise(F.col("relation")).alias("relation"), "path", "line_start", "line_end", "invalidated_at")
    return ledger.external_claims(e, t("ledger_runs"))


@query(f"WITH {_BUILTIN}, {_EXTERNAL} SELECT * FROM ex")
def external_claims(t):
    return _flat(_claims(t), "n", "line", "providers")


@query(f"""WITH {_BUILTIN}, {_EXTERNAL}, j AS (SELECT coalesce(bc.a, ex.a) AS a, coalesce(bc.b, ex.b) AS b, coalesce(bc.rel, ex.rel) AS rel, bc.n AS nb, ex.n AS ne, bc.line AS lb, ex.line AS le FROM bc FULL OUTER JOIN ex ON bc.a IS NOT DISTINCT FROM ex.a AND bc.b = ex.b AND bc.rel = ex.rel),
w AS (SELECT *, max(CASE WHEN a IS NOT NULL THEN nb END) OVER (PARTITION BY a, b) AS ab, max(CASE WHEN a IS NOT NULL THEN ne END) OVER (PARTITION BY a, b) AS ae FROM j),
k AS (SELECT CASE WHEN nb IS NOT NULL AND ne IS NOT NULL THEN 'agreement' WHEN ab IS NOT NULL AND ae IS NOT NULL THEN 'relation_conflict' WHEN nb IS NOT NULL THEN 'builtin_only' ELSE 'external_only' END AS bucket, coalesce(nb, 0) AS nb, coalesce(ne, 0) AS ne, a IS NOT NULL AND coalesce(abs(lb - le) > 2, false) AS sc FROM w)
SELECT bucket, count(*) AS claims, cast(sum(nb) AS bigint) AS builtin_rows, cast(sum(ne) AS bigint) AS external_rows, count(*) FILTER (sc) AS span_conflicts FROM k GROUP BY 1""")
def cross_check_totals(t):
    return ledger.totals(ledger.reconciled(ledger.builtin_claims(t("edges"), _named(t)), _claims(t)))


@query("""SELECT evidence_id, CASE WHEN line_start % 2 = 1 AND NOT coalesce(line_end % 3 = 0, false) THEN 'builtin_verified' WHEN NOT coalesce(line_start % 2 = 1, false) AND line_end % 3 = 0 THEN 'external_verified' ELSE 'open' END AS adjudication FROM <ledger>""")
def span_adjudication(t):
    e = t("ledger").select("evidence_id", F.when(F.col("line_start") % 2 == 1, "VERIFIED").alias("builtin_ok"), F.when(F.col("line_end") % 3 == 0, "VERIFIED").alias("external_ok"))
    return ledger.adjudicated(e).select("evidence_id", "adjudication")


@query("SELECT provider, evidence_id, place, total, total > 20 AS truncated FROM (SELECT provider, evidence_id, cast(row_number() OVER (PARTITION BY provider ORDER BY evidence_id, run_id) AS int) AS place, count(*) OVER (PARTITION BY provider) AS total FROM <ledger>) WHERE place <= 20")
def bounded_samples(t):
    return ledger.sampled(t("ledger"), "provider", ["evidence_id", "run_id"], 20).select("provider", "evidence_id", "place", "total", "truncated")
