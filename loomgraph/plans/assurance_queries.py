"""Coverage, universe, gates and receipts over the journal of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import assurance as A
from loomgraph.operators import ledger
from loomgraph.plans.registry import query

_OUT = "regexp_matches(path, '(^|/)(node_modules|\\.venv|venv|dist|build|vendor|target)/') OR regexp_matches(string_split(path, '/')[-1], '_pb\\d|_pb\\d*_grpc|\\.min\\.|\\.generated\\.')"
_EXT = "regexp_extract(path, '\\.([^./]+)$', 1)"
_LANG = f"CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'tsx' THEN 'tsx' WHEN 'md' THEN 'markdown' ELSE 'unknown' END"
STATES = f"""st AS (SELECT path, {_LANG} AS language, CASE WHEN {_OUT} THEN 'excluded' WHEN dd IS NOT NULL AND NOT (dd = jd AND ds = js) THEN 'stale' WHEN parser_outcome IS NULL THEN 'parsed' WHEN parser_outcome IN ('COMPLETE', 'VALID_EMPTY') THEN 'indexed'
  WHEN parser_outcome = 'PARTIAL_AST' THEN 'partial' ELSE 'skipped' END AS state FROM (SELECT j.path, j.digest AS jd, j.size AS js, parser_outcome, d.digest AS dd, d.size AS ds FROM <files> j LEFT JOIN <files_on_disk> d ON d.path = j.path))"""
REPORT = """rp AS (SELECT count(*) AS files, count(*) FILTER (state <> 'excluded') AS in_scope, count(*) FILTER (state IN ('indexed', 'parsed')) AS covered, count(*) FILTER (state IN ('indexed', 'parsed')) / nullif(count(*) FILTER (state <> 'excluded'), 0) AS fraction, count(*) FILTER (state = 'skipped') AS failed FROM st)"""


def _states(t):
    return A.coverage(t("files"), t("files_on_disk"))


@query(f"WITH {STATES} SELECT path, state, language FROM st")
def coverage_states(t):
    return _states(t)


@query(f"SELECT path, {_OUT} AS excluded FROM <files_on_disk>")
def excluded_paths(t):
    return t("files_on_disk").select("path", A.is_excluded(F.col("path")).alias("excluded"))


@query(f"""WITH {STATES.replace('FROM <files> j LEFT JOIN', 'FROM sc LEFT JOIN <files> j ON j.path = sc.path LEFT JOIN').replace('SELECT j.path, j.digest', 'SELECT sc.path, j.path AS known, j.digest').replace("WHEN dd IS NOT NULL", "WHEN known IS NULL THEN 'unknown' WHEN dd IS NOT NULL").replace('st AS', "sc AS (SELECT path FROM <files_on_disk> WHERE size % 7 = 0), st AS", 1).replace('ON d.path = j.path', 'ON d.path = sc.path')} SELECT path, state, language FROM st""")
def coverage_of_scope(t):
    d = t("files_on_disk")
    return A.coverage(t("files"), d, d.where("size % 7 = 0"))


@query(f"WITH {STATES} SELECT state, count(*) AS files FROM st GROUP BY 1")
def coverage_totals(t):
    return A.coverage_totals(_states(t))


@query(f"WITH {STATES}, {REPORT} SELECT files, in_scope, covered, round(fraction, 9) AS fraction, failed AS parser_failed, 'parser-partial,parser-failed,generated,stale-content' AS gaps FROM rp")
def coverage_report(t):
    r = A.coverage_report(_states(t))
    return r.withColumns({"fraction": F.round("fraction", 9), "gaps": F.array_join("gaps", ",")})


@query(f"WITH {STATES}, {REPORT} SELECT round(greatest(0, fraction - 0.045), 6) AS callgraph, round(greatest(0, fraction - 0.045), 6) AS symbols, in_scope AS eligible, covered FROM rp")
def covered_fraction(t):
    r = A.coverage_report(_states(t))
    c = lambda k: F.round(A.completeness(F.col("fraction"), F.col("gaps"), k), 6)
    return r.select(c("callgraph").alias("callgraph"), c("symbols").alias("symbols"), F.col("in_scope").alias("eligible"), "covered")


UNIVERSE = f"""un AS (SELECT * FROM (SELECT path, parser_outcome, digest, CASE WHEN ({_OUT}) AND digest IS NOT NULL THEN 'excluded' WHEN ({_OUT}) THEN NULL WHEN digest IS NULL THEN 'missing' WHEN known THEN 'eligible' WHEN {_EXT} IN ('py', 'go', 'tsx', 'md', 'js') THEN 'unknown' END AS place
  FROM (SELECT coalesce(j.path, d.path) AS path, j.path IS NOT NULL AS known, parser_outcome, d.digest FROM <files> j FULL OUTER JOIN <files_on_disk> d ON d.path = j.path)) WHERE place IS NOT NULL),
uf AS (SELECT count(*) FILTER (place IN ('eligible', 'unknown')) AS eligible, count(*) FILTER (place = 'excluded') AS excluded, count(*) FILTER (place = 'unknown') AS unknown, count(*) FILTER (place = 'missing') AS missing,
  count(*) FILTER (place = 'eligible' AND parser_outcome NOT IN ('COMPLETE', 'VALID_EMPTY')) AS weak, count(*) FILTER (place = 'eligible' AND parser_outcome = 'PARTIAL_AST') AS part FROM un)"""


def _universe(t):
    return A.universe(t("files"), t("files_on_disk"))


@query(f"WITH {UNIVERSE} SELECT path, place FROM un")
def scope_universe(t):
    return _universe(t).select("path", "place")


@query(f"WITH {UNIVERSE} SELECT eligible, excluded, unknown, missing, cast(0 AS bigint) AS walk_errors, round((eligible - unknown) / eligible, 9) AS enumeration_fraction, unknown = 0 AS enumeration_complete, weak = 0 AS parser_capability_complete, part > 0 AS partial_ast_present FROM uf")
def universe_facts(t):
    return A.universe_facts(_universe(t)).withColumn("enumeration_fraction", F.round("enumeration_fraction", 9))


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY path) - 1 AS n, sha256(concat(path, chr(0), digest)) AS h FROM <files_on_disk>), a AS (SELECT n // 64 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM l GROUP BY n // 64),
b AS (SELECT n // 64 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM a GROUP BY n // 64), c AS (SELECT n // 64 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h FROM b GROUP BY n // 64),
x AS (SELECT 1 AS level, * FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 3, * FROM c), z AS (SELECT min(level) AS top FROM (SELECT level, count(*) AS k FROM x GROUP BY 1) WHERE k = 1) SELECT cast(level AS int) AS level, n AS node, h AS hash FROM x, z WHERE level <= top""")
def universe_tree(t):
    return A.hash_tree(t("files_on_disk"), ["path"], F.concat("path", F.lit("\0"), "digest"), 64)


_DYN = f"CASE WHEN {_EXT} = 'py' AND contains(content, 'getattr') THEN 'dynamic_reflection' WHEN {_EXT} = 'go' AND contains(content, 'reflect.TypeOf') THEN 'dynamic_reflection' WHEN {_EXT} = 'js' AND contains(content, 'import(') THEN 'dynamic_import' END"
MANIFEST = f"""mf AS (SELECT path, NOT known OR content IS NULL OR coalesce(parser_outcome IN ('PARSE_ERROR', 'PARSER_UNAVAILABLE'), false) AS quarantined, list_sort(list_filter([{_DYN}, CASE WHEN NOT known THEN 'unjournaled_file' END, CASE WHEN content IS NULL THEN 'missing_source' END], lambda z: z IS NOT NULL)) AS constructs
  FROM (SELECT coalesce(j.path, d.path) AS path, j.path IS NOT NULL AS known, parser_outcome, content FROM <files> j FULL OUTER JOIN <files_on_disk> d ON d.path = j.path) WHERE NOT ({_OUT}) AND (known OR {_EXT} IN ('py', 'go', 'tsx', 'md', 'js')))"""


def _manifest(t):
    return A.scope_manifest(t("files"), t("files_on_disk"))


@query(f"WITH {MANIFEST} SELECT path, quarantined, array_to_string(constructs, ',') AS constructs FROM mf")
def scope_manifest(t):
    return _manifest(t).select("path", "quarantined", F.array_join("constructs", ",").alias("constructs"))


@query(f"WITH {MANIFEST} SELECT path FROM <files> WHERE path IN (SELECT path FROM mf WHERE quarantined)")
def quarantined_files(t):
    return A.quarantined(t("files").select("path"), _manifest(t))


_TARGETS = "(SELECT id FROM <nodes> WHERE kind = 'class' AND line_start % 100 = 31)"


def _targets(t):
    return t("nodes").where("kind = 'class' and line_start % 100 = 31").select("id")


@query(f"""SELECT * FROM (SELECT e.dst AS target, relation, line, n.id, n.path, n.kind, n.symbol, cast(row_number() OVER (PARTITION BY e.dst ORDER BY n.path, n.symbol, n.id, relation) AS int) AS place FROM <edges> e JOIN <nodes> n ON n.id = e.src WHERE e.dst IN {_TARGETS}) WHERE place <= 20""")
def edges_of_targets(t):
    return A.edges_of(t("edges"), t("nodes"), _targets(t), "in", cap=20)


@query(f"SELECT t.id AS target, count(n.id) AS enumerated, least(count(n.id), 20) AS returned, 20 AS cap, count(n.id) > 20 AS truncated FROM {_TARGETS} t LEFT JOIN <edges> e ON e.dst = t.id LEFT JOIN <nodes> n ON n.id = e.src GROUP BY 1")
def edge_accounting(t):
    return A.edge_counts(t("edges"), t("nodes"), _targets(t), "in", cap=20)


@query("SELECT n_regionkey AS k, cast(sum(n_nationkey) AS bigint) AS enumerated, cast(sum(least(n_nationkey, 10)) AS bigint) AS returned, max(10) AS cap, bool_or(n_nationkey > 10) AS truncated FROM nation GROUP BY 1")
def merged_accounting(t):
    e = F.col("n_nationkey")
    return A.merged_counts(t("nation").select(F.col("n_regionkey").alias("k"), A.counted(e, F.least(e, F.lit(10)), F.lit(10)).alias("c")).select("k", "c.*"), "k")


@query("SELECT string_agg(DISTINCT concat(n_name, '_cap_10'), ',' ORDER BY concat(n_name, '_cap_10')) AS sources FROM nation WHERE n_nationkey > 10")
def truncation_sources(t):
    return A.truncation_sources(t("nation").select(F.col("n_name").alias("source"), F.lit(10).alias("cap"), (F.col("n_nationkey") > 10).alias("truncated"))).select(F.array_join("sources", ",").alias("sources"))


@query("""SELECT n_name AS key, cast(greatest(n_nationkey + 5, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 2 ELSE 0 END) AS int) AS enumerated, cast(CASE WHEN n_nationkey % 2 = 0 THEN least(n_nationkey, 8) ELSE n_nationkey END AS int) AS returned, n_nationkey % 3 = 0 OR (n_nationkey % 2 = 0 AND 8 < n_nationkey * 2) AS truncated FROM nation""")
def receipt_projection(t):
    n, k = t("nation"), F.col("n_nationkey")
    own = n.select(F.col("n_name").alias("key"), (k + 5).alias("enumerated"), k.alias("returned"), (k % 3 == 0).alias("truncated"))
    return A.projection(own, n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), (k * 2).alias("enumerated"), F.lit(8).alias("returned")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 4 IN (0, 1, 2) OR o_orderstatus = 'F' THEN 'audit' ELSE 'verify' END AS level, o_orderkey % 7 = 0 AS security_reviewer, NOT (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AS absence_assurance FROM orders""")
def change_risk(t):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "rename").when(k % 4 == 1, "delete").when(k % 4 == 2, "public-api").otherwise("local-body")
    r = A.change_risk(kind, F.when(F.col("o_orderstatus") == "F", "class").otherwise("method"), k % 7 == 0, k % 5 == 0)
    return t("orders").select("o_orderkey", r["level"].alias("level"), r["security_reviewer"].alias("security_reviewer"), r["absence_assurance"].alias("absence_assurance"))


@query("SELECT id, contains(lower(path), 'test') OR contains(lower(path), 'spec') OR starts_with(symbol, 'test_') AS test FROM <code>")
def test_names(t):
    return t("code").select("id", A.looks_like_test(F.col("path"), F.col("symbol")).alias("test"))


#: Nodes that live in journaled files: a part is a file of the journal.
_LIVE = "SELECT n.id, f.path, kind, n.symbol, n.symbol AS fqn FROM (SELECT *, row_number() OVER (ORDER BY id) AS r FROM <nodes> WHERE kind IN ('class', 'function')) n JOIN (SELECT path, row_number() OVER (ORDER BY path) AS r FROM <files>) f ON f.r = n.r"


def _live(t):
    from loomgraph.shared import numbered

    n = numbered(t("nodes").where("kind in ('class', 'function')").select("id", "kind", "symbol"), ["id"], "r")
    f = numbered(t("files").select("path"), ["path"], "r")
    return n.join(f, "r").select("id", "path", "kind", "symbol", F.col("symbol").alias("fqn"))


_ASK = [f"Customer#{k:09d}" for k in (1, 2, 3, 4, 5, 6, 7, 8)] + [f"Supplier#{k:09d}" for k in range(1, 9)] + ["small ring", "no such name"]
_ASKED = "q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _ASK) + "]) AS query)"
_WHO = f"lv AS ({_LIVE}), {_ASKED}, wh AS (SELECT query, count(id) AS n, CASE WHEN count(id) = 1 THEN min(id) END AS id FROM q LEFT JOIN lv ON symbol = query GROUP BY 1)"


def _asked(t):
    return t.spark.createDataFrame([(x,) for x in _ASK], "query string")


@query(f"""WITH {STATES}, {UNIVERSE}, {_WHO}, cl AS (SELECT e.dst, s.path FROM <edges> e JOIN lv s ON s.id = e.src WHERE relation IN ('calls', 'call_reference', 'usage')), tf AS (SELECT query, lv.path FROM wh JOIN lv ON lv.id = wh.id UNION SELECT query, cl.path FROM wh JOIN cl ON cl.dst = wh.id),
sc AS (SELECT query, count(*) FILTER (state IN ('indexed', 'parsed')) / nullif(count(*) FILTER (state IS DISTINCT FROM 'excluded'), 0) AS f FROM tf LEFT JOIN st ON st.path = tf.path GROUP BY 1)
SELECT wh.query, id, (SELECT count(*) FROM cl WHERE cl.dst = wh.id) AS callers_found, CASE WHEN id IS NOT NULL THEN round(f, 9) END AS scoped_coverage, id IS NULL OR ((SELECT count(*) FROM cl WHERE cl.dst = wh.id) = 0 AND NOT (coalesce(f = 1, false) AND (SELECT unknown = 0 AND weak = 0 FROM uf))) AS blocked
FROM wh LEFT JOIN sc ON sc.query = wh.query""")
def rename_gate(t):
    from loomgraph.operators.resolve import symbol_identity

    live = _live(t)
    who = symbol_identity(live, _asked(t)).select("query", "id")
    return A.rename_gate(who, live, t("edges"), _states(t), A.universe_facts(_universe(t))).withColumn("scoped_coverage", F.round("scoped_coverage", 9))


def _health(t):
    e = t("ledger")
    return ledger.health(t("ledger_runs"), ledger.union_evidence(e, t("ledger_runs"), "/a", e.where("line_start % 2 = 1"), limit=500))


_WALK = "rc AS (SELECT * FROM <edges> WHERE relation <> 'defines')"


@query(f"""WITH {STATES}, {MANIFEST}, {_WHO}, i AS (SELECT e.dst AS t, s.path, row_number() OVER (PARTITION BY e.dst ORDER BY s.path, symbol, s.id, relation) AS place FROM <edges> e JOIN lv s ON s.id = e.src WHERE e.dst IN (SELECT id FROM wh)),
o AS (SELECT e.src AS t, d.path, row_number() OVER (PARTITION BY e.src ORDER BY d.path, symbol, d.id, relation) AS place FROM <edges> e JOIN lv d ON d.id = e.dst WHERE e.src IN (SELECT id FROM wh)),
af AS (SELECT id AS t, path FROM lv WHERE id IN (SELECT id FROM wh) UNION SELECT t, path FROM i WHERE place <= 500 UNION SELECT t, path FROM o WHERE place <= 500),
ag AS (SELECT t, count(*) AS files, count(*) FILTER (contains(lower(af.path), 'test') OR contains(lower(af.path), 'spec')) AS tests, count(*) FILTER (state = 'stale') AS stale FROM af LEFT JOIN st ON st.path = af.path GROUP BY 1)
SELECT query, CASE n WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS identity, id, (SELECT count(*) FROM i WHERE i.t = wh.id) AS callers, (SELECT count(*) FROM o WHERE o.t = wh.id) AS callees, coalesce(files, 0) AS affected_files, coalesce(tests, 0) AS tests, coalesce(stale, 0) AS stale_files,
  CASE WHEN n <> 1 THEN 'ABSTAINED' ELSE 'other' END AS status FROM wh LEFT JOIN ag ON ag.t = wh.id""")
def scope_receipts(t):
    """The statuses of unique names are by pytest's decision tables."""
    r = A.scope_receipts(_asked(t), _live(t), t("edges"), t("files"), t("files_on_disk"), _health(t))
    return r.select("query", "identity", "id", "callers", "callees", "affected_files", "tests", "stale_files", F.when(F.col("status") == "ABSTAINED", F.col("status")).otherwise("other").alias("status"))


_CHANGED = "SELECT path FROM <files> WHERE size % 50 = 3"


@query(f"""WITH {MANIFEST}, ch AS ({_CHANGED}), ct AS (SELECT * FROM ch ORDER BY path LIMIT 200), x AS (SELECT count(*) AS n FROM ch), s AS (SELECT count(*) FILTER (NOT coalesce(j.digest = d.digest, false)) AS stale, bool_and(d.path IS NOT NULL) AS bound FROM ct LEFT JOIN <files> j ON j.path = ct.path LEFT JOIN <files_on_disk> d ON d.path = ct.path)
SELECT n AS changed_files, least(n, 200) AS measured_files, cast(0 AS bigint) AS invalidated, cast(0 AS bigint) AS dead_evidence, (SELECT count(DISTINCT path) FROM ch WHERE path LIKE '%.py') AS tests_to_run, stale AS stale_files, CASE WHEN bound AND stale = 0 THEN 'x' ELSE 'open' END AS closure FROM x, s""")
def diff_receipt(t):
    changed = t("files").where("size % 50 = 3").select("path")
    r = A.diff_receipt(changed, changed.where("path like '%.py'"), t("files"), t("files_on_disk"), t("ledger"), t("ledger_runs"), _health(t), "/a")
    return r.select("changed_files", "measured_files", "invalidated", "dead_evidence", "tests_to_run", "stale_files", "closure")


_PENDING = "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS resolution_state FROM lineitem"


def _pending(t):
    k = F.col("l_linenumber") % 3
    return t("lineitem").select(F.when(k == 0, "RESOLVED").when(k == 1, "AMBIGUOUS").otherwise("UNRESOLVED").alias("resolution_state"))


@query(f"""WITH {STATES}, {REPORT}, {MANIFEST}, k AS (SELECT count(*) FILTER (quarantined) AS q FROM mf), p AS (SELECT count(*) FILTER (parser_outcome IN ('PARSE_ERROR', 'PARSER_UNAVAILABLE')) AS f FROM <files>)
SELECT 'reconcile' AS kind, f + q + q + 2 AS failures, q AS quarantined, (SELECT count(*) FILTER (state = 'stale') FROM st) AS stale_files, (SELECT count(*) FROM ({_PENDING}) WHERE resolution_state <> 'RESOLVED') AS pending, round(fraction, 6) AS fraction, 'UNVERIFIABLE' AS status FROM rp, k, p""")
def reconcile_receipt(t):
    return A.index_receipt("reconcile", t("files"), t("files_on_disk"), _pending(t), _health(t), failed=2, conflicts=1).select("kind", "failures", "quarantined", "stale_files", "pending", "fraction", "status")


@query(f"""WITH {STATES}, {MANIFEST}, k AS (SELECT count(*) FILTER (quarantined) AS q FROM mf), p AS (SELECT count(*) FILTER (parser_outcome IN ('PARSE_ERROR', 'PARSER_UNAVAILABLE')) AS f FROM <files>)
SELECT 'audit' AS kind, f + q + q AS failures, q AS quarantined, (SELECT count(*) FILTER (state = 'stale') FROM st) AS stale_files, 'UNVERIFIABLE' AS status FROM k, p""")
def audit_receipt(t):
    return A.index_receipt("audit", t("files"), t("files_on_disk"), _pending(t), _health(t), problems=1).select("kind", "failures", "quarantined", "stale_files", "status")


@query("SELECT cast(sum(CASE WHEN n_name IN ('NATION_3') THEN n_nationkey ELSE 0 END) + 25 AS bigint) AS conflicts, cast(0 AS bigint) AS unresolved, cast(sum(n_nationkey) AS bigint) AS external_rows, 'CONFLICTED' AS status, 'open_conflicts' AS reasons FROM nation")
def cross_check_receipt(t):
    k = F.col("n_nationkey")
    rows = t("nation").select(F.when(F.col("n_name") == "NATION_3", "relation_conflict").otherwise("agreement").alias("bucket"), k.alias("claims"), F.lit(1).alias("span_conflicts"), k.alias("external_rows"))
    return A.cross_check_receipt(rows)


@query("SELECT max(generation) AS generation FROM <files>")
def journal_generation(t):
    return A.generation(t("files"))


@query("SELECT p_partkey, '1.0' AS schema_version, (SELECT max(generation) FROM <files>) AS snapshot_generation, 'COMPLETE_WITHIN_INDEX_CAPABILITY' AS completeness, (SELECT count(DISTINCT (provider, version, capability)) FROM <ledger_runs>) AS providers FROM part")
def response_envelope(t):
    tree = A.hash_tree(t("files"), ["path"], F.concat("path", F.lit(":"), "digest"))
    root = tree.groupBy().agg(F.max_by("hash", "level").alias("digest"))
    e = A.envelope(t("part").select("p_partkey", "p_name"), t("files"), ledger.active_providers(t("ledger_runs")), root, "GLOBAL_COMPLETE")
    return e.select(F.get_json_object("data", "$.p_partkey").cast("long").alias("p_partkey"), "schema_version", "snapshot_generation", "completeness", F.size("providers").cast("long").alias("providers"))


@query("""WITH x AS (SELECT n_nationkey, n_name, sum(length(concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '"}'))) OVER (ORDER BY n_nationkey) AS used FROM nation) SELECT n_nationkey, n_name, (SELECT count(*) FROM nation) AS enumerated FROM x WHERE used <= 500""")
def response_trim(t):
    return A.fits(t("nation").select("n_nationkey", "n_name"), ["n_nationkey"], 500)


@query("""WITH u AS (SELECT run_id, (SELECT count(*) FROM <ledger> e WHERE e.run_id = r.run_id) AS k FROM <ledger_runs> r WHERE created_at % 3 = 0) SELECT count(*) AS runs, cast(coalesce(sum(k), 0) AS bigint) AS evidence_rows FROM u""")
def ledger_receipt(t):
    runs = t("ledger_runs")
    e = t("ledger")
    rows = ledger.rows_for_runs(runs, e, runs.where("created_at % 3 = 0"))
    return A.ledger_receipt(rows, ledger.union_evidence(e, runs, "/a", e.where("line_start % 2 = 1"), limit=500)).select("runs", "evidence_rows")
