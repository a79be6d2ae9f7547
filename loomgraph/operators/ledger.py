"""Evidence ledger: appending, invalidating, superseding, purging, union verdicts, cross-check.

Tables are folders that are rewritten whole, so every upkeep is a function from tables to tables. A row dies
once: the first reason stays. Times are epoch seconds and given by the caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import identity as names
from loomgraph.schemas import KEEP_RUNS, KEEP_SNAPSHOTS, SPAN_TOLERANCE, UNION_LIMIT
from loomgraph.shared import cut

DEFAULT_PROVIDER = ("builtin", "1.0.0", "STATIC_AST")


class DuplicateId(ValueError):
    """A row of that id is there already."""


def _slashes(path: str) -> Column:
    return F.regexp_replace(F.col(path), r"\\", "/")


def _new_ids(old: DataFrame, rows: DataFrame, key: str) -> None:
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    hit = rows.join(old.select(key), key, "left_semi").select(key).unionByName(twice).limit(1).collect()  # one row
    if hit:
        raise DuplicateId(str(hit[0][0]))


def append_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs with new ones; an id is used once for ever."""
    _new_ids(runs, new, "run_id")
    return runs.unionByName(new)


def filled_evidence(rows: DataFrame) -> DataFrame:
    """Evidence with each of the pairs of aliases (path and file_path, symbol and src, target and dst) filled from the other."""
    alike = [("path", "file_path"), ("symbol", "src"), ("target", "dst")]
    both = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    return rows.withColumns({c: both(c, o) for a, b in alike for c, o in ((a, b), (b, a))})


def append_evidence(evidence: DataFrame, new: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """evidence with the rows of a run, which supersede older live rows of their provider, project and path."""
    _new_ids(evidence, new, "evidence_id")
    return superseded_by_run(evidence.unionByName(filled_evidence(new)), runs, new.select("run_id").distinct(), now)


def superseded_by_run(evidence: DataFrame, runs: DataFrame, fresh: DataFrame, now: int) -> DataFrame:
    """Live rows of another run on a (provider, project, path) that a fresh run has rows on are dead from now."""
    project = runs.select("run_id", "project")
    rows = evidence.join(project, "run_id", "left")
    keys = rows.join(fresh, "run_id", "left_semi").where("path <> ''").select("provider", "project", "path", F.col("run_id").alias("by")).groupBy("provider", "project", "path").agg(F.collect_set("by").alias("by"))
    hit = F.col("by").isNotNull() & ~F.array_contains("by", F.col("run_id")) & F.col("invalidated_at").isNull()
    out = rows.join(keys, ["provider", "project", "path"], "left").withColumn("dies", F.coalesce(hit, F.lit(False)))
    return _killed(out, "dies", now, F.concat(F.lit("superseded_by_run:"), F.array_min("by"))).select(*evidence.columns)


def _killed(rows: DataFrame, flag: str, now: int, reason: Column) -> DataFrame:
    return rows.withColumns({
        "invalidation_reason": F.when(F.col(flag), reason).otherwise(F.col("invalidation_reason")), "invalidated_at": F.when(F.col(flag), F.lit(now)).otherwise(F.col("invalidated_at")),
    })


def stale_on_paths(evidence: DataFrame, paths: DataFrame, reason: str, now: int) -> DataFrame:
    """Live rows on changed paths (either alias, either kind of slash) are dead from now."""
    changed = paths.select(_slashes("path").alias("p")).distinct().withColumn("hit", F.lit(True))
    x = evidence.withColumns({"p1": _slashes("path"), "p2": _slashes("file_path")})
    x = x.join(changed.select(F.col("p").alias("p1"), F.col("hit").alias("h1")), "p1", "left").join(changed.select(F.col("p").alias("p2"), F.col("hit").alias("h2")), "p2", "left")
    x = x.withColumn("dies", F.col("invalidated_at").isNull() & (F.coalesce("h1", F.lit(False)) | F.coalesce("h2", F.lit(False))))
    return _killed(x, "dies", now, F.lit(reason)).select(*evidence.columns)


def invalidated(evidence: DataFrame, ids: DataFrame, reason: str, now: int) -> DataFrame:
    """Rows by id are dead from now; done twice it changes nothing."""
    x = evidence.join(ids.select("evidence_id").distinct().withColumn("asked", F.lit(True)), "evidence_id", "left")
    x = x.withColumn("dies", F.col("invalidated_at").isNull() & F.coalesce("asked", F.lit(False)))
    return _killed(x, "dies", now, F.lit(reason)).select(*evidence.columns)


def without_run(runs: DataFrame, evidence: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, evidence) without some runs and all they brought."""
    return runs.join(gone.select("run_id"), "run_id", "left_anti"), evidence.join(gone.select("run_id"), "run_id", "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the newest by the order columns."""
    rest = [c for c in old.columns if c not in keys]
    best = old.unionByName(new.select(*old.columns)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*old.columns)


def recorded(runs: DataFrame, bindings: DataFrame, evidence: DataFrame, run: DataFrame, binding: DataFrame | None, rows: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, bindings, evidence) after one outcome of a provider; the caller publishes the three as one snapshot."""
    all_runs = append_runs(runs, run)
    return all_runs, bindings if binding is None else upserted(bindings, binding, ["repo", "provider"], ["updated_at"]), append_evidence(evidence, rows, all_runs, now)


def purged(runs: DataFrame, snapshots: DataFrame, keep_runs: int = KEEP_RUNS, keep_snapshots: int = KEEP_SNAPSHOTS) -> tuple[DataFrame, DataFrame]:
    """(runs, snapshots) that stay: the newest runs of each provider; the newest snapshots of each root, and those that a
    staying run names."""
    kept = keep_newest(runs, keep_runs)
    place = Window.partitionBy("root").orderBy(F.desc("captured_at"), F.desc("snapshot_id"))
    named = kept.select("snapshot_id").distinct().withColumn("named", F.lit(True))
    x = snapshots.withColumn("n", F.row_number().over(place)).join(named, "snapshot_id", "left")
    return kept, x.where((F.col("n") <= keep_snapshots) | F.col("named")).select(*snapshots.columns)


def supersede(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Evidence with superseded_by: the latest run of its provider on its source, if that is a later one."""
    dated = evidence.join(runs.select("run_id", "created_at"), "run_id")
    latest = dated.groupBy("provider", "src").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("latest_run"))
    out = dated.join(latest, ["provider", "src"])
    return out.select("evidence_id", "provider", "src", "run_id", F.when(F.col("latest_run") != F.col("run_id"), F.col("latest_run")).alias("superseded_by"))


def find_evidence(evidence: DataFrame, limit: int = 1000, provider: str | None = None, **equal: str) -> DataFrame:
    """Rows that meet all given conditions, newest first, then by id."""
    wanted = [F.col(c) == v for c, v in equal.items() if v is not None] + ([F.col("provider") == provider] if provider else [])
    return filled_evidence(evidence.where(reduce(lambda a, b: a & b, wanted, F.lit(True)))).orderBy(F.desc("created_at"), "evidence_id").limit(limit)


def all_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "run_id")


def active_providers(runs: DataFrame) -> DataFrame:
    """Distinct provider, version, capability; the graph's own where there is none."""
    found = runs.select("provider", "version", "capability").distinct()
    own = runs.sparkSession.createDataFrame([DEFAULT_PROVIDER], "provider string, version string, capability string")
    return found.unionByName(own.crossJoin(found.agg(F.count(F.lit(1)).alias("n"))).where("n = 0").drop("n"))  # single rows


def rows_for_runs(runs: DataFrame, evidence: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked runs with how many evidence rows each has (0 for none)."""
    n = evidence.join(asked.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("evidence_rows"))
    return runs.join(asked.select("run_id").distinct(), "run_id", "left_semi").join(n, "run_id", "left").withColumn("evidence_rows", F.coalesce("evidence_rows", F.lit(0)))


def union_verdicts(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """One row an identity (src, dst, relation, snapshot) over runs that ended well: providers, spans, verdict."""
    ok = evidence.join(runs.where("status = 'ok'").select("run_id"), "run_id", "left_semi")
    groups = ok.groupBy(F.lower("src").alias("src"), F.lower("dst").alias("dst"), F.upper("relation").alias("relation"), "snapshot").agg(
        F.count_distinct("provider").alias("providers"), F.count_distinct("span_line").alias("spans"), F.min("span_line").alias("first_span")
    )
    verdict = F.when(F.col("snapshot").isNull(), "UNBOUND").when(F.col("spans") > 1, "CONFLICT").when(F.col("spans") == 1, "SUPPORTED").otherwise("UNVERIFIED")
    return groups.withColumn("verdict", verdict)


def union_evidence(evidence: DataFrame, runs: DataFrame, project: str, verified: DataFrame, snapshot: str | None = None, limit: int = UNION_LIMIT) -> DataFrame:
    """One row an identity (path and its language, relation, src, dst, snapshot) over live evidence of good runs of a project:
    providers, conflict, status.

    verified: path, src, line_start, line_end whose span the source proves. No snapshot or path is UNBOUND. Several spans
    are a CONFLICT, source_verified if just one is proved (the conflict stays noted); one span is SUPPORTED if proved. Of
    more rows than the limit the first count, in order, and one row more says that some were cut.
    """
    live = evidence.where("invalidated_at is null").join(runs.where((F.col("status") == "ok") & (F.col("project") == project)).select("run_id"), "run_id", "left_semi")
    if snapshot is not None:
        live = live.where(F.col("snapshot") == snapshot)
    order = ["path", "relation", "src", "dst", "line_start", "line_end", "run_id", "evidence_id"]
    taken = live.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(limit)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    proof = verified.select("path", F.lower("src").alias("src"), "line_start", "line_end").distinct().withColumn("proved", F.lit(True))
    keyed = taken.select(
        F.regexp_replace(blank("path"), r"\\", "/").alias("path"), names.language_of(F.col("path")).alias("language"), blank("relation").alias("relation"), F.lower(blank("src")).alias("src"),
        F.lower(blank("dst")).alias("dst"), blank("snapshot").alias("snapshot"), "provider", "line_start", "line_end",
    )
    keys = ["path", "language", "relation", "src", "dst", "snapshot"]
    spans = keyed.groupBy(*keys, "line_start", "line_end").agg(F.collect_set("provider").alias("ps"))
    spans = spans.join(proof, (spans["path"] == proof["path"]) & (spans["src"] == proof["src"]) & spans["line_start"].eqNullSafe(proof["line_start"]) & spans["line_end"].eqNullSafe(proof["line_end"]), "left").select(*[spans[c] for c in (*keys, "line_start", "line_end", "ps")], "proved")
    known = F.col("line_start").isNotNull() | F.col("line_end").isNotNull()
    g = spans.groupBy(*keys).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))), ",").alias("providers"), F.count_if(known).alias("n"), F.count_if(known & F.col("proved")).alias("ok"))
    unbound = (F.col("snapshot") == "") | (F.col("path") == "")
    status = (
        F.when(unbound, "UNBOUND").when((F.col("n") > 1) & (F.col("ok") == 1), "source_verified").when(F.col("n") > 1, "CONFLICT").when((F.col("n") == 1) & (F.col("ok") == 1), "SUPPORTED").otherwise("UNVERIFIED")
    )
    out = g.select(*keys, "providers", (~unbound & (F.col("n") > 1)).alias("conflict"), status.alias("status"))
    more = live.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    note = more.select(*[F.lit("").alias(c) for c in keys], F.lit("").alias("providers"), F.lit(True).alias("conflict"), F.lit("UNVERIFIED").alias("status"))
    return out.unionByName(note)


def keep_newest(runs: DataFrame, keep: int = KEEP_RUNS) -> DataFrame:
    """The newest runs of each provider."""
    newest = Window.partitionBy("provider").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= keep).drop("n")


def latest_status(runs: DataFrame) -> DataFrame:
    """The latest status of each provider and capability."""
    return runs.groupBy("provider", "capability").agg(F.max_by("status", F.struct("created_at", "run_id")).alias("status"), F.max("created_at").alias("created_at"))


def health(runs: DataFrame, union: DataFrame, newest: int = 200) -> DataFrame:
    """One row: of the newest runs, how many count, whether any latest status is bad; entries, conflicts and unresolved ones
    of a union; and whether the providers can be relied on."""
    recent = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(newest)
    r = latest_status(recent).agg(F.coalesce(F.bool_or(F.col("status") != "ok"), F.lit(False)).alias("failed"))
    n = runs.agg(F.count(F.lit(1)).alias("enumerated"))
    u = union.agg(F.count_if(F.col("path") != "").alias("entries"), F.count_if("conflict").alias("open_conflicts"), F.count_if(F.col("status") != "SUPPORTED").alias("unresolved"), F.count_if((F.col("path") == "") & (F.col("src") == "") & F.col("conflict")).alias("errors"))
    x = n.crossJoin(r).crossJoin(u)  # single rows
    return x.select("enumerated", F.least("enumerated", F.lit(newest)).alias("returned"), (F.col("enumerated") > newest).alias("truncated"), "entries", "open_conflicts", "unresolved", (~F.col("failed") & (F.col("errors") == 0)).alias("provider_ok"))


def builtin_claims(edges: DataFrame, nodes: DataFrame, repo: str = "") -> DataFrame:
    """a, b (join keys), relation, n, line: what the graph claims. A definition has no first end; an edge whose ends are no
    nodes has null keys."""
    one = names.builtin_identity(F.col("path"), F.col("fqn"), F.col("symbol"), F.col("kind"), F.col("line_start"), F.col("line_end"), F.lit(repo))
    of = nodes.select("id", one.alias("i"), F.col("line_start").alias("at")).select("id", names.join_key(F.col("i")).alias("k"), "at")
    x = edges.join(of.select(F.col("id").alias("src"), F.col("k").alias("a"), "at"), "src", "left").join(of.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst", "left")
    x = x.withColumn("relation", names.canonical_relation(F.col("relation")))
    defines = F.col("relation").isin("DEFINES", "DEFINITION")
    resolved = F.col("b").isNotNull() & (defines | F.col("a").isNotNull())
    x = x.select(F.when(resolved & ~defines, F.col("a")).alias("a"), F.when(resolved, F.col("b")).alias("b"), "relation", F.when(~defines, F.col("at")).alias("at"))
    return x.groupBy("a", "b", "relation").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("line"))


def external_claims(evidence: DataFrame, runs: DataFrame, repo: str = "", root: str | None = None, provider: str | None = None) -> DataFrame:
    """a, b, relation, n, line, providers: what live evidence claims; rows without a target claim nothing, unless they define."""
    live = evidence.where("invalidated_at is null").join(runs.select("run_id"), "run_id", "left_semi")
    if provider:
        live = live.where(F.col("provider") == provider)
    at = lambda symbol: names.evidence_identity(F.col("provider"), F.col(symbol), F.col("path"), F.lit(None).cast("string"), F.col("line_start"), F.col("line_end"), F.lit(repo), root)
    x = live.withColumn("relation", names.canonical_relation(F.col("relation")))
    defines = F.col("relation").isin("DEFINES", "DEFINITION")
    source, target = F.coalesce(F.nullif("src", F.lit("")), "symbol"), F.coalesce("dst", "target")
    x = x.where(defines | target.isNotNull()).withColumns({"source": source, "goal": target, "defines": defines})
    x = x.withColumns({"si": at("source"), "ti": at("goal")}).select("provider", "relation", "defines", names.join_key(F.col("si")).alias("s"), names.join_key(F.col("ti")).alias("t"), "line_start")
    resolved = F.col("s").isNotNull() & (F.col("defines") | F.col("t").isNotNull())
    x = x.select("provider", "relation", F.when(resolved & ~F.col("defines"), F.col("s")).alias("a"), F.when(resolved, F.when(F.col("defines"), F.col("s")).otherwise(F.col("t"))).alias("b"), "line_start")
    return x.groupBy("a", "b", "relation").agg(F.count(F.lit(1)).alias("n"), F.min("line_start").alias("line"), F.array_join(F.sort_array(F.collect_set("provider")), ",").alias("providers"))


def reconciled(builtin: DataFrame, external: DataFrame, tolerance: int = SPAN_TOLERANCE) -> DataFrame:
    """a, b, relation, bucket, spans: agreement, relation_conflict, builtin_only, external_only or unresolved; an agreement
    whose first lines lie apart is noted as a span conflict too."""
    builtin, external = cut(builtin), cut(external)  # each is read twice
    b, e = builtin.where("b is not null"), external.where("b is not null")
    same = (F.col("x.a").eqNullSafe(F.col("y.a"))) & (F.col("x.b") == F.col("y.b")) & (F.col("x.relation") == F.col("y.relation"))
    both = b.alias("x").join(e.alias("y"), same, "full_outer").select(
        F.coalesce("x.a", "y.a").alias("a"), F.coalesce("x.b", "y.b").alias("b"), F.coalesce("x.relation", "y.relation").alias("relation"), F.col("x.n").alias("nb"), F.col("y.n").alias("ne"), F.col("x.line").alias("lb"), F.col("y.line").alias("le")
    )
    pair = Window.partitionBy("a", "b")
    edge = F.col("a").isNotNull()
    both = both.withColumns({"any_b": F.max(F.when(edge, F.col("nb"))).over(pair), "any_e": F.max(F.when(edge, F.col("ne"))).over(pair)})
    bucket = F.when(F.col("nb").isNotNull() & F.col("ne").isNotNull(), "agreement").when(F.col("any_b").isNotNull() & F.col("any_e").isNotNull(), "relation_conflict").when(F.col("nb").isNotNull(), "builtin_only").otherwise("external_only")
    apart = edge & F.col("nb").isNotNull() & F.col("ne").isNotNull() & names.span_conflict(F.col("lb"), F.col("le"), tolerance)
    out = both.select("a", "b", "relation", bucket.alias("bucket"), apart.alias("span_conflict"), F.coalesce("nb", F.lit(0)).alias("builtin_count"), F.coalesce("ne", F.lit(0)).alias("external_count"))
    lost = lambda side, x, kb, ke: x.where("b is null").select("a", "b", "relation", F.lit(side).alias("bucket"), F.lit(False).alias("span_conflict"), kb.alias("builtin_count"), ke.alias("external_count"))
    zero = F.lit(0).cast("long")
    return out.unionByName(lost("unresolved_builtin", builtin, F.col("n"), zero)).unionByName(lost("unresolved_external", external, zero, F.col("n")))


def totals(found: DataFrame) -> DataFrame:
    """bucket, claims, rows on either side: the exact figures beside bounded samples."""
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("claims"), F.sum("builtin_count").alias("builtin_rows"), F.sum("external_count").alias("external_rows"), F.count_if("span_conflict").alias("span_conflicts"))


def cross_check(builtin: DataFrame, external: DataFrame, tolerance: int = SPAN_TOLERANCE) -> DataFrame:
    """src, dst, relation, bucket of every claim on either side.

    builtin: src, dst, relation, line; external: src, dst, relation, line. Equal claims agree, unless their
    lines differ by more than the tolerance; claims of a pair that the other side relates otherwise are
    relation conflicts. An unknown line never conflicts.
    """
    keys = ["src", "dst", "relation"]
    b = builtin.groupBy(*keys).agg(F.min("line").alias("bl"), F.lit(True).alias("b"))
    e = external.groupBy(*keys).agg(F.min("line").alias("el"), F.lit(True).alias("e"))
    both = b.join(e, keys, "full_outer")
    pair = Window.partitionBy("src", "dst")
    both = both.withColumns({"any_b": F.max(F.col("b")).over(pair), "any_e": F.max(F.col("e")).over(pair)})
    apart = F.coalesce(F.abs(F.col("bl") - F.col("el")) > tolerance, F.lit(False))
    bucket = (
        F.when(F.col("b") & F.col("e"), F.when(apart, "span_conflict").otherwise("agreement")).when(F.col("any_b") & F.col("any_e"), "relation_conflict")
        .when(F.col("b"), "builtin_only").otherwise("external_only")
    )
    return both.select(*keys, bucket.alias("bucket"))


def adjudicated(conflicts: DataFrame) -> DataFrame:
    """conflicts with which span the source proves: builtin_verified, external_verified or open; builtin_ok and external_ok
    are the verification statuses of the two."""
    b, e = F.coalesce(F.col("builtin_ok") == "VERIFIED", F.lit(False)), F.coalesce(F.col("external_ok") == "VERIFIED", F.lit(False))
    return conflicts.withColumn("adjudication", F.when(b & ~e, "builtin_verified").when(e & ~b, "external_verified").otherwise("open"))


def sampled(rows: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """The first rows of each group, with how many there are and whether some were cut."""
    place = Window.partitionBy(group).orderBy(*order)
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit).join(n, group).withColumn("truncated", F.col("total") > limit)
