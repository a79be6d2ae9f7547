"""Verdict ladders, decisions and risk scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schemas import COVERAGE_FLOOR, STATUS_SEVERITY


def confidence(freshness: Column, relevance: Column, cov: Column) -> Column:
    """Confidence of a hit; a missing or zero coverage takes the default of its rule."""
    or_ = lambda x: F.when(F.coalesce(cov, F.lit(0.0)) == 0, x).otherwise(cov)
    fresh = freshness == "FRESH"
    return (
        F.when(fresh & (relevance == "EXACT_SPAN"), F.greatest(F.lit(0.95), F.coalesce(cov, F.lit(0.0))))
        .when(fresh & (relevance == "EXACT_SYMBOL"), F.greatest(F.lit(0.85), F.coalesce(cov, F.lit(0.0))))
        .when(fresh & (relevance == "DECLARATION"), F.greatest(F.lit(0.30), F.least(F.lit(0.45), F.coalesce(cov, F.lit(0.45)))))
        .when(fresh & (relevance == "FILE_TOKEN"), F.least(F.lit(0.35), or_(0.3)))
        .when(freshness == "STALE", F.least(F.lit(0.35), or_(0.5) / 2))
        .otherwise(F.least(F.lit(0.5), or_(0.4)))
    )


def verdict(freshness: Column, relevance: Column) -> Column:
    return (
        F.when(freshness == "REMOVED", "REMOVED").when(freshness == "STALE", "STALE").when(freshness == "UNKNOWN", "NOPATH")
        .when(relevance.isin("EXACT_SPAN", "EXACT_SYMBOL"), "STRONG").otherwise("WEAK")
    )


def decide(
    identity: Column, bound: Column, collection_error: Column, stale: Column, measured: Column, covered: Column, parser_failures: Column, unresolved: Column, conflicts: Column,
    truncated: Column, truncation_sources: Column, enumerated: Column, parser_capable: Column, partial_ast: Column, provider_ok: Column, absence: Column, gate_blocked: Column,
    dynamic: Column, profile: Column, floor: float = COVERAGE_FLOOR, budget: int = 0,
) -> Column:
    """status and reason_codes by all rules of the reference, in its order; a null fact counts against the claim."""
    yes, no = lambda c: F.coalesce(c, F.lit(True)), lambda c: F.coalesce(c, F.lit(False))
    above = lambda c, k: F.coalesce(c > k, F.lit(True))
    cut = F.transform(
        F.coalesce(truncation_sources, F.array().cast("array<string>")), lambda x: F.when(x == "transitive_cap_200", "transitive_truncated").otherwise(F.concat(F.lit("collection_truncated:"), x))
    )
    negative = yes(absence) | yes(profile.isin("absence", "exhaustive", "relation"))
    one = lambda c, code: F.array_compact(F.array(F.when(c, code)))
    unique = no(identity == "UNIQUE")
    rules = [
        ("UNVERIFIABLE", one(yes(collection_error), "collection_error")), ("ABSTAINED", one(~unique, F.when(identity == "NOT_FOUND", "target_not_found").otherwise("target_ambiguous"))),
        ("UNVERIFIABLE", one(~no(bound), "snapshot_unbound")), ("STALE", one(above(stale, 0), "stale_sources")), ("CONFLICTED", one(above(conflicts, 0), "open_conflicts")),
        ("PARTIAL", one(yes(gate_blocked), "rename_gate_blocked")), ("PARTIAL", F.when(F.size(cut) > 0, cut).otherwise(one(yes(truncated), "transitive_truncated"))),
        ("PARTIAL", one(above(parser_failures, 0), "parser_failures")), ("PARTIAL", one(above(unresolved, budget), "unresolved_over_budget")), ("PARTIAL", one(yes(dynamic), "dynamic_dispatch_unresolved")),
        ("PARTIAL", one(negative & ~(no(measured) & no(covered >= floor)), "coverage_below_floor")), ("PARTIAL", one(negative & ~no(enumerated), "enumeration_incomplete")),
        ("PARTIAL", one(negative & ~no(parser_capable), "parser_capability_incomplete")), ("PARTIAL", one(negative & yes(partial_ast), "partial_ast_ceiling")),
        ("PARTIAL", one(~no(provider_ok), "provider_capability_missing")),
    ]
    worst = F.greatest(*[F.when(F.size(c) > 0, STATUS_SEVERITY[status]).otherwise(0) for status, c in rules])
    status = F.when(worst == 0, "ASSURED_WITHIN_SCOPE").otherwise(_map({v: k for k, v in STATUS_SEVERITY.items()}, worst))
    return F.struct(status.alias("status"), F.concat(*[c for _, c in rules]).alias("reason_codes"))


def _map(values: dict, key: Column) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


#: Paths and files whose change is a risk by itself; fixed values.
CRITICAL = ("migration", "schema", "auth", "security", "crypto", "secret", "payment", "billing", "lock", "permission", "database", "alembic", "flyway")
CONFIG = ("package.json", "cargo.toml", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "dockerfile", "docker-compose.yml", "tsconfig.json")
BUSY = 5  # references that make a symbol a core one


def commit_risks(changes: DataFrame, touched: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """commit, files, churn, points, level, reasons of each commit by what it changes.

    changes: commit, path (null for a commit without files), insertions, deletions; touched: commit, symbol, place of the
    symbols in the changed files; references: symbol, n. Of a commit's first three symbols one with BUSY references counts.
    """
    low = F.lower("path")
    name = F.element_at(F.split(low, "/"), -1)
    c = changes.groupBy("commit").agg(
        F.count("path").alias("files"), F.sum(F.col("insertions") + F.col("deletions")).alias("churn"), F.count_if(F.rlike(low, F.lit("|".join(CRITICAL)))).alias("critical"), F.count_if(name.isin(*CONFIG)).alias("config")
    )
    if touched is not None and references is not None:
        busy = touched.where("place <= 3").join(references.where(F.col("n") >= BUSY), "symbol").select("commit").distinct().withColumn("core", F.lit(True))
        c = c.join(busy, "commit", "left")
    else:
        c = c.withColumn("core", F.lit(None).cast("boolean"))
    f, k = F.col("files"), F.col("churn")
    core = F.coalesce("core", F.lit(False))
    points = F.when(f > 15, 4).when(f > 5, 2).otherwise(0) + F.when(k > 800, 4).when(k > 250, 2).otherwise(0) + F.when(F.col("critical") > 0, 4).otherwise(0) + F.when(F.col("config") > 0, 2).otherwise(0) + F.when(core, 3).otherwise(0)
    why = F.array_compact(F.array(
        F.when(f > 15, "many_files").when(f > 5, "several_files"), F.when(k > 800, "massive_churn").when(k > 250, "moderate_churn"), F.when(F.col("critical") > 0, "critical_paths"), F.when(F.col("config") > 0, "config_files"), F.when(core, "core_symbol"),
    ))
    x = c.withColumn("points", points)
    level = F.when(F.col("points") >= 5, "HIGH").when(F.col("points") >= 2, "MEDIUM").otherwise("LOW")
    return x.select("commit", "files", "churn", "points", level.alias("level"), F.when(F.size(why) == 0, "small_change").otherwise(F.array_join(why, ",")).alias("reasons"))


def impact_summary(files: Column, nodes: Column, callers: Column, apis: Column) -> Column:
    """(score, level) of a change: capped weights of changed files, nodes in them, their callers and interfaces."""
    cap = lambda k, x, m: F.least(k * x, F.lit(m))
    score = cap(5, files, 25) + cap(8, nodes, 30) + cap(4, callers, 25) + cap(10, apis, 20)
    level = F.when((score >= 60) | (apis >= 3) | (callers >= 10), "HIGH").when((score >= 25) | (callers >= 3) | (apis >= 1), "MEDIUM").otherwise("LOW")
    return F.struct(score.alias("score"), level.alias("level"))
