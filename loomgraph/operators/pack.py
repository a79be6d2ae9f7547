"""Context for a reader with a budget: the map of a repository and the bundle around a symbol.

Ranks and neighbourhoods are found over the whole graph; what is then cut to a budget is a ranked, capped list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import search, traverse
from loomgraph.operators.resolve import find_target
from loomgraph.schemas import MAP_RELATIONS, MAP_ROUNDS
from loomgraph.shared import cut, forget, written

MAP_CAP = 400
HOPS, NODES, BYTES = 2, 50, 65536


def mapped(nodes: DataFrame) -> DataFrame:
    """Nodes that a map shows."""
    return nodes.where("kind not in ('file', 'note', 'markdown') and path <> ''")


def map_ranks(nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None, rounds: int = MAP_ROUNDS) -> DataFrame:
    """id, rank over the shown nodes and the ranked relations between them, without loops; focus (id) restarts there."""
    shown = written(mapped(nodes).select("id").distinct())
    e = edges.where(F.col("relation").isin(*MAP_RELATIONS) & (F.col("src") != F.col("dst"))).select("src", "dst")
    # written between: else the shuffle files of both ends lie there at once
    led = written(e.join(shown.select(F.col("id").alias("dst")), "dst", "left_semi"))
    e = led.join(shown.select(F.col("id").alias("src")), "src", "left_semi")
    start = None if focus is None else focus.join(shown, "id", "left_semi").select("id", F.lit(1.0).alias("weight"))
    if start is not None and start.isEmpty():
        start = None
    ranks = traverse.pagerank(shown, e, start, rounds)
    forget(led)
    return ranks


def repo_map(nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None, max_tokens: int = 1024, most: int = MAP_CAP) -> DataFrame:
    """place, id, path, symbol, kind, line, rank, tokens: the longest beginning of the ranked symbols whose rendered tree
    fits; focus symbols come first, and one symbol is always there.

    A tree names each file once and then its symbols: a symbol that opens a file costs both lines. The cost of a beginning
    is the sum of its lines, which is what its rendering costs, since a line ends where the next begins.
    """
    budget = max(16, min(int(max_tokens), 32_768))
    ranks = map_ranks(nodes, edges, focus)
    first = F.lit(1) if focus is None else F.when(F.col("focused"), 0).otherwise(1)
    x = ranks.join(nodes.select("id", "path", "symbol", "kind", "line_start"), "id")
    if focus is not None:
        x = x.join(focus.select("id").distinct().withColumn("focused", F.lit(True)), "id", "left").withColumn("focused", F.coalesce("focused", F.lit(False)))
    order = [first, F.desc("rank"), F.col("path"), F.col("symbol"), F.col("id")]
    top = x.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # capped
    opens = F.row_number().over(Window.partitionBy("path").orderBy("place")) == 1
    line = F.concat(F.lit("  "), "symbol", F.lit("\n"))
    cost = search.estimate_tokens(line) + F.when(opens, search.estimate_tokens(F.concat("path", F.lit(":\n")))).otherwise(0)
    used = F.sum("cost").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    top = top.withColumn("cost", cost).withColumn("tokens", used)
    return top.where((F.col("tokens") <= budget) | (F.col("place") == 1)).select("place", "id", "path", "symbol", "kind", F.col("line_start").alias("line"), "rank", "tokens")


def map_languages(found: DataFrame) -> DataFrame:
    """ext, percent of the shown symbols by file ending."""
    ext = F.regexp_extract("path", r"[^/.][^/]*\.([^./]+)$", 1)
    n = found.groupBy(F.when(ext == "", "other").otherwise(ext).alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("all")))).select("ext", F.round(100 * F.col("n") / F.col("all"), 1).alias("percent"))  # one row


def render_map(rows: list[tuple[str, int | None, str]]) -> str:
    """The tree of (path, line, symbol) rows, of which there are as many as the map shows."""
    out: list[str] = []
    for path in sorted({p for p, _, _ in rows}):
        out += [f"{path}:", *[f"  {s}" for p, _, s in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2])) if p == path]]
    return "\n".join(out)


def neighbours(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, direction, id, line around each target (id) by calls and inheritance."""
    e = edges.where("relation in ('calls', 'extends')")
    t = targets.select(F.col("id").alias("target"))
    into = e.join(t, F.col("dst") == F.col("target")).select("target", F.lit("in").alias("direction"), F.col("src").alias("id"), "line")
    return into.unionByName(e.join(t, F.col("src") == F.col("target")).select("target", F.lit("out").alias("direction"), F.col("dst").alias("id"), "line"))


def bundles(nodes: DataFrame, edges: DataFrame, targets: DataFrame, journal: DataFrame | None = None, disk: DataFrame | None = None, hops: int = HOPS, most: int = NODES, max_tokens: int | None = None) -> DataFrame:
    """target, role, place, id, line, verdict: callers and callees of each target (id) by line and id, then stubs of what these
    lead to, `most` in all; with max_tokens the longest beginning that fits, callers first.

    A neighbour whose file has changed is STALE, one whose file is not journaled UNKNOWN.
    """
    known = nodes.select("id", "path", "kind", "symbol")
    around = neighbours(edges, targets).where("id <> target")
    place = Window.partitionBy("target").orderBy(F.col("line").asc_nulls_first(), "id", "direction")
    near = around.join(known.select("id"), "id", "left_semi")
    # a node counts once, at its first line
    once = near.withColumn("k", F.row_number().over(Window.partitionBy("target", "id").orderBy(F.col("line").asc_nulls_first(), "direction"))).where("k = 1").drop("k")
    one = cut(once.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most))
    out = one.select("target", F.when(F.col("direction") == "in", "caller").otherwise("callee").alias("role"), "place", "id", "line")
    if hops >= 2:
        step = one.select("target", F.col("id").alias("via"), F.col("place").alias("first"))
        e = edges.where("relation in ('calls', 'extends')")
        ways = e.select(F.col("dst").alias("via"), F.col("src").alias("id"), "line").unionByName(e.select(F.col("src").alias("via"), F.col("dst").alias("id"), "line"))
        far = step.join(ways, "via").join(known.where("kind <> 'file'").select("id"), "id", "left_semi").where("id <> target")
        far = far.join(one.select("target", "id"), ["target", "id"], "left_anti")
        best = far.groupBy("target", "id").agg(F.min(F.struct("first", F.coalesce("line", F.lit(-1)).alias("line"), "id")).alias("o"))
        n = one.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
        stub = best.join(n, "target").withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("o")) + F.col("n")).where(F.col("place") <= most)
        out = out.unionByName(stub.select("target", F.lit("stub").alias("role"), "place", "id", F.lit(None).cast("int").alias("line")))
    out = out.join(known.select("id", "path", "symbol"), "id")
    if journal is not None and disk is not None:
        f = journal.select("path", "digest").join(disk.select("path", F.col("digest").alias("now")), "path", "left").select("path", F.when(F.col("digest") == F.col("now"), "STRONG").otherwise("STALE").alias("verdict"))
        out = out.join(f, "path", "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNKNOWN")))
    else:
        out = out.withColumn("verdict", F.lit("UNKNOWN"))
    if max_tokens is not None:
        cost = search.estimate_tokens(F.concat_ws(" ", "role", "symbol", "path")) + 1
        order = Window.partitionBy("target").orderBy(F.when(F.col("role") == "caller", 0).when(F.col("role") == "callee", 1).otherwise(2), "place").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("used", F.sum(cost).over(order)).where(F.col("used") <= max_tokens).drop("used")
    return out.select("target", "role", "place", "id", "line", "verdict")


def bundle_for(nodes: DataFrame, edges: DataFrame, asked: DataFrame, **more) -> DataFrame:
    """query, status and the bundle's rows of asked names; a name that is not found or ambiguous has its status alone."""
    t = cut(find_target(nodes, edges, asked))
    b = bundles(nodes, edges, t.where("id is not null").select("id").distinct(), **more)
    return t.select("query", "status", F.col("id").alias("target")).join(b, "target", "left")
