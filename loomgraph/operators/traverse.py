"""Bounded traversal, components, PageRank, label propagation.

Loops cut their lineage with written checkpoints, keep frontiers distinct before each join, and stop
early when a frontier is empty.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.joins import spans_met
from loomgraph.shared import cut, forget, hashed, numbered, written
from loomgraph.schemas import ANALYTICS_ROUNDS, DAMPING, IMPACT_RELATIONS
from loomgraph.sources.texts import is_test_path, is_test_symbol


def reach(edges: DataFrame, sources: DataFrame, depth: int | None) -> DataFrame:
    """source, id, depth: every node within depth directed steps (None: any number), at its least depth, the source at 0."""
    seen = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("depth")))
    frontier = seen
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        step = frontier.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("source", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, ["source", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def explore(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """Level by level in both directions, without defines: rows (depth, id, relation, via); rows to nodes seen
    before are still emitted, rows back to the root are not, and each node is expanded once."""
    e = edges.where("relation <> 'defines'")
    both = e.select(F.col("src").alias("at"), F.col("dst").alias("id"), "relation").unionByName(e.select(F.col("dst").alias("at"), F.col("src").alias("id"), F.concat(F.lit("used_by ("), "relation", F.lit(")")).alias("relation")))
    frontier = edges.sparkSession.createDataFrame([(root,)], "at string")
    seen, out = frontier.withColumnRenamed("at", "id"), None
    for d in range(1, depth + 1):
        rows = cut(both.join(frontier, "at").where(F.col("id") != root).select(F.lit(d).alias("depth"), "id", "relation", F.when(F.lit(d > 1), F.col("at")).alias("via")))
        out = rows if out is None else out.unionByName(rows)
        new = cut(rows.select("id").distinct().join(seen, "id", "left_anti"))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new.withColumnRenamed("id", "at")
    return out


def reverse_impact(edges: DataFrame, changed: DataFrame, depth: int, relations: tuple[str, ...] = IMPACT_RELATIONS) -> DataFrame:
    """id, depth, via: callers of the changed nodes at their least depth; via is the smallest callee of the level before."""
    e = edges.where(F.col("relation").isin(*relations)).select("src", "dst")
    seen = changed.select("id").distinct()
    frontier, out = seen, None
    for d in range(1, depth + 1):
        step = _callers(e, frontier)
        new = cut(step.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"), "via"))
        out = new if out is None else out.unionByName(new)
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new.select("id")), new.select("id")
    return out


def _callers(edges: DataFrame, of: DataFrame) -> DataFrame:
    return edges.join(of.select(F.col("id").alias("dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("via"))


#: Rows that a table may have to be broadcast.
FEW = 100_000


def _few(df: DataFrame, most: int) -> DataFrame:
    """df from files, to be broadcast if it has `most` rows or less."""
    held = written(df)
    return F.broadcast(held) if held.count() <= most else held


def impacted_tests(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, depth: int = 2, few: int = FEW) -> DataFrame:
    """id, path, symbol, kind, tier, target: changed test files, callers of changed nodes within depth that are tests,
    and tests with an edge of any relation into a changed node. A test has a row in each tier that finds it; target
    is the symbol it reaches, of several the smallest (caller tier: that of the smallest callee id of the level before).

    Edges meet the changed nodes once, for the first callers and the direct edges alike, and what is known of an id is brought
    together there. Of the last level only tests are looked for, so other edges are left out before they meet the level before.
    """
    met = _few(spans_met(hunks, nodes).select("path", F.col("ns").alias("line_start"), F.col("ne").alias("line_end"), F.lit(True).alias("hit")), few)
    test = F.coalesce(is_test_path(F.col("path")), F.lit(False)) | F.coalesce(is_test_symbol(F.col("symbol")), F.lit(False))
    marked = nodes.join(met, ["path", "line_start", "line_end"], "left").select("id", "path", "symbol", "kind", F.coalesce("hit", F.lit(False)).alias("changed"), test.alias("test"))
    marked = written(marked.where("changed or test"))
    tests = marked.where("test").select("id", "path", "symbol", "kind")
    e = edges.where(F.col("relation").isin(*IMPACT_RELATIONS)).select("src", "dst")

    into = edges.join(marked.where("changed").select(F.col("id").alias("dst"), F.when(F.col("symbol") != "", F.col("symbol")).alias("target")), "dst")
    into = into.select(F.col("src").alias("id"), "target", F.when(F.col("relation").isin(*IMPACT_RELATIONS), F.col("dst")).alias("via"), F.lit(False).alias("changed"), F.lit(False).alias("test"))
    known = into.unionByName(marked.select("id", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("via"), "changed", "test"))
    with hashed(edges.sparkSession):
        known = written(known.groupBy("id").agg(F.min("target").alias("target"), F.min("via").alias("via"), F.max("changed").alias("changed"), F.max("test").alias("test")))
    first = known.where("via is not null and not changed")

    callers, seen, frontier = [first.where("test").select("id", "via")], [known.where("changed or via is not null")], first
    for _ in range(2, depth):
        frontier = functools.reduce(lambda x, s: x.join(s.select("id"), "id", "left_anti"), seen, _callers(e, frontier))
        frontier = cut(frontier)
        callers.append(frontier)
        seen.append(frontier)
    if depth > 1:
        open_ = functools.reduce(lambda x, s: x.join(s.select("id"), "id", "left_anti"), seen[1:], known.where("test and not changed and via is null").select("id"))
        callers.append(_callers(e.join(_few(open_.withColumnRenamed("id", "src"), few), "src", "left_semi"), frontier))
    called = _few(tests.join(functools.reduce(DataFrame.unionByName, callers), "id"), few)

    files = hunks.select("path").distinct().where(is_test_path(F.col("path"))).select(F.concat(F.lit("test:"), "path").alias("id"), "path", F.lit("").alias("symbol"), F.lit("file").alias("kind"), F.lit("changed_file").alias("tier"), F.lit(None).cast("string").alias("target"))
    caller = nodes.select(F.col("id").alias("via"), F.col("symbol").alias("target")).join(called, "via").select(*tests.columns, F.lit("caller").alias("tier"), "target")
    direct = tests.join(known.where("target is not null").select("id", "target"), "id").distinct().select(*tests.columns, F.lit("direct_edge").alias("tier"), "target")
    return files.unionByName(caller).unionByName(direct)


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """id, blast: distinct nodes within hops undirected steps of each start, without itself. The walk is over numbers,
    since its pairs are many more than the names."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    numbers = written(numbered(names, ["name"], "n"))
    a, b = numbers.select(F.col("name").alias("src"), F.col("n").alias("a")), numbers.select(F.col("name").alias("dst"), F.col("n").alias("b"))
    pairs = edges.select("src", "dst").where("src <> dst").join(a, "src").join(b, "dst").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs)  # each once; both ways are made when they are read
    sides = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    found = cut(starts.select(F.col("id").alias("name")).distinct().join(numbers, "name", "left"))
    at = found.where("n is not null").select(F.col("n").alias("id"))
    got = _within_two(sides, at) if hops == 2 else reach(sides, at, hops).groupBy(F.col("source").alias("n")).agg((F.count(F.lit(1)) - 1).alias("blast"))
    got = cut(found.join(got, "n", "left").select(F.col("name").alias("id"), F.coalesce("blast", F.lit(0)).alias("blast")))
    for held in (numbers, pairs):
        forget(held)
    return got


#: Numbers of starts that one node may hold as one list, and that all nodes may hold on disk at once.
LIST, AT_ONCE = 1_000_000, 100_000_000


def _within_two(sides: DataFrame, starts: DataFrame, longest: int = LIST, most: int = AT_ONCE) -> DataFrame:
    """n, blast: how many nodes lie within two steps of each start (id), without itself; sides hold every edge both ways.

    It is counted from the other end: a node is reached by the starts beside it and beside its neighbours (its doors).
    Nodes with one door are only numbers at that door. Those with several bring together the doors' lists of starts, in
    as many turns as keep the lists of a turn under `most`, and only counts a start leave a turn. Where the lists of a
    node are longer than `longest`, its starts are rows.
    """
    beside = written(sides.join(starts.select(F.col("id").alias("src")), "src").select(F.col("src").alias("start"), F.col("dst").alias("door")))
    size = beside.groupBy("door").agg(F.count(F.lit(1)).alias("k"))
    ways = sides.select(F.col("src").alias("node"), F.col("dst").alias("door")).unionByName(beside.select(F.col("door").alias("node"), "door").distinct())
    ways = written(ways.join(size, "door"))
    each = ways.groupBy("node").agg(F.count(F.lit(1)).alias("doors"), F.sum("k").alias("all"), F.min("door").alias("door"))
    each = written(each)
    alone = each.where("doors = 1").groupBy("door").agg(F.count(F.lit(1)).alias("m"))
    parts = [cut(beside.join(alone, "door").groupBy("start").agg(F.sum("m").alias("m")))]
    lists = written(beside.join(size.where(F.col("k") <= longest).select("door"), "door", "left_semi").groupBy("door").agg(F.collect_list("start").alias("starts")))
    several = each.where("doors > 1")
    total, above = several.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum((F.col("all") > longest).cast("int")), F.lit(0))).first()  # one row
    turns = max(1, -(-int(total) // most))
    for turn in range(turns):
        here = several.where(F.pmod(F.xxhash64("node"), F.lit(turns)) == turn)
        few = ways.join(here.where(F.col("all") <= longest).select("node"), "node", "left_semi").select("node", "door").join(lists, "door")
        own = few.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")).select(F.explode("starts").alias("start"))
        if above:
            many = ways.join(here.where(F.col("all") > longest).select("node"), "node", "left_semi").select("node", "door").join(beside, "door").select("node", "start").distinct()
            own = own.unionByName(many.select("start"))
        parts.append(cut(own.groupBy("start").agg(F.count(F.lit(1)).alias("m"))))
    for held in (beside, ways, each, lists):
        forget(held)
    # a start reaches itself over any neighbour
    return functools.reduce(DataFrame.unionByName, parts).groupBy(F.col("start").alias("n")).agg((F.sum("m") - 1).alias("blast"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that undirected edges lead to. Labels spread along edges and along labels."""
    sides = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        spread = sides.join(labels.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "component").unionByName(labels)
        least = cut(spread.groupBy("id").agg(F.min("component").alias("component")))
        up = least.select(F.col("id").alias("component"), F.col("component").alias("higher"))
        new = cut(least.join(up, "component", "left").select("id", F.coalesce("higher", "component").alias("component")))
        same = new.join(labels.withColumnRenamed("component", "was"), "id").where("component <> was").isEmpty()
        labels = new
        if same:
            return labels


def pagerank(nodes: DataFrame, edges: DataFrame, restart: DataFrame | None = None, rounds: int = ANALYTICS_ROUNDS, damping: float = DAMPING) -> DataFrame:
    """id, rank after a fixed number of rounds; edge rows weigh once each, dangling rank is spread evenly.

    restart: id, weight of a personalised restart (normalised here). A node that no edge leads to has its own base times one
    number of the round and a second number, the same for all, so what such nodes give is summed once; only nodes that edges
    lead to are carried through the rounds, with a checkpoint every third.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    base, w = nodes.select("id", F.lit(1.0 / n).alias("base")), None
    if restart is not None:
        total = restart.agg(F.sum("weight").alias("total"))
        w = cut(restart.crossJoin(F.broadcast(total)).select("id", (F.col("weight") / F.col("total")).alias("w")))  # total is one row
        base = nodes.select("id").join(w, "id", "left").select("id", F.coalesce("w", F.lit(0.0)).alias("base"))
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    links = written(pairs.select("src", "dst", (F.col("k") / F.sum("k").over(Window.partitionBy("src"))).alias("share")))
    sources = written(links.select(F.col("src").alias("id")).distinct())
    soon = _rank_of_short_ways(base, w, links, sources, n, rounds, damping)
    if soon is not None:
        forget(links)
        forget(sources)
        return soon
    goes = sources.withColumn("ends", F.lit(False))
    met = links.select(F.col("dst").alias("id")).distinct().withColumn("met", F.lit(True))
    state = written(base.join(goes, "id", "left").join(met, "id", "left").select("id", "base", F.coalesce("ends", F.lit(True)).alias("ends"), F.coalesce("met", F.lit(False)).alias("met")))
    alone = state.where("not met")
    given = links.join(alone.select(F.col("id").alias("src"), "base"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("base")).alias("of_base"), F.sum("share").alias("of_each"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    core = written(state.where("met").join(given, "id", "left").select("id", "base", "ends", zero("of_base"), zero("of_each")))
    inner = written(links.join(core.select(F.col("id").alias("src")), "src", "left_semi"))
    loose_base, loose_each = alone.where("ends").agg(F.coalesce(F.sum("base"), F.lit(0.0)), F.count(F.lit(1))).first()  # one row
    # a node alone has the rank own * base + each
    own, each, ranks = 1.0, 0.0, core.withColumns({"rank": F.col("base"), "each": F.lit(0.0)})
    linked = not core.isEmpty()
    for k in range(rounds):
        if linked:
            got = inner.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
            now = ranks.agg(F.max("each").alias("each"), F.coalesce(F.sum(F.when(F.col("ends"), F.col("rank"))), F.lit(0.0)).alias("loose"))
            now = now.select("each", (damping * (F.col("loose") + own * loose_base + F.col("each") * loose_each) / n).alias("next"))
            got_all = F.coalesce("got", F.lit(0.0)) + own * F.col("of_base") + F.col("each") * F.col("of_each")
            rank = (1 - damping) * F.col("base") + F.col("next") + damping * got_all
            ranks = core.join(got, "id", "left").crossJoin(F.broadcast(now)).select(*core.columns, rank.alias("rank"), F.col("next").alias("each"))  # one row
            if k % 3 == 2 or k + 1 == rounds:
                ranks = cut(ranks)
        else:
            each = damping * (own * loose_base + each * loose_each) / n
        own = 1 - damping
    if linked:
        each = ranks.agg(F.max("each")).first()[0]
    for held in (links, inner, *([core] if rounds and linked else [])):
        forget(held)
    return ranks.select("id", "rank").unionByName(alone.select("id", (own * F.col("base") + each).alias("rank"))).select("id", F.round("rank", 8).alias("rank"))


#: Longer ways are left to the rounds; a restart of so many nodes or fewer is broadcast.
WAY, FEW = 6, 1000


def _rank_of_short_ways(base: DataFrame, w: DataFrame | None, links: DataFrame, sources: DataFrame, n: int, rounds: int, damping: float) -> DataFrame | None:
    """What pagerank() gives, if no way along the links is longer than WAY; else None.

    A round takes (1 - damping) of the base, an even part of what lies at dangling nodes, and damping of what the links bring.
    So after all rounds a rank is a sum over the lengths of ways: what base and an even spread bring along ways of j links, each
    times one number for all nodes. What goes on from j links is what arrives after j + 1, so the loose part of each round
    follows from the totals. The links are read once a length, however many rounds there are.
    """
    spread = links.groupBy(F.col("dst").alias("id")).agg((F.sum("share") / n).alias("u"))
    if w is None:
        wave = spread.withColumn("v", F.col("u"))
    else:
        begin = F.broadcast(w) if w.count() <= FEW else w
        own = links.join(begin.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("w")).alias("v"))
        wave = spread.join(own, "id", "left").select("id", "u", F.coalesce("v", F.lit(0.0)).alias("v"))
    waves, totals, left = [], [(1.0, 1.0 if w is None or not w.isEmpty() else 0.0)], None
    while len(waves) < rounds:
        waves.append(written(wave))
        totals.append(tuple(waves[-1].agg(F.coalesce(F.sum("u"), F.lit(0.0)), F.coalesce(F.sum("v"), F.lit(0.0))).first()))  # one row
        on = waves[-1].join(sources, "id", "left_semi")
        was, left = left, on.count()
        if not left:
            break
        if left == was or len(waves) == WAY < rounds:  # what does not get fewer has a cycle
            for held in waves:
                forget(held)
            return None
        wave = links.join(on.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("u")).alias("u"), F.sum(F.col("share") * F.col("v")).alias("v"))
    of = lambda j: totals[j] if j < len(totals) else (0.0, 0.0)
    loose_u, loose_v = ([of(j)[c] - of(j + 1)[c] for j in range(rounds)] for c in (0, 1))
    even = [0.0]  # by round: what is spread over all nodes
    for k in range(rounds):
        lies = damping**k * loose_v[k] + sum(damping**j * ((1 - damping) * loose_v[j] + even[k - j] * loose_u[j]) for j in range(k))
        even.append(damping * lies)
    parts = [x.select("id", (F.col("v") * (damping**j * (1 - damping if j < rounds else 1.0)) + F.col("u") * (damping**j * even[rounds - j])).alias("part")) for j, x in enumerate(waves, 1)]
    start = F.col("base") * (1 - damping if rounds else 1.0) + even[rounds] / n
    if not parts:
        return base.select("id", F.round(start, 8).alias("rank"))
    brought = functools.reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("part"))
    return base.join(brought, "id", "left").select("id", F.round(start + F.coalesce("part", F.lit(0.0)), 8).alias("rank"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community: synchronous rounds; the own label stays on a tie, else the smallest most frequent wins."""
    sides = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("community")))
    for _ in range(rounds):
        votes = sides.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.max("n").alias("most"), F.max_by(F.struct("community"), F.struct("n")).alias("any"))
        of = votes.join(best, "id").where("n = most").groupBy("id").agg(F.min("community").alias("least"), F.collect_set("community").alias("tied"))
        new = labels.join(of, "id", "left").select("id", F.when(F.col("least").isNull() | F.array_contains("tied", F.col("community")), F.col("community")).otherwise(F.col("least")).alias("community"))
        new = cut(new)
        same = new.join(labels.withColumnRenamed("community", "was"), "id").where("community <> was").isEmpty()
        labels = new
        if same:
            break
    return labels


def budget_prefix(rows: DataFrame, order: list, cost: str, budget: int) -> DataFrame:
    """The longest prefix in the given order whose running cost fits; rows are few (a ranked, capped list)."""
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(so_far)).where(F.col("used") <= budget)
