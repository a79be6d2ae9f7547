"""Communities, cycles and the figures of a whole graph.

Loops run on written checkpoints; what a round needs of the whole graph is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import stats
from loomgraph.schemas import ANALYTICS_ROUNDS
from loomgraph.shared import cut, numbered

MOVES = 2  # a node may move in one of so many rounds, so that neighbours do not swap for ever
MAX_CYCLES = 100
IN_ONE_TASK = 200_000  # edges; what is left of a graph is searched in one task from there on


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = ANALYTICS_ROUNDS, seed: int = 42) -> DataFrame:
    """id, community (the smallest id of the community) by one level of local moving.

    In each round a seeded share of the nodes joins the neighbouring community with the greatest gain in modularity,
    k_in - total k / 2m, if that is above zero and above staying; of equal ones the smallest. Rounds end when none of
    MOVES rounds in a row moves a node, or with a round that would lower modularity.
    """
    pairs = edges.select("src", "dst")
    sides = pairs.where("src <> dst").unionByName(pairs.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    sides = sides.unionByName(pairs.where("src = dst")).unionByName(pairs.where("src = dst"))  # a loop counts twice
    links = cut(sides.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    degree = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    labels = cut(nodes.select("id").distinct().join(degree, "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("id").alias("community")))
    two_m = degree.agg(F.sum("k")).first()[0]
    if not two_m:
        return labels.select("id", "community")
    best, still = _quality(links, labels, two_m), 0
    for r in range(rounds):
        totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
        around = links.where("src <> dst").join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("inside"))
        moving = labels.where((F.pmod(F.xxhash64(F.lit(seed), F.lit(r // MOVES), "id"), F.lit(MOVES)) == r % MOVES) & (F.col("k") > 0)).withColumnRenamed("community", "own")
        offers = around.join(moving, "id").join(totals, "community")
        # the node's own weight does not count where it stands
        total = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        offers = offers.withColumn("gain", F.col("inside") - total * F.col("k") / two_m)
        stay = offers.where("community = own").select("id", F.col("gain").alias("stay"))
        top = offers.where("community <> own").groupBy("id").agg(F.min(F.struct((-F.round("gain", 9)).alias("g"), "community")).alias("t"))
        bare = totals.select(F.col("community").alias("own"), F.col("total").alias("own_total"))
        x = top.join(stay, "id", "left").join(moving.select("id", "own", "k"), "id").join(bare, "own")
        keep = F.coalesce("stay", -(F.col("own_total") - F.col("k")) * F.col("k") / two_m)
        moved = cut(x.where((-F.col("t.g") > 0) & (-F.col("t.g") > F.round(keep, 9))).select("id", F.col("t.community").alias("to")))
        if moved.isEmpty():
            still += 1
            if still == MOVES:
                break
            continue
        new = cut(labels.join(moved, "id", "left").select("id", "k", F.coalesce("to", "community").alias("community")))
        quality = _quality(links, new, two_m)
        if quality < best - 1e-12:
            still += 1  # moves made at once can undo each other; the next share of nodes tries
            if still == MOVES:
                break
            continue
        labels, best, still = new, quality, 0
    name = labels.groupBy("community").agg(F.min("id").alias("least"))
    return labels.join(name, "community").select("id", F.col("least").alias("community"))


def _quality(links: DataFrame, labels: DataFrame, two_m: float) -> float:
    """Modularity of a partition."""
    inside = links.join(labels.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    e = inside.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0))).first()[0] or 0.0
    t = labels.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return e / two_m - t / two_m**2


def path_prefix(nodes: DataFrame) -> DataFrame:
    """One row, prefix: the folders that all paths with a folder begin with.

    The least and the greatest list of folders have what all have.
    """
    parts = F.split(F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "/+$", ""), "/")
    x = nodes.select(parts.alias("p")).where(F.size("p") > 1).agg(F.min("p").alias("a"), F.max("p").alias("b"), F.min(F.size("p")).alias("n"))
    upto = F.sequence(F.lit(1), F.coalesce(F.col("n"), F.lit(1)))
    same = F.filter(upto, lambda k: F.slice("a", 1, k) == F.slice("b", 1, k))
    # the whole of the first path is a file, not a folder
    depth = F.least(F.coalesce(F.array_max(same), F.lit(0)), F.size("a") - 1)
    return x.select(F.when(F.col("a").isNull(), "").otherwise(F.array_join(F.slice("a", 1, F.greatest(depth, F.lit(0))), "/")).alias("prefix"))


def community_labels(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """community, label: the most frequent folder under the common one, and the most frequent kind; ties by name."""
    prefix = F.broadcast(path_prefix(nodes))  # one row
    x = member.join(nodes.select("id", "path", "kind"), "id").crossJoin(prefix)
    rest = F.when((F.col("prefix") != "") & F.startswith("path", F.col("prefix")), F.substr("path", F.length("prefix") + 1)).otherwise(F.col("path"))
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(rest, F.lit("")), r"\\", "/"), "/"), lambda p: p != "")
    folder = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).when(F.size(parts) == 1, F.get(parts, F.lit(0)))
    x = x.select("community", folder.alias("folder"), "kind")

    def most(column: str) -> DataFrame:
        n = x.where(f"{column} is not null and {column} <> ''").groupBy("community", column).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("m"), column)).alias("t")).select("community", F.col(f"t.{column}").alias(column))

    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    y = sizes.join(most("folder"), "community", "left").join(most("kind"), "community", "left")
    kind = F.coalesce("kind", F.lit("module"))
    named = F.concat("folder", F.lit(" ("), F.upper(F.substring(kind, 1, 1)), F.lower(F.substr(kind, F.lit(2))), F.lit("s)"))
    return y.select("community", F.when(F.col("folder").isNull(), F.concat(F.lit("Cluster ("), F.col("size").cast("string"), F.lit(" nodes)"))).otherwise(named).alias("label"))


def communities(nodes: DataFrame, edges: DataFrame, member: DataFrame, least: int = 1) -> DataFrame:
    """community_id, label, cohesion_score, inner, outer, node_count, first_node of a membership (id, community): largest
    first, equally large ones by falling first node; nodes of communities below the least size are one last community."""
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    large = sizes.where(F.col("n") >= least)
    of = member.join(large.select("community"), "community", "left_semi").select("id", "community")
    small = member.join(large.select("community"), "community", "left_anti").select("id", F.lit("￿").alias("community"))
    every = cut(of.unionByName(small))
    figures = stats.cohesion(edges, every).join(community_labels(nodes, every), "community")
    n = every.groupBy("community").agg(F.count(F.lit(1)).alias("node_count"), F.min("id").alias("first_node"))
    x = figures.join(n, "community")
    order = [F.when(F.col("community") == "￿", 1).otherwise(0), F.desc("node_count"), F.desc("first_node")]
    x = numbered(x.select("label", F.col("cohesion").alias("cohesion_score"), "inner_edges", "outer_edges", "node_count", "first_node", "community"), order, "community_id")
    return x.withColumn("community_id", F.col("community_id").cast("int")).withColumnRenamed("community", "key")


def saved_communities(found: DataFrame, member: DataFrame) -> DataFrame:
    """community_id, label, cohesion_score, node_count, nodes_json as a store keeps them. A community is one row there, so
    its list of nodes is one value; member: id, community."""
    lists = member.groupBy(F.col("community").alias("key")).agg(F.to_json(F.sort_array(F.collect_list("id"))).alias("nodes_json"))
    return found.join(lists, "key").select("community_id", "label", "cohesion_score", "node_count", "nodes_json")


def read_communities(saved: DataFrame) -> DataFrame:
    """The stored rows with their nodes as a list, largest first."""
    return saved.select("community_id", "label", "cohesion_score", "node_count", F.from_json("nodes_json", "array<string>").alias("nodes")).orderBy(F.desc("node_count"), "community_id")


def graph_profile(nodes: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: counts, density, average and greatest degree, isolated nodes, communities, modularity."""
    d = stats.degrees(nodes.select("id"), edges).agg(F.max("total_degree").alias("max_degree"), F.count_if(F.col("total_degree") == 0).alias("isolated_nodes"))
    c = member.agg(F.count_distinct("community").alias("community_count"))
    return stats.graph_metrics(nodes, edges).crossJoin(d).crossJoin(c).crossJoin(stats.modularity(edges, member))  # single rows


def suggestions(profile: DataFrame, hubs: DataFrame, found: DataFrame) -> DataFrame:
    """place, text: what to look at first, by rules on the greatest hub, the first loose community and isolated nodes."""
    hub = hubs.orderBy(F.desc("total_degree"), F.desc("blast_radius"), "id").limit(1).select(
        F.lit(1).alias("place"), F.concat(F.lit("Review central bottleneck '"), "id", F.lit("' ("), F.col("total_degree").cast("string"), F.lit(" connections, blast radius "), F.col("blast_radius").cast("string"), F.lit(" nodes) before major refactors.")).alias("text")
    )
    loose = found.where("cohesion_score < 0.4 and node_count >= 3").orderBy("community_id").limit(1).select(
        F.lit(2).alias("place"), F.concat(F.lit("Cluster '"), "label", F.lit("' has low cohesion ("), F.format_string("%.2f", "cohesion_score"), F.lit(") - consider modularizing tightly coupled cross-cutting symbols.")).alias("text")
    )
    alone = profile.where("isolated_nodes > 0").select(F.lit(3).alias("place"), F.concat(F.col("isolated_nodes").cast("string"), F.lit(" isolated node(s) detected without active call/import relationships.")).alias("text"))
    some = hub.unionByName(loose).unionByName(alone)
    fine = some.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(4).alias("place"), F.lit("Architecture structure is well-balanced with clean module boundaries.").alias("text"))
    return some.unionByName(fine)


def cross_community(edges: DataFrame, member: DataFrame, samples: int = 3) -> DataFrame:
    """Edges from one community to another by ordered pair: weight and the first samples."""
    a, b = member.select(F.col("id").alias("src"), F.col("community").alias("from_community")), member.select(F.col("id").alias("dst"), F.col("community").alias("to_community"))
    x = edges.join(a, "src").join(b, "dst").where("from_community <> to_community")
    pair = ["from_community", "to_community"]
    weight = x.groupBy(*pair).agg(F.count(F.lit(1)).alias("weight"))
    first = x.withColumn("n", F.row_number().over(Window.partitionBy(*pair).orderBy("src", "dst", "relation"))).where(F.col("n") <= samples)
    return first.join(weight, pair).select(*pair, "n", "src", "dst", "relation", "weight")


def _parts_in_one_task(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of the strongly connected parts of several nodes, by Tarjan's search."""
    kind = edges.schema["src"].dataType.simpleString()
    one = edges.select("src").limit(0).toArrow().schema.field(0).type
    like = pa.schema([("id", one), ("component", one)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: dict = {}
        for b in batches:
            for x, y in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
                ahead.setdefault(x, []).append(y)
        index, low, stack, held, ids, parts = {}, {}, [], set(), [], []
        for root in ahead:
            if root in index:
                continue
            index[root] = low[root] = len(index)
            stack.append(root)
            held.add(root)
            way = [(root, iter(ahead[root]))]
            while way:
                v, to = way[-1]
                w = next(to, None)
                if w is not None:
                    if w not in index:
                        index[w] = low[w] = len(index)
                        stack.append(w)
                        held.add(w)
                        way.append((w, iter(ahead.get(w, ()))))
                    elif w in held:
                        low[v] = min(low[v], index[w])
                    continue
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[v])
                if low[v] == index[v]:
                    part = [stack.pop()]
                    while part[-1] != v:
                        part.append(stack.pop())
                    held.difference_update(part)
                    if len(part) > 1:
                        ids += part
                        parts += [min(part)] * len(part)
        yield pa.RecordBatch.from_pydict({"id": ids, "component": parts}, schema=like)

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, f"id {kind}, component {kind}")


def _cycles_in_one_task(inner: DataFrame) -> DataFrame:
    """component, place, id as in cycles() of the edges (component, src, dst) of all parts."""
    kind = inner.schema["src"].dataType.simpleString()
    one = inner.select("src").limit(0).toArrow().schema.field(0).type
    like = pa.schema([("component", one), ("place", pa.int32()), ("id", one)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        for b in batches:
            for c, x, y in zip(*(b.column(k).to_pylist() for k in ("component", "src", "dst")), strict=True):
                parts.setdefault(c, {}).setdefault(x, set()).add(y)
        rows: dict = {"component": [], "place": [], "id": []}
        for c, ahead in parts.items():
            before, frontier = {c: None}, [c]
            while frontier:
                last = min((x for x in frontier if c in ahead.get(x, ())), default=None)
                if last is not None:
                    way = [last]
                    while before[way[-1]] is not None:
                        way.append(before[way[-1]])
                    rows["component"] += [c] * len(way)
                    rows["place"] += range(len(way))
                    rows["id"] += way[::-1]
                    break
                new: dict = {}
                for x in frontier:
                    for y in ahead.get(x, ()):
                        if y not in before:
                            new[y] = min(new.get(y, x), x)
                before |= new
                frontier = list(new)
        yield pa.RecordBatch.from_pydict(rows, schema=like)

    return inner.select("component", "src", "dst").coalesce(1).mapInArrow(run, f"component {kind}, place int, id {kind}")


def components_of_cycles(nodes: DataFrame, edges: DataFrame, alone: int = IN_ONE_TASK) -> DataFrame:
    """id, component: the strongly connected parts that hold a cycle, named by their smallest id.

    Nodes without a way in or out go first, round by round. Then the smallest id spreads forward until nothing
    changes; a node that its own id reaches again backward inside its colour is in the part of that colour. Parts are
    taken out and the rest starts anew, so rounds grow with how parts hang together, not with the nodes. As soon as `alone`
    edges or fewer are left, one task searches them: a long way to a cycle would be a round a step.
    """
    rest = cut(edges.select("src", "dst").distinct())
    out = cut(rest.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component")))
    rest = cut(rest.where("src <> dst"))
    found = None
    while True:
        while True:  # trim
            n = rest.count()
            if n <= alone:
                break
            rest = cut(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if rest.count() == n:
                break
        if n <= alone:
            if n:
                few = cut(_parts_in_one_task(rest))
                found = few if found is None else found.unionByName(few)
            break
        colour = cut(rest.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            ahead = rest.join(colour.select(F.col("id").alias("src"), "c"), "src").select(F.col("dst").alias("id"), "c").unionByName(colour)
            new = cut(ahead.groupBy("id").agg(F.min("c").alias("c")))
            same = new.join(colour.withColumnRenamed("c", "was"), "id").where("c <> was").isEmpty()
            colour = new
            if same:
                break
        back = cut(rest.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select("src", "dst"))
        seen = cut(colour.where("id = c").select("id", F.col("c").alias("component")))
        frontier = seen
        while True:
            step = back.join(frontier.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "component").distinct()
            frontier = cut(step.join(seen, "id", "left_anti"))
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier))
        found = seen if found is None else cut(found.unionByName(seen))
        gone = seen.select("id")
        rest = cut(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    if found is None:
        return out
    many = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")
    parts = found.join(many, "component").select("id", F.col("least").alias("component"))
    return parts.unionByName(out.join(parts.select("id"), "id", "left_anti"))


def cycles(nodes: DataFrame, edges: DataFrame, most: int = MAX_CYCLES, alone: int = IN_ONE_TASK) -> DataFrame:
    """component, place, id: a shortest cycle through the smallest node of each strongly connected part, `most` of them by
    name. Ways are found level by level for all parts at once, by one task if they have `alone` edges or fewer; of several
    ways back the smallest ids count."""
    parts = components_of_cycles(nodes, edges, alone)
    parts = cut(parts.join(parts.select("component").distinct().orderBy("component").limit(most), "component", "left_semi"))
    inner = edges.select("src", "dst").distinct().join(parts.select(F.col("id").alias("src"), "component"), "src").join(parts.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2")
    inner = cut(inner.select("component", "src", "dst"))
    if inner.count() <= alone:
        return _cycles_in_one_task(inner)
    seen = cut(parts.where("id = component").select("component", "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("before")))
    frontier, ends, depth = seen, None, 0
    while not frontier.isEmpty():
        depth += 1
        step = inner.join(frontier.select("component", F.col("id").alias("src")), ["component", "src"])
        closed = cut(step.where("dst = component").groupBy("component").agg(F.min("src").alias("last")).withColumn("length", F.lit(depth)))
        ends = closed if ends is None else cut(ends.unionByName(closed))
        new = step.where("dst <> component").groupBy("component", F.col("dst").alias("id")).agg(F.min("src").alias("before"))
        new = new.join(seen.select("component", "id"), ["component", "id"], "left_anti").join(ends.select("component"), "component", "left_anti")
        frontier = cut(new.select("component", "id", F.lit(depth).alias("depth"), "before"))
        seen = cut(seen.unionByName(frontier))
    way = cut(ends.select("component", F.col("last").alias("id"), (F.col("length") - 1).alias("place")))
    out = way
    while True:
        way = cut(way.where("place > 0").join(seen, ["component", "id"]).select("component", F.col("before").alias("id"), (F.col("place") - 1).alias("place")))
        if way.isEmpty():
            return out.select("component", "place", "id")
        out = cut(out.unionByName(way))


def analyse(nodes: DataFrame, edges: DataFrame, member: DataFrame | None = None, least: int = 1) -> dict[str, DataFrame]:
    """All analytics of a graph by name."""
    member = cut(louvain(nodes, edges) if member is None else member)
    found = cut(communities(nodes, edges, member, least))
    profile, hubs = cut(graph_profile(nodes, edges, member)), cut(stats.hubs(nodes, edges))
    return {"member": member, "communities": found, "metrics": profile, "hubs": hubs, "surprising": cross_community(edges, member), "suggestions": suggestions(profile, hubs, found)}
