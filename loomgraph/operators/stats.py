"""Degree, hub, density and community statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.traverse import neighbourhood
from loomgraph.schemas import HUB_MIN_DEGREE, HUB_SIGMA
from loomgraph.shared import cut


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, total_degree; every edge row counts, a self edge twice.

    Both ends are counted in one aggregation, so a hub is summed map-side before the one shuffle.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    sums = ends.select("e.*").groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = F.lit(0)
    out = nodes.join(sums, "id", "left").select(*nodes.columns, F.coalesce("o", zero).alias("out_degree"), F.coalesce("i", zero).alias("in_degree"))
    return out.withColumn("total_degree", F.col("out_degree") + F.col("in_degree"))


def hubs(nodes: DataFrame, edges: DataFrame, sigma: float = HUB_SIGMA, least: int = HUB_MIN_DEGREE) -> DataFrame:
    """Nodes whose degree reaches max(least, mean + sigma deviations), with the z-score and the number of nodes within 2
    undirected steps; the tier is by degree or by that share of all nodes. Needs 3 nodes."""
    d = degrees(nodes.select("id", "kind"), edges)
    s = d.agg(F.avg("total_degree").alias("mean"), F.stddev_pop("total_degree").alias("dev"), F.count(F.lit(1)).alias("n"))
    enough = F.greatest(F.lit(float(least)), F.col("mean") + sigma * F.col("dev"))
    z = F.when(F.col("dev") > 0, F.round((F.col("total_degree") - F.col("mean")) / F.col("dev"), 2)).otherwise(0.0)
    found = cut(d.crossJoin(F.broadcast(s)).where((F.col("n") >= 3) & (F.col("total_degree") >= enough)))  # one row
    found = found.join(neighbourhood(edges, found.select("id"), 2), "id", "left").withColumn("blast_radius", F.coalesce("blast", F.lit(0)))
    reaches = lambda k, share: (F.col("total_degree") >= F.col("mean") + k * F.col("dev")) | (F.col("blast_radius") >= F.col("n") * share)
    tier = F.when(reaches(3, 0.3), "CRITICAL").when(reaches(2, 0.15), "HIGH").otherwise("MEDIUM")
    return found.select("id", "kind", "total_degree", z.alias("z_score"), "blast_radius", tier.alias("risk"))


def top_degree(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    return degrees(nodes.select("id"), edges).orderBy(F.desc("total_degree"), "id").limit(limit)


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("kind") == "file").alias("file_count"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    nodes_, edges_ = F.col("node_count"), F.col("edge_count")
    return n.crossJoin(F.broadcast(e)).select(
        "node_count", "edge_count", "file_count", (nodes_ - F.col("file_count")).alias("symbol_count"),
        F.when(nodes_ > 1, F.round(edges_ / (nodes_ * (nodes_ - 1)), 6)).otherwise(0.0).alias("density"),
        F.when(nodes_ > 0, F.round(2 * edges_ / nodes_, 2)).otherwise(0.0).alias("average_degree"),
    )


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: sum over communities of inner share minus squared half-degree share, 0 without edges. member: id, community.

    Each edge gives its two ends once, the first with whether it stays inside; the total is the one row that is joined.
    """
    a, b = member.select(F.col("id").alias("src"), F.col("community").alias("ca")), member.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    ends = edges.select("src", "dst").join(a, "src").join(b, "dst").select(F.explode(F.array(
        F.struct(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).cast("long").alias("inside")), F.struct(F.col("cb").alias("c"), F.lit(0).cast("long").alias("inside")),
    )).alias("e"))
    per = ends.select("e.*").groupBy("c").agg(F.sum("inside").alias("inside"), F.count(F.lit(1)).alias("degree"))
    sums = per.agg(F.sum("inside").alias("i"), F.sum("degree").alias("d"), F.sum(F.col("degree").cast("double") * F.col("degree")).alias("s"))
    m = F.col("d") / 2
    return sums.select(F.round(F.coalesce(F.col("i") / m - F.col("s") / (4 * m * m), F.lit(0.0)), 4).alias("modularity"))


def cohesion(edges: DataFrame, member: DataFrame) -> DataFrame:
    """community, inner, outer, cohesion of the out edges of each community (1 without edges)."""
    a, b = member.select(F.col("id").alias("src"), F.col("community").alias("ca")), member.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    of = edges.join(a, "src").join(b, "dst", "left").groupBy(F.col("ca").alias("community")).agg(
        F.count_if(F.col("ca") == F.col("cb")).alias("inner_edges"), F.count_if(~F.col("ca").eqNullSafe(F.col("cb"))).alias("outer_edges")
    )
    every = member.select("community").distinct().join(of, "community", "left").fillna(0, ["inner_edges", "outer_edges"])
    total = F.col("inner_edges") + F.col("outer_edges")
    return every.withColumn("cohesion", F.when(total == 0, 1.0).otherwise(F.round(F.col("inner_edges") / total, 3)))


def counts(journal: DataFrame, nodes: DataFrame, edges: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: paths, nodes, edges, references, ambiguous and unresolved ones."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    state = F.col("resolution_state")
    p = pending.agg(F.count(F.lit(1)).alias("pending"), F.count_if(state == "AMBIGUOUS").alias("pending_ambiguous"), F.count_if(state == "UNRESOLVED").alias("pending_unresolved"))
    return one(journal, "paths").crossJoin(one(nodes, "nodes")).crossJoin(one(edges, "edges")).crossJoin(p)  # single rows


def integrity(journal: DataFrame, nodes: DataFrame, pending: DataFrame, indexed: DataFrame) -> DataFrame:
    """what, n: nodes without a journaled file (notes have none), how far the text index (id) is from the nodes, references by
    state and by relation."""
    note = (F.col("kind") == "note") | F.startswith("id", F.lit("note:"))
    lost = nodes.where(~note).join(journal.select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphaned_nodes").alias("what"), "n")
    gap = nodes.agg(F.count(F.lit(1)).alias("a")).crossJoin(indexed.agg(F.count(F.lit(1)).alias("b"))).select(F.lit("index_gap").alias("what"), F.abs(F.col("a") - F.col("b")).alias("n"))  # single rows
    g = pending.groupingSets([[F.col("resolution_state")], [F.col("relation")]], "resolution_state", "relation").agg(F.count(F.lit(1)).alias("n"), F.grouping("resolution_state").alias("g"))
    open_ = g.select(F.when(F.col("g") == 0, F.concat(F.lit("pending_state:"), "resolution_state")).otherwise(F.concat(F.lit("pending_relation:"), "relation")).alias("what"), "n")
    return lost.unionByName(gap).unionByName(open_)
