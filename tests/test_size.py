"""What must not grow with repeated rows, with rounds, or with names that files hold in few bytes."""

import random
import threading
import time

from pyspark.sql import functions as F

from loomgraph.operators import community, export, joins, pack, traverse
from loomgraph.plans import registry
from loomgraph.plans.registry import Tables
from loomgraph.shared import MOST_BYTES, cut, hashed, sized
from loomgraph.sources import fixtures


def test_equal_spans_and_changes_are_compared_once(spark):
    n = 200_000  # pair by pair 4e10 comparisons
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("p").alias("path"), F.lit(5).alias("line_start"), F.lit(9).alias("line_end"))
    hunks = spark.range(n).select(F.col("id").alias("event_id"), F.lit("p").alias("path"), F.lit(7).alias("line_start"), (7 + F.col("id") % 2).cast("int").alias("line_end"))
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = joins.hunks_to_nodes(hunks, nodes).agg(F.count(F.lit(1)), F.min("hits"), F.max("hits"), F.min("first_line"), F.max("last_line")).first()
    finally:
        stop.cancel()
    assert tuple(got) == (n, n, n, 7, 8)


def test_names_in_small_files_are_not_broadcast(spark, tmp_path):
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    place = str(tmp_path / "nodes_of_this_test.parquet")
    spark.range(2_000_000).select(F.concat(F.lit("ord:"), "id").alias("id")).write.option("compression", "zstd").parquet(place)
    nodes = Tables(spark, str(tmp_path))("nodes_of_this_test")
    edges = spark.range(10).select(F.concat(F.lit("ord:"), "id").alias("src"), F.concat(F.lit("ord:"), F.col("id") + 1).alias("dst"))
    assert "Broadcast" not in joins.orphan_edges(nodes, edges)._jdf.queryExecution().executedPlan().toString()


def test_checkpoints_keep_no_endless_estimates(spark):
    x = cut(spark.range(10).withColumn("s", F.lit("a")))
    for _ in range(8):
        x = cut(x.join(x.withColumnRenamed("s", "t"), "id").join(x.withColumnRenamed("s", "u"), "id").select("id", "s"))
        assert x._jdf.queryExecution().analyzed().stats().sizeInBytes() < 2 * MOST_BYTES
    assert x.count() == 10


def test_long_ways_to_a_cycle_are_no_rounds(spark):
    # a tail of 3000 steps into a cycle of 1000
    e = spark.range(4000).select(F.format_string("n%04d", "id").alias("src"), F.format_string("n%04d", F.when(F.col("id") == 3999, 3000).otherwise(F.col("id") + 1)).alias("dst"))
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = community.cycles(e.select(F.col("src").alias("id")), e).collect()
    finally:
        stop.cancel()
    assert sorted((r.place, r.id) for r in got) == [(k, f"n{3000 + k}") for k in range(1000)] and {r.component for r in got} == {"n3000"}


def test_one_task_finds_what_rounds_find(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)] + [("a", "a"), ("b", "c"), ("c", "b")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    n = e.select(F.col("src").alias("id")).distinct()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(community.components_of_cycles(n, e)) == rows(community.components_of_cycles(n, e, alone=0))
    assert rows(community.cycles(n, e)) == rows(community.cycles(n, e, alone=0))


def test_edges_by_number_are_the_edges(spark, tmp_path):
    """Repeated pairs, missing ends, and two kinds of file that define what has no name."""
    spark.sql("SELECT * FROM VALUES (1L, 2L, 3L, 4), (1L, 2L, 3L, 2), (1L, 2L, 5L, 7), (NULL, 2L, NULL, 1), (NULL, 2L, NULL, 3) t(l_orderkey, l_partkey, l_suppkey, l_linenumber)").createOrReplaceTempView("lineitem")
    spark.sql("SELECT * FROM VALUES (1L, 8L), (1L, 8L), (2L, NULL) t(o_orderkey, o_custkey)").createOrReplaceTempView("orders")
    spark.sql("SELECT * FROM VALUES (8L, 4), (8L, 4), (NULL, 4) t(c_custkey, c_nationkey)").createOrReplaceTempView("customer")
    spark.sql("SELECT * FROM VALUES (3L, 4), (NULL, 4) t(s_suppkey, s_nationkey)").createOrReplaceTempView("supplier")
    rows = lambda text: sorted(map(str, spark.sql(text).collect()))
    assert rows(fixtures.EDGES_BY_NUMBER) == rows(fixtures.EDGES)


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    sized(spark)
    left = lambda: sum(1 for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_"))
    before = left()
    held = cut(spark.range(100_000).groupBy((F.col("id") % 5000).alias("k")).count())
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.2)
    assert left() <= before and held.count() == 5000


def test_two_steps_by_doors_are_two_steps(spark):
    """Whatever the lists and turns are; a checkpoint of all pairs is no longer made."""
    r = random.Random(5)
    near: dict[int, set[int]] = {}
    for _ in range(70):
        a, b = r.randrange(60), r.randrange(60)
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    starts = [k for k in sorted(near) if k % 2]
    want = {k: len(near[k].union(*[near[x] for x in near[k]]) - {k}) for k in starts}
    sides = spark.createDataFrame([(a, b) for a in near for b in near[a]], "src long, dst long")
    ids = spark.createDataFrame([(k,) for k in starts], "id long")
    for longest, most in ((10**6, 10**8), (3, 10**8), (3, 20), (10**6, 15)):
        assert dict(map(tuple, traverse._within_two(sides, ids, longest, most).collect())) == want


def test_reconcile_writes_its_tables_in_compressed_files(spark, monkeypatch):
    from loomgraph.operators import reconcile
    from loomgraph.plans import catalog

    held, written = [], reconcile.written
    monkeypatch.setattr(reconcile, "written", lambda df: held.append(written(df)) or held[-1])
    assert catalog.QUERIES["reconcile_counts"](spark, "/root/testdata/sf0.001").count() == 1
    assert len(held) >= 8 and all(f.endswith(".zstd.parquet") for df in held for f in df.inputFiles())


def test_nodes_that_no_edge_leads_to_are_not_carried(spark, monkeypatch):
    """Ranks as by plain rounds, with and without a restart; checkpoints hold only what edges lead to."""
    rows, cut_ = [], traverse.cut

    def seen(df):
        rows.append(df.count())
        return cut_(df)

    monkeypatch.setattr(traverse, "cut", seen)
    pairs = [(f"o{k}", f"c{k % 3}") for k in range(300)] + [("c0", "c1"), ("c1", "x"), ("x", "c0"), ("o1", "c1"), ("o1", "c1")]
    ids = sorted({i for p in pairs for i in p} | {f"alone{k}" for k in range(40)})
    nodes, edges = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string")
    for start in (None, {"o1": 1.0, "alone3": 2.0, "c0": 1.0}):
        base = {i: 1 / len(ids) if start is None else start.get(i, 0) / 4 for i in ids}
        rank, out = dict(base), {i: sum(s == i for s, _ in pairs) for i in ids}
        for _ in range(7):
            loose = sum(v for i, v in rank.items() if not out[i])
            new = {i: 0.15 * base[i] + 0.85 * loose / len(ids) for i in ids}
            for s, d in pairs:
                new[d] += 0.85 * rank[s] / out[s]
            rank = new
        restart = None if start is None else spark.createDataFrame(list(start.items()), "id string, weight double")
        got = {r.id: r["rank"] for r in traverse.pagerank(nodes, edges, restart, 7).collect()}
        assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 2e-8 for i in ids)
    assert max(rows) <= 4
    got = {r.id: r["rank"] for r in traverse.pagerank(nodes, edges.where("1 = 0"), None, 7).collect()}
    assert set(got.values()) == {round(1 / len(ids), 8)} and len(got) == len(ids)


def test_references_by_a_common_name_are_counted_by_name(spark):
    n = 150_000  # pair by pair 2e10
    nodes = spark.range(n).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("a.b").alias("symbol"))
    pending = spark.range(n).select(F.concat(F.lit("p"), "id").alias("src"), F.when(F.col("id") < 5, "a.b").otherwise("b").alias("dst_symbol"), F.lit("AMBIGUOUS").alias("resolution_state"))
    edges = spark.createDataFrame([("p1", "p2", "calls"), ("p1", "p2", "uses"), ("gone", "p2", "calls")], "src string, dst string, relation string")
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = joins.usages_with_risk(nodes, edges, pending, nodes)
        assert {(r.unresolved, r.status, r.k) for r in got.groupBy("unresolved", "status").agg(F.count(F.lit(1)).alias("k")).collect()} == {(n - 1, "PARTIAL", n)}
    finally:
        stop.cancel()
    assert [(r.resolved, r.callers) for r in got.where("target = 'p2'").collect()] == [(2, 1)]


def test_names_of_targets_and_entities_are_not_broadcast(spark, tmp_path):
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    spark.range(2_000_000).select(F.concat(F.lit("ord:"), "id").alias("id")).write.option("compression", "zstd").parquet(str(tmp_path / "nodes_of_this_test.parquet"))
    nodes = Tables(spark, str(tmp_path))("nodes_of_this_test").select("id", *[F.lit("a").alias(c) for c in ("label", "body", "kind", "path", "symbol", "risk")], F.lit(1).alias("line_start"), F.lit(0).alias("community_id"))
    edges = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("calls").alias("relation"), F.lit(1).alias("line"))
    extends = edges.withColumn("relation", F.lit("extends"))
    pending = extends.selectExpr("src", "dst as dst_symbol", "relation", "'AMBIGUOUS' as resolution_state")
    for df in (pack.neighbours(edges, nodes), export.entities(nodes.drop("community_id", "risk"), edges, nodes, nodes), joins.inheritance_around(nodes, extends, pending, nodes.select("id", F.col("id").alias("symbol")))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_impacted_tests_read_the_edges_twice(spark):
    """Once for the first callers and the direct edges, once for the last level."""
    n, passes = 2000, spark.sparkContext.accumulator(0)

    def counted(row):
        passes.add(1)
        return row

    nodes = spark.range(n).select(F.format_string("n%04d", "id").alias("id"), F.when(F.col("id") % 2 == 0, "tests/a.py").otherwise("src/b.py").alias("path"), F.lit("function").alias("kind"), F.lit("run").alias("symbol"), F.col("id").cast("int").alias("line_start"), F.col("id").cast("int").alias("line_end"))
    pairs = spark.range(n - 1).select(F.format_string("n%04d", F.col("id") + 1).alias("src"), F.format_string("n%04d", "id").alias("dst"), F.lit("calls").alias("relation"))
    edges = spark.createDataFrame(pairs.rdd.map(counted), pairs.schema)
    hunks = spark.createDataFrame([(1, "src/b.py", 5, 5)], "event_id long, path string, line_start int, line_end int")
    got = {(r.id, r.tier) for r in traverse.impacted_tests(nodes, edges, hunks).collect()}
    assert got == {("n0006", "caller"), ("n0006", "direct_edge")} and passes.value <= 2 * (n - 1)


def test_stored_tables_are_made_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(registry, "fixture", lambda spark, sf_dir, name: (both.wait(), name)[1])
    assert Tables(spark, "somewhere").together("nodes", "edges") == ["nodes", "edges"]


def test_measured_small_sides_are_hashed(spark):
    keys = ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    were, broadcast = [spark.conf.get(k) for k in keys], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small, large = (spark.range(k).select(F.concat(F.lit("n"), F.col("id") % 5000).alias("id")) for k in (5000, 200_000))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with hashed(spark):
            both = large.join(small, "id")
            assert len(both.collect()) == 200_000
        assert "ShuffledHashJoin" in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert [spark.conf.get(k) for k in keys] == were


def test_ranks_of_a_graph_without_cycles_take_a_pass_a_length(spark, monkeypatch):
    """Ranks as by plain rounds; what is written does not grow with the rounds."""
    held, written = [], traverse.written
    monkeypatch.setattr(traverse, "written", lambda df: held.append(written(df)) or held[-1])
    pairs = [(f"o{k}", f"p{k % 7}") for k in range(60)] + [(f"o{k}", f"p{k % 5}") for k in range(40)] + [(f"p{k}", f"s{j}") for k in range(7) for j in range(1 + k % 3)] + [("o1", "s0")]
    ids = sorted({i for p in pairs for i in p} | {f"alone{k}" for k in range(9)})
    nodes, edges = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string")
    out = {i: sum(s == i for s, _ in pairs) for i in ids}
    for rounds, start in ((24, None), (24, {"o1": 1.0, "s0": 3.0}), (1, {"p1": 1.0}), (0, None)):
        held.clear()
        base = {i: 1 / len(ids) if start is None else start.get(i, 0) / sum(start.values()) for i in ids}
        rank = dict(base)
        for _ in range(rounds):
            loose = sum(v for i, v in rank.items() if not out[i])
            new = {i: 0.15 * base[i] + 0.85 * loose / len(ids) for i in ids}
            for s, d in pairs:
                new[d] += 0.85 * rank[s] / out[s]
            rank = new
        restart = None if start is None else spark.createDataFrame(list(start.items()), "id string, weight double")
        got = {r.id: r["rank"] for r in traverse.pagerank(nodes, edges, restart, rounds).collect()}
        assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 2e-8 for i in ids)
        assert len(held) <= 4  # links, sources, ways of one and of two


def _asked_of(monkeypatch, name):
    """The distinct relations of the edges that the query gives to the map."""
    from loomgraph.plans import upkeep_queries

    seen = []
    monkeypatch.setattr(upkeep_queries.pack, "repo_map", lambda nodes, edges, *a: seen.append({r[0] for r in edges.select("relation").distinct().collect()}) or nodes)
    return lambda spark: (registry.QUERIES[name](spark, "/root/testdata/sf0.001"), seen[0])[1]


def test_the_map_is_ranked_over_all_edges(spark, monkeypatch):
    assert _asked_of(monkeypatch, "repo_map_budget")(spark) == {"calls", "uses", "extends", "defines", "imports"}


def test_the_map_around_a_focus_is_ranked_over_all_edges(spark, monkeypatch):
    assert _asked_of(monkeypatch, "repo_map_focus")(spark) == {"calls", "uses", "extends", "defines", "imports"}


def test_references_are_resolved_once_and_imports_that_nobody_asks_for_are_not_listed(spark, monkeypatch):
    from loomgraph.operators import reconcile, resolve
    from loomgraph.plans import catalog

    held, written, lists, cut_ = [], reconcile.written, [], resolve.cut
    monkeypatch.setattr(reconcile, "written", lambda df: held.append(written(df)) or held[-1])
    monkeypatch.setattr(resolve, "cut", lambda df: lists.append(cut_(df)) or lists[-1])
    assert catalog.QUERIES["reconcile_counts"](spark, "/root/testdata/sf0.001").count() == 1
    assert sum({"state", "tier", "target"} <= set(df.columns) for df in held) == 1
    assert [df.count() for df in lists if df.columns == ["path", "module"]] == [0]  # no name that references ask for without an import stands in several files


def test_pairs_of_one_name_are_dealt_over_the_tasks(spark):
    nodes = spark.range(400).select(F.concat(F.lit("p"), "id").alias("id"), F.when(F.col("id") < 50, "a.b").otherwise("c").alias("symbol"))
    pending = nodes.selectExpr("id as src", "'b' as dst_symbol", "'extends' as relation", "'AMBIGUOUS' as resolution_state")
    edges = spark.createDataFrame([], "src string, dst string, relation string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = joins.inheritance_around(nodes, edges, pending, nodes).where("side = 'pending_derived'")
        rows = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(rows) == 50 * 399 and max(rows) < 0.7 * sum(rows)
        assert got.distinct().count() == 50 * 399
    finally:
        spark.conf.unset(key)
