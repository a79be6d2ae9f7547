"""Iterative operators against plain Python on random graphs, and the store."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import joins, stats, store, traverse, trust
from loomgraph.plans import catalog
from loomgraph.sources import fixtures
from loomgraph.sources.fixtures import base, fixture


def graph(spark, seed, n=24, m=40):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]
    ids = sorted({x for p in pairs for x in p} | {f"n{n}"})
    return ids, pairs, spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, relation string")


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    ids, pairs, nodes, edges = graph(spark, seed)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {r.id: r.component for r in traverse.connected(nodes, edges).collect()} == {i: find(i) for i in ids}


def test_pagerank(spark):
    ids, pairs, nodes, edges = graph(spark, 3)
    out = {i: [b for a, b in pairs if a == i] for i in ids}
    rank = {i: 1 / len(ids) for i in ids}
    for _ in range(7):
        loose = sum(rank[i] for i in ids if not out[i])
        new = {i: 0.15 / len(ids) + 0.85 * loose / len(ids) for i in ids}
        for i in ids:
            for j in out[i]:
                new[j] += 0.85 * rank[i] / len(out[i])
        rank = new
    got = {r.id: r.rank for r in traverse.pagerank(nodes, edges, rounds=7).collect()}
    assert got == pytest.approx(rank, abs=1e-7)


def test_reach_and_blast(spark):
    ids, pairs, nodes, edges = graph(spark, 4)
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in ids}
    want = {i: len((near[i] | {k for j in near[i] for k in near[j]}) - {i}) for i in ids}
    assert {r.id: r.blast for r in traverse.neighbourhood(edges, nodes, 2).collect()} == want


def test_interval_join_over_bins(spark):
    r = random.Random(5)
    spans = [(f"n{i}", "p", a := r.randrange(1, 3000), a + r.randrange(2000)) for i in range(60)]
    hunks = [(i, "p", a := r.randrange(1, 5000), a + r.randrange(50)) for i in range(40)]
    n = spark.createDataFrame(spans, "id string, path string, line_start int, line_end int")
    h = spark.createDataFrame(hunks, "event_id long, path string, line_start int, line_end int")
    want = {i: c for i, _, a, b in spans if (c := sum(a <= d and b >= s for _, _, s, d in hunks))}
    assert {r.id: r.hits for r in joins.hunks_to_nodes(h, n, width=64).collect()} == want


def test_store_swaps_only_on_the_expected_generation(spark, tmp_path):
    t = store.VersionedTable(spark, f"file://{tmp_path}/t")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "path string, x int")
    assert t.generation() == 0 and t.publish(one, 0) == 1
    with pytest.raises(store.Conflict):
        t.publish(one, 0)
    t.publish(store.replace_files(t.read(), spark.createDataFrame([("b", 3)], "path string, x int")), 1)
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 3)]


def test_requeue_and_rehome(spark):
    nodes = spark.createDataFrame([("sym:1", "a.py", "class", "A.b"), ("sym:2", "b.py", "class", "C")], "id string, path string, kind string, symbol string")
    edges = spark.createDataFrame([("b.py", "sym:2", "sym:1", "calls", 4), ("a.py", "sym:1", "sym:2", "calls", 1)], "path string, src string, dst string, relation string, line int")
    gone = spark.createDataFrame([("a.py",)], "path string")
    assert [tuple(r) for r in store.requeue(edges, nodes, gone).collect()] == [("b.py", "sym:2", "b", "calls", 4, "UNRESOLVED")]
    ns = spark.range(1).select(F.substring(F.sha2(F.lit("a.py"), 256), 1, 12)).first()[0]
    df = spark.createDataFrame([("a.py", f"sym:{ns}:A"), ("c.py", "sym:ffffffffffff:C")], "path string, id string")
    moved = {r.path: r.id for r in store.rehome(df, spark.createDataFrame([("a.py", "z.py")], "old_path string, new_path string"), ["id"]).collect()}
    new = spark.range(1).select(F.substring(F.sha2(F.lit("z.py"), 256), 1, 12)).first()[0]
    assert moved == {"z.py": f"sym:{new}:A", "c.py": "sym:ffffffffffff:C"}


def test_steps_are_all_pairs_of_consecutive_lines(spark):
    sf = "/root/testdata/sf0.001"
    lines = {}
    for r in base(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").collect():
        lines.setdefault((r.l_orderkey, r.l_linenumber), set()).add(r.l_partkey)
    want = {(f"part:{a}", f"part:{b}") for (o, n), parts in lines.items() for a in parts for b in lines.get((o, n + 1), ()) if a != b}
    got = [(r.src, r.dst) for r in fixture(spark, sf, "steps").collect()]
    assert len(got) == len(want) == 2736 and set(got) == want


def test_impacted_tests_of_three_tiers(spark):
    nodes = spark.createDataFrame(
        [("a", "src/a.py", "function", "run", 1, 9), ("b", "src/b.py", "function", "main", 1, 9), ("t1", "tests/x.py", "function", "check_run", 1, 9),
         ("t2", "src/y.py", "function", "test_main", 1, 9), ("t3", "src/z.py", "class", "RunSpec", 1, 9), ("t4", "tests/w.py", "function", "far", 1, 9), ("t5", "tests/v.py", "function", "changed", 1, 9)],
        "id string, path string, kind string, symbol string, line_start int, line_end int",
    )
    edges = spark.createDataFrame([("t1", "a", "calls"), ("b", "a", "calls"), ("t2", "b", "uses"), ("t3", "a", "reads"), ("t4", "t2", "calls")], "src string, dst string, relation string")
    hunks = spark.createDataFrame([(1, "src/a.py", 3, 4), (2, "tests/v.py", 50, 51)], "event_id long, path string, line_start int, line_end int")
    got = {(r.id, r.tier, r.target) for r in traverse.impacted_tests(nodes, edges, hunks).collect()}
    assert got == {("test:tests/v.py", "changed_file", None), ("t1", "caller", "run"), ("t2", "caller", "main"), ("t1", "direct_edge", "run"), ("t3", "direct_edge", "run")}


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_impacted_tests_of_any_depth_and_size(spark, depth):
    r = random.Random(depth)
    ids = [f"n{k}" for k in range(40)]
    rows = [(i, f"tests/{i}.py" if k % 3 == 0 else f"src/{i}.py", "function", r.choice(["run", "test_it", "", None]), 1, 9) for k, i in enumerate(ids)]
    pairs = sorted({(r.choice(ids + ["gone"]), r.choice(ids + ["gone"]), r.choice(["calls", "uses", "reads"])) for _ in range(70)})
    hit = {i for k, i in enumerate(ids) if k % 8 == 0}
    symbol, path = {x[0]: x[3] for x in rows}, {x[0]: x[1] for x in rows}
    is_test = {i for i in ids if path[i].startswith("tests/") or (symbol[i] or "").startswith("test")}
    want, seen, level = {(f"test:{path[i]}", "changed_file", None) for i in hit if path[i].startswith("tests/")}, set(hit), hit
    for _ in range(depth):
        via: dict[str, str] = {}
        for a, b, relation in pairs:
            if b in level and a not in seen and relation != "reads":
                via[a] = min(b, via.get(a, b))
        want |= {(a, "caller", symbol[b]) for a, b in via.items() if a in is_test and b in symbol}
        seen, level = seen | set(via), set(via)
    direct: dict[str, str] = {}
    for a, b, _ in pairs:
        if b in hit and symbol[b] and a in is_test:
            direct[a] = min(symbol[b], direct.get(a, symbol[b]))
    want |= {(a, "direct_edge", s) for a, s in direct.items()}
    nodes = spark.createDataFrame(rows, "id string, path string, kind string, symbol string, line_start int, line_end int")
    edges = spark.createDataFrame(pairs, "src string, dst string, relation string")
    hunks = spark.createDataFrame([(k, path[i], 3, 4) for k, i in enumerate(sorted(hit))], "event_id long, path string, line_start int, line_end int")
    for few in (0, 100_000):
        got = [(x.id, x.tier, x.target) for x in traverse.impacted_tests(nodes, edges, hunks, depth, few).collect()]
        assert len(got) == len(want) and set(got) == want


def test_impacted_tests_where_callees_are_no_nodes(spark, tmp_path):
    """Lines whose part is missing, and a customer and an order that stand there twice: the rows of the SQL."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in fixtures.TABLES:
        more = {"part": "where p_partkey % 3 > 0", "customer": "union all select * from t where c_custkey % 7 = 0", "orders": "union all select * from t where o_orderkey % 5 = 0"}.get(t, "")
        c.sql(f"copy (with t as (select * from '{sf}/{t}.parquet') select * from t {more}) to '{tmp_path}/{t}.parquet'")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = c.sql(catalog.ORACLES["impacted_tests"]).fetchall()
    got = catalog.QUERIES["impacted_tests"](spark, str(tmp_path)).select("id", "path", "symbol", "kind", "tier", "target").collect()
    assert want and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_blast_starts_from_every_node(spark):
    sf = "/root/testdata/sf0.001"
    near = {}
    for r in fixture(spark, sf, "steps").collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    want = {i: len((js | {k for j in js for k in near[j]}) - {i}) for i, js in near.items()}
    assert {r.id: r.blast for r in catalog.QUERIES["blast_radius_2hop"](spark, sf).collect()} == want


def test_api_impact_starts_from_every_changed_node(spark):
    got = {r.id for r in catalog.QUERIES["api_or_join"](spark, "/root/testdata/sf0.001").collect()}
    hit = {r.id for r in catalog.QUERIES["hunk_node_interval_join"](spark, "/root/testdata/sf0.001").collect()}
    assert {i for i in hit if not i.startswith("file:")} <= got


def ranks_after(edges, rounds, more=(), start=None):
    ids = sorted({x for e in edges for x in e} | set(more))
    out = {i: [b for a, b in edges if a == i] for i in ids}
    base = {i: (start or {}).get(i, 0.0) if start else 1 / len(ids) for i in ids}
    rank = dict(base)
    for _ in range(rounds):
        loose = sum(rank[i] for i in ids if not out[i])
        new = {i: 0.15 * base[i] + 0.85 * loose / len(ids) for i in ids}
        for i in ids:
            for j in out[i]:
                new[j] += 0.85 * rank[i] / len(out[i])
        rank = new
    return rank


def test_registered_loops_run_all_rounds(spark, tmp_path):
    n = 41
    spark.createDataFrame([(1, k, k) for k in range(1, n + 1)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, n + 1)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    path = [(f"part:{k}", f"part:{k + 1}") for k in range(1, n)]
    got = lambda name: {r[0]: r[1] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("pagerank") == pytest.approx(ranks_after(path, 30), abs=2e-8)
    assert got("personalised_pagerank") == pytest.approx(ranks_after(path, 30, start={"part:1": 0.5, "part:2": 0.5}), abs=2e-8)
    near = {f"part:{k}": [f"part:{j}" for j in (k - 1, k + 1) if 1 <= j <= n] for k in range(1, n + 1)}
    label = {i: i for i in near}
    for _ in range(30):
        new = {}
        for i, js in near.items():
            votes = [label[j] for j in js]
            best = {v for v in votes if votes.count(v) == max(map(votes.count, votes))}
            new[i] = label[i] if label[i] in best else min(best)
        label = new
    assert got("label_propagation") == label


def test_repo_map_ranks_after_all_rounds(spark):
    sf = "/root/testdata/sf0.001"
    shown = {r.id for r in fixture(spark, sf, "nodes").where("kind not in ('file', 'note', 'markdown') and path <> ''").collect()}
    pairs = [(r.src, r.dst) for r in fixture(spark, sf, "edges").where("relation in ('extends', 'uses')").collect()]
    want = ranks_after([(a, b) for a, b in pairs if a in shown and b in shown and a != b], 24, more=shown)
    got = {r.id: r["rank"] for r in catalog.QUERIES["repo_map_budget"](spark, sf).collect()}
    assert got and got == pytest.approx({i: want[i] for i in got}, abs=2e-8)


def test_hub_of_moderate_degree_is_critical_by_its_reach(spark):
    big = [("s1", f"a{k}") for k in range(80)] + [("s2", f"b{k}") for k in range(80)]
    pairs = big + [("h", "s1"), ("h", "s2"), *[("h", f"c{k}") for k in range(18)]]
    ids = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(i, "class") for i in ids], "id string, kind string")
    got = {r.id: (r.total_degree, r.blast_radius, r.risk) for r in stats.hubs(nodes, spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got["h"] == (20, len(ids) - 1, "CRITICAL")


def test_decide_has_every_reason(spark):
    fine = {"identity": "UNIQUE", "bound": True, "collection_error": False, "stale": 0, "measured": True, "covered": 1.0, "parser_failures": 0, "unresolved": 0, "conflicts": 0, "truncated": False,
            "truncation_sources": [], "enumerated": True, "parser_capable": True, "partial_ast": False, "provider_ok": True, "absence": True, "gate_blocked": False, "dynamic": False, "profile": "absence"}
    cases = [
        ({}, "ASSURED_WITHIN_SCOPE", []), ({"collection_error": True}, "UNVERIFIABLE", ["collection_error"]), ({"identity": "NOT_FOUND"}, "ABSTAINED", ["target_not_found"]),
        ({"identity": "AMBIGUOUS"}, "ABSTAINED", ["target_ambiguous"]), ({"bound": False}, "UNVERIFIABLE", ["snapshot_unbound"]), ({"stale": 1}, "STALE", ["stale_sources"]),
        ({"conflicts": 1}, "CONFLICTED", ["open_conflicts"]), ({"gate_blocked": True}, "PARTIAL", ["rename_gate_blocked"]), ({"truncated": True}, "PARTIAL", ["transitive_truncated"]),
        ({"truncation_sources": ["transitive_cap_200", "edges_cap_500"]}, "PARTIAL", ["transitive_truncated", "collection_truncated:edges_cap_500"]), ({"parser_failures": 2}, "PARTIAL", ["parser_failures"]),
        ({"unresolved": 1}, "PARTIAL", ["unresolved_over_budget"]), ({"dynamic": True}, "PARTIAL", ["dynamic_dispatch_unresolved"]), ({"covered": 0.89}, "PARTIAL", ["coverage_below_floor"]),
        ({"measured": False}, "PARTIAL", ["coverage_below_floor"]), ({"covered": None}, "PARTIAL", ["coverage_below_floor"]), ({"enumerated": None}, "PARTIAL", ["enumeration_incomplete"]),
        ({"parser_capable": False}, "PARTIAL", ["parser_capability_incomplete"]), ({"partial_ast": True}, "PARTIAL", ["partial_ast_ceiling"]), ({"provider_ok": False}, "PARTIAL", ["provider_capability_missing"]),
        ({"absence": False, "profile": "presence", "covered": None, "enumerated": None, "parser_capable": None, "partial_ast": True}, "ASSURED_WITHIN_SCOPE", []),
        ({"absence": False, "profile": "relation", "covered": 0.5}, "PARTIAL", ["coverage_below_floor"]), ({"stale": 1, "conflicts": 1, "unresolved": 1}, "STALE", ["stale_sources", "open_conflicts", "unresolved_over_budget"]),
    ]
    types = "identity string, bound boolean, collection_error boolean, stale int, measured boolean, covered double, parser_failures int, unresolved int, conflicts int, truncated boolean, truncation_sources array<string>, enumerated boolean, parser_capable boolean, partial_ast boolean, provider_ok boolean, absence boolean, gate_blocked boolean, dynamic boolean, profile string"
    df = spark.createDataFrame([(*(fine | c).values(), k) for k, (c, _, _) in enumerate(cases)], types + ", k int")
    got = {r.k: (r.status, r.reason_codes) for r in df.select("k", trust.decide(**{x: F.col(x) for x in fine}).alias("d")).select("k", "d.*").collect()}
    assert got == {k: (status, codes) for k, (_, status, codes) in enumerate(cases)}


def test_repo_map_ranks_over_calls_too(spark):
    sf = "/root/testdata/sf0.001"
    shown = {r.id for r in fixture(spark, sf, "nodes").where("kind not in ('file', 'note', 'markdown') and path <> ''").collect()}
    pairs = [(r.src, r.dst) for r in fixture(spark, sf, "edges").where("relation in ('calls', 'extends', 'implements', 'uses')").collect()]
    want = ranks_after([(a, b) for a, b in pairs if a in shown and b in shown and a != b], 24, more=shown)
    got = {r.id: r["rank"] for r in catalog.QUERIES["repo_map_budget"](spark, sf).collect()}
    assert got and got == pytest.approx({i: want[i] for i in got}, abs=2e-8)
