"""Operators that SQL can't say, against plain Python: communities, cycles, budgets, state upkeep, verification, providers."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import assurance, community, export, pack, providers, reconcile, resolve, search, traverse, verify
from loomgraph.operators.store import Conflict
from loomgraph.shared import carried, cut, numbered
from loomgraph.streaming import changes

EDGE, NODE = "src string, dst string, relation string", "id string"


def frames(spark, pairs, ids=()):
    every = sorted({x for p in pairs for x in p} | set(ids))
    return spark.createDataFrame([(i,) for i in every], NODE), spark.createDataFrame([(a, b, "calls") for a, b in pairs], EDGE)


def modularity(pairs, part):
    m = len(pairs)
    degree = collections.Counter(x for p in pairs for x in p)
    total = collections.Counter()
    for i, d in degree.items():
        total[part[i]] += d
    return sum(part[a] == part[b] for a, b in pairs) / m - sum(t * t for t in total.values()) / (4 * m * m)


def test_louvain_finds_planted_groups(spark):
    r = random.Random(3)
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "abcd" for i in range(8) for j in range(i) if r.random() < 0.7] + [("a0", "b0"), ("b1", "c1"), ("c2", "d2")]
    nodes, edges = frames(spark, pairs, ["alone"])
    got = {x.id: x.community for x in community.louvain(nodes, edges).collect()}
    assert {i: c[0] for i, c in got.items() if i != "alone"} == {i: i[0] for i in got if i != "alone"} and got["alone"] == "alone"
    assert modularity(pairs, got) > 0.6


def test_louvain_on_random_graphs(spark):
    r = random.Random(9)
    pairs = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(60)]
    nodes, edges = frames(spark, pairs)
    got = {x.id: x.community for x in community.louvain(nodes, edges).collect()}
    # plain local moving, one node after the other
    part = {i: i for i in got}
    best = modularity(pairs, part)
    moved = True
    while moved:
        moved = False
        for i in sorted(part):
            for c in {part[b] for a, b in pairs if a == i} | {part[a] for a, b in pairs if b == i}:
                q = modularity(pairs, part | {i: c})
                if q > best + 1e-9:
                    part[i], best, moved = c, q, True
    assert modularity(pairs, got) > best - 0.08
    assert community.louvain(*frames(spark, [("x", "x")], ["y"])).count() == 2


def strong(pairs):
    """Smallest id of the part of each node on a cycle."""
    ids = {x for p in pairs for x in p}
    ahead = {i: {b for a, b in pairs if a == i} for i in ids}
    reach = {}
    for i in ids:
        seen, todo = set(), list(ahead[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ahead[x]
        reach[i] = seen
    return {i: min(j for j in reach[i] if i in reach[j]) for i in ids if i in reach[i]}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(spark, seed):
    r = random.Random(seed)
    pairs = sorted({(f"n{r.randrange(16)}", f"n{r.randrange(16)}") for _ in range(22)}) + [("s", "s")]
    nodes, edges = frames(spark, pairs)
    parts = strong(pairs)
    assert {x.id: x.component for x in community.components_of_cycles(nodes, edges).collect()} == parts
    found = collections.defaultdict(dict)
    for x in community.cycles(nodes, edges).collect():
        found[x.component][x.place] = x.id
    assert set(found) == set(parts.values())
    for start, way in found.items():
        ring = [way[k] for k in range(len(way))]
        assert ring[0] == start and len(set(ring)) == len(ring)
        assert all((a, b) in pairs for a, b in zip(ring, [*ring[1:], start], strict=True))


def test_label_propagation(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    nodes, edges = frames(spark, pairs)
    got = {x.id: x.community for x in traverse.label_propagation(nodes, edges, 30).collect()}
    assert len({c for i, c in got.items() if i[0] == "a"}) == 1 == len({c for i, c in got.items() if i[0] == "b"})
    assert traverse.pagerank(nodes.where("1 = 0"), edges.where("1 = 0")).count() == 0


def pieces(text):
    import re

    return max(1, len(re.findall(search.PIECE, text))) if text else 0


def test_token_budgets(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["def f", " x", "\n", "  ", "123456", "it's ", ";;", "é"]) for _ in range(r.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {x.i: x for x in df.select("i", search.truncate_to_budget(F.col("t"), 40).alias("r"), search.fit_lines(search.lines_with_ends(F.col("t")), 12).alias("f"), search.estimate_tokens(F.col("t")).alias("n")).collect()}
    import re

    for i, t in rows:
        assert got[i].n == pieces(t)
        lines = re.findall("[^\n]*\n|[^\n]+", t)

        def longest(budget, lines=lines):
            lo, hi, best = 0, len(lines), 0
            while lo <= hi:
                mid = (lo + hi) // 2
                if pieces("".join(lines[:mid])) <= budget:
                    best, lo = mid, mid + 1
                else:
                    hi = mid - 1
            return best

        assert got[i].f.kept == longest(12)
        if pieces(t) <= 40:
            assert (got[i].r.text, got[i].r.truncated) == (t, False)
        else:
            assert got[i].r.text == "".join(lines[: longest(max(1, 40 - pieces(search.TRUNCATED)))]) + search.TRUNCATED


def test_repo_map(spark):
    rows = [(f"s{i}", f"p{i % 3}.py", "function", f"name{i}", i) for i in range(30)] + [("f", "p0.py", "file", "p0", 1)]
    nodes = spark.createDataFrame(rows, "id string, path string, kind string, symbol string, line_start int")
    edges = spark.createDataFrame([(f"s{i}", f"s{i % 4}", "calls") for i in range(30)] + [("s1", "s2", "defines")], EDGE)
    ranks = {x.id: x.rank for x in pack.map_ranks(nodes, edges).collect()}
    got = pack.repo_map(nodes, edges, None, 64).orderBy("place").collect()
    order = sorted(ranks, key=lambda i: (-ranks[i], f"p{int(i[1:]) % 3}.py", f"name{i[1:]}", i))
    assert [x.id for x in got] == order[: len(got)] and 0 < len(got) < 30 and got[-1].tokens <= 64
    text = pack.render_map([(x.path, x.line, x.symbol) for x in got])
    assert pieces(text) <= 64
    focus = spark.createDataFrame([("s29",)], NODE)
    assert pack.repo_map(nodes, edges, focus, 64).orderBy("place").first().id == "s29"
    assert {x.ext: x.percent for x in pack.map_languages(pack.repo_map(nodes, edges, None, 64)).collect()} == {"py": 100.0}


def state(spark, journal, nodes, edges, pending=()):
    return reconcile.State(
        spark.createDataFrame(journal, "path string, digest string, size long, mtime_ms long, generation int, parser_outcome string"), spark.createDataFrame(nodes, "id string, path string, kind string, symbol string, fqn string"),
        spark.createDataFrame(edges, "path string, src string, dst string, relation string, line int"),
        spark.createDataFrame(list(pending), "path string, src string, dst_symbol string, relation string, line int, import_source string, receiver string, resolution_state string"),
    )


def parse(spark, texts):
    """A file's text is 'name calls…': one node, and an open reference a call."""
    def run(jobs):
        todo = {r.path: r for r in jobs.collect()}
        made = [(p, texts[p].split()) for p in todo]
        records = spark.createDataFrame([(p, texts[p], len(texts[p]), len(texts[p]), todo[p].base_generation, "COMPLETE") for p, _ in made], "path string, digest string, size long, mtime_ms long, base_generation int, parser_outcome string")
        nodes = spark.createDataFrame([(f"sym:{p}:{w[0]}", p, "function", w[0], f"{p}.{w[0]}") for p, w in made], "id string, path string, kind string, symbol string, fqn string")
        edges = spark.createDataFrame([], "path string, src string, dst string, relation string, line int")
        pending = spark.createDataFrame([(p, f"sym:{p}:{w[0]}", c, "calls", k, None, None, "UNRESOLVED") for p, w in made for k, c in enumerate(w[1:])], "path string, src string, dst_symbol string, relation string, line int, import_source string, receiver string, resolution_state string")
        return records, nodes, edges, pending

    return run


def disk(spark, texts):
    return spark.createDataFrame([(p, t, len(t), len(t)) for p, t in texts.items()], "path string, digest string, size long, mtime_ms long")


def seen(s):
    return ({(r.id, r.path) for r in s.nodes.collect()}, {(r.src, r.dst, r.relation) for r in s.edges.collect()}, {(r.src, r.dst_symbol) for r in s.pending.collect()}, {(r.path, r.digest) for r in s.journal.collect()})


def test_step_by_step_equals_rebuild(spark):
    empty = state(spark, [], [], [])
    one = {"a": "f g h", "b": "g", "c": "h f"}
    two = {"a": "f g nowhere", "c": "h2 f", "d": "g f"}  # b is gone, c renamed what it defines, d is new
    s, counts = reconcile.reconcile(empty, disk(spark, one), parse(spark, one))
    assert counts.first().asDict() == {"scanned": 3, "unchanged": 0, "updated": 3, "deleted": 0, "failed": 0, "conflicts": 0}
    assert seen(s)[1] == {("sym:a:f", "sym:b:g", "calls"), ("sym:a:f", "sym:c:h", "calls"), ("sym:c:h", "sym:a:f", "calls")}
    s, counts = reconcile.reconcile(s, disk(spark, two), parse(spark, two))
    assert counts.first().asDict() == {"scanned": 3, "unchanged": 0, "updated": 3, "deleted": 1, "failed": 0, "conflicts": 0}
    full, _ = reconcile.reconcile(empty, disk(spark, two), parse(spark, two))
    assert seen(s) == seen(full)
    again, counts = reconcile.reconcile(s, disk(spark, two), parse(spark, two))
    assert counts.first().unchanged == 3 and seen(again) == seen(s)


def test_snapshots(spark, tmp_path):
    store = reconcile.Snapshot(spark, f"file://{tmp_path}/s")
    s = state(spark, [("a", "d", 1, 1, 1, None)], [("n", "a", "file", "a", "a")], [])
    assert store.publish(s, 0) == 1 == store.generation()
    with pytest.raises(Conflict):
        store.publish(s, 0)
    before = store.sizes()[1]
    saved = store.compact()
    assert saved["files_before"] == before and saved["files_after"] <= before and store.generation() == 2
    assert store.read().nodes.count() == 1


def test_declarations():
    code = "# run\nclass A:\n    def run(self):\n        pass\n\n\n\nx = 'stop'\n"
    d = lambda *a: verify.declaration(*a)[:3]
    assert d("a.py", "A.run", 4, code, None, 0.5) == ("EXACT_SPAN", "ast_visitor:exact_span", True)
    assert d("a.py", "run", 30, code, None, 0.5) == ("EXACT_SYMBOL", "ast_visitor:exact_symbol", True)
    assert d("a.py", "stop", 1, code, None, 0.5) == ("FILE_TOKEN", "lexical:comment_or_literal", False)
    assert d("a.py", "none", 1, code, None, 0.5) == ("NAME_ONLY", "ast_visitor:not_found", False)
    assert d("a.ts", "go", 1, "// function go\n", None, 0.5) == ("FILE_TOKEN", "lexical:file_token", False)
    assert d("a.ts", "go", 1, "function go() {}", None, 0.5) == ("FILE_TOKEN", "regex_decl:heuristic_span", False)
    assert d("a.py", "run", 1, "def run(", None, 0.5)[0] == "FILE_TOKEN" and verify.declaration("a.py", "run", 1, "def run(", None, 0.5)[3] == "PARSE_ERROR"
    assert d("a.ts", None, 1, "", 0.9, 0.5)[0] == "FILE_TOKEN"
    two = "def f():\n    pass\ndef f():\n    pass\n"
    assert verify.subject_status("a.py", two, "function", "m.f", 1, 4) == "AMBIGUOUS" and verify.subject_status("a.py", two, "function", "m.f", 1, 2) == "VERIFIED"
    assert verify.subject_status("a.go", "func f", "function", "f", 1, 1) == "NOT_APPLICABLE" and verify.subject_status("../a", "", "x", "f", 1, 1) == "MISSING"
    assert verify.subject_status("a.py", two, "variable", "f", 1, 9) == "SPAN_MISMATCH" and verify.subject_status("a.py", None, "x", "f", 1, 1) == "MISSING"


class Fake:
    name, capabilities = "fake", ("trace", "search_symbols")

    def __init__(self, healthy=True):
        self.healthy = healthy

    def probe(self, root=""):
        return {"healthy": self.healthy}

    def trace(self, **request):
        return request or {"none": True}

    def search_symbols(self, **request):
        raise OSError


def test_providers():
    assert providers.parse_spec(None) == ("builtin", None) and providers.parse_spec("require:x") == ("require", "x")
    with pytest.raises(ValueError):
        providers.parse_spec("prefer:")
    p = providers.plan("auto", "usages", [Fake()])
    assert providers.ask(p, "usages", symbol="s") == ({"symbol": "s"}, "trace")
    assert providers.plan("require:none", "usages", [Fake()]).failure and providers.plan("prefer:none", "usages", [Fake()]).warnings
    assert providers.plan("require:fake", "usages", [Fake(False)]).failure and providers.plan("auto", "usages", [Fake()], False).warnings
    assert providers.plan("nonsense", "usages", []).failure and providers.ask(providers.plan("builtin", "usages", [Fake()]), "usages") == (None, None)
    assert providers.contract_problems(Fake, {}) == ["search_symbols raises OSError"] and providers.static_problems(object) != []
    assert providers.plugins() == ({}, [])


def test_receipts_store(spark, tmp_path):
    s = providers.Store(spark, f"file://{tmp_path}/r")
    d = s.put({"a": 1, "captured_at": 5, "b": {"elapsed_ms": 2, "c": "é"}})
    assert s.put({"b": {"c": "é"}, "a": 1, "captured_at": 9}) == d and s.get(d) == {"a": 1, "b": {"c": "é"}}
    (tmp_path / f"r/{d}.json").write_text("{}")
    with pytest.raises((ValueError, Exception)):
        s.get(d)
    with pytest.raises(KeyError):
        s.get("0" * 64)
    claim = providers.impact_claim({"target": "HEAD", "depth": 2}, lambda target, depth: spark.createDataFrame([(target, depth)], "t string, d int"))
    assert claim["receipt"] == {"t": "HEAD", "d": 2}
    with pytest.raises(ValueError):
        providers.impact_claim({"target": "", "depth": 2}, None)


def test_carried_and_numbered(spark):
    r = random.Random(1)
    rows = [(k, i, r.choice([None, None, i])) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(x.k, x.i): x.last for x in carried(df, ["k"], "i", {"last": F.col("v")}, 16).collect()}
    for k in "ab":
        last = None
        for kk, i, v in rows:
            if kk == k:
                last = v if v is not None else last
                assert got[k, i] == last
    assert {(x.i, x.n) for x in numbered(df.where("k = 'a'"), ["i"], "n").collect()} == {(i, i) for i in range(200)}


def test_watch_tries_again_what_was_deferred(spark):
    one = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime_ms long")
    listings = iter([one([("a", 1, 1)]), one([("a", 1, 1), ("b", 1, 1)]), one([("a", 1, 1), ("b", 1, 1)])])
    applied = []

    def apply(todo):
        paths = sorted(r.path for r in todo.collect())
        applied.append(paths)
        return todo.where("path = 'a'") if len(applied) == 1 else todo.limit(0)

    changes.watch(lambda: next(listings), one([]), apply, 3, cut)
    assert applied == [["a"], ["a", "b"], []]


def test_vault(spark):
    nodes = spark.createDataFrame([("1", "A/b", "class", "x.py"), ("2", "a b", "class", "x.py"), ("3", "A/B", "file", None)], "id string, label string, kind string, path string")
    edges = spark.createDataFrame([("1", "2", "calls"), ("3", "1", "defines")], EDGE)
    got = {r.id: r for r in export.vault(nodes, edges).collect()}
    assert len({r.name.lower() for r in got.values()}) == 3 and "- calls [[a b]]" in got["1"].text and "Used by (1)" in got["1"].text
    page = export.page([{"id": "</script>"}], [], "t")
    assert "</script>\"" not in page and export.report({"nodes": 1}, [], [], ["x"]).endswith("- x") and "hasPart" in export.jsonld({}, [])


def test_receipt_statuses(spark):
    """A unique name in clean files is assured, and each fault says so."""
    nodes = spark.createDataFrame([("n", "a.py", "function", "f", "a.f"), ("m", "b.py", "function", "g", "b.g")], "id string, path string, kind string, symbol string, fqn string")
    edges = spark.createDataFrame([("m", "n", "calls", 1)], "src string, dst string, relation string, line int")
    journal = spark.createDataFrame([("a.py", "1", 1, "COMPLETE"), ("b.py", "2", 1, "COMPLETE")], "path string, digest string, size long, parser_outcome string")
    disk_ = spark.createDataFrame([("a.py", "1", 1, "x"), ("b.py", "2", 1, "y")], "path string, digest string, size long, content string")
    health = spark.createDataFrame([(0, 0, True, False)], "open_conflicts long, unresolved long, provider_ok boolean, truncated boolean")
    asked = spark.createDataFrame([("f",)], "query string")
    one = lambda j=journal, d=disk_, h=health, **k: assurance.scope_receipts(asked, nodes, edges, j, d, h, **k).first()
    clean = one()
    assert (clean.status, clean.reasons, clean.callers, clean.affected_files) == ("ASSURED_WITHIN_SCOPE", "", 1, 2) and clean.digest == one().digest
    assert one(d=disk_.withColumn("digest", F.lit("9"))).status == "STALE"
    assert one(h=health.withColumn("open_conflicts", F.lit(2))).status == "CONFLICTED"
    assert one(d=disk_.where("path = 'a.py'")).status == "UNVERIFIABLE"
    assert "dynamic_dispatch_unresolved" in one(d=disk_.withColumn("content", F.lit("eval(x)"))).reasons
    assert "parser_failures" in one(j=journal.withColumn("parser_outcome", F.lit("PARSE_ERROR"))).reasons
    assert assurance.bounded("7", 5) == 5 and assurance.bounded(None, 5) == 1 and assurance.bounded(-3, 5) == 1


def test_resolution_follows_bases(spark):
    nodes = spark.createDataFrame([("1", "b.py", "method", "Base.run", "b.Base.run"), ("2", "m.py", "method", "Mid.stop", "m.Mid.stop"), ("3", "o.py", "function", "run", "o.run"), ("4", "q.py", "function", "run", "q.run")], "id string, path string, kind string, symbol string, fqn string")
    edges = spark.createDataFrame([("m.py", "sym:x:Mid", "sym:x:Base", "extends", 1)], "path string, src string, dst string, relation string, line int")
    rows = [("k.py", "sym:k:Kid.go", "run", "calls", 1, None, "sym:k:Kid"), ("k.py", "sym:k:Kid", "Mid", "extends", 1, None, None), ("z.py", "sym:z:f", "run", "calls", 2, None, None), ("o.py", "sym:o:f", "run", "calls", 3, "q", None), ("o.py", "sym:o:f", "x", "calls", 4, "os.path", None)]
    pending = spark.createDataFrame(rows, "path string, src string, dst_symbol string, relation string, line int, import_source string, receiver string")
    got = {r.line: (r.state, r.tier, r.target) for r in resolve.resolve_pending(pending.where("relation = 'calls'").unionByName(pending.where("relation = 'extends'")), nodes, edges, nodes.select("path").distinct()).where("relation = 'calls'").collect()}
    assert got == {1: ("RESOLVED", "receiver", "1"), 2: ("AMBIGUOUS", None, None), 3: ("RESOLVED", "import", "4"), 4: ("EXTERNAL", None, None)}
