"""Parsers of diffs, logs, symbol indexes and Python code; path and name rules."""

import json

from pyspark.sql import functions as F

from loomgraph.operators import identity
from loomgraph.sources import files, python_code, symbols, texts

DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@
 a
+b
@@ -10,4 +11,0 @@
-z
diff --git a/old.py b/old.py
--- a/old.py
+++ /dev/null
@@ -1,5 +0,0 @@
diff --git a/n.py b/n.py
--- /dev/null
+++ b/n.py
@@ -0,0 +1 @@
+q"""


def lines(spark, text, key):
    return spark.createDataFrame([("k", i, x) for i, x in enumerate(text.split("\n"))], f"{key} string, line_no int, line string")


def test_diff(spark):
    got = sorted(tuple(r)[1:] for r in texts.parse_unified_diff(lines(spark, DIFF, "diff")).collect())
    assert got == [("n.py", 1, 1), ("old.py", 1, 5), ("x.py", 1, 3), ("x.py", 10, 13)]


def test_diff_over_bins(spark):
    """A long diff is cut into bins and still knows the file of each hunk."""
    body = ["--- a/x.py", "+++ b/x.py"] + [y for k in range(3000) for y in (f"@@ -{k + 1},1 +{k + 1},2 @@", " a", "+b")] + ["--- a/y.py", "+++ b/y.py", "@@ -1 +1 @@"]
    got = texts.parse_unified_diff(lines(spark, "\n".join(body), "diff")).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in got} == {"x.py": 3000, "y.py": 1}


def test_numstat(spark):
    d = "\x1f"
    log = f"before\na1{d}a{d}me{d}today{d}one\n\n3\t1\t./x.py\n-\t-\tp.png\nb2{d}b{d}me{d}today{d}two\nc3{d}c{d}you{d}today{d}three\n1\t0\ty.py"
    got = {r.commit: (r.author, r.message, r.files, r.insertions, r.deletions) for r in texts.parse_numstat(lines(spark, log, "log")).collect()}
    assert got == {"a1": ("me", "one", ["x.py", "p.png"], 3, 1), "b2": ("me", "two", [], 0, 0), "c3": ("you", "three", ["y.py"], 1, 0)}


INDEX = [{"relative_path": "a.py", "language": "python", "occurrences": [
    {"symbol": "scip py m 1 `a`/B#", "range": [0, 0, 9, 1], "symbol_roles": 1}, {"symbol": "scip py m 1 `a`/B#c().", "range": [4, 0, 3], "symbol_roles": 1}, {"symbol": "x y z 1 D#", "range": [5, 2, 3]}, {"symbol": "x y z 1 E#", "range": [20, 0, 1], "symbol_roles": 2}],
    "symbols": [{"symbol": "B", "relationships": [{"symbol": "A", "is_implementation": True}]}]}]


def test_symbol_index(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"documents": INDEX}))
    docs = symbols.read_json(spark, str(tmp_path / "i.json"))
    o = {(r.role, r.line_start, r.line_end, r.symbol[-3:]) for r in symbols.occurrences(docs).collect()}
    assert o == {("definition", 1, 10, "/B#"), ("definition", 5, 5, "c()."[1:]), ("reference", 6, 6, " D#"), ("import", 21, 21, " E#")}
    assert [tuple(r) for r in symbols.relations(docs).collect()] == [("a.py", "B", "A", "implements")]
    owners = {r.symbol[-2:]: r.owner for r in symbols.enclosed(symbols.occurrences(docs), lines=3).collect()}
    # the last definition before D ended in its own line, and so does not cover it
    assert owners == {"D#": None, "E#": None}
    journal = spark.createDataFrame([("a.py", "d1")], "path string, digest string")
    rows = symbols.as_evidence(docs, journal, "scip", "run", 5).collect()
    assert sorted(r.relation for r in rows) == ["defines", "defines", "implements", "imports", "references"] and {r.snapshot for r in rows} == {"d1"}
    assert [r.name for r in symbols.search_symbols(docs, "B", 5).collect()] == ["B"]
    assert {(r.path, r.indexed) for r in symbols.index_coverage(docs, spark.createDataFrame([("a.py",), ("b.py",)], "path string")).collect()} == {("a.py", True), ("b.py", False)}
    assert symbols.index_usages(docs, "x y z 1 D#").count() == 1


def test_binary_index(spark):
    from loomgraph.operators.export import field, index_bytes, symbol_index

    nodes = spark.createDataFrame([("f", "a.py", "function", "run", "a.run", "def run()", 3, 9), ("g", "a.py", "class", "G", "a.G", None, 1, 1), ("h", "b.py", "method", "G.m", "b.G.m", "", 2, 4)], "id string, path string, kind string, symbol string, fqn string, body string, line_start int, line_end int")
    edges = spark.createDataFrame([("h", "g", "extends", 2), ("f", "h", "calls", 5)], "src string, dst string, relation string, line int")
    docs = [bytes(r.document) for r in symbol_index(nodes, edges, "/p").collect()]
    data = index_bytes(docs, "/p")
    got = {d["relative_path"]: d for d in symbols.parse_index(data)}
    assert set(got) == {"a.py", "b.py"}
    assert [o["range"] for o in got["a.py"]["occurrences"]] == [[0, 0, 1], [2, 0, 8, 3], [4, 0, 1]]
    assert [r["is_implementation"] for s in got["b.py"]["symbols"] for r in s["relationships"]] == [True]
    assert sorted(r.relative_path for r in symbols.read_binary(spark.createDataFrame([(bytearray(data),)], "content binary")).collect()) == ["a.py", "b.py"]
    for cut in (1, len(data) // 2, len(data) - 1):
        try:
            symbols.parse_index(data[:cut])
            raise AssertionError("a cut index was read")
        except symbols.Damaged:
            pass
    assert list(symbols.fields(field(300, 1 << 40))) == [(300, 0, 1 << 40)]


def test_symbol_strings(spark):
    p = symbols.parse_symbol("scip-python python pkg 0.1.0 core/`my file`/Pay#charge().")
    assert (p["scheme"], p["manager"], p["package"], p["version"], p["name"], p["kind"], p["parent"], p["fqn"]) == ("scip-python", "python", "pkg", "0.1.0", "charge", "method", "Pay", "core.my file.Pay.charge")
    assert symbols.parse_symbol("local 1")["is_local"] and symbols.parse_symbol("a b c d x/Y#")["kind"] == "class"
    got = spark.createDataFrame([("a b c 1 m/F#g().",)], "s string").select(symbols.parsed_symbol(F.col("s")).alias("p")).first().p
    assert (got.name, got.parent) == ("g", "F")
    assert symbols.characters(3, "a\U0001F600b") == 2


def test_ignore_rules():
    r = files.IgnoreRules([("", "*.log2"), ("", "/top"), ("", "docs/**/x.txt"), ("sub", "only.py"), ("", "out/"), ("", "!out/keep.py"), ("", "# note"), ("", "a?c"), ("", "[!x]y.z")])
    cases = {
        "a.log2": True, "d/a.log2": True, "top/x": True, "d/top/x": False, "docs/q/w/x.txt": True, "docs/x.txt": True, "sub/only.py": True, "only.py": False, "subway/only.py": False, "out/a.py": True, "out/keep.py": False, "abc": True, "abbc": False,
        "qy.z": True, "xy.z": False, "node_modules/a.js": True, "x.pyc": True, "src/a.py": False, "": False,
    }
    assert {p: r.ignored(p) for p in cases} == cases
    assert r.ignored("my_env", folder=True) and not r.ignored("environment", folder=True)
    assert files.looks_like_environment("x", ("pyvenv.cfg",)) and not files.looks_like_environment("x")


def test_settings_and_paths(tmp_path):
    (tmp_path / "a.toml").write_text("depth = 3\nfast = 'yes'\n")
    assert files.settings({"depth": 2, "fast": False, "mode": "x"}, [str(tmp_path / "a.toml"), "none"], {"mode": "y"}, {"mode": ("x", "y")}) == {"depth": 3, "fast": True, "mode": "y"}
    for bad in ({"fast": "perhaps"}, {"mode": "z"}, {"other": 1}):
        try:
            files.settings({"depth": 2, "fast": False, "mode": "x"}, [], bad, {"mode": ("x", "y")})
            raise AssertionError(bad)
        except (ValueError, KeyError):
            pass
    assert files.unquote('"a\\tb\\303\\251"') == "a\tbé" and files.unquote("plain") == "plain"
    (tmp_path / "p/q/.mark").mkdir(parents=True)
    (tmp_path / "p/q/r/.mark").mkdir(parents=True)
    assert files.projects(str(tmp_path), ".mark") == [str(tmp_path / "p/q")]


def test_read_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.py").write_text("x = 1\n")
    (tmp_path / "s/b.log").write_text("no")
    rows = files.read_files(spark, str(tmp_path), rules=files.IgnoreRules()).collect()
    assert [(r.path, r.size, bytes(r.content)) for r in rows] == [("s/a.py", 6, b"x = 1\n")]


def test_python_extraction(spark):
    code = "import os.path as p\nfrom .m import q\nclass A:\n  def f(self):\n    self.g(); q()\n  def g(self): pass\nclass B(A): pass\ndef h(): A()\n"
    got = python_code.tables(python_code.extract(spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.py", None)], "path string, text string")))
    assert {r.symbol for r in got["nodes"].collect() if r.kind != "file"} == {"A", "A.f", "A.g", "B", "h"}
    e = {(r.src.split(":")[-1], r.relation, r.dst.split(":")[-1]) for r in got["edges"].collect() if r.relation != "defines"}
    assert e == {("A.f", "calls", "A.g"), ("B", "extends", "A"), ("h", "calls", "A")}
    assert ("q", ".m") in {(r.dst_symbol, r.import_source) for r in got["pending"].collect()}


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_names_and_paths(spark):
    rel = lambda s, m, p: one(spark, texts.resolve_relative(F.lit(s), F.lit(m), F.lit(p)))
    assert [rel(".x", "a.b.c", False), rel("..x", "a.b", False), rel(".", "a.b", True), rel("z.y", "a", False)] == ["a.b.x", "", "a.b", "z.y"]
    assert one(spark, texts.dotted_module(F.lit("src/a/b/__init__.py"))) == "a.b"
    assert one(spark, texts.module_names(F.lit("src/a/b/c.py"))) == ["c", "b.c", "a.b.c"]
    assert one(spark, texts.normalise_path(F.lit(".\\a//./b/"))) == "a/b"
    fold = lambda x: one(spark, identity.canonical_relation(F.lit(x)))
    assert [fold(x) for x in ("call:virtual", "weird", "uses", "references", "extends", "inherits", " ")] == ["CALLS", "WEIRD", "CALLS", "CALLS", "INHERITS", "INHERITS", ""]
    assert one(spark, texts.keywords(F.lit("parseHTTP_request"))) == ["parseHTTP_request", "parseHTTP", "request", "parse"]
    assert [one(spark, texts.is_test_path(F.lit(p))) for p in ("tests/a.py", "a/test_b.py", "a/b.spec.ts", "a/contest.py")] == [True, True, True, False]
    assert one(spark, texts.language(F.lit("a/b.RS"))) == "rust"
