"""Diffs, logs, names, decisions, providers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import joins, providers, resolve, stats, traverse, trust
from loomgraph.plans.registry import query
from loomgraph.shared import shared_dir
from loomgraph.sources import python_code, texts
from loomgraph.streaming import changes


@query("""SELECT user_id AS diff, concat('src/f', event_id % 50, '.py') AS path, cast(CASE WHEN event_id % 9 = 0 OR event_id % 5 = 0 THEN 1 + event_id % 70 ELSE 3 + event_id % 70 END AS int) AS line_start,
  cast(CASE WHEN event_id % 9 = 0 OR event_id % 5 = 0 THEN 4 + event_id % 70 ELSE 2 + event_id % 70 + event_id % 5 END AS int) AS line_end FROM events""")
def diff_hunks(t):
    return texts.parse_unified_diff(t("diffs"))


_PATHS = """CASE l_partkey % 12 WHEN 0 THEN 'src/auth/login.py' WHEN 1 THEN 'package.json' WHEN 2 THEN concat('db/migration/v', l_suppkey, '.sql') ELSE concat('src/f', l_partkey, '.py') END"""
_CHANGES = f"""ch AS (SELECT concat('h', l_orderkey) AS commit, {_PATHS} AS path, CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE cast(l_quantity * 2 AS int) END AS ins, cast(l_quantity AS int) AS del, l_orderkey FROM lineitem)"""


@query(f"""WITH {_CHANGES} SELECT concat('log', o_orderkey % 3) AS log, concat('h', o_orderkey) AS commit, concat('author', o_custkey % 7) AS author, o_orderpriority AS message, (SELECT count(*) FROM ch WHERE l_orderkey = o_orderkey) AS files,
  cast(coalesce((SELECT sum(ins) FROM ch WHERE l_orderkey = o_orderkey), 0) AS bigint) AS insertions, cast(coalesce((SELECT sum(del) FROM ch WHERE l_orderkey = o_orderkey), 0) AS bigint) AS deletions FROM orders""")
def log_commits(t):
    return texts.parse_numstat(t("log")).select("log", "commit", "author", "message", F.size("files").cast("long").alias("files"), "insertions", "deletions")


#: Symbols of changed files: parts whose file is named after them.
_NAMED = "nf AS (SELECT concat('src/f', p_partkey, '.py') AS path, p_name AS symbol, concat('part:', p_partkey) AS id FROM part)"


def _named(t):
    p = t("part")
    key = F.col("p_partkey").cast("string")
    return p.select(F.concat(F.lit("part:"), key).alias("id"), F.concat(F.lit("src/f"), key, F.lit(".py")).alias("path"), F.lit("function").alias("kind"), F.col("p_name").alias("symbol"), F.lit(1).alias("line_start"))


@query(f"""WITH {_CHANGES}, {_NAMED}, rf AS (SELECT nf.symbol, count(*) AS n FROM <edges> e JOIN nf ON nf.id = e.dst WHERE relation <> 'defines' GROUP BY 1), tc AS (SELECT commit, symbol, row_number() OVER (PARTITION BY commit ORDER BY path, nf.id) AS place FROM (SELECT DISTINCT commit, path FROM ch) c JOIN nf USING (path)),
cr AS (SELECT DISTINCT commit FROM tc JOIN rf ON rf.symbol = tc.symbol WHERE place <= 3 AND n >= 5), cm AS (SELECT concat('h', o_orderkey) AS commit, count(ch.path) AS files, coalesce(sum(ins + del), 0) AS churn, count(*) FILTER (path LIKE '%auth%' OR path LIKE '%migration%') AS cri, count(*) FILTER (path = 'package.json') AS cfg FROM orders LEFT JOIN ch ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT *, commit IN (SELECT commit FROM cr) AS core, CASE WHEN files > 15 THEN 4 WHEN files > 5 THEN 2 ELSE 0 END + CASE WHEN churn > 800 THEN 4 WHEN churn > 250 THEN 2 ELSE 0 END + CASE WHEN cri > 0 THEN 4 ELSE 0 END + CASE WHEN cfg > 0 THEN 2 ELSE 0 END + CASE WHEN commit IN (SELECT commit FROM cr) THEN 3 ELSE 0 END AS points FROM cm)
SELECT commit, files, cast(churn AS bigint) AS churn, cast(points AS int) AS points, CASE WHEN points >= 5 THEN 'HIGH' WHEN points >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p""")
def commit_risk(t):
    rows = texts.numstat_rows(t("log"))
    named = _named(t)
    touched = rows.where("path is not null").select("commit", "path").distinct().join(resolve.touched_symbols(rows.select("path"), named), "path")
    place = Window.partitionBy("commit").orderBy("path", "id")
    touched = touched.select("commit", "symbol", F.row_number().over(place).alias("place"))
    references = t("edges").where("relation <> 'defines'").join(named.select(F.col("id").alias("dst"), "symbol"), "dst").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return trust.commit_risks(rows, touched, references).drop("reasons")


@query(f"""WITH {_CHANGES}, cm AS (SELECT concat('h', o_orderkey) AS commit, count(ch.path) AS files, coalesce(sum(ins + del), 0) AS churn, count(*) FILTER (path LIKE '%auth%' OR path LIKE '%migration%') AS cri, count(*) FILTER (path = 'package.json') AS cfg FROM orders LEFT JOIN ch ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT CASE WHEN files > 15 THEN 4 WHEN files > 5 THEN 2 ELSE 0 END + CASE WHEN churn > 800 THEN 4 WHEN churn > 250 THEN 2 ELSE 0 END + CASE WHEN cri > 0 THEN 4 ELSE 0 END + CASE WHEN cfg > 0 THEN 2 ELSE 0 END AS points FROM cm)
SELECT CASE WHEN points >= 5 THEN 'HIGH' WHEN points >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level, count(*) AS commits FROM p GROUP BY 1""")
def history_breakdown(t):
    return trust.commit_risks(texts.numstat_rows(t("log"))).groupBy("level").agg(F.count(F.lit(1)).alias("commits"))


_DIRECT = "dn AS (SELECT DISTINCT n.id, n.path FROM <hunks> h JOIN <nodes> n ON h.path = n.path AND n.line_start <= h.line_end AND n.line_end >= h.line_start)"


@query(f"""WITH {_DIRECT}, c AS (SELECT dn.path, count(DISTINCT e.src) AS callers FROM dn JOIN <edges> e ON e.dst = dn.id WHERE relation IN ('calls', 'extends', 'implements', 'uses', 'imports') GROUP BY 1), d AS (SELECT path, count(*) AS nodes, count(*) FILTER (id LIKE 'sup:%') AS apis FROM dn GROUP BY 1),
x AS (SELECT d.path, nodes, coalesce(callers, 0) AS callers, apis, least(5, 25) + least(8 * nodes, 30) + least(4 * coalesce(callers, 0), 25) + least(10 * apis, 20) AS score FROM d LEFT JOIN c ON c.path = d.path)
SELECT path, nodes, callers, apis, score, CASE WHEN score >= 60 OR apis >= 3 OR callers >= 10 THEN 'HIGH' WHEN score >= 25 OR callers >= 3 OR apis >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM x""")
def impact_risk_score(t):
    direct = joins.hunks_to_nodes(t("hunks"), t("nodes")).select("id", "path")
    e = t("edges").where(F.col("relation").isin(*traverse.IMPACT_RELATIONS))
    callers = e.join(direct.select(F.col("id").alias("dst"), "path"), "dst").groupBy("path").agg(F.count_distinct("src").alias("callers"))
    d = direct.groupBy("path").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.startswith("id", F.lit("sup:"))).alias("apis"))
    x = d.join(callers, "path", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return x.select("path", "nodes", "callers", "apis", trust.impact_summary(F.lit(1), F.col("nodes"), F.col("callers"), F.col("apis")).alias("s")).select("path", "nodes", "callers", "apis", "s.*")


#: Facts of a decision, dealt over the lines of all orders.
_FACTS = """SELECT l_orderkey * 7 + l_linenumber AS k, CASE l_partkey % 9 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'AMBIGUOUS' ELSE 'UNIQUE' END AS identity, l_suppkey % 7 <> 0 AS bound, l_partkey % 31 = 0 AS error, l_suppkey % 3 AS stale, l_linenumber <> 1 AS measured, CASE WHEN l_linenumber <> 2 THEN l_discount * 10 + 0.5 END AS covered,
  l_partkey % 2 AS failures, l_suppkey % 2 AS unresolved, l_partkey % 4 - 2 AS conflicts, l_linenumber = 3 AS cut, l_linenumber <> 4 AS enumerated, CASE WHEN l_linenumber <> 5 THEN l_returnflag <> 'R' END AS capable, l_returnflag = 'A' AS part, l_linestatus = 'F' AS provider, l_tax > 0.04 AS absence, l_partkey % 11 = 0 AS gate, l_suppkey % 5 = 0 AS dyn,
  CASE l_linenumber % 3 WHEN 0 THEN 'scoped' WHEN 1 THEN 'presence' ELSE 'absence' END AS profile FROM lineitem"""
_CODES = """list_filter([CASE WHEN error THEN 'collection_error' END, CASE WHEN identity = 'NOT_FOUND' THEN 'target_not_found' WHEN identity <> 'UNIQUE' THEN 'target_ambiguous' END, CASE WHEN NOT bound THEN 'snapshot_unbound' END, CASE WHEN stale > 0 THEN 'stale_sources' END, CASE WHEN conflicts > 0 THEN 'open_conflicts' END,
  CASE WHEN gate THEN 'rename_gate_blocked' END, CASE WHEN cut AND neg THEN 'transitive_truncated' WHEN cut THEN 'collection_truncated:edges_cap_500' END, CASE WHEN failures > 0 THEN 'parser_failures' END, CASE WHEN unresolved > 0 THEN 'unresolved_over_budget' END, CASE WHEN dyn THEN 'dynamic_dispatch_unresolved' END,
  CASE WHEN neg AND NOT (measured AND coalesce(covered >= 0.9, false)) THEN 'coverage_below_floor' END, CASE WHEN neg AND NOT enumerated THEN 'enumeration_incomplete' END, CASE WHEN neg AND NOT coalesce(capable, false) THEN 'parser_capability_incomplete' END, CASE WHEN neg AND part THEN 'partial_ast_ceiling' END, CASE WHEN NOT provider THEN 'provider_capability_missing' END], lambda z: z IS NOT NULL)"""


@query(f"""WITH f AS (SELECT *, absence OR profile = 'absence' AS neg FROM ({_FACTS})), r AS (SELECT k, {_CODES} AS c FROM f)
SELECT k, array_to_string(c, ',') AS reasons, CASE WHEN list_contains(c, 'target_not_found') OR list_contains(c, 'target_ambiguous') THEN 'ABSTAINED' WHEN list_contains(c, 'collection_error') OR list_contains(c, 'snapshot_unbound') THEN 'UNVERIFIABLE' WHEN list_contains(c, 'stale_sources') THEN 'STALE'
  WHEN list_contains(c, 'open_conflicts') THEN 'CONFLICTED' WHEN len(c) > 0 THEN 'PARTIAL' ELSE 'ASSURED_WITHIN_SCOPE' END AS status FROM r""")
def receipt_decision(t):
    t("lineitem").createOrReplaceTempView("lineitem")
    f = t.spark.sql(_FACTS)
    c = F.col
    negative = c("absence") | (c("profile") == "absence")
    sources = F.when(c("cut"), F.array(F.when(negative, "transitive_cap_200").otherwise("edges_cap_500"))).otherwise(F.array().cast("array<string>"))
    d = trust.decide(
        c("identity"), c("bound"), c("error"), c("stale"), c("measured"), c("covered"), c("failures"), c("unresolved"), c("conflicts"), c("cut"), sources, c("enumerated"), c("capable"), c("part"), c("provider"), c("absence"), c("gate"),
        c("dyn"), c("profile"),
    )
    return f.select("k", d.alias("d")).select("k", F.array_join("d.reason_codes", ",").alias("reasons"), "d.status")


#: The parts of each symbol of the code table, by reading the rule.
@query("""SELECT id, CASE event_id % 9 WHEN 0 THEN 'listOrders list Orders' WHEN 1 THEN 'approveOrder approve Order' WHEN 2 THEN 'hidden' WHEN 3 THEN 'exportCsv export Csv' WHEN 4 THEN 'AdminController Admin Controller' WHEN 5 THEN 'uploadFile upload File' WHEN 6 THEN 'payment' WHEN 7 THEN 'doIt do It' ELSE 'WebhookHandler Webhook Handler' END AS words FROM <code>""")
def keyword_decompose(t):
    return t("code").select("id", F.array_join(texts.keywords(F.col("symbol")), " ").alias("words"))


@query("""SELECT id, CASE regexp_extract(path, '\\.([^.]+)$', 1) WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' END AS language FROM <code>""")
def file_languages(t):
    return t("code").select("id", texts.language(F.col("path")).alias("language"))


_PY = "CASE event_id % 4 WHEN 0 THEN 'src/a/b/c.py' WHEN 1 THEN 'lib/x/__init__.py' WHEN 2 THEN 'tools/run.pyi' ELSE 'pkg/mod.go' END"


def _py(t):
    return t("events").select("event_id", F.expr(_PY).alias("path"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a.b.c' WHEN 1 THEN 'x' WHEN 2 THEN 'tools.run' ELSE 'pkg.mod.go' END AS module FROM events")
def dotted_modules(t):
    return _py(t).select("event_id", texts.dotted_module(F.col("path")).alias("module"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a a.b a.b.c c' WHEN 1 THEN 'x' WHEN 2 THEN 'run tools tools.run' ELSE 'go pkg pkg.mod pkg.mod.go' END AS names FROM events")
def module_candidates(t):
    return _py(t).select("event_id", F.array_join(F.sort_array(texts.module_candidates(F.col("path"))), " ").alias("names"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'c b.c a.b.c src.a.b.c' WHEN 1 THEN 'x lib.x' WHEN 2 THEN 'run tools.run' ELSE 'mod.go pkg.mod.go' END AS names FROM events")
def project_module_names(t):
    return _py(t).select("event_id", F.array_join(resolve.project_names(F.col("path")), " ").alias("names"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'pkg_a.hooks' WHEN 1 THEN '' WHEN 2 THEN 'pkg_a' WHEN 3 THEN 'os.path' ELSE 'pkg_a.sub.x' END AS module, CASE event_id % 5 WHEN 0 THEN 'hooks' WHEN 1 THEN 'x' WHEN 2 THEN '' WHEN 3 THEN 'os.path' ELSE 'x' END AS bare FROM events")
def relative_imports(t):
    k = F.col("event_id") % 5
    source = F.when(k == 0, ".hooks").when(k == 1, "...x").when(k == 2, ".").when(k == 3, "os.path").otherwise(".x")
    module = F.when(k == 4, "pkg_a.sub.mod").when(k == 2, "pkg_a").otherwise("pkg_a.mod")
    return t("events").select("event_id", texts.resolve_relative(source, module, k == 2).alias("module"), texts.normalise_import(source).alias("bare"))


_NAMES = "(SELECT DISTINCT concat('lib.', p_brand) AS name FROM part)"


@query(f"SELECT DISTINCT concat('lib.Brand#', l_suppkey % 9) AS imp FROM lineitem WHERE concat('lib.Brand#', l_suppkey % 9) IN (SELECT name FROM {_NAMES})")
def imports_of_the_project(t):
    imps = t("lineitem").select(F.concat(F.lit("lib.Brand#"), (F.col("l_suppkey") % 9).cast("string")).alias("imp")).distinct()
    names = t("part").select(F.concat(F.lit("lib."), "p_brand").alias("name")).distinct()
    return imps.join(names, F.col("imp") == F.col("name"), "left_semi")


@query("""SELECT id, path LIKE 'tests/%' OR regexp_matches(path, '(^|/)test_[^/]*$') AS by_path, starts_with(lower(symbol), 'test') OR regexp_matches(symbol, '(Test|Tests|IT|Spec)$') AS by_name FROM (SELECT id, path, CASE event_id % 4 WHEN 0 THEN 'testLogin' WHEN 1 THEN 'LoginIT' WHEN 2 THEN symbol ELSE 'Contest' END AS symbol FROM <code>)""")
def test_rules(t):
    n = t("code").withColumn("symbol", F.expr("CASE event_id % 4 WHEN 0 THEN 'testLogin' WHEN 1 THEN 'LoginIT' WHEN 2 THEN symbol ELSE 'Contest' END"))
    return n.select("id", texts.is_test_path(F.col("path")).alias("by_path"), texts.is_test_symbol(F.col("symbol")).alias("by_name"))


def _sources(t):
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("def f"), k, F.lit("(a):\n    return g(a)\n\nclass C(B"), k, F.lit("):\n    def m(self):\n        return self.n()\n    def n(self):\n        return f"), k, F.lit("(1)\n"))
    return t("orders").select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), F.when(F.col("o_orderkey") % 10 == 0, "def (").otherwise(text).alias("text"))


@query("""SELECT concat('src/m', o_orderkey, '.py') AS path, CASE WHEN o_orderkey % 10 = 0 THEN 'PARSE_ERROR' ELSE 'COMPLETE' END AS outcome, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('C C.m C.n f', o_orderkey) END AS symbols, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('C.m>C.n C.n>f', o_orderkey) END AS calls,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('B', o_orderkey, ' g') END AS open FROM orders""")
def python_extraction(t):
    p = python_code.extract(_sources(t))
    tail = lambda x: F.element_at(F.split(x, ":"), -1)
    symbols = F.sort_array(F.transform(F.filter("nodes", lambda n: n["kind"] != "file"), lambda n: n["symbol"]))
    calls = F.sort_array(F.transform(F.filter("edges", lambda e: e["relation"] == "calls"), lambda e: F.concat(tail(e["src"]), F.lit(">"), tail(e["dst"]))))
    return p.select("path", "outcome", F.array_join(symbols, " ").alias("symbols"), F.array_join(calls, " ").alias("calls"), F.array_join(F.sort_array(F.transform("pending", lambda x: x["dst_symbol"])), " ").alias("open"))


@query("""SELECT (SELECT count(*) FROM <files>) AS paths, (SELECT count(*) FROM <file_nodes>) AS nodes, (SELECT count(*) FROM <file_edges>) AS edges, (SELECT count(*) FROM <file_pending>) AS pending, cast(0 AS bigint) AS pending_ambiguous, (SELECT count(*) FROM <file_pending>) AS pending_unresolved""")
def graph_stats(t):
    return stats.counts(t("files"), t("file_nodes"), t("file_edges"), t("file_pending"))


@query("""SELECT 'orphaned_nodes' AS what, count(*) AS n FROM <file_nodes> WHERE kind <> 'note' AND path NOT IN (SELECT path FROM <files>) UNION ALL SELECT 'index_gap', abs((SELECT count(*) FROM <file_nodes>) - (SELECT count(*) FROM <file_nodes> WHERE kind <> 'note'))
UNION ALL SELECT concat('pending_state:', resolution_state), count(*) FROM <file_pending> GROUP BY resolution_state UNION ALL SELECT concat('pending_relation:', relation), count(*) FROM <file_pending> GROUP BY relation""")
def integrity_check(t):
    n = t("file_nodes")
    return stats.integrity(t("files"), n, t("file_pending"), n.where("kind <> 'note'").select("id"))


_PENDING = "SELECT src, dst_symbol, CASE WHEN line = 7 THEN 'extends' ELSE relation END AS relation, CASE WHEN line % 2 = 0 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS resolution_state FROM <refs>"


def _pending(t):
    r = t("refs")
    return r.select("src", "dst_symbol", F.when(F.col("line") == 7, "extends").otherwise(F.col("relation")).alias("relation"), F.when(F.col("line") % 2 == 0, "AMBIGUOUS").otherwise("UNRESOLVED").alias("resolution_state"))


@query(f"""WITH tg AS (SELECT id, symbol FROM <nodes> WHERE kind = 'function'), p AS (SELECT p.* FROM ({_PENDING}) p WHERE src IN (SELECT id FROM <nodes>)), u AS (SELECT tg.id, count(*) AS n FROM tg JOIN p ON p.dst_symbol = tg.symbol WHERE p.src <> tg.id GROUP BY 1),
s AS (SELECT dst AS id, count(*) AS n, count(DISTINCT src) AS c FROM <edges> WHERE relation <> 'defines' AND src IN (SELECT id FROM <nodes>) GROUP BY 1)
SELECT tg.id AS target, CASE WHEN u.n IS NULL THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, coalesce(s.n, 0) AS resolved, coalesce(u.n, 0) AS unresolved, coalesce(s.c, 0) AS callers FROM tg LEFT JOIN s ON s.id = tg.id LEFT JOIN u ON u.id = tg.id""")
def usages_with_risk(t):
    return joins.usages_with_risk(t("nodes"), t("edges"), _pending(t), t("nodes").where("kind = 'function'").select("id", "symbol"))


@query(f"""WITH tg AS (SELECT id AS target, symbol FROM <nodes> WHERE kind IN ('class', 'function')), p AS (SELECT * FROM ({_PENDING}) WHERE relation IN ('extends', 'implements') AND src IN (SELECT id FROM <nodes>))
SELECT target, 'base' AS side, dst AS other, relation FROM <edges> JOIN tg ON src = target WHERE relation IN ('extends', 'implements') AND dst IN (SELECT id FROM <nodes>) UNION ALL SELECT target, 'derived', src, relation FROM <edges> JOIN tg ON dst = target WHERE relation IN ('extends', 'implements') AND src IN (SELECT id FROM <nodes>)
UNION ALL SELECT target, 'pending_base', dst_symbol, relation FROM p JOIN tg ON src = target UNION ALL SELECT target, 'pending_derived', src, relation FROM p JOIN tg ON dst_symbol = symbol WHERE src <> target""")
def inheritance_around(t):
    return joins.inheritance_around(t("nodes"), t("edges"), _pending(t), t("nodes").where("kind in ('class', 'function')").select("id", "symbol"))


@query("SELECT n_name AS name, n_nationkey % 5 AS priority FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 7 <> 0 ORDER BY priority DESC, name")
def provider_ranking(t):
    k = F.col("n_nationkey")
    s = t("nation").select(F.col("n_name").alias("name"), F.when(k % 2 == 0, F.array(F.lit("trace"))).otherwise(F.array(F.lit("search"))).alias("capabilities"), (k % 5).alias("priority"), (k % 3 != 0).alias("installed"), F.lit(True).alias("healthy"), (k % 7 != 0).alias("enabled"), F.lit(False).alias("external"))
    return providers.ranked(s, "trace")


@query("SELECT 'p' AS provider, concat('pkg.', c_name) AS name, concat('src/', c_nationkey, '.py') AS path, cast(c_custkey AS int) AS line, 'class' AS kind FROM customer")
def provider_candidates(t):
    k = F.col("c_custkey").cast("string")
    json = F.concat(F.lit('{"results":[{"qualified_name":"pkg.'), "c_name", F.lit('","path":"src/'), F.col("c_nationkey").cast("string"), F.lit('.py","start_line":'), k, F.lit(',"kind":"class"}]}'))
    return providers.candidates(t("customer").select(json.alias("json")), "p")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'PARTIAL_AST' END AS outcome FROM orders")
def parser_outcomes(t):
    k = F.col("o_orderkey") % 4
    return t("orders").select("o_orderkey", providers.outcome(F.when(k == 0, "COMPLETE").when(k == 1, "PARTIAL_AST").when(k == 2, "else")).alias("outcome"))


_EVENTS = "SELECT event_id, cast(user_id AS string) AS path, ts, value AS size FROM events"


@query(f"SELECT path, arg_max(size, struct_pack(t := ts, e := event_id)) AS size, max(event_id) AS seen FROM ({_EVENTS}) GROUP BY path")
def stream_last_state(t):
    """The changes as a stream of three files, run until nothing is left, and what its state then is."""
    base = f"{shared_dir(t.spark)}/loomgraph-stream/{uuid.uuid4().hex}"
    rows = t("events").select("event_id", F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("size"))
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    changes.maintain(changes.read_changes(t.spark, f"{base}/in", "1 hour"), f"{base}/state", f"{base}/ck").start().awaitTermination()
    state = t.spark.read.parquet(f"{base}/state/gen=2")
    seen = t.spark.read.parquet(f"{base}/in").groupBy("path").agg(F.max("event_id").alias("seen"))
    return state.select("path", "size").join(seen, "path")


@query("""WITH a AS (SELECT path, size, mtime_ms FROM <files>), b AS (SELECT path, size, mtime_ms FROM <files_on_disk>) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.mtime_ms <> b.mtime_ms""")
def poll_changes(t):
    return changes.polled(t("files"), t("files_on_disk"))
