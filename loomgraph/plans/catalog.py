"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import joins, ledger, stats, traverse, trust
from loomgraph.plans.registry import ORACLES, QUERIES, query
from loomgraph.schemas import ANALYTICS_ROUNDS
from loomgraph.streaming import changes

DEGREE = """WITH o AS (SELECT src AS id, count(*) AS n FROM <edges> GROUP BY src), i AS (SELECT dst AS id, count(*) AS n FROM <edges> GROUP BY dst),
d AS (SELECT nodes.id, kind, cast(coalesce(o.n, 0) AS bigint) AS out_degree, cast(coalesce(i.n, 0) AS bigint) AS in_degree, cast(coalesce(o.n, 0) + coalesce(i.n, 0) AS bigint) AS total_degree
  FROM <nodes> nodes LEFT JOIN o ON o.id = nodes.id LEFT JOIN i ON i.id = nodes.id)"""


@query(DEGREE + """, s AS (SELECT avg(total_degree) AS mean, stddev_pop(total_degree) AS dev, count(*) AS n FROM d),
h AS (SELECT * FROM d, s WHERE n >= 3 AND total_degree >= greatest(4.0, mean + 1.5 * dev)), b AS (SELECT src AS a, dst AS id FROM <edges> WHERE src <> dst UNION SELECT dst, src FROM <edges> WHERE src <> dst),
r AS (SELECT h.id AS a, b.id FROM h JOIN b ON b.a = h.id UNION SELECT h.id, c.id FROM h JOIN b ON b.a = h.id JOIN b c ON c.a = b.id), k AS (SELECT a, count(*) FILTER (id <> a) AS blast FROM r GROUP BY a)
SELECT h.id, kind, total_degree, round((total_degree - mean) / dev, 2) AS z_score, coalesce(blast, 0) AS blast_radius,
  CASE WHEN total_degree >= mean + 3 * dev OR coalesce(blast, 0) >= 0.3 * n THEN 'CRITICAL' WHEN total_degree >= mean + 2 * dev OR coalesce(blast, 0) >= 0.15 * n THEN 'HIGH' ELSE 'MEDIUM' END AS risk
FROM h LEFT JOIN k ON k.a = h.id""")  # fmt: skip
def hub_nodes(t):
    return stats.hubs(t("nodes"), t("edges"))


@query(DEGREE + " SELECT id, out_degree, in_degree, total_degree FROM d")
def degree_table(t):
    return stats.degrees(t("nodes").select("id"), t("edges"))


@query(DEGREE + " SELECT id, out_degree, in_degree, total_degree FROM d ORDER BY total_degree DESC, id LIMIT 50")
def top_degree_nodes(t):
    return stats.top_degree(t("nodes"), t("edges"))


@query("""SELECT n.c AS node_count, e.c AS edge_count, f AS file_count, n.c - f AS symbol_count, round(e.c / (n.c * (n.c - 1)), 6) AS density, round(2 * e.c / n.c, 2) AS average_degree
FROM (SELECT count(*) AS c, count(*) FILTER (kind = 'file') AS f FROM <nodes>) n, (SELECT count(*) AS c FROM <edges>) e""")
def graph_metrics(t):
    return stats.graph_metrics(t("nodes"), t("edges"))


@query("SELECT kind, path, count(*) AS n, min(line_start) AS first_line FROM <nodes> GROUP BY kind, path")
def kind_path_counts(t):
    return t("nodes").groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"), F.min("line_start").alias("first_line"))


@query("""SELECT e.dst AS target, e.src AS caller, n.path, n.kind, count(*) AS uses, min(e.line) AS first_line FROM <edges> e JOIN <nodes> n ON n.id = e.src
WHERE e.relation <> 'defines' AND e.dst IN (SELECT id FROM <nodes> WHERE kind = 'class') GROUP BY e.dst, e.src, n.path, n.kind""")
def usages_by_caller(t):
    return joins.usages(t("nodes"), t("edges"), t("nodes").where("kind = 'class'"))


@query("SELECT dst AS base, count(*) AS derived, min(src) AS first_derived, max(src) AS last_derived FROM <edges> WHERE relation IN ('extends', 'implements') GROUP BY dst")
def inheritance_edges(t):
    return joins.inheritance(t("edges"))


@query("""WITH k AS (SELECT id FROM <nodes> WHERE NOT (kind = 'class' AND line_start % 7 = 0)) SELECT src, dst, relation, line FROM <edges> e
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = e.src) OR NOT EXISTS (SELECT 1 FROM k WHERE k.id = e.dst)""")
def orphan_edges_anti(t):
    return joins.orphan_edges(t("nodes").where("not (kind = 'class' and line_start % 7 = 0)"), t("edges"))


@query("""SELECT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) AS scope, sha256(string_agg(concat(path, ':', digest, chr(10)), '' ORDER BY path, digest)) AS digest
FROM <journal> GROUP BY 1""")
def manifest_digest(t):
    return joins.manifest_digest(t("journal"))


@query("""SELECT n.id, n.path, count(*) AS hits, min(h.line_start) AS first_line, max(h.line_end) AS last_line FROM <hunks> h JOIN <nodes> n
ON h.path = n.path AND n.line_start <= h.line_end AND n.line_end >= h.line_start GROUP BY n.id, n.path""")
def hunk_node_interval_join(t):
    return joins.hunks_to_nodes(t("hunks"), t("nodes"))


@query("""WITH r AS (SELECT event_id, path, line_start AS line FROM <hunks>), d AS (SELECT * FROM <nodes> WHERE kind = 'class'),
b AS (SELECT r.event_id, max(struct_pack(l := d.line_start, i := d.id, e := d.line_end)) AS m FROM r JOIN d ON r.path = d.path AND d.line_start <= r.line GROUP BY r.event_id)
SELECT r.event_id, r.path, r.line, CASE WHEN b.m.e >= r.line THEN b.m.i END AS definition FROM r LEFT JOIN b ON b.event_id = r.event_id""")
def nearest_definition_asof(t):
    return joins.enclosing_definition(t("hunks").select("event_id", "path", F.col("line_start").alias("line")), t("nodes").where("kind = 'class'"))


#: The files of one region play the test files, in nodes and hunks alike.
_TEST_PATH = "CASE WHEN path LIKE 'src/asia/%' THEN concat('tests/', path) ELSE path END"
_HIT = "SELECT DISTINCT n.id, n.symbol FROM h JOIN n ON h.path = n.path AND n.line_start <= h.line_end AND n.line_end >= h.line_start"
_IS_TEST = "(path LIKE 'tests/%' OR lower(symbol) LIKE 'test%' OR symbol LIKE '%Test' OR symbol LIKE '%Tests' OR symbol LIKE '%IT' OR symbol LIKE '%Spec')"


@query(f"""WITH n AS (SELECT id, {_TEST_PATH} AS path, kind, symbol, line_start, line_end FROM <nodes>), h AS (SELECT {_TEST_PATH} AS path, line_start, line_end FROM <hunks>), d AS ({_HIT}),
e AS (SELECT DISTINCT src, dst FROM <edges> WHERE relation IN ('calls', 'extends', 'implements', 'uses', 'imports')),
c1 AS (SELECT src AS id, min(dst) AS via FROM e WHERE dst IN (SELECT id FROM d) AND src NOT IN (SELECT id FROM d) GROUP BY src),
c2 AS (SELECT src AS id, min(dst) AS via FROM e WHERE dst IN (SELECT id FROM c1) AND src NOT IN (SELECT id FROM d) AND src NOT IN (SELECT id FROM c1) GROUP BY src),
t AS (SELECT id, path, symbol, kind FROM n WHERE {_IS_TEST})
SELECT DISTINCT concat('test:', path) AS id, path, '' AS symbol, 'file' AS kind, 'changed_file' AS tier, cast(NULL AS varchar) AS target FROM h WHERE path LIKE 'tests/%'
UNION ALL SELECT t.id, t.path, t.symbol, t.kind, 'caller', v.symbol FROM t JOIN (SELECT * FROM c1 UNION ALL SELECT * FROM c2) c ON c.id = t.id JOIN n v ON v.id = c.via
UNION ALL SELECT t.id, t.path, t.symbol, t.kind, 'direct_edge', min(d.symbol) FROM t JOIN <edges> x ON x.src = t.id JOIN d ON d.id = x.dst WHERE d.symbol <> '' GROUP BY t.id, t.path, t.symbol, t.kind""")
def impacted_tests(t):
    moved = F.expr(_TEST_PATH)
    edges, nodes, hunks = t.together("edges", "nodes", "hunks")
    return traverse.impacted_tests(nodes.withColumn("path", moved), edges, hunks.withColumn("path", moved))


@query(f"""WITH n AS (SELECT * FROM <nodes>), h AS (SELECT * FROM <hunks>), d AS ({_HIT}), p AS (SELECT DISTINCT path FROM h),
x AS (SELECT b.id, 0 AS prio FROM n b JOIN d ON d.id = b.id WHERE b.kind <> 'file' UNION ALL SELECT e.src, 1 FROM <edges> e JOIN d ON e.dst = d.id WHERE e.relation <> 'defines'
  UNION ALL SELECT n.id, 2 FROM n JOIN p ON p.path = n.path WHERE n.kind = 'class')
SELECT id, cast(min(prio) AS int) AS prio, count(*) AS ways FROM x GROUP BY id""")
def api_or_join(t):
    n = t("nodes")
    d = joins.hunks_to_nodes(t("hunks"), n).select("id")
    direct = n.where("kind <> 'file'").join(d, "id", "left_semi").select("id", F.lit(0).alias("prio"))
    caller = t("edges").where("relation <> 'defines'").join(d.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), F.lit(1).alias("prio"))
    file = n.where("kind = 'class'").join(t("hunks").select("path").distinct(), "path").select("id", F.lit(2).alias("prio"))
    return direct.unionByName(caller).unionByName(file).groupBy("id").agg(F.min("prio").alias("prio"), F.count(F.lit(1)).alias("ways"))


@query("""WITH x AS (SELECT e.evidence_id, e.provider, e.src, e.run_id, r.created_at FROM <evidence> e JOIN <runs> r ON r.run_id = e.run_id), l AS (SELECT provider, src, arg_max(run_id, struct_pack(c := created_at, r := run_id)) AS latest FROM x GROUP BY provider, src)
SELECT evidence_id, x.provider, x.src, run_id, CASE WHEN latest <> run_id THEN latest END AS superseded_by FROM x JOIN l ON l.provider = x.provider AND l.src = x.src""")
def evidence_supersede(t):
    return ledger.supersede(t("evidence"), t("runs"))


@query("""WITH g AS (SELECT lower(src) AS src, lower(dst) AS dst, upper(relation) AS relation, snapshot, count(DISTINCT provider) AS providers, count(DISTINCT span_line) AS spans, min(span_line) AS first_span
  FROM <evidence> e WHERE e.run_id IN (SELECT run_id FROM <runs> WHERE status = 'ok') GROUP BY 1, 2, 3, 4)
SELECT *, CASE WHEN snapshot IS NULL THEN 'UNBOUND' WHEN spans > 1 THEN 'CONFLICT' WHEN spans = 1 THEN 'SUPPORTED' ELSE 'UNVERIFIED' END AS verdict FROM g""")
def evidence_union_verdict(t):
    return ledger.union_verdicts(t("evidence"), t("runs"))


@query("SELECT run_id, provider, created_at, status FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY created_at DESC, run_id DESC) AS n FROM <runs>) WHERE n <= 10")
def retention_keep_n(t):
    return ledger.keep_newest(t("runs"))


@query("""WITH b AS (SELECT src, dst, relation, min(line) AS bl FROM <edges> WHERE relation = 'calls' GROUP BY 1, 2, 3), e AS (SELECT src, dst, relation, min(span_line) AS el FROM <evidence> GROUP BY 1, 2, 3),
x AS (SELECT coalesce(b.src, e.src) AS src, coalesce(b.dst, e.dst) AS dst, coalesce(b.relation, e.relation) AS relation, bl, el FROM b FULL OUTER JOIN e ON b.src = e.src AND b.dst = e.dst AND b.relation = e.relation)
SELECT src, dst, relation, CASE WHEN bl IS NOT NULL AND el IS NOT NULL THEN CASE WHEN abs(bl - el) > 2 THEN 'span_conflict' ELSE 'agreement' END
  WHEN count(bl) OVER (PARTITION BY src, dst) > 0 AND count(el) OVER (PARTITION BY src, dst) > 0 THEN 'relation_conflict' WHEN bl IS NOT NULL THEN 'builtin_only' ELSE 'external_only' END AS bucket FROM x""")
def cross_check_buckets(t):
    return ledger.cross_check(t("edges").where("relation = 'calls'"), t("evidence").withColumnRenamed("span_line", "line"))


@query("""WITH b AS (SELECT src AS a, dst AS id, relation FROM <edges> WHERE relation <> 'defines' UNION ALL SELECT dst, src, concat('used_by (', relation, ')') FROM <edges> WHERE relation <> 'defines'),
one AS (SELECT id, relation FROM b WHERE a = 'sup:1' AND id <> 'sup:1'), f AS (SELECT DISTINCT id FROM one),
two AS (SELECT b.id, b.relation, b.a AS via FROM b JOIN f ON f.id = b.a WHERE b.id <> 'sup:1')
SELECT cast(1 AS int) AS depth, id, relation, cast(NULL AS varchar) AS via FROM one UNION ALL SELECT 2, id, relation, via FROM two""")
def explore_bfs(t):
    return traverse.explore(t("edges"), "sup:1", 2)


@query("""WITH e AS (SELECT DISTINCT src, dst FROM <edges> WHERE relation IN ('calls', 'extends', 'implements', 'uses', 'imports')), s AS (SELECT id FROM <nodes> WHERE id IN ('sup:1', 'cust:2', 'part:3')),
d1 AS (SELECT src AS id, min(dst) AS via FROM e WHERE dst IN (SELECT id FROM s) AND src NOT IN (SELECT id FROM s) GROUP BY src),
d2 AS (SELECT src AS id, min(dst) AS via FROM e WHERE dst IN (SELECT id FROM d1) AND src NOT IN (SELECT id FROM s) AND src NOT IN (SELECT id FROM d1) GROUP BY src)
SELECT id, cast(1 AS int) AS depth, via FROM d1 UNION ALL SELECT id, 2, via FROM d2""")
def reverse_impact_bfs(t):
    return traverse.reverse_impact(t("edges"), t("nodes").where("id in ('sup:1', 'cust:2', 'part:3')"), 2)


@query("""WITH b AS (SELECT DISTINCT src AS a, dst AS id FROM (SELECT src, dst FROM <steps> UNION ALL SELECT dst, src FROM <steps>) WHERE src <> dst), r AS (SELECT a, id FROM b UNION SELECT b.a, c.id FROM b JOIN b c ON c.a = b.id)
SELECT a AS id, count(*) FILTER (id <> a) AS blast FROM r GROUP BY a""")
def blast_radius_2hop(t):
    e = t("steps")
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return traverse.neighbourhood(e, ends, 2)


@query("""WITH RECURSIVE n AS (SELECT DISTINCT src AS id FROM <steps> UNION SELECT DISTINCT dst FROM <steps>), b AS (SELECT src AS a, dst AS id FROM <steps> UNION SELECT dst, src FROM <steps>),
r(id, c) AS (SELECT id, id FROM n UNION SELECT b.id, r.c FROM r JOIN b ON b.a = r.id WHERE r.c < b.id) SELECT id, min(c) AS component FROM r GROUP BY id""")
def connected_components(t):
    e = t("steps")
    return traverse.connected(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e)


def _ranks(personal: bool) -> str:
    base_sql = "CASE WHEN id IN ('part:1', 'part:2') THEN 0.5 ELSE 0.0 END" if personal else "1.0 / c"
    return f"""WITH RECURSIVE n AS (SELECT DISTINCT src AS id FROM <steps> UNION SELECT DISTINCT dst FROM <steps> UNION SELECT 'part:1' UNION SELECT 'part:2'), k AS (SELECT count(*) AS c FROM n),
o AS (SELECT src, count(*) AS d FROM <steps> GROUP BY src), z AS (SELECT id, {base_sql} AS base, o.d FROM n CROSS JOIN k LEFT JOIN o ON o.src = n.id),
r(i, id, rank) AS (SELECT 0, id, cast(base AS double) FROM z UNION ALL
  SELECT i, id, 0.15 * base + 0.85 * loose / c + 0.85 * coalesce(got, 0) FROM (SELECT cur.i + 1 AS i, z.id, z.base, k.c, (SELECT coalesce(sum(r.rank), 0) FROM r JOIN z y ON y.id = r.id WHERE y.d IS NULL) AS loose,
    (SELECT sum(r.rank / y.d) FROM r JOIN z y ON y.id = r.id JOIN <steps> s ON s.src = r.id WHERE s.dst = z.id) AS got FROM z, k, (SELECT max(i) AS i FROM r) cur WHERE cur.i < {ANALYTICS_ROUNDS}) q)
SELECT id, round(rank, 8) AS rank FROM r WHERE i = {ANALYTICS_ROUNDS}"""


@query(_ranks(False))
def pagerank(t):
    e = t("steps")
    more = e.sparkSession.createDataFrame([("part:1",), ("part:2",)], "id string")
    return traverse.pagerank(e.select(F.col("src").alias("id")).union(e.select("dst")).union(more).distinct(), e, rounds=ANALYTICS_ROUNDS)


@query(_ranks(True))
def personalised_pagerank(t):
    e = t("steps")
    start = e.sparkSession.createDataFrame([("part:1", 1.0), ("part:2", 1.0)], "id string, weight double")
    return traverse.pagerank(e.select(F.col("src").alias("id")).union(e.select("dst")).union(start.select("id")).distinct(), e, start, rounds=ANALYTICS_ROUNDS)


_MEMBER = "m AS (SELECT id, path AS community FROM <nodes>)"


def _member(t):
    return t("nodes").select("id", F.col("path").alias("community"))


@query(f"""WITH {_MEMBER}, x AS (SELECT a.community AS ca, b.community AS cb FROM <edges> e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst), t AS (SELECT count(*) AS m FROM x),
d AS (SELECT c, sum(i) AS i, count(*) - sum(h) AS d FROM (SELECT ca AS c, CASE WHEN ca = cb THEN 1 ELSE 0 END AS i, 0 AS h FROM x UNION ALL SELECT cb, 0, 0 FROM x) GROUP BY c)
SELECT round(sum(i / m - power(d / (2 * m), 2)), 4) AS modularity FROM d, t""")
def modularity_by_label(t):
    return stats.modularity(t("edges"), _member(t))


@query(f"""WITH {_MEMBER}, x AS (SELECT a.community AS c, count(*) FILTER (a.community = b.community) AS i, count(*) FILTER (a.community IS DISTINCT FROM b.community) AS o FROM <edges> e JOIN m a ON a.id = e.src LEFT JOIN m b ON b.id = e.dst GROUP BY 1)
SELECT k.community, coalesce(i, 0) AS inner_edges, coalesce(o, 0) AS outer_edges, CASE WHEN coalesce(i + o, 0) = 0 THEN 1.0 ELSE round(i / (i + o), 3) END AS cohesion FROM (SELECT DISTINCT community FROM m) k LEFT JOIN x ON x.c = k.community""")
def community_cohesion(t):
    return stats.cohesion(t("edges"), _member(t))


@query()
def label_propagation(t):
    e = t("steps")
    return traverse.label_propagation(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e, ANALYTICS_ROUNDS)


_TRUST = """x AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'UNKNOWN' WHEN toxic = 1 THEN 'STALE' ELSE 'FRESH' END AS fresh,
  CASE WHEN quality = 1 AND d.doc_id % 2 = 0 THEN 'EXACT_SPAN' WHEN quality = 1 THEN 'EXACT_SYMBOL' ELSE 'FILE_TOKEN' END AS rel, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE (d.doc_id % 10) / 10.0 END AS cov FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _trust(t):
    d = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    fresh = F.when(F.col("quality").isNull(), "UNKNOWN").when(F.col("toxic") == 1, "STALE").otherwise("FRESH")
    rel = F.when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), "EXACT_SPAN").when(F.col("quality") == 1, "EXACT_SYMBOL").otherwise("FILE_TOKEN")
    return d.select("doc_id", fresh.alias("fresh"), rel.alias("rel"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 10 / 10).alias("cov"))


@query(f"""WITH {_TRUST}, y AS (SELECT *, CASE WHEN coalesce(cov, 0) = 0 THEN NULL ELSE cov END AS c FROM x) SELECT doc_id, CASE WHEN fresh = 'STALE' THEN 'STALE' WHEN fresh = 'UNKNOWN' THEN 'NOPATH' WHEN rel IN ('EXACT_SPAN', 'EXACT_SYMBOL') THEN 'STRONG' ELSE 'WEAK' END AS verdict,
  round(cast(CASE WHEN fresh = 'FRESH' AND rel = 'EXACT_SPAN' THEN greatest(0.95, coalesce(cov, 0)) WHEN fresh = 'FRESH' AND rel = 'EXACT_SYMBOL' THEN greatest(0.85, coalesce(cov, 0)) WHEN fresh = 'FRESH' THEN least(0.35, coalesce(c, 0.3))
   WHEN fresh = 'STALE' THEN least(0.35, coalesce(c, 0.5) / 2) ELSE least(0.5, coalesce(c, 0.4)) END AS double), 4) AS confidence FROM y""")
def trust_verdict(t):
    f, r, c = F.col("fresh"), F.col("rel"), F.col("cov")
    return _trust(t).select("doc_id", trust.verdict(f, r).alias("verdict"), F.round(trust.confidence(f, r, c), 4).alias("confidence"))


_CHANGES = "SELECT event_id, cast(user_id AS string) AS path, ts, value AS size FROM events"


def _changes(t):
    return t("events").select("event_id", F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("size"))


@query(f"""WITH c AS ({_CHANGES}), g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY path ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM c), s AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY ts) AS s FROM g)
SELECT path, cast(floor(epoch(min(ts))) AS bigint) AS first, cast(floor(epoch(max(ts))) AS bigint) AS last, count(*) AS n FROM s GROUP BY path, s""")
def change_session_fold(t):
    return changes.fold(_changes(t), "6 hours").select("path", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


@query(f"""WITH c AS (SELECT event_id, path, ts - (CASE WHEN event_id % 7 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END) AS ts FROM ({_CHANGES})), w AS (SELECT *, max(ts) OVER (PARTITION BY path ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM c)
SELECT event_id, path FROM w WHERE floor(epoch(newest)) - floor(epoch(ts)) > 86400""")
def late_change_dedup(t):
    c = _changes(t).withColumn("ts", F.when(F.col("event_id") % 7 == 0, F.col("ts") - F.expr("interval 2 days")).otherwise(F.col("ts")))
    return changes.late(c, 86_400).select("event_id", "path")


@query(f"SELECT path, arg_max(size, struct_pack(t := ts, e := event_id)) AS size, count(*) AS generation FROM ({_CHANGES}) GROUP BY path")
def generation_latest_state(t):
    return changes.latest(_changes(t)).drop("ts")


from loomgraph.plans import assurance_queries, code_queries, graph_queries, identity_queries, impact_queries, ledger_queries, resolve_queries, search_queries, upkeep_queries  # noqa: E402, F401  each registers its queries
