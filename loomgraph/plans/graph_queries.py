"""Communities, cycles and figures of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import community, stats
from loomgraph.plans.registry import query

_MEMBER = "m AS (SELECT id, path AS community FROM <nodes>)"


def _member(t):
    return t("nodes").select("id", F.col("path").alias("community"))


@query(f"""WITH {_MEMBER}, x AS (SELECT a.community AS from_community, b.community AS to_community, e.src, e.dst, e.relation FROM <edges> e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.community <> b.community)
SELECT from_community, to_community, n, src, dst, relation, weight FROM (SELECT *, cast(row_number() OVER (PARTITION BY from_community, to_community ORDER BY src, dst, relation) AS int) AS n, count(*) OVER (PARTITION BY from_community, to_community) AS weight FROM x) WHERE n <= 3""")
def cross_community_top3(t):
    return community.cross_community(t("edges"), _member(t))


@query("SELECT 'src' AS prefix FROM (SELECT 1)")
def path_prefix(t):
    return community.path_prefix(t("nodes").where("path like 'src/%'"))


_LABELS = """x AS (SELECT path AS community, kind, CASE WHEN path LIKE 'src/%' THEN split_part(path, '/', 2) ELSE path END AS folder FROM <nodes>), y AS (SELECT community, kind, CASE WHEN community LIKE 'src/%' THEN concat('src/', folder) ELSE 'lib' END AS folder FROM x),
k AS (SELECT community, arg_min(kind, struct_pack(a := -n, b := kind)) AS kind, min(folder) AS folder FROM (SELECT community, kind, folder, count(*) AS n FROM y GROUP BY 1, 2, 3) GROUP BY 1),
lb AS (SELECT community, concat(folder, ' (', upper(kind[1:1]), kind[2:], 's)') AS label FROM k)"""


@query(f"WITH {_LABELS} SELECT * FROM lb")
def community_labels(t):
    return community.community_labels(t("nodes"), _member(t))


_FOUND = f"""{_MEMBER}, {_LABELS}, s AS (SELECT community, count(*) AS node_count, min(id) AS first_node FROM m GROUP BY 1),
ch AS (SELECT a.community AS c, count(*) FILTER (a.community = b.community) AS i, count(*) FILTER (a.community IS DISTINCT FROM b.community) AS o FROM <edges> e JOIN m a ON a.id = e.src LEFT JOIN m b ON b.id = e.dst GROUP BY 1),
fd AS (SELECT cast(row_number() OVER (ORDER BY node_count DESC, first_node DESC) - 1 AS int) AS community_id, label, CASE WHEN coalesce(i + o, 0) = 0 THEN 1.0 ELSE round(i / (i + o), 3) END AS cohesion_score, node_count, first_node, s.community FROM s JOIN lb ON lb.community = s.community LEFT JOIN ch ON ch.c = s.community)"""


@query(f"WITH {_FOUND} SELECT community_id, label, cohesion_score, node_count, first_node FROM fd")
def community_list(t):
    return community.communities(t("nodes"), t("edges"), _member(t)).select("community_id", "label", "cohesion_score", "node_count", "first_node")


@query(f"WITH {_FOUND} SELECT community_id, node_count, sha256(list_aggregate(list_sort(l), 'string_agg', ',')) AS nodes FROM fd JOIN (SELECT community, list(id) AS l FROM m GROUP BY 1) USING (community)")
def communities_saved(t):
    member = _member(t)
    saved = community.saved_communities(community.communities(t("nodes"), t("edges"), member), member)
    return community.read_communities(saved).select("community_id", "node_count", F.sha2(F.array_join("nodes", ","), 256).alias("nodes"))


@query(f"""WITH {_MEMBER}, d AS (SELECT id, count(e) AS k FROM <nodes> n LEFT JOIN (SELECT src AS e FROM <edges> UNION ALL SELECT dst FROM <edges>) x ON x.e = n.id GROUP BY id), x AS (SELECT a.community AS ca, b.community AS cb FROM <edges> e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst), t AS (SELECT count(*) AS m FROM x),
q AS (SELECT c, sum(i) AS i, count(*) AS d FROM (SELECT ca AS c, CASE WHEN ca = cb THEN 1 ELSE 0 END AS i FROM x UNION ALL SELECT cb, 0 FROM x) GROUP BY c), z AS (SELECT (SELECT count(*) FROM <nodes>) AS node_count, (SELECT count(*) FROM <edges>) AS edge_count, (SELECT count(*) FROM <nodes> WHERE kind = 'file') AS file_count)
SELECT node_count, edge_count, file_count, node_count - file_count AS symbol_count, round(edge_count / (node_count * (node_count - 1)), 6) AS density, round(2 * edge_count / node_count, 2) AS average_degree, (SELECT max(k) FROM d) AS max_degree, (SELECT count(*) FROM d WHERE k = 0) AS isolated_nodes,
  (SELECT count(DISTINCT community) FROM m) AS community_count, (SELECT round(sum(i / m - power(d / (2 * m), 2)), 4) FROM q, t) AS modularity FROM z""")
def graph_profile(t):
    return community.graph_profile(t("nodes"), t("edges"), _member(t))


@query()
def focus_suggestions(t):
    """Text of the rows that hub_nodes, community_list and graph_profile give; by pytest."""
    member = _member(t)
    return community.suggestions(community.graph_profile(t("nodes"), t("edges"), member), stats.hubs(t("nodes"), t("edges")), community.communities(t("nodes"), t("edges"), member))


@query()
def louvain_communities(t):
    """By pytest: planted groups, and modularity against plain local moving."""
    return community.louvain(t("code").select("id"), t("code_edges"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM <code_edges>), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT a AS id, min(least(a, b)) AS component FROM (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a) GROUP BY a""")
def cycle_components(t):
    return community.components_of_cycles(t("code"), t("code_edges"))


@query()
def cycles(t):
    """By pytest against a plain search for shortest cycles."""
    return community.cycles(t("code"), t("code_edges"))
