"""Lookups by name and unresolved references."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import resolve
from loomgraph.plans.registry import query

_STEM = "CASE WHEN parts[-1] = '__init__.py' THEN parts[:-2] ELSE list_append(parts[:-2], regexp_replace(parts[-1], '\\.pyi?$', '')) END"
_NAMES = f"SELECT path, unnest(list_transform(range(1, least(len(stem), 8) + 1), lambda k: array_to_string(stem[-k:], '.'))) AS name FROM (SELECT path, {_STEM} AS stem FROM (SELECT path, list_filter(string_split(path, '/'), lambda z: z <> '') AS parts FROM {{}}))"

#: The tiers, step by step; the only relative imports of the table climb one level from a plain file.
RESOLVED = f"""WITH paths AS (SELECT DISTINCT path FROM <nodes>), nm AS ({_NAMES.format("paths")}), names AS (SELECT DISTINCT name FROM nm), rn AS (SELECT * FROM <rich>),
np AS (SELECT path, name FROM ({_NAMES.format("(SELECT DISTINCT path FROM rn WHERE path <> '')")})),
p AS (SELECT *, CASE WHEN import_source IS NULL THEN '' WHEN import_source LIKE '.%' THEN concat(split_part(path, '/', 2), import_source) ELSE import_source END AS imp, string_split(receiver, ':')[-1] AS cls, path[1:length(path) - length(string_split(path, '/')[-1]) - 1] AS folder FROM <refs>),
ext AS (SELECT DISTINCT imp FROM p WHERE imp <> '' AND imp NOT IN (SELECT name FROM names) AND NOT EXISTS (SELECT 1 FROM names WHERE starts_with(name, concat(p.imp, '.')) OR starts_with(p.imp, concat(name, '.')))),
ix AS (SELECT symbol AS sym, id, path AS loc FROM rn WHERE symbol IS NOT NULL UNION ALL SELECT fqn, id, path FROM rn WHERE fqn IS NOT NULL AND fqn <> symbol),
c AS (SELECT sym, count(*) AS n, min(id) AS only_id, min(loc) AS only_at FROM ix GROUP BY sym),
ms AS (SELECT split_part(symbol, '.', 1) AS owner, split_part(symbol, '.', 2) AS method, min(id) AS id FROM rn WHERE kind = 'method' AND contains(symbol, '.') GROUP BY 1, 2),
t1 AS (SELECT cls, method, arg_min(id, owner) AS id FROM (SELECT DISTINCT cls FROM p WHERE cls IS NOT NULL) k JOIN ms ON owner >= cls GROUP BY 1, 2),
br AS (SELECT e.path, n.id, n.symbol, n.path AS of FROM <rich_edges> e JOIN rn n ON n.id = e.dst WHERE relation = 'imports'),
t2 AS (SELECT np2.name AS imp, br.symbol, min(br.id) AS id FROM br JOIN ({_NAMES.format("(SELECT DISTINCT path FROM <rich_edges>)")}) np2 ON np2.path = br.path WHERE br.symbol <> '' GROUP BY 1, 2),
pl AS (SELECT sym, loc, count(*) AS k, min(id) AS id FROM ix GROUP BY 1, 2),
t3 AS (SELECT q.imp, q.dst_symbol, sum(k) AS n, min(id) AS id FROM (SELECT DISTINCT imp, dst_symbol FROM p WHERE imp <> '') q JOIN pl ON sym = dst_symbol WHERE EXISTS (SELECT 1 FROM np WHERE np.path = pl.loc AND starts_with(np.name, q.imp)) GROUP BY 1, 2),
mo AS (SELECT DISTINCT br.path, np.name AS m FROM br JOIN np ON np.path = br.of UNION SELECT path, import_source FROM p WHERE relation = 'imports' AND import_source IN (SELECT name FROM names)),
t3b AS (SELECT q.path, q.dst_symbol, sum(k) AS n, min(id) AS id FROM (SELECT DISTINCT path, dst_symbol FROM p JOIN c ON c.sym = dst_symbol WHERE imp = '' AND c.n > 1) q JOIN pl ON sym = dst_symbol
  WHERE EXISTS (SELECT 1 FROM np JOIN mo ON starts_with(np.name, mo.m) WHERE np.path = pl.loc AND mo.path = q.path) GROUP BY 1, 2),
t3c AS (SELECT sym, loc[1:length(loc) - length(string_split(loc, '/')[-1]) - 1] AS folder, sum(k) AS n, min(id) AS id FROM pl GROUP BY 1, 2),
t5 AS (SELECT name, count(*) AS n, min(id) AS id FROM rn JOIN np ON np.path = rn.path WHERE kind = 'file' GROUP BY 1),
x AS (SELECT p.*, ext.imp IS NOT NULL AS outside, c.n, CASE WHEN t1.id IS NOT NULL THEN struct_pack(t := 'receiver', g := t1.id) WHEN p.imp <> '' AND t2.id IS NOT NULL THEN struct_pack(t := 're_export', g := t2.id)
    WHEN p.imp <> '' AND t3.n = 1 THEN struct_pack(t := 'import', g := t3.id) WHEN p.imp <> '' AND t3.n > 1 THEN struct_pack(t := 'import', g := cast(NULL AS varchar))
    WHEN p.imp = '' AND c.n > 1 AND t3b.n = 1 THEN struct_pack(t := 'caller_import', g := t3b.id) WHEN p.imp = '' AND c.n > 1 AND t3c.n = 1 THEN struct_pack(t := 'folder', g := t3c.id)
    WHEN c.n = 1 AND c.only_at <> p.path THEN struct_pack(t := 'unique', g := c.only_id) WHEN p.imp <> '' AND p.relation = 'imports' AND t5.n = 1 THEN struct_pack(t := 'file', g := t5.id) END AS ch
  FROM p LEFT JOIN ext ON ext.imp = p.imp LEFT JOIN c ON c.sym = p.dst_symbol LEFT JOIN t1 ON t1.cls = p.cls AND t1.method = p.dst_symbol LEFT JOIN t2 ON t2.imp = p.imp AND t2.symbol = p.dst_symbol
  LEFT JOIN t3 ON t3.imp = p.imp AND t3.dst_symbol = p.dst_symbol LEFT JOIN t3b ON t3b.path = p.path AND t3b.dst_symbol = p.dst_symbol LEFT JOIN t3c ON t3c.sym = p.dst_symbol AND t3c.folder = p.folder LEFT JOIN t5 ON t5.name = p.imp),
r AS (SELECT path, src, dst_symbol, relation, line, import_source, receiver, CASE WHEN outside THEN 'EXTERNAL' WHEN ch.g IS NOT NULL THEN 'RESOLVED' WHEN n > 1 OR ch IS NOT NULL THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS state,
  CASE WHEN NOT outside AND ch.g IS NOT NULL THEN ch.t END AS tier, CASE WHEN NOT outside THEN ch.g END AS target FROM x)"""


def _resolved(t, **only):
    return resolve.resolve_pending(t("refs"), t("rich"), t("rich_edges"), t("nodes").select("path").distinct(), **only)


@query(RESOLVED + " SELECT * FROM r")
def pending_resolution_tiers(t):
    return _resolved(t)


@query(RESOLVED + " SELECT * FROM r WHERE dst_symbol IN ('m3', 'unknown symbol') OR path = 'src/asia/nation_7'")
def pending_scoped(t):
    return _resolved(t, symbols=["m3", "unknown symbol"], path="src/asia/nation_7")


@query(RESOLVED + " SELECT path, src, target AS dst, relation, max(line) AS line FROM r WHERE state = 'RESOLVED' GROUP BY 1, 2, 3, 4")
def pending_promoted(t):
    return resolve.promoted(_resolved(t))[0]


@query(RESOLVED + " SELECT state, relation, count(*) AS n, cast(grouping(state) AS int) AS g_state FROM r GROUP BY GROUPING SETS ((state), (relation))")
def pending_state_grouping_sets(t):
    r = _resolved(t)
    return r.groupingSets([[F.col("state")], [F.col("relation")]], "state", "relation").agg(F.count(F.lit(1)).alias("n"), F.grouping("state").cast("int").alias("g_state"))


_ASKED = ["small ring", "Base2.m1", "m1", "NATION_3", "src.asia.nation_3", "Customer#000000001", "nothing of the kind", "Base3.m3", "nation_3", "Supplier#000000007", "part:5", "note NATION_4"]
ASKED = "q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _ASKED) + "]) AS query)"


def _asked(t):
    return t.spark.createDataFrame([(x,) for x in _ASKED], "query string")


@query("SELECT id, path, kind, symbol, fqn, label, body, line_start, line_end, updated_at FROM <rich> WHERE id IN ('part:5', 'note:4', 'sup:3', 'none')")
def node_by_id(t):
    return t("rich").where(F.col("id").isin("part:5", "note:4", "sup:3", "none"))


@query(f"""WITH {ASKED}, o AS (SELECT query, id, CASE WHEN symbol = query OR fqn = query THEN 0 ELSE 1 END AS rank FROM <rich> r JOIN q ON symbol = query OR fqn = query OR ends_with(symbol, concat('.', query)) OR ends_with(fqn, concat('.', query)))
SELECT query, arg_min(id, struct_pack(k := rank, i := id)) AS id FROM o GROUP BY query""")
def node_by_symbol(t):
    return resolve.node_by_symbol(t("rich"), _asked(t))


@query(f"""WITH {ASKED}, n AS (SELECT query, count(id) AS n, min(id) AS id FROM q LEFT JOIN <rich> r ON r.symbol = q.query OR r.fqn = q.query GROUP BY query)
SELECT query, CASE n WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN id END AS id, n FROM n""")
def symbol_identity(t):
    return resolve.symbol_identity(t("rich"), _asked(t))


_NEAR = "contains(lower({0}), lower(query))"


@query(f"""WITH {ASKED}, o AS (SELECT query, id, kind, 0 AS tier FROM <rich> r JOIN q ON symbol = query UNION ALL SELECT query, id, kind, 1 FROM <rich> r JOIN q ON {_NEAR.format('label')} OR {_NEAR.format('fqn')}),
m AS (SELECT query, min(struct_pack(t := tier, k := kind, i := id)) AS m FROM o GROUP BY query) SELECT query, m.i AS id, cast(m.t AS int) AS tier FROM m""")
def resolve_symbol(t):
    return resolve.resolve_symbol(t("rich"), _asked(t))


@query(f"""WITH {ASKED}, e AS (SELECT DISTINCT query, id, kind, 0 AS tier FROM <rich> r JOIN q ON symbol = query OR fqn = query),
o AS (SELECT * FROM e UNION ALL SELECT query, id, kind, 1 FROM <rich> r JOIN q ON {_NEAR.format('label')} OR {_NEAR.format('fqn')} OR {_NEAR.format('symbol')} OR {_NEAR.format('path')} WHERE query NOT IN (SELECT query FROM e))
SELECT * FROM (SELECT query, id, cast(tier AS int) AS tier, cast(row_number() OVER (PARTITION BY query ORDER BY kind DESC, id) AS int) AS place FROM o) WHERE place <= 20""")
def matching_nodes(t):
    return resolve.matching_nodes(t("rich"), _asked(t))


_DOMINANT = """h AS (SELECT dst AS id, count(*) AS refs FROM <edges> WHERE relation <> 'defines' GROUP BY dst),
d AS (SELECT query, id, refs FROM (SELECT query, id, refs, row_number() OVER (PARTITION BY query ORDER BY refs DESC, id) AS n, lead(refs) OVER (PARTITION BY query ORDER BY refs DESC, id) AS nx FROM cand JOIN h USING (id)) WHERE n = 1 AND (nx IS NULL OR refs >= 2 * nx))"""


@query(f"WITH cand AS (SELECT path AS query, id FROM <nodes> WHERE kind = 'class'), {_DOMINANT} SELECT * FROM d")
def dominant_candidate(t):
    return resolve.dominant(t("nodes").where("kind = 'class'").select(F.col("path").alias("query"), "id"), t("edges"))


@query(f"""WITH {ASKED}, nn AS (SELECT id, symbol, fqn FROM <rich> WHERE kind <> 'file'), o AS (SELECT query, id, 0 AS tier FROM nn JOIN q ON fqn = query UNION SELECT query, id, 1 FROM nn JOIN q ON ends_with(fqn, concat('.', query)) OR starts_with(fqn, concat(query, '.'))
  UNION SELECT query, id, 2 FROM nn JOIN q ON symbol = query), b AS (SELECT query, min(tier) AS tier FROM o GROUP BY query), a AS (SELECT o.* FROM o JOIN b ON b.query = o.query AND b.tier = o.tier),
k AS (SELECT query, tier, count(*) AS n, min(id) AS one FROM a GROUP BY 1, 2), cand AS (SELECT query, id FROM a WHERE tier > 0), {_DOMINANT}
SELECT q.query, CASE WHEN n IS NULL THEN 'TARGET_NOT_FOUND' WHEN n = 1 THEN 'FOUND' WHEN d.id IS NOT NULL THEN 'AUTO_RESOLVED' ELSE 'AMBIGUOUS_TARGET' END AS status, CASE WHEN n = 1 THEN one ELSE d.id END AS id, cast(tier AS int) AS tier
FROM q LEFT JOIN k ON k.query = q.query LEFT JOIN d ON d.query = q.query""")
def find_target(t):
    return resolve.find_target(t("rich"), t("edges"), _asked(t))


@query(f"""WITH {ASKED}, o AS (SELECT query, id, 0 AS tier FROM <rich> r JOIN q ON id = query UNION ALL SELECT query, id, 1 FROM <rich> r JOIN q ON symbol = query UNION ALL SELECT query, id, 2 FROM <rich> r JOIN q ON {_NEAR.format('label')} OR {_NEAR.format('fqn')}),
m AS (SELECT query, min(struct_pack(t := tier, i := id)) AS m FROM o GROUP BY query) SELECT query, m.i AS id, cast(m.t AS int) AS tier FROM m""")
def target_row(t):
    return resolve.target_row(t("rich"), _asked(t))


@query(f"""WITH {ASKED}, o AS (SELECT query, id, kind, 0 AS tier FROM <rich> r JOIN q ON symbol = query UNION ALL SELECT query, id, kind, 1 FROM <rich> r JOIN q ON ({_NEAR.format('label')} OR {_NEAR.format('fqn')}) AND kind <> 'file'),
m AS (SELECT query, min(struct_pack(t := tier, k := kind, i := id)) AS m FROM o GROUP BY query) SELECT query, m.i AS id FROM m WHERE m.i IN (SELECT id FROM <rich> WHERE kind NOT IN ('file', 'note', 'markdown') AND path <> '')""")
def resolve_focus(t):
    return resolve.focus(t("rich"), _asked(t))


@query("SELECT id, label, updated_at FROM <rich> WHERE kind = 'note' AND (contains(lower(label), 'nation_1') OR contains(lower(body), 'nation_1')) ORDER BY updated_at DESC, id LIMIT 8")
def notes_newest(t):
    return resolve.notes(t("rich"), "NATION_1", 8).select("id", "label", "updated_at")


@query("""SELECT * FROM (SELECT path, id, symbol, cast(row_number() OVER (PARTITION BY path ORDER BY line_start, id) AS int) AS place FROM <nodes> WHERE kind <> 'file' AND symbol <> '' AND path IN (SELECT path FROM <hunks>)) WHERE place <= 5""")
def touched_symbols(t):
    return resolve.touched_symbols(t("hunks"), t("nodes"))
