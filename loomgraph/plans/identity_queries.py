"""Canonical names and identities over the tables, each beside SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import identity as I
from loomgraph.plans.registry import query

#: Claims of providers: every line of an order is one.
CLAIMS = """SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string)) AS claim, CASE l_suppkey % 12 WHEN 0 THEN 'call' WHEN 1 THEN ' Calls ' WHEN 2 THEN 'usage' WHEN 3 THEN 'references' WHEN 4 THEN 'extends_class'
  WHEN 5 THEN 'implementation' WHEN 6 THEN 'call:out' WHEN 7 THEN 'imports' WHEN 8 THEN 'definition' WHEN 9 THEN 'type_of' WHEN 10 THEN ' ' END AS relation, CASE l_partkey % 5 WHEN 0 THEN 'Method' WHEN 1 THEN 'struct' WHEN 2 THEN 'package' WHEN 3 THEN 'macro' END AS kind,
  CASE l_partkey % 6 WHEN 0 THEN concat('pkg.mod', cast(l_partkey AS string), '.run()') WHEN 1 THEN concat('src/a.py.Cls.m', cast(l_partkey AS string)) WHEN 2 THEN concat('home-me-code-app.pkg.f', cast(l_partkey AS string)) WHEN 3 THEN concat('f', cast(l_partkey AS string)) WHEN 4 THEN '..a..b().' END AS name,
  CASE l_suppkey % 5 WHEN 0 THEN concat('./src//x', cast(l_suppkey AS string), '.py') WHEN 1 THEN concat('src/y/../z', cast(l_suppkey AS string), '.go') WHEN 2 THEN concat('lib\\\\w', cast(l_suppkey AS string), '.TSX') WHEN 3 THEN 'README' END AS path,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS line_start, CASE WHEN l_linenumber % 4 <> 0 THEN l_linenumber + 9 END AS line_end, l_returnflag = 'R' AS bound, l_linestatus = 'F' AS changed, l_quantity AS quantity, l_suppkey, l_partkey, l_linenumber FROM lineitem"""
_DUCK = CLAIMS.replace("\\\\", "\\")
_GIVEN = "coalesce(trim({0}), '') <> ''"


def _claims(t):
    t("lineitem").createOrReplaceTempView("lineitem")
    return t.spark.sql(CLAIMS)


_CANON = """CASE WHEN NOT (coalesce(trim(relation), '') <> '') THEN '' WHEN lower(trim(relation)) IN ('call', 'calls', 'usage', 'references', 'call:out') THEN 'CALLS' WHEN trim(relation) = 'extends_class' THEN 'INHERITS' WHEN trim(relation) = 'implementation' THEN 'IMPLEMENTS'
  WHEN trim(relation) = 'imports' THEN 'IMPORTS' WHEN trim(relation) = 'definition' THEN 'DEFINES' ELSE upper(trim(relation)) END"""


@query(f"SELECT claim, {_CANON} AS relation FROM ({_DUCK})")
def canonical_relation(t):
    return _claims(t).select("claim", I.canonical_relation(F.col("relation")).alias("relation"))


@query(f"""SELECT claim, CASE WHEN lower(trim(relation)) IN ('call', 'calls', 'imports', 'definition', 'implementation', 'extends_class', 'usage', 'references') THEN {_CANON} END AS canonical, CASE WHEN lower(trim(relation)) IN ('usage', 'references') THEN false
  WHEN lower(trim(relation)) IN ('call', 'calls', 'imports', 'definition', 'implementation', 'extends_class') THEN true END AS direct FROM ({_DUCK})""")
def relation_mapping(t):
    m = I.relation_mapping(F.col("relation"))
    return _claims(t).select("claim", m["canonical"].alias("canonical"), m["direct"].alias("direct"))


_KIND = "CASE kind WHEN 'Method' THEN 'callable' WHEN 'struct' THEN 'type' WHEN 'package' THEN 'module' WHEN 'macro' THEN 'other' ELSE '' END"


@query(f"SELECT claim, {_KIND} AS kind_class FROM ({_DUCK})")
def kind_classes(t):
    return _claims(t).select("claim", I.kind_class(F.col("kind")).alias("kind_class"))


_FQN = """CASE l_partkey % 6 WHEN 0 THEN concat('pkg.mod', l_partkey, '.run') WHEN 1 THEN concat('py.Cls.m', l_partkey) WHEN 2 THEN concat('home-me-code-app.pkg.f', l_partkey) WHEN 3 THEN concat('f', l_partkey) WHEN 4 THEN 'a.b' ELSE '' END"""


@query(f"SELECT claim, {_FQN} AS fqn FROM ({_DUCK})")
def canonical_fqn(t):
    return _claims(t).select("claim", I.canonical_fqn(F.col("name")).alias("fqn"))


_PATH = "CASE l_suppkey % 5 WHEN 0 THEN concat('src/x', l_suppkey, '.py') WHEN 1 THEN concat('src/z', l_suppkey, '.go') WHEN 2 THEN concat('lib/w', l_suppkey, '.TSX') WHEN 3 THEN 'README' END"
_LANG = "CASE l_suppkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'tsx' ELSE 'unknown' END"


@query(f"SELECT claim, {_PATH} AS path, {_LANG} AS language FROM ({_DUCK})")
def repo_paths(t):
    return _claims(t).select("claim", I.normalise_path(F.col("path")).alias("path"), I.language_of(F.col("path")).alias("language"))


def _one(f, **more):
    return f(F.col("name"), F.col("path"), F.col("kind"), F.col("line_start"), F.col("line_end"), F.lit("app"), **more)


_PARTS = "claim, {name} AS name, {path} AS path, {lang} AS language, {kind} AS kind"
_KIND2 = f"CASE WHEN {_KIND} = '' THEN 'other' ELSE {_KIND} END"


def _shown(rows, one):
    return rows.select("claim", "line_start", one.alias("i")).select("claim", "i.name", "i.path", "i.language", "i.kind", F.col("i.line_start").alias("line"))


def _identity_sql(name: str, more: str = "true") -> str:
    return f"SELECT claim, CASE WHEN k THEN name END AS name, CASE WHEN k THEN path END AS path, CASE WHEN k THEN language END AS language, CASE WHEN k THEN kind END AS kind, CASE WHEN k THEN line_start END AS line FROM (SELECT claim, {name} AS name, {_PATH} AS path, {_LANG} AS language, {_KIND2} AS kind, line_start, ({name}) <> '' AND {more} AS k FROM ({_DUCK}))"


@query(_identity_sql(f"CASE l_partkey % 6 WHEN 2 THEN concat('pkg.f', l_partkey) ELSE {_FQN} END"))
def external_identity(t):
    return _shown(_claims(t), _one(I.external_identity, root="/home/me/code/app"))


@query(_identity_sql(_FQN, "l_partkey % 6 <> 2"))
def external_identity_without_root(t):
    return _shown(_claims(t), _one(I.external_identity, root=None))


@query("SELECT id, concat(replace(path, '/', '.'), CASE WHEN kind = 'file' THEN '' ELSE concat('.', symbol) END) AS name, CASE kind WHEN 'class' THEN 'type' WHEN 'file' THEN 'file' ELSE 'callable' END AS kind FROM <nodes> WHERE path LIKE 'src/%'")
def builtin_identity(t):
    n = t("nodes").where("path like 'src/%'")
    fqn = F.concat(F.replace("path", F.lit("/"), F.lit(".")), F.when(F.col("kind") == "file", F.lit("")).otherwise(F.concat(F.lit("."), "symbol")))
    one = I.builtin_identity(F.col("path"), fqn, F.col("symbol"), F.col("kind"), F.col("line_start"), F.col("line_end"), F.lit("app"))
    return n.select("id", one.alias("i")).select("id", "i.name", "i.kind")


_MODULE = "CASE l_suppkey % 5 WHEN 0 THEN concat('src.x', l_suppkey) WHEN 1 THEN concat('src.z', l_suppkey) WHEN 2 THEN concat('lib.w', l_suppkey) WHEN 3 THEN 'README' END"


@query(f"""SELECT claim, CASE WHEN k THEN name END AS name, CASE WHEN k THEN path END AS path, CASE WHEN k THEN language END AS language, CASE WHEN k THEN kind END AS kind, CASE WHEN k THEN line_start END AS line FROM (
  SELECT *, coalesce(path <> '' AND name <> '', false) AS k FROM (SELECT claim, CASE WHEN name IS NULL THEN NULL WHEN l_partkey % 6 = 1 THEN concat('src.a.Cls.m', l_partkey) ELSE concat({_MODULE}, '.', {_FQN}) END AS name, {_PATH} AS path, {_LANG} AS language, {_KIND2} AS kind, line_start FROM ({_DUCK})))""")
def index_identity(t):
    rows = _claims(t)
    bare = F.element_at(F.split("name", r"\."), -1)
    one = I.index_identity(F.col("name"), bare, F.col("path"), F.col("kind"), F.col("line_start"), F.col("line_end"), F.lit("app"))
    return _shown(rows, F.when(F.col("name").isNotNull(), one))


@query(f"SELECT claim, CASE WHEN l_partkey % 6 = 5 THEN NULL ELSE {_FQN} END AS name FROM ({_DUCK})")
def evidence_identity(t):
    """Plain providers; a tenth of the names are the graph's own ids in the table below and join nothing."""
    one = I.evidence_identity(F.lit("lsp"), F.col("name"), F.col("path"), F.col("kind"), F.col("line_start"), F.col("line_end"), F.lit("app"))
    return _claims(t).select("claim", one.alias("i")).select("claim", "i.name")


@query(f"""SELECT claim, n AS name, CASE WHEN n IS NOT NULL THEN CASE WHEN contains(n, '.') THEN '' ELSE coalesce({_PATH}, concat(chr(0), 'missing')) END END AS place FROM (SELECT *, CASE WHEN l_partkey % 6 <> 5 THEN {_FQN} END AS n FROM ({_DUCK}))""")
def identity_join_key(t):
    one = I.evidence_identity(F.lit("lsp"), F.col("name"), F.col("path"), F.col("kind"), F.col("line_start"), F.col("line_end"), F.lit("app"))
    return _claims(t).select("claim", I.join_key(one).alias("k")).select("claim", "k.name", "k.place")


@query(f"""WITH x AS (SELECT DISTINCT {_FQN} AS n, {_PATH} AS p FROM ({_DUCK}) WHERE l_partkey % 6 <> 5 AND l_partkey < 60), k AS (SELECT n, p, CASE WHEN contains(n, '.') THEN '' ELSE coalesce(p, concat(chr(0), 'missing')) END AS place FROM x)
SELECT a.n AS name, count(*) AS pairs FROM k a JOIN k b ON a.n = b.n AND a.place = b.place AND (a.p IS NULL OR b.p IS NULL OR a.p = b.p) GROUP BY a.n""")
def identities_joinable(t):
    one = I.evidence_identity(F.lit("lsp"), F.col("name"), F.col("path"), F.lit(None).cast("string"), F.lit(1), F.lit(2), F.lit("app"))
    x = _claims(t).where("l_partkey < 60").select(one.alias("i")).where("i is not null").distinct().withColumn("k", I.join_key(F.col("i")))
    pairs = x.select("k", F.col("i").alias("a")).join(x.select("k", F.col("i").alias("b")), "k").where(I.joinable(F.col("a"), F.col("b")))
    return pairs.groupBy(F.col("a.name").alias("name")).agg(F.count(F.lit(1)).alias("pairs"))


@query(f"""SELECT claim, substr(sha256(concat('app', chr(31), coalesce({_PATH}, ''), chr(31), {_LANG}, chr(31), {_KIND2}, chr(31), {_FQN}, chr(31), CASE WHEN line_start IS NULL THEN '' ELSE concat('(', line_start, ', ', coalesce(cast(line_end AS varchar), 'None'), ', None, None)') END, chr(31), '')), 1, 16) AS h
FROM ({_DUCK}) WHERE l_partkey % 6 <> 5""")
def identity_hash(t):
    one = I.evidence_identity(F.lit("lsp"), F.col("name"), F.col("path"), F.col("kind"), F.col("line_start"), F.col("line_end"), F.lit("app"))
    return _claims(t).where("l_partkey % 6 <> 5").select("claim", I.identity_hash(one).alias("h"))


@query(f"""SELECT min(claim) AS claim FROM (SELECT *, {_FQN} AS n FROM ({_DUCK})) WHERE l_partkey % 6 <> 5 GROUP BY n, {_PATH}, {_LANG}, {_KIND2}, line_start, line_end""")
def identity_dedup(t):
    one = I.evidence_identity(F.lit("lsp"), F.col("name"), F.col("path"), F.col("kind"), F.col("line_start"), F.col("line_end"), F.lit("app"))
    rows = _claims(t).where("l_partkey % 6 <> 5").select("claim", one.alias("i"))
    return I.dedup_by_identity(rows, "i", "claim").select("claim")


_VERIFY = "CASE l_partkey % 7 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'SPAN_MISMATCH' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'NOT_APPLICABLE' WHEN 4 THEN 'MISSING' END"


@query(f"""WITH x AS (SELECT claim, bound, changed, line_start IS NOT NULL AS span, quantity < 40 AS uniq, {_VERIFY} AS v, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 3 = 1 END AS mb, CASE WHEN l_linenumber % 2 = 0 THEN true END AS mf, CASE WHEN l_suppkey % 11 = 0 THEN 'UNTESTED' ELSE 'COMPATIBLE' END AS ver FROM ({_DUCK})),
y AS (SELECT *, CASE WHEN uniq AND span THEN 'EXACT' WHEN uniq THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS shape, ver <> 'COMPATIBLE' OR NOT bound OR (NOT changed AND v IS NOT NULL AND coalesce(mb, false) = false) AS unver FROM x),
z AS (SELECT *, CASE WHEN ver <> 'COMPATIBLE' OR NOT bound THEN 'UNVERIFIABLE' WHEN changed THEN 'STALE' WHEN v IS NOT NULL AND NOT coalesce(mb, false) THEN 'UNVERIFIABLE' WHEN v IS NOT NULL AND NOT coalesce(mf, false) THEN 'STALE' WHEN v IS NULL OR v = 'VERIFIED' THEN CASE WHEN NOT uniq THEN 'AMBIGUOUS' WHEN NOT span THEN 'HEURISTIC' ELSE 'SUPPORTED' END
  WHEN v = 'AMBIGUOUS' THEN 'AMBIGUOUS' ELSE 'HEURISTIC' END AS verdict FROM y)
SELECT claim, verdict, CASE verdict WHEN 'AMBIGUOUS' THEN 'AMBIGUOUS' WHEN 'HEURISTIC' THEN 'INFERRED' WHEN 'SUPPORTED' THEN 'EXACT' ELSE shape END AS resolution FROM z""")
def trust_ceiling(t):
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    r = I.trust_ceiling(
        F.col("bound"), F.col("line_start").isNotNull(), F.col("quantity") < 40, F.col("changed"), F.expr(_VERIFY), F.when(s % 3 != 0, s % 3 == 1), F.when(n % 2 == 0, True),
        F.when(s % 11 == 0, "UNTESTED").otherwise("COMPATIBLE"),
    )
    return _claims(t).select("claim", r.alias("r")).select("claim", "r.verdict", "r.resolution")


_MAPPED = "lower(trim(coalesce(relation, ''))) IN ('call', 'calls', 'imports', 'definition', 'implementation', 'extends_class', 'usage', 'references')"


@query(f"""WITH x AS (SELECT *, path IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL AS subj FROM ({_DUCK})),
y AS (SELECT *, CASE WHEN {_MAPPED} THEN lower(trim(relation)) NOT IN ('usage', 'references') AND subj AND line_start IS NOT NULL ELSE subj AND line_start IS NOT NULL END AS span FROM x)
SELECT claim, CASE WHEN {_MAPPED} THEN {_CANON} ELSE 'UNKNOWN' END AS relation, CASE WHEN NOT bound THEN 'UNVERIFIABLE' WHEN changed THEN 'STALE' WHEN quantity >= 40 THEN 'AMBIGUOUS' WHEN NOT span THEN 'HEURISTIC' ELSE 'SUPPORTED' END AS verdict,
  cast(CASE WHEN path IS NULL THEN 1 ELSE 0 END + CASE WHEN kind IS NULL THEN 1 ELSE 0 END + CASE WHEN name IS NULL THEN 1 ELSE 0 END + CASE WHEN subj AND (line_start IS NULL OR line_end IS NULL) THEN 1 ELSE 0 END
    + CASE WHEN relation IS NOT NULL AND NOT {_MAPPED} THEN 1 ELSE 0 END + CASE WHEN {_MAPPED} AND lower(trim(relation)) NOT IN ('usage', 'references') AND subj AND line_start IS NULL THEN 1 ELSE 0 END AS int) AS problems FROM y""")
def normalise_assertion(t):
    targets = F.when(F.col("quantity") < 40, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    r = I.assertion(F.col("path"), F.col("kind"), F.col("name"), F.col("line_start"), F.col("line_end"), F.col("relation"), targets, F.col("bound"), F.col("changed"), F.lit("COMPATIBLE"))
    return _claims(t).select("claim", r.alias("r")).select("claim", "r.relation", "r.verdict", F.size("r.problems").alias("problems"))


@query(f"""SELECT claim, array_to_string(list_filter([CASE WHEN path IS NULL THEN 'missing path' END, CASE WHEN kind IS NULL THEN 'missing kind' END, CASE WHEN name IS NULL THEN 'missing qualified_name' END,
  CASE WHEN path IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL AND (line_start IS NULL OR line_end IS NULL) THEN 'no span: subject identity is low-resolution' END], lambda z: z IS NOT NULL), '; ') AS problems FROM ({_DUCK})""")
def normalise_subject(t):
    return _claims(t).select("claim", F.array_join(I.subject_problems(F.col("path"), F.col("kind"), F.col("name"), F.col("line_start"), F.col("line_end")), "; ").alias("problems"))


@query(f"SELECT claim, CASE WHEN line_start IS NULL OR line_end IS NULL THEN false ELSE abs(line_start - (line_end - 7 - l_suppkey % 4)) > 2 END AS conflict FROM ({_DUCK})")
def span_conflicts(t):
    return _claims(t).select("claim", I.span_conflict(F.col("line_start"), F.col("line_end") - 7 - F.col("l_suppkey") % 4).alias("conflict"))


@query("""WITH b AS (SELECT symbol AS label, path AS b_path, line_start AS b_line, CASE WHEN line_start % 3 = 0 THEN 'VERIFIED' ELSE 'MISSING' END AS b_ok FROM <nodes> WHERE kind = 'class'),
c AS (SELECT 'p' AS provider, concat('pkg.', symbol) AS name, symbol AS label, concat('./', path, CASE WHEN line_start % 2 = 0 THEN '' ELSE 'x' END) AS path, line_start + line_start % 20 / 10 AS line, CASE WHEN line_start % 5 = 1 THEN 'VERIFIED' END AS ok FROM <nodes> WHERE kind = 'class')
SELECT b.label, b_path, b_line, provider, name, c.path, cast(line AS int) AS line, CASE WHEN (coalesce(ok, '') = 'VERIFIED') <> (b_ok = 'VERIFIED') THEN 'source_verified' ELSE 'recorded-not-resolved' END AS resolution,
  CASE WHEN coalesce(ok, '') = 'VERIFIED' AND b_ok <> 'VERIFIED' THEN 'external' WHEN coalesce(ok, '') <> 'VERIFIED' AND b_ok = 'VERIFIED' THEN 'builtin' END AS resolved
FROM b JOIN c ON b.label = c.label WHERE replace(c.path, './', '') <> b_path OR cast(line AS int) <> b_line""".replace("line_start + line_start % 20 / 10", "line_start + CASE WHEN line_start % 20 = 11 THEN 1 ELSE 0 END"))
def target_conflicts(t):
    n = t("nodes").where("kind = 'class'")
    line = F.col("line_start")
    b = n.select(F.col("symbol").alias("label"), "path", line.alias("line"), F.when(line % 3 == 0, "VERIFIED").otherwise("MISSING").alias("verified"))
    c = n.select(
        F.lit("p").alias("provider"), F.concat(F.lit("pkg."), "symbol").alias("name"), F.concat(F.lit("./"), "path", F.when(line % 2 == 0, "").otherwise("x")).alias("path"),
        (line + F.when(line % 20 == 11, 1).otherwise(0)).alias("line"), F.when(line % 5 == 1, "VERIFIED").alias("verified"),
    )
    return I.target_conflicts(b, c)
