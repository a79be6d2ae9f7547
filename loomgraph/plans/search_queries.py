"""Search: index, ranked order, vectors, fusion, token budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import search
from loomgraph.operators import trust
from loomgraph.plans.registry import query

QUERY, SCOPE = "thin reso", "src1"
_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)


@query(f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_.\\-/]{{3,}}')) AS l FROM documents)
SELECT doc_id, cast(len(list_filter(l, lambda x: x NOT IN ({_STOP}))) AS int) AS n_tokens FROM t""")
def search_tokens(t):
    return t("documents").select("doc_id", F.size(search.tokens("text")).alias("n_tokens"))


def _fold(column: str) -> str:
    return f"regexp_extract_all(translate(lower({column}), '{search.MARKED}', '{search.PLAIN}'), '[\\p{{L}}\\p{{N}}_.:$@-]+')"


_WORDS = "list_concat(" * 3 + _fold("label") + ", " + "), ".join(_fold(c) for c in ("fqn", "body", "keywords")) + ")"
_TERM = "CASE WHEN ln((n - df{0} + 0.5) / (df{0} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{0} + 0.5) / (df{0} + 0.5)) END * tf{0} * 2.2 / (tf{0} + 1.2 * (0.25 + 0.75 * dl * n / words))"
BM25 = f"""WITH w AS (SELECT id, {_WORDS} AS w FROM <corpus>), p AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: starts_with(x, 'reso'))) AS tf0, len(list_filter(w, lambda x: starts_with(x, 'thin'))) AS tf1 FROM w),
s AS (SELECT count(*) AS n, sum(dl) AS words, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM p),
b AS (SELECT id, round({_TERM.format(0)} + {_TERM.format(1)}, 6) AS score FROM p, s WHERE tf0 > 0 OR tf1 > 0)"""
_SHOWN = "id, path, kind, symbol, fqn, label, line_start, score"
_HITS = """ SELECT {shown}, bucket, cast(row_number() OVER (ORDER BY bucket, score DESC, id) AS int) AS place FROM (SELECT c.id, path, kind, symbol, fqn, label, line_start, score,
  cast(CASE WHEN kind <> 'file' AND (contains(lower(concat(symbol, ' ', label)), 'thin') OR contains(lower(concat(symbol, ' ', label)), 'reso')) THEN 0 ELSE 1 END AS int) AS bucket
  FROM b JOIN <corpus> c ON c.id = b.id {where} ORDER BY score DESC, c.id LIMIT {n})"""
_SCOPED = "WHERE contains(lower(path), 'src1') OR contains(lower(body), 'src1')"


def _index(t):
    return search.TextIndex(t.spark, f"corpus {t.sf_dir}", lambda: t("corpus"))


def _found(t, limit, scope=None):
    return search.search_text(_index(t), t("corpus"), QUERY, limit, scope)


@query(BM25 + _HITS.format(shown=_SHOWN, where="", n=30))
def bm25_search(t):
    return _found(t, 10)


@query(BM25 + _HITS.format(shown=_SHOWN, where=_SCOPED, n=30))
def bm25_scoped(t):
    return _found(t, 10, SCOPE)


@query(BM25.replace("'reso'", "'re'").replace("'thin'", "'src1'") + ", h AS (" + _HITS.format(shown="id", where="", n=30).replace("'thin'", "'src1'").replace("'reso'", "'re'") + ") SELECT id, bucket, place FROM h")
def search_rerank(t):
    return search.search_text(_index(t), t("corpus"), "src1 re", 10).select("id", "bucket", "place")


_TRUST = """t AS (SELECT c.id, CASE WHEN l.doc_id IS NULL THEN 'UNKNOWN' WHEN toxic = 1 THEN 'STALE' ELSE 'FRESH' END AS freshness, CASE WHEN quality = 1 THEN 'EXACT_SYMBOL' ELSE 'FILE_TOKEN' END AS relevance,
  CASE WHEN c.doc_id % 5 <> 0 THEN c.doc_id % 10 / 10.0 END AS coverage FROM <corpus> c LEFT JOIN labels l ON l.doc_id = c.doc_id),
v AS (SELECT h.*, freshness, coverage, CASE WHEN freshness = 'STALE' THEN 'STALE' WHEN freshness = 'UNKNOWN' THEN 'NOPATH' WHEN relevance = 'EXACT_SYMBOL' THEN 'STRONG' ELSE 'WEAK' END AS verdict FROM h JOIN t ON t.id = h.id)"""
_ORDER = "CASE verdict WHEN 'STRONG' THEN 0 WHEN 'WEAK' THEN 1 WHEN 'NOPATH' THEN 2 WHEN 'STALE' THEN 3 ELSE 4 END"


def _verified(t):
    c = t("corpus").select("id", "doc_id").join(t("labels"), "doc_id", "left")
    fresh = F.when(F.col("quality").isNull(), "UNKNOWN").when(F.col("toxic") == 1, "STALE").otherwise("FRESH")
    about = F.when(F.col("quality") == 1, "EXACT_SYMBOL").otherwise("FILE_TOKEN")
    of = c.select("id", fresh.alias("freshness"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 10 / 10).alias("coverage"), trust.verdict(fresh, about).alias("verdict"))
    return _found(t, 10).join(of, "id")


@query(BM25 + ", h AS (" + _HITS.format(shown=_SHOWN, where="", n=30) + "), " + _TRUST + f""", e AS (SELECT path, symbol, count(*) AS n FROM <doc_evidence> WHERE invalidated_at IS NULL GROUP BY 1, 2),
g AS (SELECT v.*, coalesce(e.n, 0) AS evidence, cast(floor(coalesce(coverage, 0) * 100) AS int) AS percent, cast(CASE WHEN label = 'thin reso' THEN 0 WHEN fqn = 'thin reso' OR ends_with(fqn, '.thin reso') THEN 1 WHEN starts_with(lower(label), 'thin reso') THEN 2 ELSE 3 END AS int) AS grade
  FROM v LEFT JOIN e ON e.path = v.path AND e.symbol = v.label), r AS (SELECT *, cast(row_number() OVER (ORDER BY {_ORDER}, grade, evidence DESC, percent DESC, place) AS int) AS rank FROM g)
SELECT id, rank, grade, evidence, percent, concat('verdict=', verdict, '; text match only; freshness=', freshness, CASE WHEN evidence > 0 THEN concat('; provider evidence rows: ', evidence) ELSE '' END) AS reasons FROM r WHERE rank <= 10""")
def search_ranked(t):
    return search.ranked(_verified(t), t("doc_evidence"), QUERY, 10)


@query(BM25 + ", h AS (" + _HITS.format(shown=_SHOWN, where="", n=30) + "), " + _TRUST + f""", r AS (SELECT id, verdict, cast(row_number() OVER (ORDER BY {_ORDER}, coalesce(coverage, 0) DESC, bucket, id) AS int) AS rank FROM v WHERE NOT (verdict = 'WEAK' AND coalesce(coverage, 0) < 0.5))
SELECT id, rank, verdict FROM r WHERE rank <= 6""")
def search_service_order(t):
    return search.service_order(_verified(t), 6)


@query("""SELECT id, cast(CASE WHEN label = 'src1 en' THEN 0 WHEN fqn = 'src1 en' OR ends_with(fqn, '.src1 en') OR ends_with(fqn, '::src1 en') THEN 1 WHEN starts_with(lower(label), 'src1 en') THEN 2 ELSE 3 END AS int) AS grade FROM <corpus>""")
def identity_grades(t):
    return t("corpus").select("id", search.identity_grade(F.col("label"), F.col("fqn"), "src1 en")["grade"].alias("grade"))


@query("SELECT path, coalesce(symbol, '') AS symbol, count(*) AS n FROM <doc_evidence> WHERE invalidated_at IS NULL AND path IN (SELECT path FROM <corpus> WHERE kind = 'file') GROUP BY 1, 2")
def provider_evidence_counts(t):
    return search.evidence_counts(t("doc_evidence"), t("corpus").where("kind = 'file'"))


@query("""SELECT doc_id, CASE WHEN text IS NOT NULL AND octet_length(encode(text)) <= 5000 AND NOT contains(substr(text, 1, 1024), chr(0))
  THEN round((cast(contains(lower(text), 'thin') AS int) + cast(contains(lower(text), 'reso') AS int) + cast(contains(lower(text), 'zzzz') AS int)) / 3, 4) END AS coverage FROM documents""")
def query_coverage(t):
    return search.query_coverage(t("documents"), "doc_id", "text", ["thin", "reso", "zzzz"], most=5000)


@query("""WITH t AS (SELECT item_id, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS s FROM benchmark), v AS (SELECT item_id, cast(concat('0x', substr(s, 1, 8)) AS bigint) % 256 AS idx,
  sum(CASE WHEN cast(concat('0x', substr(s, 9, 1)) AS int) % 2 = 0 THEN 1 ELSE -1 END) AS weight FROM t GROUP BY 1, 2) SELECT item_id, idx, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY item_id)), 6) AS weight FROM v WHERE weight <> 0""")
def hash_embed(t):
    return search.hash_embed(t("benchmark"), "item_id", "text")


_STATE = "SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE sha256(concat(label, chr(10), fqn, chr(10), body)) END AS embedded_hash, doc_id % 4 <> 0 AS has_vector FROM <corpus> WHERE doc_id % 5 <> 1"


def _state(t):
    c = t("corpus").where("doc_id % 5 <> 1")
    hashed = search.content_hash(F.col("label"), F.col("fqn"), F.col("body"))
    return c.select("id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(hashed).alias("embedded_hash"), (F.col("doc_id") % 4 != 0).alias("has_vector"))


@query(f"""WITH d AS (SELECT id, sha256(concat(label, chr(10), fqn, chr(10), body)) AS h FROM <corpus> ORDER BY updated_at DESC, id LIMIT 500), s AS ({_STATE})
SELECT coalesce(d.id, s.id) AS id, CASE WHEN d.id IS NULL THEN 'prune' WHEN s.id IS NULL THEN 'embed_new' WHEN h = embedded_hash AND has_vector THEN 'skip' ELSE 'embed_changed' END AS action FROM d FULL OUTER JOIN s ON s.id = d.id""")
def embed_incremental(t):
    c = t("corpus")
    nodes = c.select("id", "updated_at", search.content_hash(F.col("label"), F.col("fqn"), F.col("body")).alias("hash"))
    return search.embed_plan(nodes, _state(t), 500)


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def vector_prune(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "label")
    return search.prune_orphans(vectors, t("documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"))).select(F.col("id").alias("vec_id"), "label")


KNN = """q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, 65), lambda i: cast(e[i] AS double) * cast(embedding[i] AS double))), 5) AS similarity
  FROM embeddings, q WHERE vec_id <> query_id), k AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS int) AS rank FROM x)"""


def _queries(t):
    """The stated query set of searches: every row whose id is divisible by 50."""
    return t("embeddings").where("vec_id % 50 = 0")


@query("WITH " + KNN + " SELECT * FROM k WHERE rank <= 10")
def knn_cosine(t):
    return search.nearest(t("embeddings"), _queries(t), 10)


@query(BM25 + ", " + KNN + """, y AS (SELECT id, cast(row_number() OVER (ORDER BY score DESC, id) AS int) AS rank FROM (SELECT * FROM b ORDER BY score DESC, id LIMIT 60)), z AS (SELECT * FROM y WHERE rank <= 20),
l AS (SELECT query_id, concat('doc:', vec_id) AS id, rank, 'vector' AS source FROM k WHERE rank <= 20 UNION ALL SELECT query_id, z.id, rank, 'text' FROM z, q),
f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM l GROUP BY 1, 2)
SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS int) AS place FROM f) WHERE place <= 10""")
def rrf_hybrid(t):
    """The text leg of one query text with the vector leg of each query vector, twice the limit each."""
    queries = _queries(t).select(F.col("vec_id").alias("query_id"))
    best = _index(t).bm25(search.query_terms(QUERY)[0]).orderBy(F.desc("score"), "id").limit(20)
    text = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).crossJoin(queries)  # 20 rows a query
    vector = search.nearest(t("embeddings"), _queries(t), 20).select("query_id", F.concat(F.lit("doc:"), "vec_id").alias("id"), "rank")
    return search.fuse([("text", text), ("vector", vector)], "id", 10, group="query_id")


# RE2 has no look-ahead: a run of blanks counts once, and once more where more than one blank stands before a word
_PIECES = "len(regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?[a-zA-Z]+| ?[0-9]{1,3}| ?[^\\s\\w]+'))"


@query("""SELECT p_partkey, cast(CASE WHEN p_name = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(concat(p_name, ', ', p_type, ' (', p_size, ') it''s'), '''s|''t|''re|''ve|''m|''ll|''d| ?[a-zA-Z]+| ?[0-9]{1,3}| ?[^\\s\\w]+'))) END AS int) AS n FROM part""")
def token_estimate(t):
    text = F.concat("p_name", F.lit(", "), "p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit(") it's"))
    return t("part").select("p_partkey", search.estimate_tokens(text).cast("int").alias("n"))


@query()
def token_budget_truncate(t):
    """By pytest against a plain search for the longest beginning; RE2 lacks the look-ahead of the piece pattern."""
    r = search.truncate_to_budget(F.col("text"), 256)
    return t("documents").where("text is not null").select("doc_id", r["truncated"].alias("truncated"), r["tokens"].alias("tokens"), F.length(r["text"]).alias("chars"))


@query()
def token_budget_lines(t):
    r = search.fit_lines(search.lines_with_ends(F.col("text")), 128)
    return t("documents").where("text is not null").select("doc_id", r["kept"].alias("kept"), r["truncated"].alias("truncated"), r["tokens"].alias("tokens"))
