"""Reconciling, cleaning, verifying, packing and exporting over the journal of files and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import export, joins, pack, reconcile, stats, verify
from loomgraph.plans.registry import query
from loomgraph.sources import files


def _state(t):
    return reconcile.State(t("files"), t("file_nodes"), t("file_edges"), t("file_pending"))


_JOINED = "FROM <files_on_disk> d LEFT JOIN <files> j ON j.path = d.path"


@query(f"SELECT d.path, d.size, d.mtime_ms, coalesce(generation, 0) AS base_generation {_JOINED} WHERE j.path IS NULL OR NOT (d.size = j.size AND d.mtime_ms = j.mtime_ms AND d.digest = j.digest)")
def reconcile_jobs(t):
    return reconcile.jobs(t("files_on_disk"), t("files"))


@query("SELECT path FROM <files> WHERE path = 'src/p3/f100.go' OR starts_with(path, 'src/p3/') OR starts_with(path, 'vendor/')")
def deletion_scope(t):
    return reconcile.deletion_scope(t("files"), ["src/p3/f100.go", "src/p3", "vendor/"])


_DEAD = "SELECT path FROM <files> WHERE path NOT IN (SELECT path FROM <files_on_disk>)"


@query(f"{_DEAD} AND starts_with(path, 'src/')")
def vanished_files(t):
    return reconcile.dead_paths(t("files"), t("files_on_disk"), ["src"])


_DRIFT = "SELECT j.path, CASE WHEN d.path IS NULL THEN 'missing' WHEN {0} THEN '{1}' END AS why FROM <files> j LEFT JOIN <files_on_disk> d ON d.path = j.path WHERE d.path IS NULL OR {0}"
_SHALLOW = _DRIFT.format("d.size <> j.size OR d.mtime_ms <> j.mtime_ms", "mtime_size_mismatch")


@query(_SHALLOW)
def drift_by_time(t):
    return reconcile.drift(t("files"), t("files_on_disk"))


@query(_DRIFT.format("d.digest <> j.digest", "hash_mismatch"))
def drift_by_bytes(t):
    return reconcile.drift(t("files"), t("files_on_disk"), deep=True)


@query(f"WITH x AS ({_SHALLOW}) SELECT path, why, (SELECT count(*) FROM x) AS total FROM x ORDER BY path LIMIT 50")
def drift_bounded(t):
    return reconcile.bounded_drift(t("files"), t("files_on_disk"), limit=50)


@query("SELECT j.path FROM <files> j LEFT JOIN <files_on_disk> d ON d.path = j.path WHERE j.size % 3 = 0 AND NOT coalesce(d.digest = j.digest AND d.size = j.size, false)")
def stale_journal_files(t):
    return reconcile.stale_files(t("files").where("size % 3 = 0"), t("files"), t("files_on_disk"))


@query("SELECT path, digest, size, generation FROM <files> WHERE path LIKE '%f1' OR path LIKE '%f1.%' OR path LIKE '%f12.go' OR path LIKE '%f13.go'")
def file_journal(t):
    return t("files").where("path like '%f1' or path like '%f1.%' or path like '%f12.go' or path like '%f13.go'").select("path", "digest", "size", "generation")


@query("SELECT path FROM <files> ORDER BY path")
def journal_paths(t):
    return t("files").select("path").orderBy("path")


#: What a parse of the changed files gives; a fifth of the parses began from an older generation.
_RECORDS = f"rec AS (SELECT d.path, concat('n', d.digest) AS digest, d.size, d.mtime_ms, CASE WHEN d.size % 5 = 0 THEN coalesce(generation, 0) + 9 ELSE coalesce(generation, 0) END AS base_generation, coalesce(generation, 0) AS g {_JOINED} WHERE d.mtime_ms % 3 = 1), won AS (SELECT * FROM rec WHERE base_generation = g)"


def _records(t):
    d = t("files_on_disk").join(t("files").select("path", "generation"), "path", "left").where("mtime_ms % 3 = 1")
    g = F.coalesce("generation", F.lit(0))
    return d.select("path", F.concat(F.lit("n"), "digest").alias("digest"), "size", "mtime_ms", F.when(F.col("size") % 5 == 0, g + 9).otherwise(g).alias("base_generation"), F.lit("COMPLETE").alias("parser_outcome"))


def _parsed(t, records):
    spot = F.substring(F.sha2("path", 256), 1, 12)
    nodes = records.select(F.concat(F.lit("p:"), spot).alias("id"), "path", F.lit("file").alias("kind"), F.lit("s").alias("symbol"), F.lit("q").alias("fqn"))
    edges = records.select("path", F.concat(F.lit("p:"), spot).alias("src"), F.lit("f:1").alias("dst"), F.lit("imports").alias("relation"), F.lit(1).alias("line"))
    pending = records.select("path", F.concat(F.lit("p:"), spot).alias("src"), F.lit("nowhere").alias("dst_symbol"), F.lit("calls").alias("relation"), F.lit(3).alias("line"), F.lit(None).cast("string").alias("import_source"), F.lit(None).cast("string").alias("receiver"), F.lit("UNRESOLVED").alias("resolution_state"))
    return nodes, edges, pending


@query(f"WITH {_RECORDS} SELECT path FROM rec WHERE base_generation <> g")
def commit_conflicts(t):
    return reconcile.conflicts(_records(t), t("files"))


def _committed(t):
    r = _records(t)
    return reconcile.commit(_state(t), r, *_parsed(t, r))[0]


@query(f"WITH {_RECORDS} SELECT path, digest, size, mtime_ms, generation, parser_outcome FROM <files> WHERE path NOT IN (SELECT path FROM won) UNION ALL SELECT path, digest, size, mtime_ms, g + 1, 'COMPLETE' FROM won")
def commit_batch_journal(t):
    return _committed(t).journal


@query(f"WITH {_RECORDS} SELECT id, path, kind FROM <file_nodes> WHERE path NOT IN (SELECT path FROM won) UNION ALL SELECT concat('p:', substr(sha256(path), 1, 12)), path, 'file' FROM won")
def commit_batch_nodes(t):
    return _committed(t).nodes.select("id", "path", "kind")


@query(f"WITH {_RECORDS} SELECT path, src, dst, relation, line FROM <file_edges> WHERE path NOT IN (SELECT path FROM won) UNION ALL SELECT path, concat('p:', substr(sha256(path), 1, 12)), 'f:1', 'imports', 1 FROM won")
def commit_batch_edges(t):
    return _committed(t).edges


_GONE = "go AS (SELECT path FROM <files> WHERE size % 20 = 3), gi AS (SELECT id FROM <file_nodes> WHERE path IN (SELECT path FROM go))"


def _gone(t):
    return t("files").where("size % 20 = 3").select("path")


@query(f"WITH {_GONE} SELECT e.path, e.src, e.dst, e.line FROM <file_edges> e WHERE path NOT IN (SELECT path FROM go) AND src NOT IN (SELECT id FROM gi) AND dst NOT IN (SELECT id FROM gi)")
def delete_path_edges(t):
    return reconcile.delete_paths(_state(t), _gone(t)).edges.select("path", "src", "dst", "line")


_AGAIN = "rq AS (SELECT e.path, e.src, concat('mod', split_part(n.fqn, 'mod', 2)) AS dst_symbol, relation, line, fqn AS import_source FROM <file_edges> e JOIN <file_nodes> n ON n.id = e.dst WHERE n.path IN (SELECT path FROM go) AND e.path NOT IN (SELECT path FROM go) AND e.src NOT IN (SELECT id FROM gi))"


@query(f"WITH {_GONE}, {_AGAIN} SELECT path, src, dst_symbol, relation, line, import_source FROM rq")
def requeued_references(t):
    return reconcile.requeued(t("file_edges"), t("file_nodes"), _gone(t)).select("path", "src", "dst_symbol", "relation", "line", "import_source")


@query(f"WITH {_GONE}, {_AGAIN} SELECT path, src, dst_symbol, relation, import_source FROM <file_pending> WHERE path NOT IN (SELECT path FROM go) AND src NOT IN (SELECT id FROM gi) UNION ALL SELECT path, src, dst_symbol, relation, import_source FROM rq")
def delete_path_pending(t):
    return reconcile.delete_paths(_state(t), _gone(t)).pending.select("path", "src", "dst_symbol", "relation", "import_source")


@query("SELECT path, src, dst FROM <file_edges> WHERE src NOT IN ('f:1', 'f:2', 'f:30') AND dst NOT IN ('f:1', 'f:2', 'f:30')")
def delete_node_edges(t):
    ids = t.spark.createDataFrame([("f:1",), ("f:2",), ("f:30",)], "id string")
    return reconcile.delete_node(_state(t), ids).edges.select("path", "src", "dst")


_CLEAN_EDGES = "SELECT * FROM <file_edges> WHERE src IN (SELECT id FROM <file_nodes>) AND dst IN (SELECT id FROM <file_nodes>)"
_CLEAN_PENDING = "SELECT * FROM <file_pending> WHERE src IN (SELECT id FROM <file_nodes>) AND path IN (SELECT path FROM <files>)"


@query(f"SELECT 'edges' AS what, path, src FROM ({_CLEAN_EDGES}) UNION ALL SELECT 'pending', path, src FROM ({_CLEAN_PENDING})")
def orphan_cleanup(t):
    s = reconcile.cleaned(_state(t))
    return s.edges.select(F.lit("edges").alias("what"), "path", "src").unionByName(s.pending.select(F.lit("pending").alias("what"), "path", "src"))


@query(f"""WITH de AS ({_DEAD}), ce AS ({_CLEAN_EDGES}), cp AS ({_CLEAN_PENDING}) SELECT (SELECT count(*) FROM de) AS paths, (SELECT count(*) FROM <file_nodes> WHERE kind <> 'note' AND path IN (SELECT path FROM de)) AS nodes,
  (SELECT count(*) FROM <file_edges>) - (SELECT count(*) FROM ce WHERE path NOT IN (SELECT path FROM de)) AS edges, (SELECT count(*) FROM <file_pending>) - (SELECT count(*) FROM cp WHERE path NOT IN (SELECT path FROM de)) AS pending, cast(0 AS bigint) AS notes""")
def clean_plan(t):
    return reconcile.clean_plan(_state(t), t("files_on_disk"))


@query("SELECT (SELECT count(*) FROM <files>) AS paths, (SELECT count(*) FROM <file_nodes> WHERE kind <> 'note') AS nodes, (SELECT count(*) FROM <file_edges>) AS edges, (SELECT count(*) FROM <file_pending>) AS pending, (SELECT count(*) FROM <file_nodes> WHERE kind = 'note') AS notes")
def clean_plan_reset(t):
    return reconcile.clean_plan(_state(t), t("files_on_disk"), reset=True, include_notes=True)


@query(f"WITH de AS ({_DEAD}) SELECT id, kind FROM <file_nodes> WHERE kind = 'note' OR path NOT IN (SELECT path FROM de)")
def clean_applied_nodes(t):
    return reconcile.apply_clean(_state(t), t("files_on_disk")).nodes.select("id", "kind")


@query(f"WITH de AS ({_DEAD}), nn AS (SELECT id FROM <file_nodes> WHERE kind = 'note' OR path NOT IN (SELECT path FROM de)) SELECT path, src, dst FROM <file_edges> WHERE path NOT IN (SELECT path FROM de) AND src IN (SELECT id FROM nn) AND dst IN (SELECT id FROM nn)")
def clean_applied_edges(t):
    return reconcile.apply_clean(_state(t), t("files_on_disk")).edges.select("path", "src", "dst")


@query("SELECT id, label, body, kind FROM <rich> WHERE kind = 'note' UNION ALL SELECT concat('note:', substr(sha256(concat('todo', chr(10), 'check the graph')), 1, 12)), 'todo', 'check the graph', 'note'")
def note_insert(t):
    twice = reconcile.with_note(reconcile.with_note(t("rich"), "todo", "check the graph", 7), "todo", "check the graph", 8)
    return twice.where("kind = 'note'").select("id", "label", "body", "kind")


@query(f"WITH m AS ({_DEAD}), u AS (SELECT string_split(p, '/')[-1] AS name, count(*) AS n, min(p) AS new_path FROM (SELECT concat('new/', split_part(path, '/', 3)) AS p FROM <files> WHERE size % 4 = 1 UNION ALL SELECT concat('old/', split_part(path, '/', 3)) FROM <files> WHERE size % 8 = 1) GROUP BY 1) SELECT m.path, new_path FROM m JOIN u ON u.name = string_split(m.path, '/')[-1] WHERE n = 1")
def rehome_candidates(t):
    f = t("files")
    name = F.split_part("path", F.lit("/"), F.lit(3))
    disk = f.where("size % 4 = 1").select(F.concat(F.lit("new/"), name).alias("path")).unionByName(f.where("size % 8 = 1").select(F.concat(F.lit("old/"), name).alias("path")))
    return reconcile.rehome_candidates(reconcile.dead_paths(f, t("files_on_disk")), disk)


@query(f"""WITH jb AS (SELECT d.path, d.size {_JOINED} WHERE j.path IS NULL OR NOT (d.size = j.size AND d.mtime_ms = j.mtime_ms AND d.digest = j.digest)), ok AS (SELECT * FROM jb WHERE size % 9 <> 0)
SELECT (SELECT count(*) FROM <files_on_disk>) AS scanned, (SELECT count(*) FROM <files_on_disk>) - (SELECT count(*) FROM jb) AS unchanged, (SELECT count(*) FROM ok) AS updated, (SELECT count(*) FROM ({_DEAD})) AS deleted, (SELECT count(*) FROM jb) - (SELECT count(*) FROM ok) AS failed, cast(0 AS bigint) AS conflicts""")
def reconcile_counts(t):
    disk, *state = t.together("files_on_disk", "files", "file_nodes", "file_edges", "file_pending")

    def parse(jobs):
        good = jobs.where("size % 9 <> 0").join(disk.select("path", "digest"), "path").withColumn("parser_outcome", F.lit("COMPLETE"))
        return good, *_parsed(t, good)

    return reconcile.reconcile(reconcile.State(*state), disk, parse)[1]


#: A hit a file: the name x in line 1.
_HITS = "SELECT path AS id, path, CASE WHEN size % 6 = 0 THEN 'file' ELSE 'function' END AS kind, 'x' AS symbol, 1 AS line FROM <files>"


def _hits(t):
    return t("files").select(F.col("path").alias("id"), "path", F.when(F.col("size") % 6 == 0, "file").otherwise("function").alias("kind"), F.lit("x").alias("symbol"), F.lit(1).alias("line"))


_VERIFIED = f"""x AS (SELECT h.*, j.digest AS jd, d.digest AS dd, content, round((CASE WHEN contains(lower(content), 'getattr') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'text') THEN 1 ELSE 0 END) / 2.0, 4) AS cov FROM ({_HITS}) h JOIN <files> j ON j.path = h.path LEFT JOIN <files_on_disk> d ON d.path = h.path),
y AS (SELECT *, CASE WHEN dd IS NULL THEN 'MISSING' WHEN jd <> dd THEN 'STALE' ELSE 'FRESH' END AS fresh, CASE WHEN path LIKE '%.py' AND content = 'x = getattr(a, b)' THEN 'EXACT_SPAN' WHEN contains(content, 'x') THEN 'FILE_TOKEN' WHEN cov >= 0.5 THEN CASE WHEN path LIKE '%.py' AND content = 'plain' THEN 'NAME_ONLY' ELSE 'FILE_TOKEN' END ELSE 'NAME_ONLY' END AS decl FROM x),
z AS (SELECT *, CASE WHEN dd IS NULL THEN 'UNKNOWN' WHEN kind = 'file' THEN CASE WHEN cov >= 0.5 THEN 'EXACT_SYMBOL' ELSE 'FILE_TOKEN' END WHEN decl = 'EXACT_SPAN' AND fresh <> 'FRESH' THEN 'FILE_TOKEN' ELSE decl END AS rel FROM y)"""


@query(f"""WITH {_VERIFIED} SELECT id, fresh AS freshness, rel AS relevance, CASE WHEN dd IS NULL THEN 'UNRESOLVED' WHEN kind = 'file' THEN 'NOT_APPLICABLE' ELSE 'EXACT' END AS resolution, CASE WHEN dd IS NULL THEN NULL ELSE cov END AS coverage,
  CASE WHEN dd IS NULL THEN 'STALE' WHEN fresh = 'STALE' THEN 'STALE' WHEN rel IN ('EXACT_SPAN', 'EXACT_SYMBOL') THEN 'STRONG' ELSE 'WEAK' END AS verdict,
  round(cast(CASE WHEN dd IS NULL THEN 0 WHEN fresh = 'STALE' THEN least(0.35, CASE WHEN cov = 0 THEN 0.5 ELSE cov END / 2) WHEN rel = 'EXACT_SPAN' THEN greatest(0.95, cov) WHEN rel = 'EXACT_SYMBOL' THEN greatest(0.85, cov) WHEN rel = 'FILE_TOKEN' THEN least(0.35, CASE WHEN cov = 0 THEN 0.3 ELSE cov END) ELSE 0.25 END AS double), 4) AS confidence FROM z""")
def verify_evidence(t):
    v = verify.verified(_hits(t), t("files"), t("files_on_disk"), ["getattr", "text"])
    return v.select("id", "freshness", "relevance", "resolution", "coverage", "verdict", "confidence")


@query(f"WITH {_VERIFIED} SELECT id, path, CASE WHEN dd IS NULL THEN 'STALE' WHEN fresh = 'STALE' THEN 'STALE' WHEN rel IN ('EXACT_SPAN', 'EXACT_SYMBOL') THEN 'STRONG' ELSE 'WEAK' END AS verdict FROM z")
def verify_hits(t):
    return verify.verify_hits(_hits(t), t("files"), t("files_on_disk"), ["getattr", "text"]).select("id", "path", "verdict")


_EXCLUDED = "(regexp_matches(path, '(^|/)(node_modules|\\.venv|venv|dist|build|vendor|target)/') OR contains(path, '.min.'))"


@query(f"""SELECT id, CASE WHEN {_EXCLUDED} THEN 'NOT_APPLICABLE' WHEN content IS NULL THEN 'MISSING' WHEN size % 7 = 0 THEN 'SPAN_MISMATCH' WHEN NOT regexp_matches(content, '\\bx\\b') THEN 'SPAN_MISMATCH' WHEN size % 2 = 0 AND path LIKE '%.py' THEN 'VERIFIED' WHEN size % 2 = 0 THEN 'NOT_APPLICABLE' ELSE 'VERIFIED' END AS status
FROM (SELECT j.path AS id, j.path, j.size, content FROM <files> j LEFT JOIN <files_on_disk> d ON d.path = j.path)""")
def verify_subjects(t):
    size = F.col("size")
    subjects = t("files").select(F.col("path").alias("id"), "path", F.when(size % 2 == 0, "function").otherwise("variable").alias("kind"), F.lit("m.x").alias("name"), F.lit(1).alias("line_start"), F.when(size % 7 == 0, 9).otherwise(1).alias("line_end"))
    return verify.verify_subjects(subjects, t("files_on_disk"))


@query()
def repo_map_budget(t):
    """By pytest: ranks against plain PageRank, and the longest beginning that fits."""
    nodes, edges = t.together("nodes", "edges")
    return pack.repo_map(nodes, edges, None, 1024)


@query()
def repo_map_focus(t):
    nodes, edges = t.together("nodes", "edges")
    return pack.repo_map(nodes, edges, nodes.where("id in ('sup:1', 'cust:5')").select("id"), 512)


_T = "(SELECT id AS target FROM <nodes> WHERE kind = 'class' AND line_start % 100 = 31)"


@query(f"SELECT target, 'in' AS direction, src AS id, line FROM <edges> JOIN {_T} ON dst = target WHERE relation IN ('calls', 'extends') UNION ALL SELECT target, 'out', dst, line FROM <edges> JOIN {_T} ON src = target WHERE relation IN ('calls', 'extends')")
def neighbour_edges(t):
    return pack.neighbours(t("edges"), t("nodes").where("kind = 'class' and line_start % 100 = 31"))


@query(f"""WITH ed AS (SELECT * FROM <edges> WHERE relation IN ('calls', 'extends')), tg AS (SELECT target FROM {_T}), ar AS (SELECT target, 'in' AS d, src AS id, line FROM ed JOIN tg ON dst = target UNION ALL SELECT target, 'out', dst, line FROM ed JOIN tg ON src = target),
o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, id ORDER BY line NULLS FIRST, d) AS k FROM ar WHERE id <> target) WHERE k = 1), o2 AS (SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY target ORDER BY line NULLS FIRST, id, d) AS int) AS place FROM o1) WHERE place <= 12),
wy AS (SELECT dst AS via, src AS id, line FROM ed UNION ALL SELECT src, dst, line FROM ed), fr AS (SELECT o2.target, wy.id, min(struct_pack(f := o2.place, l := coalesce(wy.line, -1), i := wy.id)) AS o FROM o2 JOIN wy ON wy.via = o2.id WHERE wy.id <> o2.target AND NOT EXISTS (SELECT 1 FROM o2 z WHERE z.target = o2.target AND z.id = wy.id) GROUP BY 1, 2),
nn AS (SELECT target, count(*) AS n FROM o2 GROUP BY 1), st AS (SELECT fr.target, fr.id, cast(row_number() OVER (PARTITION BY fr.target ORDER BY o) + n AS int) AS place FROM fr JOIN nn ON nn.target = fr.target)
SELECT target, CASE d WHEN 'in' THEN 'caller' ELSE 'callee' END AS role, place, id FROM o2 UNION ALL SELECT target, 'stub', place, id FROM st WHERE place <= 12""")
def context_bundle(t):
    targets = t("nodes").where("kind = 'class' and line_start % 100 = 31").select("id")
    return pack.bundles(t("nodes"), t("edges"), targets, most=12).select("target", "role", F.col("place").cast("int").alias("place"), "id")


def _numbered(t):
    return t("nodes").select("id", (F.col("line_start") % 7).alias("community_id"))


def _labelled(t):
    return t("nodes").withColumns({"label": F.concat("kind", F.lit(" <"), "symbol", F.lit(">")), "body": F.lit("b")})


_DEG = "dg AS (SELECT n.id, count(*) FILTER (w = 'o') AS o, count(*) FILTER (w = 'i') AS i FROM <nodes> n LEFT JOIN (SELECT src AS e, 'o' AS w FROM <edges> UNION ALL SELECT dst, 'i' FROM <edges>) x ON x.e = n.id GROUP BY n.id)"


@query(f"WITH {_DEG} SELECT n.id, concat(kind, ' <', symbol, '>') AS title, upper(kind) AS type, line_start % 7 AS community_id, o + i AS degree, i AS in_degree, o AS out_degree, CASE WHEN o + i > 100 THEN 'HIGH' ELSE 'NORMAL' END AS risk_level FROM <nodes> n JOIN dg ON dg.id = n.id")
def export_entities(t):
    d = stats.degrees(t("nodes").select("id"), t("edges"))
    hubs = d.where("total_degree > 100").select("id", F.lit("HIGH").alias("risk"))
    return export.entities(_labelled(t), t("edges"), _numbered(t), hubs).select("id", "title", "type", "community_id", "degree", "in_degree", "out_degree", "risk_level")


@query("SELECT src AS source, dst AS target, relation, line FROM <edges>")
def export_relationships(t):
    return export.relationships(t("edges")).select("source", "target", "relation", "line")


@query("""SELECT 1 AS part, id AS key, sha256(concat('    <node id="', id, '">', chr(10), '      <data key="label">', kind, ' &lt;', symbol, '&gt;</data>', chr(10), '      <data key="kind">', kind, '</data>', chr(10), '      <data key="path">', path, '</data>', chr(10), '      <data key="community">', line_start % 7,
  '</data>', chr(10), '      <data key="is_god">', CASE WHEN kind = 'file' THEN 'true' ELSE 'false' END, '</data>', chr(10), '    </node>')) AS h FROM <nodes>""")
def export_graphml(t):
    hubs = t("nodes").where("kind = 'file'").select("id", F.lit("HIGH").alias("risk"))
    return export.graphml(_labelled(t), t("edges"), _numbered(t), hubs).where("part = 1").select("part", "key", F.sha2("text", 256).alias("h"))


@query("SELECT id, CASE WHEN n = 1 THEN b ELSE concat(b, ' ', n) END AS name FROM (SELECT id, b, row_number() OVER (PARTITION BY lower(b) ORDER BY id) AS n FROM (SELECT id, regexp_replace(symbol, '[^\\p{L}\\p{N}._ -]+', '_', 'g') AS b FROM <nodes>))")
def vault_names(t):
    return export.vault_names(t("nodes").withColumn("label", F.col("symbol")))


@query()
def export_vault(t):
    """By pytest on a small graph."""
    return export.vault(_labelled(t), t("edges"))


@query()
def export_symbol_index(t):
    """By pytest: read back by the decoder of the binary form."""
    return export.symbol_index(t("rich"), t("rich_edges"), "/project").select("path", F.octet_length("document").alias("bytes"))


@query("SELECT count(*) AS files, count(*) FILTER (digest IS NULL) AS unreadable, CASE WHEN count(*) FILTER (digest IS NULL) = 0 THEN 'bound' END AS state FROM (SELECT path FROM <files> WHERE size % 100 = 3) c LEFT JOIN (SELECT path, digest FROM <files_on_disk>) d USING (path)")
def content_binding(t):
    b = files.content_binding(t("files").where("size % 100 = 3").select("path"), t("files_on_disk"))
    return b.select("files", "unreadable", F.when(F.col("scope_digest").isNotNull(), "bound").alias("state"))


@query("SELECT 'abc' AS commit_sha, count(*) > 0 AS dirty, (SELECT max(generation) FROM <files>) AS generation FROM <files> WHERE size % 50 = 7")
def worktree_snapshot(t):
    f = t("files")
    s = files.worktree_snapshot("abc", f.where("size % 50 = 7").select("path"), f, t("files_on_disk"), f.where("size % 50 = 7").select("path"), 5)
    return s.select("commit_sha", "dirty", "generation")


@query("SELECT root AS repo, 'p' AS provider, captured_at % 3 <> 0 AS bound, coalesce(CASE WHEN captured_at % 3 <> 0 THEN captured_at % 3 = 1 END, false) AS fresh FROM <snapshots>")
def snapshot_match(t):
    c = F.col("captured_at") % 3
    binding = t("snapshots").select(F.col("root").alias("repo"), F.lit("p").alias("provider"), F.when(c == 1, "abc").when(c == 2, "old").alias("head_sha"))
    return files.snapshot_match(binding, "abc", t("files").where("1 = 0"))


@query("""SELECT path FROM <files_on_disk> WHERE NOT regexp_matches(path, '(^|/)(build|vendor_vault)/') AND NOT (path LIKE '%.md' AND NOT path LIKE 'src/p3/%') AND NOT (path LIKE 'src/p1/%' AND path LIKE '%.go') AND NOT path LIKE 'src/p2/f1%'""")
def ignore_rules(t):
    rules = files.IgnoreRules([("", "*.md"), ("", "!src/p3/*.md"), ("src/p1", "*.go"), ("", "/src/p2/f1*")])
    return files.kept_files(t("files_on_disk").select("path"), rules)


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'go_pkg.storage' WHEN 1 THEN 'models.order' WHEN 2 THEN 'app.views.util' WHEN 3 THEN NULL WHEN 4 THEN 'a.b' ELSE 'x.y' END AS form FROM orders""")
def import_forms(t):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "go_pkg/storage").when(k == 1, "../../models/order").when(k == 2, "./util").when(k == 3, "").when(k == 4, "a/b.js").otherwise("x/y.ts")
    lang = F.when(k == 0, "go").when(k.isin(1, 2), "typescript").otherwise("rust")
    return t("orders").select("o_orderkey", files.import_form(raw, lang, F.when(k == 1, "app").otherwise("app.views")).alias("form"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'src/é.py' WHEN 1 THEN 'plain.py' WHEN 2 THEN concat('a', chr(9), 'b\"c') ELSE 'x\\y' END AS path FROM orders")
def unquoted_paths(t):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, '"src/\\303\\251.py"').when(k == 1, " plain.py ").when(k == 2, '"a\\tb\\"c"').otherwise('"x\\\\y"')
    return t("orders").select("o_orderkey", files.unquoted_path(raw).alias("path"))


@query("""SELECT coalesce(j.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing' WHEN j.path IS NULL THEN 'unrecorded' WHEN j.digest <> d.digest THEN 'hash_mismatch' ELSE 'mtime_size_mismatch' END AS state
FROM <files> j FULL OUTER JOIN <files_on_disk> d ON j.path = d.path WHERE j.path IS NULL OR d.path IS NULL OR j.digest <> d.digest OR j.size <> d.size""")
def journal_drift_full_outer(t):
    return joins.drift(t("files"), t("files_on_disk"))
