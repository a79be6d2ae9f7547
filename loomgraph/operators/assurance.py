"""What an answer may claim: coverage, the universe of files, gates, receipts and envelopes.

Every count is exact beside its bounded sample. What is not known counts against the claim and is never filled
in: the nulls that rules speak of are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import identity as names
from loomgraph.operators import trust
from loomgraph.operators.resolve import symbol_identity
from loomgraph.shared import cut, numbered

#: Folders and file names of generated and foreign code; fixed values.
GENERATED_FOLDERS = ("node_modules", ".venv", "venv", "dist", "build", "vendor", "target")
GENERATED_NAME = r"_pb\d|_pb\d*_grpc|\.min\.|\.generated\."
#: What a parser's outcome means; fixed values.
OUTCOMES = {"COMPLETE": "indexed", "VALID_EMPTY": "indexed", "PARTIAL_AST": "partial", "PARSE_ERROR": "skipped", "PARSER_UNAVAILABLE": "skipped"}
#: What gaps cost a claim; fixed values.
STRUCTURAL = {"generated": 0.005, "parser-partial": 0.02, "parser-failed": 0.02, "unresolved-edge": 0.01}
BEHAVIOURAL = {"dynamic-dispatch": 0.02, "reflection": 0.01, "di": 0.01, "framework-routing": 0.01, "macros": 0.005, "fn-pointers": 0.005, "cross-repo": 0.005}
STRUCTURAL_CAPABILITIES = ("symbols", "search", "architecture", "repo-map")
#: Constructs that no reader of source text resolves: (language, pattern, name); fixed values.
DYNAMIC = (
    ("python", r"\b(getattr|setattr|eval|exec|importlib|__import__)\b", "dynamic_reflection"), ("python", r"\b(globals|locals)\(\)\s*\[", "dynamic_symbol_lookup"),
    ("typescript", r"\beval\s*\(", "dynamic_eval"), ("typescript", r"\bimport\s*\(", "dynamic_import"), ("typescript", r"\b(window|globalThis)\s*\[", "dynamic_global_lookup"),
    ("javascript", r"\beval\s*\(", "dynamic_eval"), ("javascript", r"\bimport\s*\(", "dynamic_import"), ("javascript", r"\b(window|globalThis)\s*\[", "dynamic_global_lookup"),
    ("java", r"\bClass\.forName\b", "dynamic_class_loading"), ("java", r"\b(getMethod|getDeclaredMethod|invoke)\b", "dynamic_reflection"), ("java", r"\bProxy\.newProxyInstance\b", "dynamic_proxy"),
    ("go", r"\breflect\.(ValueOf|TypeOf|New|MakeFunc)\b", "dynamic_reflection"), ("go", r"\.\(\s*type\s*\)", "dynamic_type_switch"), ("go", r"\.\(\s*any\s*\)|\.\(\s*interface\{\}\s*\)", "dynamic_any_assertion"),
    ("rust", r"\b(std::any::Any|downcast_ref)\b", "dynamic_any_downcast"), ("rust", r"(&\s*dyn\s+\w+|Box<\s*dyn\s+[^>]+>|\bdyn\s+[A-Z]\w*)", "dynamic_trait_object"),
    ("c", r"\b(dlopen|dlsym)\b", "dynamic_library_loading"), ("cpp", r"\b(dlopen|dlsym)\b", "dynamic_library_loading"),
)
#: Caps of what a receipt shows; fixed values.
EDGES_CAP, EVIDENCE_CAP, TRANSITIVE_CAP, FILES_CAP = 500, 50, 200, 200
SUPPORTED = ("py", "go", "ts", "tsx", "js", "jsx", "java", "rs", "rb", "c", "h", "cpp", "cc", "cs", "kt", "md", "txt", "json", "yaml", "yml", "toml")
TREE_FANOUT = 1024
VOLATILE = ("captured_at", "snapshot_id", "execution_time_ms", "elapsed_ms")


def is_excluded(path: Column) -> Column:
    """Generated or foreign: by a folder on the way, or by the file's name."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(x) for x in GENERATED_FOLDERS])) | F.rlike(F.element_at(parts, -1), F.lit(GENERATED_NAME))


def coverage(journal: DataFrame, disk: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """path, state, language of every journaled file, and of those of the scope that never were. Foreign files are
    excluded; bytes that differ from the journal's are stale whatever the parser said; times say nothing."""
    j = journal.select("path", F.col("digest").alias("jd"), F.col("size").alias("js"), "parser_outcome", F.lit(True).alias("known"))
    if scope is not None:
        j = scope.select("path").distinct().join(j, "path", "left")
    x = j.join(disk.select("path", F.col("digest").alias("dd"), F.col("size").alias("ds")), "path", "left")
    stale = F.col("dd").isNotNull() & ~((F.col("dd") == F.col("jd")) & (F.col("ds") == F.col("js")))
    parsed = F.when(F.col("parser_outcome").isNull(), "parsed").otherwise(names.lookup(OUTCOMES, F.col("parser_outcome"), F.lit("unknown")))
    state = F.when(is_excluded(F.col("path")), "excluded").when(F.col("known").isNull(), "unknown").when(F.coalesce(stale, F.lit(True)) & F.col("dd").isNotNull(), "stale").otherwise(parsed)
    return x.select("path", state.alias("state"), names.language_of(F.col("path")).alias("language"))


def coverage_totals(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("files"))


def coverage_report(states: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """One row: files, in_scope, covered, fraction (null without any in scope), gaps."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    x = states.agg(F.count(F.lit(1)).alias("files"), (F.count(F.lit(1)) - n("excluded")).alias("in_scope"), n("indexed", "parsed").alias("covered"), n("partial").alias("p"), n("skipped").alias("f"), n("excluded").alias("g"), n("stale").alias("s"))
    pending = F.lit(0)
    if unresolved is not None:
        x = x.crossJoin(unresolved.agg(F.count(F.lit(1)).alias("pending")))  # single rows
        pending = F.col("pending")
    gap = lambda c, name: F.when(c > 0, name)
    gaps = F.array_compact(F.array(gap(F.col("p"), "parser-partial"), gap(F.col("f"), "parser-failed"), gap(F.col("g"), "generated"), gap(F.col("s"), "stale-content"), gap(pending, "unresolved-edge")))
    return x.select("files", "in_scope", "covered", (F.col("covered") / F.nullif("in_scope", F.lit(0))).alias("fraction"), F.col("f").alias("parser_failed"), gaps.alias("gaps"))


def completeness(fraction: Column, gaps: Column, capability: str = "callgraph") -> Column:
    """Covered fraction less what the gaps cost, 0 at least; null where nothing is measured."""
    costs = STRUCTURAL if capability in STRUCTURAL_CAPABILITIES else STRUCTURAL | BEHAVIOURAL
    cost = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + names.lookup(costs, g, F.lit(0.0)))
    return F.when(fraction.isNotNull(), F.greatest(F.lit(0.0), fraction - cost))


def universe(journal: DataFrame, disk: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """path, place: eligible, excluded, unknown (eligible, never journaled) or missing (journaled, not on disk) of every file
    that a claim of absence could have missed, with the parser's outcome and the digest. Errors of the walk are rows too."""
    j = journal.select("path", "parser_outcome", F.lit(True).alias("known"))
    x = j.join(disk.select("path", "digest"), "path", "full_outer")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = is_excluded(F.col("path"))
    place = (
        F.when(out & F.col("digest").isNotNull(), "excluded").when(out, F.lit(None)).when(F.col("digest").isNull(), "missing").when(F.col("known").isNotNull(), "eligible")
        .when(ext.isin(*SUPPORTED), "unknown")
    )
    rows = x.select("path", place.alias("place"), "parser_outcome", "digest").where("place is not null")
    if errors is not None:
        rows = rows.unionByName(errors.select("path", F.lit("walk_error").alias("place"), F.lit(None).cast("string").alias("parser_outcome"), F.lit(None).cast("string").alias("digest")))
    return rows


def universe_facts(files: DataFrame) -> DataFrame:
    """One row: counts, how much was enumerated, and whether enumeration and parsing were complete."""
    n = lambda *p: F.count_if(F.col("place").isin(*p))
    weak = (F.col("place") == "eligible") & F.col("parser_outcome").isNotNull() & ~F.col("parser_outcome").isin("COMPLETE", "VALID_EMPTY")
    x = files.agg(
        n("eligible", "unknown").alias("eligible"), n("excluded").alias("excluded"), n("unknown").alias("unknown"), n("missing").alias("missing"), n("walk_error").alias("walk_errors"),
        F.count_if(weak).alias("weak"), F.count_if((F.col("place") == "eligible") & (F.col("parser_outcome") == "PARTIAL_AST")).alias("partial"),
    )
    e, u = F.col("eligible"), F.col("unknown")
    return x.select(
        "eligible", "excluded", "unknown", "missing", "walk_errors", F.when(e == 0, 1.0).otherwise((e - u) / e).alias("enumeration_fraction"), ((u == 0) & (F.col("walk_errors") == 0)).alias("enumeration_complete"),
        (F.col("weak") == 0).alias("parser_capability_complete"), (F.col("partial") > 0).alias("partial_ast_present"),
    )


def hash_tree(rows: DataFrame, order: list[str], text: Column, fanout: int = TREE_FANOUT) -> DataFrame:
    """level, node, hash of a tree over rows in order; a group holds `fanout` hashes at most, so no task sees all rows. The one
    node of the last level is the root; no rows, no nodes."""
    nodes = numbered(rows.select(*order, F.sha2(text, 256).alias("hash")), order, "node").select("node", "hash")
    nodes, level, out = cut(nodes), 0, None
    n = nodes.count()
    while n and (n > 1 or level == 0):
        level += 1
        n = -(-n // fanout)
        inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda z: z["hash"]), "")
        nodes = cut(nodes.groupBy(F.floor(F.col("node") / fanout).alias("up")).agg(F.sha2(inside, 256).alias("hash")).select(F.col("up").alias("node"), "hash"))
        one = nodes.select(F.lit(level).alias("level"), "node", "hash")
        out = one if out is None else out.unionByName(one)
    return nodes.limit(0).select(F.lit(0).alias("level"), "node", "hash") if out is None else out


def scope_manifest(journal: DataFrame, disk: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """path, quarantined, parser_error, constructs: the files of a scope; unjournaled, unparsed and vanished ones are
    quarantined, and constructs that cannot be resolved are named. disk: path, content."""
    j = journal.select("path", "parser_outcome", F.lit(True).alias("known"))
    d = disk.select("path", "content", F.lit(True).alias("there"))
    x = j.join(d, "path", "full_outer").where(~is_excluded(F.col("path")))
    if targets is not None:
        x = x.join(targets.select("path").distinct(), "path", "left_semi")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    x = x.where(F.col("known").isNotNull() | ext.isin(*SUPPORTED))
    lang = names.language_of(F.col("path"))
    found = F.array_compact(F.array(
        *[F.when((lang == l) & F.rlike(F.coalesce("content", F.lit("")), F.lit(p)), k) for l, p, k in DYNAMIC], F.when(F.col("known").isNull(), "unjournaled_file"), F.when(F.col("there").isNull(), "missing_source")
    ))
    bad = F.col("known").isNull() | F.col("there").isNull() | F.coalesce(F.col("parser_outcome").isin("PARSE_ERROR", "PARSER_UNAVAILABLE"), F.lit(False))
    return x.select("path", bad.alias("quarantined"), bad.alias("parser_error"), F.sort_array(found).alias("constructs"))


def quarantined(paths: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths that the manifest holds back."""
    return paths.join(manifest.where("quarantined or parser_error").select("path"), "path", "left_semi")


def enough_providers(providers: DataFrame, capability: str) -> DataFrame:
    """Providers of a capability, best first. providers: provider, capabilities (list), priority, available."""
    return providers.where(F.col("available") & F.array_contains("capabilities", capability)).orderBy(F.desc("priority"), "provider")


def edges_of(edges: DataFrame, nodes: DataFrame, targets: DataFrame, direction: str, relations: tuple[str, ...] | None = None, cap: int = EDGES_CAP) -> DataFrame:
    """target, relation, line, id, path, kind, symbol, place: one-hop edges of each target (id) that lead to a node, by path,
    symbol and id, cap of them."""
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    hit = e.join(targets.select(F.col("id").alias(near)).distinct(), near, "left_semi").select(F.col(near).alias("target"), "relation", "line", F.col(far).alias("id"))
    x = hit.join(nodes.select("id", "path", "kind", "symbol"), "id")
    place = Window.partitionBy("target").orderBy("path", "symbol", "id", "relation")
    return x.withColumn("place", F.row_number().over(place)).where(F.col("place") <= cap).select("target", "relation", "line", "id", "path", "kind", "symbol", "place")


def edge_counts(edges: DataFrame, nodes: DataFrame, targets: DataFrame, direction: str, relations: tuple[str, ...] | None = None, cap: int = EDGES_CAP) -> DataFrame:
    """target, enumerated, returned, cap, truncated of the same edges; a target without any has zeros."""
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    n = e.join(nodes.select(F.col("id").alias(far)), far, "left_semi").groupBy(F.col(near).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    x = targets.select("id").distinct().join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.select(F.col("id").alias("target"), "n", counted(F.col("n"), F.least("n", F.lit(cap)), F.lit(cap)).alias("c")).select("target", "c.*")


def counted(enumerated: Column, returned: Column, cap: Column) -> Column:
    """Accounting of a bounded list: it was cut if more was there than is shown."""
    return F.struct(enumerated.alias("enumerated"), returned.alias("returned"), cap.alias("cap"), (enumerated > returned).alias("truncated"))


def merged_counts(parts: DataFrame, by: str) -> DataFrame:
    """The accounting of a collection that several bounded queries make."""
    return parts.groupBy(by).agg(F.sum("enumerated").alias("enumerated"), F.sum("returned").alias("returned"), F.max("cap").alias("cap"), F.bool_or("truncated").alias("truncated"))


def truncation_sources(stats: DataFrame) -> DataFrame:
    """One row, sources: names of the collections that were cut. stats: source, cap, truncated."""
    return stats.agg(F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("truncated"), F.concat("source", F.lit("_cap_"), F.col("cap").cast("string")))))).alias("sources"))


def projection(collections: DataFrame, transport: DataFrame) -> DataFrame:
    """key, enumerated, returned, truncated: of the collector's and the transport's accounting the worse."""
    t = transport.select("key", F.col("enumerated").alias("te"), F.col("returned").alias("tr"))
    x = collections.join(t, "key", "left")
    e, r = F.greatest("enumerated", F.coalesce("te", F.lit(0))), F.least("returned", F.coalesce("tr", "returned"))
    return x.select("key", e.alias("enumerated"), r.alias("returned"), (F.col("truncated") | F.coalesce(F.col("tr") < F.col("te"), F.lit(False))).alias("truncated"))


def change_risk(kind: Column, symbol_kind: Column, auth: Column, dynamic: Column) -> Column:
    """(level, security_reviewer, absence_assurance, rule) of a change by the first rule that holds."""
    one = lambda level, reviewer, absence, rule: F.struct(F.lit(level).alias("level"), F.lit(reviewer).alias("security_reviewer"), F.lit(absence).alias("absence_assurance"), F.lit(rule).alias("rule"))
    return (
        F.when(auth, one("audit", True, False, "auth/tenant → audit + security reviewer")).when(dynamic, one("audit", False, False, "dynamic-heavy → no absence assurance"))
        .when(kind.isin("rename", "delete", "public-api"), one("audit", False, True, "public API/rename/delete → audit"))
        .when(symbol_kind.isin("class", "interface", "trait", "struct"), one("audit", False, True, "type surface (class/interface) → audit")).otherwise(one("verify", False, True, "local body → verify"))
    )


def looks_like_test(path: Column, symbol: Column) -> Column:
    low = F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"))
    return F.contains(low, F.lit("test")) | F.contains(low, F.lit("spec")) | F.startswith(F.coalesce(symbol, F.lit("")), F.lit("test_"))


def rename_gate(asked: DataFrame, nodes: DataFrame, edges: DataFrame, states: DataFrame, facts: DataFrame) -> DataFrame:
    """query, id, callers_found, scoped_coverage, blocked: a rename of a name without callers waits until the universe is
    exhausted and the file of the name fully covered; of an unknown name it always waits.

    asked: query, id (null where there is no such node); facts: the one row of universe_facts().
    """
    rel = ("calls", "call_reference", "usage")
    callers = edges.where(F.col("relation").isin(*rel)).join(asked.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src"), F.col("path").alias("from")), "src")
    x = asked.join(nodes.select("id", "path"), "id", "left")
    touched = x.select("query", "path").unionByName(callers.join(asked.select("query", F.col("id").alias("dst")), "dst").select("query", F.col("from").alias("path"))).distinct()
    # files outside the journal's universe are unknown, not covered
    s = touched.where("path <> ''").join(states.select("path", "state"), "path", "left").groupBy("query").agg(
        (F.count_if(F.col("state").isin("indexed", "parsed")) / F.nullif(F.count_if(~F.col("state").eqNullSafe("excluded")), F.lit(0))).alias("scoped_coverage")
    )
    n = callers.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    y = x.join(n, "id", "left").join(s, "query", "left").crossJoin(F.broadcast(facts.select("enumeration_complete", "parser_capability_complete")))  # one row
    found = F.coalesce("n", F.lit(0))
    enough = F.col("enumeration_complete") & F.col("parser_capability_complete") & F.coalesce(F.col("scoped_coverage") == 1.0, F.lit(False))
    blocked = F.col("id").isNull() | ((found == 0) & ~F.coalesce(enough, F.lit(False)))
    return y.select("query", "id", found.alias("callers_found"), F.when(F.col("id").isNotNull(), F.col("scoped_coverage")).alias("scoped_coverage"), blocked.alias("blocked"))


def scope_receipts(
    asked: DataFrame, nodes: DataFrame, edges: DataFrame, journal: DataFrame, disk: DataFrame, health: DataFrame, reached: DataFrame | None = None, change: str = "local-body", auth: bool = False, dynamic: bool = False
) -> DataFrame:
    """One row for each asked name, before a change: identity, callers, callees, what is reached, affected files, tests, stale
    files, risk, gate, status, reasons and digest.

    health: the one row of ledger.health(); reached: target, id of what the change may reach (see traverse.reach()).
    """
    who = cut(symbol_identity(nodes, asked))
    targets = who.where("id is not null").select("id").distinct()
    ins, outs = cut(edges_of(edges, nodes, targets, "in")), cut(edges_of(edges, nodes, targets, "out"))
    ci, co = edge_counts(edges, nodes, targets, "in"), edge_counts(edges, nodes, targets, "out")
    per = ci.select("target", F.col("enumerated").alias("callers"), F.col("truncated").alias("t1")).join(co.select("target", F.col("enumerated").alias("callees"), F.col("truncated").alias("t2")), "target")
    place = Window.partitionBy("target").orderBy("id")
    walk = (reached if reached is not None else ins.select("target", "id").limit(0)).join(nodes.select("id", "path"), "id").withColumn("n", F.row_number().over(place))
    size = walk.groupBy("target").agg(F.least(F.count(F.lit(1)), F.lit(TRANSITIVE_CAP)).alias("transitive"), (F.count(F.lit(1)) > TRANSITIVE_CAP).alias("t3"))
    own = targets.join(nodes.select("id", "path"), "id").select(F.col("id").alias("target"), "path")
    files = cut(own.unionByName(ins.select("target", "path")).unionByName(outs.select("target", "path")).unionByName(walk.where(F.col("n") <= TRANSITIVE_CAP).select("target", "path")).where("path <> ''").distinct())
    states = cut(coverage(journal, disk))
    manifest = cut(scope_manifest(journal, disk, files.select("path")))
    cited = files.join(states, "path", "left").join(manifest, "path", "left").join(disk.select("path", F.lit(True).alias("there")), "path", "left")
    f = cited.groupBy("target").agg(
        F.count(F.lit(1)).alias("affected_files"), F.count_if(looks_like_test(F.col("path"), F.lit(""))).alias("tests"), F.count_if(F.col("state") == "stale").alias("stale_files"),
        F.count_if(F.col("parser_error")).alias("parser_errors"), F.count_if(F.size("constructs") > 0).alias("dynamic_files"), F.bool_and(F.coalesce("there", F.lit(False))).alias("bound"),
    )
    report, facts = coverage_report(states), universe_facts(universe(journal, disk))
    gate = rename_gate(who.select("query", "id"), nodes, edges, states, facts).select("query", "blocked") if change in ("rename", "delete") else None
    x = who.join(per, F.col("id") == F.col("target"), "left").drop("target").join(size, F.col("id") == F.col("target"), "left").drop("target").join(f, F.col("id") == F.col("target"), "left").drop("target")
    x = x.join(nodes.select("id", F.col("kind").alias("node_kind")), "id", "left")
    x = x.join(gate, "query", "left") if gate is not None else x.withColumn("blocked", F.lit(False))
    one = report.crossJoin(facts).crossJoin(health.select("open_conflicts", "unresolved", "provider_ok", F.col("truncated").alias("runs_cut")))  # single rows
    x = x.crossJoin(F.broadcast(one.withColumnRenamed("unknown", "unknown_files")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    unresolved_code = F.lit(dynamic) | (zero("dynamic_files") > 0)
    risk = change_risk(F.lit(change), F.coalesce("node_kind", F.lit("")), F.lit(auth), unresolved_code)
    sources = F.array_compact(F.array(F.when(no("t1") | no("t2"), "edges_cap_500"), F.when(no("t3"), "transitive_cap_200"), F.when(no("runs_cut"), "ledger_runs_cap_200")))
    x = x.withColumns({"risk": risk, "sources": sources, "dyn": unresolved_code})
    decided = trust.decide(
        F.col("status"), no("bound"), F.lit(False), zero("stale_files"), F.col("fraction").isNotNull(), F.col("fraction"), F.greatest("parser_failed", zero("parser_errors")), F.col("unresolved"), F.col("open_conflicts"),
        F.size("sources") > 0, F.col("sources"), F.col("enumeration_complete"), F.col("parser_capability_complete"), F.col("partial_ast_present"), F.col("provider_ok"),
        F.col("risk.absence_assurance") & (zero("callers") == 0), no("blocked"), F.col("dyn"), F.lit("absence"),
    )
    x = x.withColumn("d", decided)
    out = x.select(
        "query", F.col("status").alias("identity"), "id", zero("callers").alias("callers"), zero("callees").alias("callees"), zero("transitive").alias("transitive"), zero("affected_files").alias("affected_files"), zero("tests").alias("tests"),
        zero("stale_files").alias("stale_files"), F.col("risk.level").alias("level"), no("blocked").alias("blocked"), F.col("d.status").alias("status"), F.array_join("d.reason_codes", ",").alias("reasons"),
    )
    return out.withColumn("digest", digest(out.columns))


def digest(columns: list[str]) -> Column:
    """SHA-256 over the canonical JSON (keys in order, nulls too) of the columns that do not change with time."""
    held = sorted(c for c in columns if c not in VOLATILE)
    return F.sha2(F.to_json(F.struct(*held), {"ignoreNullFields": "false"}), 256)


def diff_receipt(changed: DataFrame, tests: DataFrame, journal: DataFrame, disk: DataFrame, evidence: DataFrame, runs: DataFrame, health: DataFrame, project: str, open_confirmations: int = 0) -> DataFrame:
    """One row after a change: files (the first of them by name are measured), live and dead evidence on them, tests to run,
    stale files, status, reasons, closure and digest. changed: path; tests: path."""
    files = changed.select("path").distinct()
    cited = cut(files.orderBy("path").limit(FILES_CAP))
    n = files.agg(F.count(F.lit(1)).alias("changed_files"))
    good = runs.where((F.col("status") == "ok") & (F.col("project") == project)).select("run_id")
    e = evidence.withColumn("path", F.regexp_replace("path", r"\\", "/")).join(cited, "path", "left_semi").join(good, "run_id", "left_semi")
    by = e.groupBy("path").agg(F.count_if(F.col("invalidated_at").isNull()).alias("live"), F.count_if(F.col("invalidated_at").isNotNull()).alias("dead"))
    ev = by.agg(F.coalesce(F.sum(F.least("live", F.lit(EVIDENCE_CAP))), F.lit(0)).alias("invalidated"), F.coalesce(F.sum("dead"), F.lit(0)).alias("dead"), F.coalesce(F.max("live"), F.lit(0)).alias("most"))
    j, d = journal.select("path", F.col("digest").alias("jd")), disk.select("path", F.col("digest").alias("dd"))
    s = cited.join(j, "path", "left").join(d, "path", "left").agg(F.count_if(~F.coalesce(F.col("jd") == F.col("dd"), F.lit(False))).alias("stale"), F.coalesce(F.bool_and(F.col("dd").isNotNull()), F.lit(False)).alias("bound"))
    m = scope_manifest(journal, disk, files).agg(F.count_if("parser_error").alias("parser_errors"), F.count_if(F.size("constructs") > 0).alias("dynamic"))
    t = tests.where("path <> ''").agg(F.count_distinct("path").alias("tests_to_run"))
    x = n.crossJoin(ev).crossJoin(s).crossJoin(m).crossJoin(t).crossJoin(health.select("open_conflicts", "provider_ok", F.col("truncated").alias("runs_cut")))  # single rows
    sources = F.array_compact(F.array(F.when(F.col("changed_files") > FILES_CAP, "changed_files_cap_200"), F.when(F.col("most") > EVIDENCE_CAP, "evidence_cap_50"), F.when(F.col("runs_cut"), "ledger_runs_cap_200")))
    x = x.withColumn("sources", sources)
    d = trust.decide(
        F.lit("UNIQUE"), F.col("bound"), F.lit(False), F.col("stale"), F.lit(False), F.lit(None).cast("double"), F.col("parser_errors"), F.col("invalidated"), F.col("open_conflicts"), F.size("sources") > 0, F.col("sources"),
        F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(False), F.col("provider_ok"), F.lit(False), F.lit(False), F.col("dynamic") > 0, F.lit("scoped"),
    )
    x = x.withColumn("d", d)
    out = x.select(
        "changed_files", F.least("changed_files", F.lit(FILES_CAP)).alias("measured_files"), "invalidated", F.col("dead").alias("dead_evidence"), "tests_to_run", F.col("stale").alias("stale_files"), F.col("d.status").alias("status"),
        F.array_join("d.reason_codes", ",").alias("reasons"), F.when(F.col("d.status") == "ASSURED_WITHIN_SCOPE", "closed").otherwise("open").alias("closure"),
        ((F.col("invalidated") > 0).cast("int") + F.lit(int(open_confirmations > 0))).alias("remaining_gaps"),
    )
    return out.withColumn("digest", digest(out.columns))


def index_receipt(kind: str, journal: DataFrame, disk: DataFrame, pending: DataFrame, health: DataFrame, failed: int = 0, conflicts: int = 0, problems: int = 0, unresolved: int = 0) -> DataFrame:
    """One row on the whole index after a reconcile or an audit (kind): failures, quarantine, stale files, pending
    references, coverage, status, reasons and digest; unjournaled or unparsed files are collection errors."""
    states = cut(coverage(journal, disk))
    m = scope_manifest(journal, disk).agg(F.count_if("quarantined").alias("quarantined"), F.count_if("parser_error").alias("parser_errors"))
    p = journal.agg(F.count_if(F.col("parser_outcome").isin("PARSE_ERROR", "PARSER_UNAVAILABLE")).alias("failures"))
    u = pending.where("resolution_state <> 'RESOLVED'").agg(F.count(F.lit(1)).alias("pending"))
    s = states.agg(F.count_if(F.col("state") == "stale").alias("stale"))
    x = coverage_report(states).drop("gaps").crossJoin(m).crossJoin(p).crossJoin(u).crossJoin(s).crossJoin(health.select("open_conflicts", "provider_ok"))  # single rows
    errors = (F.col("quarantined") > 0).cast("int") + F.lit(int(failed > 0)) + F.lit(int(problems > 0))
    x = x.withColumns({"errors": errors, "failures": F.col("failures") + F.col("quarantined") + F.col("parser_errors") + F.lit(failed), "pending": F.greatest("pending", F.lit(unresolved)), "conflicts": F.col("open_conflicts") + F.lit(conflicts)})
    clean = F.col("errors") == 0
    d = trust.decide(
        F.lit("UNIQUE"), clean, ~clean, F.col("stale"), clean, F.coalesce("fraction", F.lit(0.0)), F.col("failures"), F.col("pending"), F.col("conflicts"), F.lit(False), F.lit(None).cast("array<string>"),
        F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(False), F.col("provider_ok"), F.lit(True), F.lit(False), F.lit(False), F.lit("absence"),
    )
    x = x.withColumn("d", d)
    out = x.select(F.lit(kind).alias("kind"), "failures", "quarantined", F.col("stale").alias("stale_files"), "pending", F.round("fraction", 6).alias("fraction"), "conflicts", F.col("d.status").alias("status"), F.array_join("d.reason_codes", ",").alias("reasons"))
    return out.withColumn("digest", digest(out.columns))


def cross_check_receipt(totals: DataFrame) -> DataFrame:
    """One row from ledger.totals(): conflicts, unresolved identities, status, reasons; without any external row it abstains."""
    of = lambda *b: F.coalesce(F.sum(F.when(F.col("bucket").isin(*b), F.col("claims"))), F.lit(0))
    x = totals.agg((of("relation_conflict") + F.coalesce(F.sum("span_conflicts"), F.lit(0))).alias("conflicts"), of("unresolved_builtin", "unresolved_external").alias("unresolved"), F.coalesce(F.sum("external_rows"), F.lit(0)).alias("external_rows"))
    d = trust.decide(
        F.lit("UNIQUE"), F.lit(True), F.lit(False), F.lit(0), F.lit(False), F.lit(None).cast("double"), F.lit(0), F.col("unresolved"), F.col("conflicts"), F.lit(False), F.lit(None).cast("array<string>"),
        F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(False), F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.lit("presence"),
    )
    x = x.withColumn("d", d)
    alone = (F.col("external_rows") == 0) & (F.col("d.status") == "ASSURED_WITHIN_SCOPE")
    return x.select(
        "conflicts", "unresolved", "external_rows", F.when(alone, "ABSTAINED").otherwise(F.col("d.status")).alias("status"), F.when(alone, "no_external_evidence").otherwise(F.array_join("d.reason_codes", ",")).alias("reasons")
    )


def ledger_receipt(runs: DataFrame, union: DataFrame) -> DataFrame:
    """One row that stored rows alone make: runs, their evidence, entries, conflicts."""
    a = runs.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("evidence_rows"), F.lit(0)).alias("evidence_rows"))
    return a.crossJoin(union.agg(F.count(F.lit(1)).alias("union_entries"), F.count_if("conflict").alias("conflict_count")))  # single rows


def generation(journal: DataFrame) -> DataFrame:
    """One row: the newest generation of any file, 1 for none."""
    return journal.agg(F.coalesce(F.max("generation"), F.lit(1)).alias("generation"))


def envelope(data: DataFrame, journal: DataFrame, providers: DataFrame, manifest: DataFrame, completeness_: str = "COMPLETE_WITHIN_INDEX_CAPABILITY") -> DataFrame:
    """Each row of data as JSON in an envelope that says from which state of the index it comes. manifest: one row, digest.

    Nothing is complete beyond what the index can tell.
    """
    said = "COMPLETE_WITHIN_INDEX_CAPABILITY" if completeness_ in ("GLOBAL_COMPLETE", "COMPLETE") else completeness_
    p = providers.agg(F.array_sort(F.collect_list(F.struct("provider", "version", "capability"))).alias("providers"))  # as many as are installed
    one = generation(journal).crossJoin(p).crossJoin(manifest.select(F.col("digest").alias("manifest_digest")))  # single rows
    return data.select(F.to_json(F.struct(*data.columns)).alias("data")).crossJoin(F.broadcast(one)).select(
        F.lit("1.0").alias("schema_version"), F.col("generation").alias("snapshot_generation"), "manifest_digest", F.lit(said).alias("completeness"), "providers", "data"
    )


def bounded(value: int | None, most: int, default: int = 1) -> int:
    """A caller's number between 1 and a limit."""
    try:
        return max(1, min(int(value), most))
    except (TypeError, ValueError):
        return default


def fits(rows: DataFrame, order: list, most: int = 256 * 1024) -> DataFrame:
    """The longest beginning of a page of rows whose JSON stays within a size; whether a row more was there is said."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # a page
    x = rows.withColumn("__used", F.sum(size).over(so_far))
    n = rows.agg(F.count(F.lit(1)).alias("enumerated"))
    return x.where(F.col("__used") <= most).drop("__used").crossJoin(F.broadcast(n))  # one row
