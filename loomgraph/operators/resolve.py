"""Which node a name means: lookups by tier, and unresolved references against the whole graph.

Never a guess: where a rule finds several, the answer says so. Ties that the data leaves open go by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.traverse import reach
from loomgraph.shared import cut, written
from loomgraph.sources.texts import dotted_module, resolve_relative

MODULE_DEPTH = 8


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once a row, not at each place and each step of a lambda that it stands in."""
    return F.element_at(F.transform(F.array(value), use), 1)


def project_names(path: Column) -> Column:
    """Every dotted suffix under which a file may be imported, shortest first."""

    def stem(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        before = F.slice(parts, 1, F.size(parts) - 1)
        return F.when(last == "__init__.py", before).otherwise(F.concat(before, F.array(F.regexp_replace(last, r"\.pyi?$", ""))))

    def names(of: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.least(F.size(of), F.lit(MODULE_DEPTH))), lambda k: F.array_join(F.slice(of, -k, k), "."))
        return F.when(F.size(of) > 0, made).otherwise(F.array().cast("array<string>"))

    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: x != "")
    some = _once(parts, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("__init__.py"))))
    return _once(_once(some, stem), names)


def directory(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/+$", "")


def tail(symbol: Column) -> Column:
    """What stands after the last colon."""
    return F.element_at(F.split(symbol, ":"), -1)


def imported(source: Column, path: Column) -> Column:
    """The module an import names: relative ones made absolute against their file, else without leading dots."""
    plain = F.trim(F.regexp_replace(F.coalesce(source, F.lit("")), r"^\.+", ""))
    whole = resolve_relative(source, dotted_module(path), F.coalesce(F.endswith(path, F.lit("__init__.py")), F.lit(False)))
    return F.when(F.startswith(source, F.lit(".")) & (whole != ""), whole).otherwise(plain)


def _prefixes(name: Column) -> Column:
    """Proper dotted prefixes."""

    def begins(parts: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))
        return F.when(F.size(parts) > 1, made).otherwise(F.array().cast("array<string>"))

    return _once(F.split(name, r"\."), begins)


def external_imports(imports: DataFrame, names: DataFrame) -> DataFrame:
    """imp of those imports that are neither a project module nor a prefix or an extension of one."""
    known = names.select("name").unionByName(names.select(F.explode(_prefixes(F.col("name"))).alias("name"))).distinct()
    rest = imports.where("imp <> ''").select("imp").distinct().join(known, F.col("imp") == F.col("name"), "left_anti")
    longer = rest.select("imp", F.explode(_prefixes(F.col("imp"))).alias("p")).join(names, F.col("p") == F.col("name"), "left_semi").select("imp")
    return rest.join(longer.distinct(), "imp", "left_anti")


def inherited_methods(asked: DataFrame, nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """cls, method, id of each asked (cls, method): the class's own method, else that of the nearest base; bases: cls, base.

    Of bases equally near the first by name counts. The walk goes on until no class is new; methods that nobody asks for
    are never listed, however many a common base has.
    """
    own = nodes.where("kind = 'method' and instr(symbol, '.') > 0").select(
        F.regexp_extract("symbol", r"^(.*)\.[^.]*$", 1).alias("owner"), F.element_at(F.split("symbol", r"\."), -1).alias("method"), "id"
    ).groupBy("owner", "method").agg(F.min("id").alias("id"))
    up = reach(cut(bases.select(F.col("cls").alias("src"), F.col("base").alias("dst"))), asked.select(F.col("cls").alias("id")).distinct(), None)
    found = asked.join(up.select(F.col("source").alias("cls"), F.col("id").alias("owner"), "depth"), "cls").join(own, ["owner", "method"])
    return found.groupBy("cls", "method").agg(F.min_by("id", F.struct("depth", "owner")).alias("id"))


def candidates_in(places: DataFrame, modules: DataFrame) -> DataFrame:
    """dst_symbol, module, k, id: how many candidates of a name lie in files of a module, and the first of them.

    places: dst_symbol, at, k, id. A module (modules: module) stands for every file with a name that begins with it. The
    names are few and bring the prefixes that were asked for; so files and references meet by equality, and each module
    has one row a name, however many files both have.
    """
    files = places.select("at").distinct().select("at", F.explode(project_names(F.col("at"))).alias("name"))
    begins = F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substr("name", F.lit(1), n))
    covers = files.where("name <> ''").select("name").distinct().select("name", F.explode(begins).alias("module")).join(modules.distinct(), "module", "left_semi")
    inside = files.join(covers, "name").select("at", "module").distinct()
    return places.join(inside, "at").groupBy("dst_symbol", "module").agg(F.sum("k").alias("k"), F.min("id").alias("id"))


def resolve_pending(pending: DataFrame, nodes: DataFrame, edges: DataFrame, paths: DataFrame, symbols: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Each reference with state (EXTERNAL, RESOLVED, AMBIGUOUS, UNRESOLVED), tier and target.

    pending: path, src, dst_symbol, relation, line, import_source, receiver; nodes: id, path, symbol, kind, fqn; edges:
    path, src, dst, relation; paths: the project's files. With symbols or path only references to those or from there
    are resolved. Tiers: receiver's class and its bases, then the caller's class; re-exports; files of the imported
    module; files the caller imports; files in its folder; the only one in another file; a file itself. Each tier looks
    at the distinct combinations that ask it and counts what it finds, so a frequent name is never listed per row.
    """
    rows = pending
    if symbols or path:
        rows = rows.where(F.col("dst_symbol").isin(*(symbols or [])) | (F.col("path") == F.lit(path)))
    asks = F.coalesce(F.col("receiver"), F.lit("")) != ""
    rows = cut(rows.withColumns({
        "imp": imported(F.col("import_source"), F.col("path")), "folder": directory(F.col("path")), "cls": F.when(asks, tail(F.col("receiver"))),
        "caller": F.when(asks & F.contains("src", F.lit(".")), F.regexp_extract(tail(F.col("src")), r"^(.*)\.[^.]*$", 1)),
    }))
    names = written(paths.select(F.explode(project_names(F.col("path"))).alias("name")).distinct())  # read several times below
    outside = external_imports(rows, names).withColumn("outside", F.lit(True))

    named = nodes.where("symbol is not null")
    index = named.select(F.col("symbol").alias("dst_symbol"), "id", F.col("path").alias("at")).unionByName(
        named.where("fqn is not null and fqn <> symbol").select(F.col("fqn").alias("dst_symbol"), "id", F.col("path").alias("at"))
    )
    index = cut(index.join(rows.select("dst_symbol").distinct(), "dst_symbol", "left_semi"))  # of names that are asked for
    counts = index.groupBy("dst_symbol").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only_id"), F.min("at").alias("only_at"))
    places = index.groupBy("dst_symbol", "at").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"))

    # 1: receiver and bases
    up = F.col("relation").isin("extends", "inherits", "implements")
    bases = edges.where(up).select(tail(F.col("src")).alias("cls"), tail(F.col("dst")).alias("base")).unionByName(
        pending.where(up).select(tail(F.col("src")).alias("cls"), tail(F.col("dst_symbol")).alias("base"))
    ).distinct()
    wanted = rows.select("cls", F.col("dst_symbol").alias("method")).unionByName(rows.select(F.col("caller").alias("cls"), F.col("dst_symbol").alias("method")))
    methods = inherited_methods(cut(wanted.where("cls is not null and cls <> ''").distinct()), nodes, bases)
    by_cls = methods.select("cls", F.col("method").alias("dst_symbol"), F.col("id").alias("t1"))
    by_caller = methods.select(F.col("cls").alias("caller"), F.col("method").alias("dst_symbol"), F.col("id").alias("t1b"))

    # 2: what a module's file imports can be imported from that module; of names that references with an import ask for
    wanted_names = rows.where("imp <> ''").select("dst_symbol").distinct()
    imports = edges.where("relation = 'imports'").select("path", F.col("dst").alias("id"))
    offered = nodes.where("symbol <> ''").select("id", F.col("symbol").alias("dst_symbol")).join(wanted_names, "dst_symbol", "left_semi")
    again = imports.join(offered, "id").select(F.explode(project_names(F.col("path"))).alias("imp"), "dst_symbol", "id").groupBy("imp", "dst_symbol").agg(F.min("id").alias("t2"))

    # 3: candidates in files of the imported module, and of the modules that the caller's file imports; these are looked up
    # for files that refer without an import to a name that several have
    many = cut(rows.where("imp = ''").select("path", "dst_symbol").distinct().join(counts.where("n > 1").select("dst_symbol"), "dst_symbol", "left_semi"))
    callers = many.select("path").distinct()
    modules = imports.join(callers, "path", "left_semi").join(nodes.select("id", F.col("path").alias("of")), "id").select("path", F.explode(project_names(F.col("of"))).alias("module")).unionByName(
        pending.where("relation = 'imports' and import_source is not null").join(callers, "path", "left_semi").select("path", F.trim(F.regexp_replace("import_source", r"^\.+", "")).alias("module")).join(names, F.col("module") == F.col("name"), "left_semi")
    )
    modules = cut(modules.distinct())
    scoped = cut(candidates_in(places, modules.select("module").unionByName(rows.where("imp <> ''").select(F.col("imp").alias("module")))))
    in_module = scoped.select(F.col("module").alias("imp"), "dst_symbol", F.col("k").alias("n3"), F.col("id").alias("t3"))
    by_import = many.join(modules, "path").join(scoped, ["dst_symbol", "module"]).groupBy("path", "dst_symbol").agg(
        F.when((F.max("k") == 1) & (F.min("id") == F.max("id")), 1).otherwise(2).alias("n3b"), F.min("id").alias("t3b")
    )

    # 3c: candidates in the caller's folder
    folders = places.select("at").distinct().withColumn("folder", directory(F.col("at")))
    folder = places.join(folders, "at").groupBy("dst_symbol", "folder").agg(F.sum("k").alias("n3c"), F.min("id").alias("t3c"))

    # 5: an import that names a file
    wanted_files = rows.where("imp <> '' and relation = 'imports'").select("imp").distinct()
    files = nodes.where("kind = 'file'").select("id", F.explode(project_names(F.col("path"))).alias("imp")).join(wanted_files, "imp", "left_semi").groupBy("imp").agg(F.count(F.lit(1)).alias("n5"), F.min("id").alias("t5"))

    x = (
        rows.join(outside, "imp", "left").join(counts, "dst_symbol", "left").join(by_cls, ["cls", "dst_symbol"], "left")
        .join(by_caller, ["caller", "dst_symbol"], "left").join(again, ["imp", "dst_symbol"], "left").join(in_module, ["imp", "dst_symbol"], "left")
        .join(by_import, ["path", "dst_symbol"], "left").join(folder, ["dst_symbol", "folder"], "left").join(files, "imp", "left")
    )
    free, several = F.col("imp") == "", F.coalesce(F.col("n") > 1, F.lit(False))
    choice = (
        F.when(F.col("t1").isNotNull(), _chosen("receiver", "t1")).when(F.col("t1b").isNotNull(), _chosen("caller_class", "t1b"))
        .when(~free & F.col("t2").isNotNull(), _chosen("re_export", "t2")).when(~free & (F.col("n3") == 1), _chosen("import", "t3")).when(~free & (F.col("n3") > 1), _chosen("import", None))
        .when(free & several & (F.col("n3b") == 1), _chosen("caller_import", "t3b")).when(free & several & (F.col("n3c") == 1), _chosen("folder", "t3c"))
        .when((F.col("n") == 1) & (F.col("only_at") != F.col("path")), _chosen("unique", "only_id"))
        .when(~free & (F.col("relation") == "imports") & (F.col("n5") == 1), _chosen("file", "t5"))
    )
    x = x.withColumn("c", F.when(F.col("outside").isNull(), choice))
    state = F.when(F.col("outside"), "EXTERNAL").when(F.col("c.target").isNotNull(), "RESOLVED").when(several | F.col("c").isNotNull(), "AMBIGUOUS").otherwise("UNRESOLVED")
    return x.select(*pending.columns, state.alias("state"), F.when(F.col("c.target").isNotNull(), F.col("c.tier")).alias("tier"), F.col("c.target").alias("target"))


def _chosen(tier: str, column: str | None) -> Column:
    return F.struct(F.lit(tier).alias("tier"), (F.col(column) if column else F.lit(None).cast("string")).alias("target"))


def promoted(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new edges, references that stay): resolved ones become edges, external ones go, ambiguous ones say so."""
    edges = resolved.where("state = 'RESOLVED'").groupBy("path", "src", F.col("target").alias("dst"), "relation").agg(F.max("line").alias("line"))
    left = resolved.where("state in ('AMBIGUOUS', 'UNRESOLVED')").drop("tier", "target").withColumnRenamed("state", "resolution_state")
    return edges, left


def node_by_symbol(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """query, id: the node whose symbol or fqn is the query or ends with it after a dot; exact ones first, then by id.

    asked: query. Every node offers its dotted suffixes, so this is one equi-join and not a comparison of all with all.
    """
    offers = nodes.select("id", F.explode(F.array("symbol", "fqn")).alias("name")).where("name is not null")
    parts = F.split("name", r"\.")
    ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, -k, k), ".").alias("query"), (k < F.size(parts)).cast("int").alias("rank")))
    offers = offers.select("id", F.explode(ways).alias("w")).select("id", "w.*")
    return asked.select("query").distinct().join(offers, "query").groupBy("query").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))


def symbol_identity(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """query, status, id, n: UNIQUE, AMBIGUOUS or NOT_FOUND by exact symbol or fqn."""
    offers = nodes.select("id", F.explode(F.array_distinct(F.array("symbol", "fqn"))).alias("query")).where("query is not null")
    found = asked.select("query").distinct().join(offers, "query", "left").groupBy("query").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    status = F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    return found.select("query", status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"), "n")


def _contains_any(nodes: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """nodes with query, for the few asked names (a stated set) that one of the columns contains."""
    hay = F.concat_ws("\u0000", *[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    names = [r[0] for r in asked.select("query").distinct().collect()]  # names a caller typed
    hits = F.filter(F.array(*[F.lit(n) for n in names]), lambda q: F.contains(hay, F.lower(q)))
    return nodes.withColumn("query", F.explode(hits))


def resolve_symbol(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """query, id, tier: exact symbol, else label or fqn that contains it; within a tier by kind, then id."""
    exact = nodes.join(asked.select(F.col("query").alias("symbol")).distinct(), "symbol", "left_semi").select(F.col("symbol").alias("query"), "id", "kind", F.lit(0).alias("tier"))
    near = _contains_any(nodes, asked, ["label", "fqn"]).select("query", "id", "kind", F.lit(1).alias("tier"))
    return exact.unionByName(near).groupBy("query").agg(F.min(F.struct("tier", "kind", "id")).alias("r")).select("query", "r.id", "r.tier")


def matching_nodes(nodes: DataFrame, asked: DataFrame, limit: int = 20) -> DataFrame:
    """query, id, tier, place: exact fqn or symbol; where there is none, what contains it in label, fqn, symbol or path;
    kinds in descending order, then id."""
    exact = nodes.select("id", "kind", F.explode(F.array_distinct(F.array("symbol", "fqn"))).alias("query")).join(asked.select("query").distinct(), "query", "left_semi").select("query", "id", "kind", F.lit(0).alias("tier"))
    near = _contains_any(nodes, asked, ["label", "fqn", "symbol", "path"]).select("query", "id", "kind", F.lit(1).alias("tier"))
    every = exact.unionByName(near.join(exact.select("query").distinct(), "query", "left_anti"))
    place = Window.partitionBy("query").orderBy(F.desc("kind"), "id")
    return every.select("query", "id", "tier", F.row_number().over(place).alias("place")).where(F.col("place") <= limit)


def dominant(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """query, id: the only candidate that anything refers to, or the one with at least twice the references of the next."""
    hits = edges.where("relation <> 'defines'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("refs"))
    place = Window.partitionBy("query").orderBy(F.desc("refs"), "id")
    ranked = candidates.join(hits, "id").withColumns({"n": F.row_number().over(place), "next": F.lead("refs").over(place)})
    return ranked.where("n = 1 and (next is null or refs >= 2 * next)").select("query", "id", "refs")


def find_target(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """query, status, id, tier: by exact fqn (several are AMBIGUOUS), then by fqn that ends or begins with it, then by
    symbol; among several of the last two the dominant one counts, and none makes it AMBIGUOUS."""
    named = nodes.where("kind <> 'file'").select("id", "symbol", "fqn")
    q = asked.select("query").distinct()
    parts = F.split("fqn", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    inner = F.when(F.size(parts) > 1, F.array_distinct(F.concat(ends, begins))).otherwise(F.array().cast("array<string>"))
    offers = named.select("id", F.col("fqn").alias("query"), F.lit(0).alias("tier")).unionByName(
        named.where("fqn is not null").select("id", F.explode(inner).alias("query"), F.lit(1).alias("tier"))
    ).unionByName(named.select("id", F.col("symbol").alias("query"), F.lit(2).alias("tier")))
    found = cut(offers.join(q, "query", "left_semi").distinct())
    best = found.groupBy("query").agg(F.min("tier").alias("tier"))
    asked_tier = found.join(best, ["query", "tier"])
    counts = asked_tier.groupBy("query", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    wins = dominant(asked_tier.where("tier > 0").select("query", "id"), edges).select("query", F.col("id").alias("won"))
    x = q.join(counts, "query", "left").join(wins, "query", "left")
    status = F.when(F.col("n").isNull(), "TARGET_NOT_FOUND").when(F.col("n") == 1, "FOUND").when(F.col("won").isNotNull(), "AUTO_RESOLVED").otherwise("AMBIGUOUS_TARGET")
    return x.select("query", status.alias("status"), F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("won")).alias("id"), "tier")


def target_row(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """query, id, tier: by id, then symbol, then label or fqn that contains it."""
    by_id = nodes.join(asked.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query"), "id", F.lit(0).alias("tier"))
    by_symbol = nodes.join(asked.select(F.col("query").alias("symbol")).distinct(), "symbol", "left_semi").select(F.col("symbol").alias("query"), "id", F.lit(1).alias("tier"))
    near = _contains_any(nodes, asked, ["label", "fqn"]).select("query", "id", F.lit(2).alias("tier"))
    return by_id.unionByName(by_symbol).unionByName(near).groupBy("query").agg(F.min(F.struct("tier", "id")).alias("r")).select("query", "r.id", "r.tier")


def focus(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """query, id of the symbols a map starts from: exact symbol, else a node other than a file that contains it."""
    exact = nodes.join(asked.select(F.col("query").alias("symbol")).distinct(), "symbol", "left_semi").select(F.col("symbol").alias("query"), "id", "kind", F.lit(0).alias("tier"))
    near = _contains_any(nodes.where("kind <> 'file'"), asked, ["label", "fqn"]).select("query", "id", "kind", F.lit(1).alias("tier"))
    found = exact.unionByName(near).groupBy("query").agg(F.min(F.struct("tier", "kind", "id")).alias("r")).select("query", "r.id")
    mapped = nodes.where("kind not in ('file', 'note', 'markdown') and path <> ''").select("id")
    return found.join(mapped, "id", "left_semi").select("query", "id")


def notes(nodes: DataFrame, query: str | None = None, limit: int = 50) -> DataFrame:
    """Notes, newest first, that contain the query in label or body."""
    found = nodes.where("kind = 'note'")
    if query:
        found = found.where(F.contains(F.lower(F.concat_ws("\u0000", "label", "body")), F.lit(query.lower())))
    return found.orderBy(F.desc("updated_at"), "id").limit(limit)


def touched_symbols(changes: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """path, id, symbol: up to five symbols of each changed file, by line."""
    named = nodes.where("kind <> 'file' and symbol <> ''").join(changes.select("path").distinct(), "path", "left_semi")
    place = Window.partitionBy("path").orderBy("line_start", "id")
    return named.select("path", "id", "symbol", F.row_number().over(place).alias("place")).where(F.col("place") <= most)
