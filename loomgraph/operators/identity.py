"""Names that several providers give to one symbol: canonical relations, identities, join keys, trust ceilings.

All are column expressions over a row; what cannot be made canonical is null and joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.schemas import SPAN_TOLERANCE

#: (names that providers give, canonical relation, whether direct, whether it has a span); fixed values.
RELATION_RULES = (
    (("call", "calls"), "CALLS", True, True),
    (("reference", "references", "usage", "uses"), "CALLS", False, False),
    (("import", "imports"), "IMPORTS", True, True),
    (("define", "defines", "definition", "definitions"), "DEFINES", True, True),
    (("implements", "implementation"), "IMPLEMENTS", True, True),
    (("inherits", "inheritance", "extends", "extends_class"), "INHERITS", True, True),
)
#: Kinds folded to classes; fixed values.
KIND_CLASSES = {
    "function": "callable", "method": "callable", "constructor": "callable", "field": "field", "property": "field", "class": "type", "struct": "type",
    "interface": "type", "type": "type", "enum": "type", "trait": "type", "module": "module", "package": "module", "file": "file",
}
#: Extensions and languages; fixed values.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "go": "go", "java": "java", "rs": "rust", "rb": "ruby", "kt": "kotlin", "swift": "swift",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "php": "php", "md": "markdown",
}
PATH_ENDS = "py|ts|tsx|js|jsx|go|java|rs|rb|kt|swift|c|cc|cpp|h"
COMPATIBLE = "COMPATIBLE"


def lookup(values: dict, key: Column, otherwise: Column | None = None) -> Column:
    """values[key] as one map literal, else otherwise (or null)."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.try_element_at(pairs, key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def _given(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) != ""


def relation_mapping(raw: Column) -> Column:
    """(canonical, direct, has_span) of a provider's relation name; null for an unknown one."""
    name = F.lower(F.trim(raw))
    rule = F.lit(None)
    for names, canonical, direct, has_span in reversed(RELATION_RULES):
        one = F.struct(F.lit(canonical).alias("canonical"), F.lit(direct).alias("direct"), F.lit(has_span).alias("has_span"))
        rule = F.when(name.isin(*names), one).otherwise(rule)
    return rule


def canonical_relation(raw: Column) -> Column:
    """Canonical name; directed calls are calls, unknown names go to upper case, a blank one stays empty."""
    name = F.when(F.startswith(F.lower(F.trim(raw)), F.lit("call:")), F.lit("call")).otherwise(F.trim(raw))
    known = {n: canonical for names, canonical, _, _ in RELATION_RULES for n in names}
    return F.when(~_given(raw), "").otherwise(lookup(known, F.lower(name), F.upper(name)))


def kind_class(kind: Column) -> Column:
    return F.when(~_given(kind), "").otherwise(lookup(KIND_CLASSES, F.lower(F.trim(kind)), F.lit("other")))


def language_of(path: Column) -> Column:
    return lookup(LANGUAGES, F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./]+)$", 1)), F.lit("unknown"))


def canonical_fqn(fqn: Column) -> Column:
    """Dotted name without a closing call, empty parts and parts that are file paths."""
    chunks = F.split(F.regexp_replace(F.trim(F.coalesce(fqn, F.lit(""))), r"\(\)\.?$", ""), r"\.")
    pathish = rf"(?:^|[/\\])\S*\.(?:{PATH_ENDS})$|[/\\]"
    return F.array_join(F.filter(chunks, lambda c: (F.trim(c) != "") & ~F.rlike(c, F.lit(pathish))), ".")


def normalise_path(path: Column) -> Column:
    """Forward slashes, without . and inner .. parts; null for none."""
    whole = F.regexp_replace(path, r"\\", "/")
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    # each .. takes the part before it away, except another .. ; at the root it has nothing to take
    def step(kept: Column, p: Column) -> Column:
        back = (p == "..") & (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) != "..")
        lost = (p == "..") & (F.size(kept) == 0) & F.startswith(whole, F.lit("/"))
        return F.when(lost, kept).when(back, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    rooted = F.concat(F.when(F.startswith(whole, F.lit("/")), "/").otherwise(""), joined)
    return F.when(_present(path), F.when(rooted == "", ".").otherwise(rooted))


def _present(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def mangled_root(root: str) -> str:
    """A project's folder as one word of dashes, as a provider writes it before its names."""
    plain = root.replace("\\", "/")
    if plain[1:2] == ":" and plain[0].isalpha():
        plain = plain[0] + plain[2:]
    return plain.strip("/").replace("/", "-")


def identity(repo: Column, path: Column, language: Column, kind: Column, name: Column, start: Column, end: Column, provider_id: Column | None = None) -> Column:
    """The identity struct; null without a name."""
    one = F.struct(
        F.coalesce(repo, F.lit("")).alias("repo"), path.alias("path"), language.alias("language"), kind.alias("kind"), name.alias("name"), start.alias("line_start"), end.alias("line_end"),
        (F.lit(None).cast("string") if provider_id is None else provider_id).alias("provider_id"),
    )
    return F.when(_present(name), one)


def builtin_identity(path: Column, fqn: Column, symbol: Column, kind: Column, start: Column, end: Column, repo: Column) -> Column:
    """Of a node: by its qualified name, else by its symbol; never by its id."""
    whole = canonical_fqn(fqn)
    name = F.when(whole != "", whole).otherwise(canonical_fqn(symbol))
    kinds = kind_class(kind)
    return identity(repo, normalise_path(path), language_of(path), F.when(kinds == "", "other").otherwise(kinds), name, start, end)


def external_identity(symbol: Column, path: Column, kind: Column, start: Column, end: Column, repo: Column, root: str | None) -> Column:
    """Of a provider whose names begin with its mangled root: the root is taken off; a name that looks mangled while the
    root is not known is null."""
    name = F.trim(symbol)
    if root:
        head = mangled_root(root) + "."
        name = F.when(F.startswith(name, F.lit(head)), F.substring(name, len(head) + 1, 1 << 30)).otherwise(name)
    else:
        odd = F.rlike(name, F.lit(r"^[A-Za-z0-9_.-]*-[A-Za-z0-9_.-]+\.")) & (F.length(name) - F.length(F.replace(name, F.lit("-"), F.lit(""))) >= 3)
        name = F.when(~odd, name)
    kinds = kind_class(kind)
    return identity(repo, normalise_path(path), language_of(path), F.when(kinds == "", "other").otherwise(kinds), canonical_fqn(name), start, end)


def index_identity(fqn: Column, bare: Column, path: Column, kind: Column, start: Column, end: Column, repo: Column) -> Column:
    """Of a compiler index: a document path inside the name, else the row's path, gives the module. fqn and bare are
    parse_symbol()'s; without a path it is null."""
    found = lambda k: F.regexp_extract(F.trim(fqn), r"^([^.\s]*[/\\][^.\s]*)\.([A-Za-z]{1,5})\.(.+)$", k)
    inside = found(3) != ""
    rel = normalise_path(path)
    own = F.regexp_replace(F.regexp_replace(rel, r"\.[^./]*$", ""), "/", ".")
    module = F.when(inside, canonical_fqn(F.regexp_replace(found(1), r"[/\\]", "."))).otherwise(canonical_fqn(own))
    rest = F.when(F.startswith(fqn, F.concat(rel, F.lit("."))), F.expr("1")).otherwise(F.lit(None))
    chain = F.when(inside, canonical_fqn(found(3))).when(rest.isNotNull(), canonical_fqn(F.substr(fqn, F.length(rel) + 2))).otherwise(canonical_fqn(fqn))
    name = (
        F.when((chain != "") & (chain != module), F.when(module != "", F.concat(module, F.lit("."), chain)).otherwise(chain))
        .when((module != "") & _present(bare), F.concat(module, F.lit("."), bare)).when(chain != "", chain)
    )
    kinds = kind_class(kind)
    return F.when(_present(path), identity(repo, rel, language_of(path), F.when(kinds == "", "other").otherwise(kinds), name, start, end))


def evidence_identity(provider: Column, symbol: Column, path: Column, kind: Column, start: Column, end: Column, repo: Column, root: str | None = None) -> Column:
    """By provider; a node id of the graph itself in a provider's column is null and never joins."""
    foreign = F.rlike(F.trim(symbol), F.lit("^(?:sym|file|note):[0-9a-f]{6,}:"))
    who = F.lower(F.coalesce(provider, F.lit("")))
    kinds = kind_class(kind)
    plain = identity(repo, normalise_path(path), language_of(path), F.when(kinds == "", "other").otherwise(kinds), canonical_fqn(symbol), start, end)
    return F.when(_given(symbol) & ~foreign, (
        F.when(F.contains(who, F.lit("scip")), index_identity(symbol, F.element_at(F.split(symbol, r"\."), -1), path, kind, start, end, repo))
        .when(F.contains(who, F.lit("codebase-memory")) | F.contains(who, F.lit("cbm")), external_identity(symbol, path, kind, start, end, repo, root)).otherwise(plain)
    ))


def join_key(one: Column) -> Column:
    """(repo, name, path only for a name without a dot); identities of equal keys may be one symbol."""
    name = canonical_fqn(one["name"])
    where = F.when(F.contains(name, F.lit(".")), F.lit("")).otherwise(F.coalesce(F.when(_present(one["path"]), one["path"]), F.lit("\0missing")))
    return F.when(one.isNotNull(), F.struct(one["repo"].alias("repo"), name.alias("name"), where.alias("place")))


def joinable(a: Column, b: Column) -> Column:
    """Equal keys, and equal paths where both are known."""
    return (join_key(a) == join_key(b)) & (~_present(a["path"]) | ~_present(b["path"]) | F.coalesce(a["path"] == b["path"], F.lit(False)))


def span_conflict(a: Column, b: Column, tolerance: int = SPAN_TOLERANCE) -> Column:
    """Whether two first lines lie further apart than the tolerance; an unknown one never does."""
    return F.coalesce(F.abs(a - b) > tolerance, F.lit(False))


def identity_hash(one: Column) -> Column:
    """16 hex digits over all parts of the identity."""
    span = F.when(one["line_start"].isNotNull(), F.concat(F.lit("("), one["line_start"].cast("string"), F.lit(", "), F.coalesce(one["line_end"].cast("string"), F.lit("None")), F.lit(", None, None)")))
    parts = [F.coalesce(p, F.lit("")) for p in (one["repo"], one["path"], one["language"], one["kind"], one["name"], span, one["provider_id"])]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def dedup_by_identity(rows: DataFrame, one: str, order: str) -> DataFrame:
    """The first row of each identity, spans and all, by order; never by short name."""
    place = Window.partitionBy(*[F.col(f"{one}.{p}") for p in ("repo", "path", "language", "kind", "name", "line_start", "line_end", "provider_id")]).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def trust_ceiling(
    bound: Column, has_span: Column, unique: Column, changed: Column, verification: Column, match_bound: Column, match_fresh: Column, version: Column
) -> Column:
    """(verdict, resolution): what an assertion can be at most. A version that was not tested, an unbound snapshot and a
    changed source cap it before its structure counts; a verification, where there is one, can lower it further."""
    shape = F.when(unique & has_span, "EXACT").when(unique, "INFERRED").otherwise("AMBIGUOUS")
    out = lambda v, r: F.struct(F.lit(v).alias("verdict"), (F.lit(r) if isinstance(r, str) else r).alias("resolution"))
    structure = F.when(~unique, out("AMBIGUOUS", "AMBIGUOUS")).when(~has_span, out("HEURISTIC", "INFERRED")).otherwise(out("SUPPORTED", "EXACT"))
    return (
        F.when(version != COMPATIBLE, out("UNVERIFIABLE", shape)).when(~bound, out("UNVERIFIABLE", shape)).when(changed, out("STALE", shape)).when(verification.isNull(), structure)
        .when(~F.coalesce(match_bound, F.lit(False)), out("UNVERIFIABLE", shape)).when(~F.coalesce(match_fresh, F.lit(False)), out("STALE", shape)).when(verification == "VERIFIED", structure)
        .when(verification == "AMBIGUOUS", out("AMBIGUOUS", "AMBIGUOUS")).otherwise(out("HEURISTIC", "INFERRED"))
    )


def subject_problems(path: Column, kind: Column, name: Column, start: Column, end: Column) -> Column:
    """What a provider's subject lacks; with any of the first three it is no subject."""
    return F.array_compact(F.array(
        F.when(~_present(path), "missing path"), F.when(~_present(kind), "missing kind"), F.when(~_present(name), "missing qualified_name"),
        F.when(_present(path) & _present(kind) & _present(name) & (start.isNull() | end.isNull()), "no span: subject identity is low-resolution"),
    ))


def assertion(path: Column, kind: Column, name: Column, start: Column, end: Column, relation: Column, targets: Column, bound: Column, changed: Column, version: Column) -> Column:
    """(relation, verdict, resolution, problems) of a provider's claim that a subject relates to its targets."""
    rule = relation_mapping(relation)
    subject = _present(path) & _present(kind) & _present(name)
    placed = subject & start.isNotNull()
    proves = F.when(rule.isNull(), placed).otherwise(rule["has_span"] & placed)
    top = trust_ceiling(bound, proves, F.size(targets) == 1, changed, F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), version)
    more = F.array_compact(F.array(
        F.when(rule.isNull(), F.concat(F.lit("unmapped provider relation: '"), relation, F.lit("'"))),
        F.when(rule["has_span"] & subject & start.isNull(), F.concat(F.lit("relation "), rule["canonical"], F.lit(" requires a span but subject has none"))),
    ))
    problems = F.concat(subject_problems(path, kind, name, start, end), more)
    return F.struct(F.coalesce(rule["canonical"], F.lit("UNKNOWN")).alias("relation"), top["verdict"].alias("verdict"), top["resolution"].alias("resolution"), problems.alias("problems"))


def target_conflicts(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Where a provider places a symbol in another file or line than the graph does, and which side the source proves.

    targets: label, path, line, verified; candidates: provider, name, path, line, verified (each verified is a
    verification status or null). Joined by the last part of the name, so only same-named ones meet.
    """
    t = targets.select("label", F.col("path").alias("b_path"), F.col("line").alias("b_line"), F.col("verified").alias("b_ok"))
    c = candidates.where("path is not null").withColumn("label", F.element_at(F.split("name", r"\."), -1))
    elsewhere = ~normalise_path(F.col("path")).eqNullSafe(normalise_path(F.col("b_path")))
    moved = F.coalesce(F.col("line") != F.col("b_line"), F.lit(False))
    ok = lambda x: F.coalesce(F.col(x) == "VERIFIED", F.lit(False))
    side = F.when(ok("verified") & ~ok("b_ok"), "external").when(ok("b_ok") & ~ok("verified"), "builtin")
    both = t.join(c, "label").where(elsewhere | moved)
    return both.select("label", "b_path", "b_line", "provider", "name", "path", "line", F.when(side.isNotNull(), "source_verified").otherwise("recorded-not-resolved").alias("resolution"), side.alias("resolved"))
