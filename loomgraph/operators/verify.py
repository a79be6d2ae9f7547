"""Does a hit still say what the source says: spans, declarations, freshness, confidence.

The source is a table of files (path, digest, content) beside the hits; nothing is read hit by hit. What only a parser can
tell runs in Arrow batches with Python's own parser; all else is column expressions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import trust
from loomgraph.operators.assurance import is_excluded
from loomgraph.operators.search import query_coverage
from loomgraph.schemas import MAX_TEXT_BYTES

#: Kinds that a declaration defines, words that open one, and what is cut from a text before it is searched; fixed values.
DEFINING = ("function", "method", "class", "struct", "interface", "trait", "enum", "type")
OPENERS = "function|class|def|interface|type|const|let|var|func|fn|struct|enum|trait"
SLASH_FILES = ("js", "ts", "tsx", "jsx", "java", "c", "cpp", "cs", "go", "rs", "php", "swift", "kt")
HASH_FILES = ("py", "sh", "rb")
_SLASH = re.compile(r"""/\*[\s\S]*?\*/|//[^\n]*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`""")
_HASH = re.compile(r'''#[^\n]*|"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*\'''')


def _declared(tree: ast.AST) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of what a Python text declares."""
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            name = n.name
        elif isinstance(n, ast.Assign):
            name = next((t.id for t in n.targets if isinstance(t, ast.Name)), None)
        elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            name = n.target.id
        else:
            continue
        if name:
            out.append((name, n.lineno, n.end_lineno or n.lineno))
    return out


def _without_quotes(text: str, ext: str) -> str:
    """text without comments and with empty strings; line ends stay."""
    if ext in SLASH_FILES:
        return _SLASH.sub(lambda m: "\n" * m[0].count("\n") if m[0].startswith("/*") else "" if m[0].startswith("//") else '"' + "\n" * m[0].count("\n") + '"', text)
    if ext in HASH_FILES:
        return _HASH.sub(lambda m: "" if m[0].startswith("#") else '"' + "\n" * m[0].count("\n") + '"', text)
    return text


def declaration(path: str, symbol: str | None, line: int | None, text: str, cov: float | None, threshold: float) -> tuple[str, str, bool, str | None]:
    """(relevance, provenance, proved, parser outcome): only a parser proves; a pattern on text without comments is a hint."""
    enough = cov is not None and cov >= threshold
    if not symbol:
        return ("FILE_TOKEN", "lexical:file_token", False, None) if enough else ("UNKNOWN", "lexical:unknown", False, None)
    name, ext = symbol.rsplit(".", 1)[-1], path.rsplit(".", 1)[-1].lower() if "." in path else ""
    outcome = "PARTIAL_AST"
    if ext == "py":
        try:
            hits = [(a, b) for n, a, b in _declared(ast.parse(text)) if n == name]
        except (SyntaxError, ValueError, RecursionError):
            outcome = "PARSE_ERROR"
        else:
            slack = 2 if len(hits) == 1 else 0  # of several alike, a near one may be the wrong one
            if line and line > 0 and any(a - slack <= line <= b + slack for a, b in hits):
                return "EXACT_SPAN", "ast_visitor:exact_span", True, "COMPLETE"
            if hits:
                return "EXACT_SYMBOL", "ast_visitor:exact_symbol", True, "COMPLETE"
            return ("FILE_TOKEN", "lexical:comment_or_literal", False, "COMPLETE") if name in text else ("NAME_ONLY", "ast_visitor:not_found", False, "COMPLETE")
    bare = _without_quotes(text, ext)
    opens = re.compile(rf"(?:{OPENERS})\s+{re.escape(name)}\b")
    if opens.search(bare):
        if line and line > 0:
            near = "\n".join(bare.splitlines()[max(0, line - 5) : line + 5])
            if opens.search(near):
                return "FILE_TOKEN", "regex_decl:heuristic_span", False, outcome
            if name in near:
                return "FILE_TOKEN", "regex_decl:heuristic_candidate", False, outcome
        return "FILE_TOKEN", "regex_decl:heuristic", False, outcome
    if name in text or (cov and enough):
        return "FILE_TOKEN", "lexical:file_token", False, outcome
    return "NAME_ONLY", "lexical:name_only", False, outcome


def declarations(hits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """hits (id, path, symbol, line, content, coverage) with relevance, provenance, proved, parser_outcome."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("path", "symbol", "line", "content", "coverage")], strict=True)
            found = [declaration(p or "", s, n, t or "", c, threshold) for p, s, n, t, c in rows]
            more = [pa.array(list(x), t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *more], ["id", "relevance", "provenance", "proved", "parser_outcome"])

    return hits.select("id", "path", "symbol", F.col("line").cast("int").alias("line"), "content", F.col("coverage").cast("double").alias("coverage")).mapInArrow(
        run, "id string, relevance string, provenance string, proved boolean, parser_outcome string"
    )


def verified(hits: DataFrame, journal: DataFrame, disk: DataFrame, tokens: list[str], threshold: float = 0.5) -> DataFrame:
    """id, freshness, relevance, resolution, completeness, confidence, coverage, verdict of each hit.

    hits: id, path, kind, symbol, line; journal: path, digest; disk: path, digest, content. A text that is too long or binary
    is not read: freshness is unknown and confidence 0.
    """
    x = hits.join(journal.select("path", F.col("digest").alias("jd"), F.lit(True).alias("known")), "path", "left").join(disk.select("path", F.col("digest").alias("dd"), "content", F.lit(True).alias("there")), "path", "left")
    nowhere = F.coalesce(F.trim("path"), F.lit("")) == ""
    unread = F.col("there").isNotNull() & ((F.octet_length("content") > MAX_TEXT_BYTES) | F.contains(F.substring("content", 1, 1024), F.lit("\0")))
    cov = query_coverage(x.where(F.col("there").isNotNull()), "id", "content", tokens)
    x = x.join(cov, "id", "left").withColumns({"nowhere": nowhere, "unread": F.coalesce(unread, F.lit(False))})
    freshness = F.when(nowhere, "UNKNOWN").when(F.col("there").isNull(), "MISSING").when(F.col("unread") | F.col("known").isNull(), "UNKNOWN").when(~F.coalesce(F.col("jd") == F.col("dd"), F.lit(False)), "STALE").otherwise("FRESH")
    x = x.withColumn("freshness", freshness)
    read = x.where(F.col("there").isNotNull() & ~F.col("unread") & (F.col("kind") != "file"))
    x = x.join(declarations(read, threshold), "id", "left")
    file_says = F.when(F.coalesce(F.col("coverage") >= threshold, F.lit(True)), "EXACT_SYMBOL").otherwise("FILE_TOKEN")
    about = F.when(nowhere | F.col("there").isNull() | F.col("unread"), "UNKNOWN").when(F.col("kind") == "file", file_says).otherwise(F.col("relevance"))
    # what is not fresh has no exact span
    about = F.when((about == "EXACT_SPAN") & (F.col("freshness") != "FRESH"), "FILE_TOKEN").otherwise(about)
    x = x.withColumn("about", about)
    hint = F.when(F.startswith("provenance", F.lit("regex_decl:")) & (F.col("freshness") == "FRESH"), "DECLARATION").otherwise(F.col("about"))
    sure = trust.confidence(F.col("freshness"), hint, F.col("coverage"))
    confidence = F.when(nowhere | F.col("there").isNull() | F.col("unread"), 0.0).when((F.col("freshness") == "FRESH") & hint.isin("NAME_ONLY", "UNKNOWN"), 0.25).otherwise(sure)
    resolution = F.when(nowhere | F.col("there").isNull(), "UNRESOLVED").when(F.col("unread") | (F.col("kind") != "file"), "EXACT").otherwise("NOT_APPLICABLE")
    complete = F.when(nowhere, "UNKNOWN").when(F.col("there").isNull(), "PARTIAL").when(F.col("unread"), "COMPLETE").when(F.col("freshness") == "STALE", "PARTIAL").otherwise("COMPLETE_WITHIN_INDEX_CAPABILITY")
    verdict = F.when(nowhere | ((F.col("freshness") == "UNKNOWN") & F.col("unread")), "NOPATH").when(F.col("freshness") == "MISSING", "STALE").otherwise(trust.verdict(F.col("freshness"), F.col("about")))
    return x.select(
        "id", "freshness", F.col("about").alias("relevance"), resolution.alias("resolution"), complete.alias("completeness"), F.round(confidence, 4).alias("confidence"),
        F.when(nowhere, 1.0).otherwise(F.col("coverage")).alias("coverage"), verdict.alias("verdict"),
    )


def verify_hits(hits: DataFrame, journal: DataFrame, disk: DataFrame, tokens: list[str], threshold: float = 0.5) -> DataFrame:
    """id, verdict, coverage, path: the short answer."""
    return verified(hits, journal, disk, tokens, threshold).join(hits.select("id", "path"), "id").select("id", "verdict", "coverage", "path")


def _defined(text: str, token: str, start: int, end: int) -> int | None:
    """How often Python code defines the token inside a span; null where it does not parse."""
    try:
        return sum(n == token and start <= a <= end for n, a, _ in _declared(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError):
        return None


def subject_status(path: str | None, content: str | None, kind: str | None, name: str | None, start: int | None, end: int | None) -> str:
    """NOT_APPLICABLE, MISSING, SPAN_MISMATCH, AMBIGUOUS or VERIFIED of one claimed span in its file's text."""
    if not path or not path.strip():
        return "NOT_APPLICABLE"
    if path.startswith("/") or ".." in path.split("/"):
        return "MISSING"
    if start is None:
        return "NOT_APPLICABLE"
    if content is None:
        return "MISSING"
    lines = content.splitlines(keepends=True)
    last = start if end is None else end
    if start < 1 or last < start or last > len(lines):
        return "SPAN_MISMATCH"
    token = re.sub(r"\(\)\.?$", "", (name or "").strip()).rsplit(".", 1)[-1].rsplit("::", 1)[-1]
    if not token:
        return "NOT_APPLICABLE"
    n = len(re.findall(rf"\b{re.escape(token)}\b", "".join(lines[start - 1 : last])))
    if not n:
        return "SPAN_MISMATCH"
    if (kind or "").strip().lower() in DEFINING:
        n = _defined(content, token, start, last) if path.endswith(".py") else None
        if n is None:
            return "NOT_APPLICABLE"
        if not n:
            return "SPAN_MISMATCH"
    return "AMBIGUOUS" if n > 1 else "VERIFIED"


def verify_subjects(subjects: DataFrame, disk: DataFrame) -> DataFrame:
    """id, status of subjects (id, path, kind, name, line_start, line_end) against the files; generated ones are not judged."""
    x = subjects.join(disk.select("path", "content"), "path", "left").withColumn("out", is_excluded(F.coalesce("path", F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("path", "content", "kind", "name", "line_start", "line_end", "out")], strict=True)
            found = ["NOT_APPLICABLE" if out and p else subject_status(p, t, k, n, s, e) for p, t, k, n, s, e, out in rows]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.string())], ["id", "status"])

    return x.select("id", "path", "content", "kind", "name", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), "out").mapInArrow(run, "id string, status string")


def verify_edges(edges: DataFrame, disk: DataFrame) -> DataFrame:
    """id, status of edges by the subject they begin at; an edge without a span is not judged."""
    return verify_subjects(edges, disk)
