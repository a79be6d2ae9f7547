"""Text formats: unified diffs, numstat logs, symbol-index JSON, identifiers and import paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.shared import carried


def parse_unified_diff(lines: DataFrame) -> DataFrame:
    """diff, path, line_start, line_end of each hunk; lines: diff, line_no, line.

    A hunk that only deletes takes the old side. A hunk's file is carried to it bin by bin, so one huge diff is as many small
    sorts; binary files have no hunks.
    """
    group = lambda k: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k)
    number = lambda k, default: F.when(group(k) == "", F.lit(default)).otherwise(group(k)).cast("int")
    old = F.when(F.col("line").startswith("--- "), F.regexp_replace("line", r"^--- (?:a/)?([^\t]*).*$", "$1"))
    new = F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?([^\t]*).*$", "$1"))
    x = carried(lines, ["diff"], "line_no", {"old": old, "new": new}).where(F.col("line").rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"))
    x = x.withColumns({"os": number(1, 0), "oc": number(2, 1), "ns": number(3, 0), "nc": number(4, 1)})
    gone = F.col("nc") == 0
    start = F.when(gone, F.col("os")).otherwise(F.col("ns"))
    end = F.when(gone, F.greatest(F.col("os"), F.col("os") + F.col("oc") - 1)).otherwise(F.col("ns") + F.col("nc") - 1)
    path = F.when(F.col("new") == "/dev/null", F.col("old")).otherwise(F.col("new"))
    return x.select("diff", path.alias("path"), start.alias("line_start"), end.alias("line_end"))


def numstat_rows(lines: DataFrame, delimiter: str = "\x1f") -> DataFrame:
    """log, commit, author, date, message, path, insertions, deletions, line_no of each changed file of a log, and a row
    without path for each commit; lines: log, line_no, line. Binary files count no lines; what stands before the first
    commit is left out."""
    parts = F.split("line", delimiter)
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    head = F.when(F.contains("line", F.lit(delimiter)), F.struct(part(0).alias("commit"), part(2).alias("author"), part(3).alias("date"), part(4).alias("message"), F.col("line_no").alias("at")))
    x = carried(lines, ["log"], "line_no", {"c": head}).where("c is not null")
    stat = F.split("line", "\t")
    n = lambda k: F.when(F.trim(F.get(stat, F.lit(k))).rlike("^[0-9]+$"), F.trim(F.get(stat, F.lit(k))).cast("long")).otherwise(0)
    is_head = F.col("c.at") == F.col("line_no")
    x = x.where(is_head | (F.size(stat) >= 3))
    path = F.regexp_replace(F.trim(F.get(stat, F.lit(2))), r"^\./", "")
    return x.select("log", "c.commit", "c.author", "c.date", "c.message", F.when(~is_head, path).alias("path"), F.when(is_head, 0).otherwise(n(0)).alias("insertions"), F.when(is_head, 0).otherwise(n(1)).alias("deletions"), "line_no")


def parse_numstat(lines: DataFrame, delimiter: str = "\x1f") -> DataFrame:
    """log, commit, author, date, message, files (in order), insertions, deletions; a commit's files are one list."""
    files = F.transform(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("line_no", "path")))), lambda f: f["path"])
    return numstat_rows(lines, delimiter).groupBy("log", "commit", "author", "date", "message").agg(files.alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


def language(path: Column) -> Column:
    known = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "md": "markdown", "rb": "ruby", "kt": "kotlin", "cs": "csharp"}
    out, ext = F.lit(None), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    for k, v in known.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def dotted_module(path: Column) -> Column:
    """Dotted module of a file path, without src/ or lib/, the suffix, and a closing __init__."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^(src|lib)/", ""), r"(/__init__)?\.pyi?$", ""), "/", ".")


def module_names(path: Column, depth: int = 8) -> Column:
    """All dotted suffixes of a file's module, shortest first."""
    parts = F.split(dotted_module(path), r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.array_join(F.slice(parts, -k, k), "."))


def resolve_relative(source: Column, module: Column, is_package: Column) -> Column:
    """Absolute form of a relative import; empty where it climbs past the root; absolute ones stay."""
    dots = F.length(F.regexp_extract(source, r"^\.*", 0))
    parts = F.split(module, r"\.")
    keep = F.size(parts) - dots + F.when(is_package, 1).otherwise(0)
    rest = F.regexp_replace(source, r"^\.+", "")
    joined = F.concat_ws(".", F.slice(parts, 1, F.greatest(keep, F.lit(0))), F.when(rest != "", rest))
    return F.when(dots == 0, source).when(keep < 1, F.lit("")).otherwise(joined)


#: Parts of a camel-case name.
CAMEL = r"[A-Z]?[a-z0-9]+|[A-Z]+(?=[A-Z][a-z0-9]|\b)"


def keywords(*sources: Column) -> Column:
    """Names and their parts in order, each once and of two characters or more: whole, separated, snake and camel parts and
    pairs of snake parts."""
    none = F.array().cast("array<string>")

    def of(source: Column) -> Column:
        parts = F.filter(F.split(source, r"[\s/\\.:\-]+"), lambda p: p != "")

        def inner(p: Column) -> Column:
            snake = F.filter(F.split(p, "_"), lambda x: x != "")
            pairs = F.zip_with(F.slice(snake, 1, F.greatest(F.size(snake) - 1, F.lit(0))), F.slice(snake, 2, F.greatest(F.size(snake) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
            camel = F.regexp_extract_all(p, F.lit(CAMEL), F.lit(0))
            return F.concat(F.array(p), F.when(F.size(snake) > 1, F.concat(snake, pairs)).otherwise(none), F.when(F.size(camel) > 1, camel).otherwise(none))

        return F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.array(source), F.flatten(F.transform(parts, inner)))).otherwise(none)

    every = F.transform(F.concat(*[of(s) for s in sources]), lambda x: F.regexp_replace(x, r"^[._\-/$: ]+|[._\-/$: ]+$", ""))
    return F.array_distinct(F.filter(every, lambda x: F.length(x) >= 2))


def module_candidates(path: Column) -> Column:
    """Names under which one file may be imported: its whole module, the last part and the packages above it."""
    m = dotted_module(path)
    parts = F.split(m, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    return F.when(m != "", F.array_distinct(F.concat(above, F.array(F.element_at(parts, -1))))).otherwise(F.array().cast("array<string>"))


def normalise_import(source: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(source, F.lit("")), r"^\.+", ""))


def normalise_path(path: Column) -> Column:
    """Forward slashes, no ./ and no doubled or closing slash."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), "/$", ""), r"^\./", "")


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), F.substring(F.sha2(path, 256), 1, 12))


def is_test_path(path: Column) -> Column:
    # most paths hold neither word and need no search by the pattern
    return (path.contains("test") | path.contains("spec")) & path.rlike(r"(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]*$|[._](test|spec)\.[^/]+$")


def is_test_symbol(symbol: Column) -> Column:
    ends = (symbol.contains("Test") | symbol.contains("IT") | symbol.contains("Spec")) & symbol.rlike("(Test|Tests|IT|Spec)$")
    return F.lower(symbol).startswith("test") | ends
