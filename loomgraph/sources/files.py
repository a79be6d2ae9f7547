"""Files of a project: which count, how they are read, and from which state of them an answer comes."""

from __future__ import annotations

import os
import re
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Folders and names that are never a project's own; fixed values.
IGNORED_FOLDERS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", "ENV", "dist", "build", "target", ".cache", ".idea", ".vscode", "coverage", "htmlcov", ".coverage", ".next", ".turbo", ".dart_tool", "Pods", ".gradle", "DerivedData",
)
IGNORED_PATTERNS = ("*.pyc", "*.pyo", "*.pyd", ".DS_Store", "Thumbs.db", "*.log", "*.tmp", "*.swp", "*~")
GRAMMARS = ("python",)  # parsers that are here; others report that they are not


def glob_regex(pattern: str) -> str:
    """An ignore pattern as a regular expression over a relative path: * and ? stay inside a folder, ** does not; a pattern
    with a slash inside or before it is anchored; what matches a folder matches what is in it."""
    body = pattern.strip("/")
    anchored = pattern.startswith("/") or "/" in body
    out, i = "^" if anchored else "(?:^|.*/)", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (m := re.match(r"\[([!^]?)(\]?[^\]]*)\]", body[i:])):
            out, i = out + f"[{'^' if m[1] else ''}" + m[2].replace("\\", "\\\\") + "]", i + m.end()
        else:
            out, i = out + re.escape(body[i]), i + 1
    return out + "(?:/.*)?$"


class IgnoreRules:
    """Ignore files of a project: the last rule that matches decides, and a rule with ! brings back."""

    def __init__(self, lines: list[tuple[str, str]] = ()) -> None:
        """lines: (folder the file stands in, or "", line)."""
        self.rules: list[tuple[str, bool, bool, re.Pattern]] = []
        for base, line in [*(("", p) for p in IGNORED_PATTERNS), *lines]:
            text = line.strip()
            negated, text = text.startswith("!"), text.removeprefix("!").strip()
            if text and not line.strip().startswith("#"):
                if bare := text.removesuffix("/"):
                    self.rules.append((base.strip("/"), negated, text.endswith("/"), re.compile(glob_regex(bare))))

    @classmethod
    def under(cls, root: str, names: tuple[str, ...] = (".gitignore",)) -> IgnoreRules:
        lines = []
        for folder, folders, found in os.walk(root):
            folders[:] = sorted(d for d in folders if d not in IGNORED_FOLDERS)
            base = os.path.relpath(folder, root).replace(os.sep, "/")
            for name in names:
                if name in found:
                    lines += [("" if base == "." else base, x) for x in Path(folder, name).read_text("utf-8", "replace").splitlines()]
        return cls(lines)

    def _hit(self, rule: tuple[str, bool, bool, re.Pattern], path: str, folder: bool) -> bool:
        base, _, folders_only, pattern = rule
        if (folders_only and not folder) or (base and path != base and not path.startswith(base + "/")):
            return False
        return bool(pattern.match(path[len(base) :].lstrip("/") if base else path))

    def ignored(self, path: str, folder: bool = False) -> bool:
        path = path.replace("\\", "/").strip("/")
        if path in ("", "."):
            return False
        parts = path.split("/")
        brought_back = any(r[1] and self._hit(r, path, folder) for r in self.rules)
        inner = parts if folder else parts[:-1]
        if not brought_back and any(p in IGNORED_FOLDERS or p.endswith("_vault") for p in inner):
            return True
        if folder and looks_like_environment(parts[-1]):
            return True
        above = ["/".join(parts[:k]) for k in range(1, len(parts))]
        for rule in reversed(self.rules):
            if self._hit(rule, path, folder) or (rule[2] and any(self._hit(rule, a, True) for a in above)):
                return not rule[1]
        return False


def looks_like_environment(name: str, entries: tuple[str, ...] = ()) -> bool:
    """A folder of a Python environment, by its name or by what stands in it."""
    low = name.lower()
    return low.endswith(("_env", "-env")) or low in ("env", "venv", ".venv") or "venv" in low or "virtualenv" in low or bool({"pyvenv.cfg", "bin/activate", "Scripts/activate.bat"} & set(entries))


def kept_files(files: DataFrame, rules: IgnoreRules) -> DataFrame:
    """Rows whose path no rule ignores; the rules go to the executors, they are as many as a project has lines of them."""
    sent = files.sparkSession.sparkContext.broadcast(rules)

    @pandas_udf("boolean")
    def ignored(paths):
        return paths.map(lambda p: sent.value.ignored(p or ""))

    return files.where(~ignored("path"))


def read_files(spark: SparkSession, root: str, endings: tuple[str, ...] = (), rules: IgnoreRules | None = None) -> DataFrame:
    """path (relative), size, mtime_ms, digest, content of the files under a folder that Spark can read."""
    base = root.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    bare = re.sub(r"^[a-z]+:/*(?=/)", "", base)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), "^" + re.escape(bare) + "/", "")
    out = f.select(F.url_decode(rel).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), F.sha2("content", 256).alias("digest"), "content")
    if endings:
        out = out.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings))
    return kept_files(out, rules) if rules else out


def as_text(content: Column) -> Column:
    """Bytes as text; signs that are none are replaced."""
    return F.decode(content, "UTF-8")


def content_binding(cited: DataFrame, disk: DataFrame) -> DataFrame:
    """One row: the digest over path and content of all cited files, null as soon as one of them cannot be read."""
    x = cited.select("path").distinct().join(disk.select("path", "digest"), "path", "left")
    one = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda r: F.concat(r["path"], F.lit(":"), r["digest"], F.lit("\n"))), ""), 256)
    a = x.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("digest").isNull()).alias("unreadable"), one.alias("d"))  # cited files are capped by the caller
    return a.select("files", "unreadable", F.when((F.col("files") > 0) & (F.col("unreadable") == 0), F.col("d")).alias("scope_digest"))


def worktree_snapshot(head: str | None, changed: DataFrame | None, journal: DataFrame, disk: DataFrame, cited: DataFrame, now: int) -> DataFrame:
    """One row: head, dirty (null where it cannot be told), a fingerprint of what is changed, generation, scope digest."""
    g = journal.agg(F.coalesce(F.max("generation"), F.lit(1)).alias("generation"))
    if changed is None:
        d = g.select(F.lit(None).cast("boolean").alias("dirty"), F.lit(None).cast("string").alias("dirty_fingerprint"))
    else:
        c = changed.select("path").distinct().join(disk.select("path", "digest"), "path", "left")
        row = F.sha2(F.concat_ws("\0", "path", F.coalesce("digest", F.lit("gone"))), 256)
        # hashes are added up, so that no order of all changed files is needed
        d = c.agg((F.count(F.lit(1)) > 0).alias("dirty"), F.sha2(F.concat_ws(" ", *[F.coalesce(F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(5)]), 256).alias("fp"))
        d = d.select("dirty", F.when(F.col("dirty"), F.col("fp")).alias("dirty_fingerprint"))
    return g.crossJoin(d).crossJoin(content_binding(cited, disk)).select(F.lit(head).alias("commit_sha"), "dirty", "dirty_fingerprint", "generation", "scope_digest", F.lit(now).alias("captured_at"))  # single rows


def snapshot_match(binding: DataFrame, head: str, changed: DataFrame) -> DataFrame:
    """repo, provider, bound, fresh of external indexes: bound to the head, and no changed file since. binding: repo, provider,
    head_sha."""
    n = changed.agg(F.count(F.lit(1)).alias("n"))
    return binding.crossJoin(F.broadcast(n)).select("repo", "provider", F.col("head_sha").isNotNull().alias("bound"), F.coalesce((F.col("head_sha") == head) & (F.col("n") == 0), F.lit(False)).alias("fresh"))  # one row


def import_form(raw: Column, language: Column, folder: Column) -> Column:
    """An import as the dotted form of the project's modules; null where nothing is left."""
    dotted = F.replace(raw, F.lit("/"), F.lit("."))
    rest = F.regexp_replace(raw, r"^[./]+", "")
    dots = F.length(F.regexp_extract(raw, r"^\.*", 0))
    parts = F.when(F.coalesce(folder, F.lit("")) != "", F.split(folder, r"\.")).otherwise(F.array().cast("array<string>"))
    base = F.slice(parts, 1, F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    joined = F.concat_ws(".", F.when(F.size(base) > 0, F.array_join(base, ".")), F.replace(rest, F.lit("/"), F.lit(".")))
    script = language.isin("typescript", "tsx", "javascript") & F.startswith(raw, F.lit("."))
    plain = F.regexp_replace(F.regexp_replace(dotted, r"\.js$", ""), r"\.ts$", "")
    return F.when(F.coalesce(raw, F.lit("")) == "", None).when(language == "go", dotted).when(script & (rest == ""), None).when(script, joined).otherwise(plain)


def unquoted_path(path: Column) -> Column:
    """A path as a version control tool prints it, without its quotes and with its escaped bytes."""

    @pandas_udf("string")
    def run(s):
        return s.map(unquote)

    return F.when(F.startswith(F.trim(path), F.lit('"')), run(path)).otherwise(F.trim(path))


def unquote(text: str) -> str:
    text = text.strip()
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    names = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}
    out, body, i = bytearray(), text[1:-1].encode(), 0
    while i < len(body):
        if body[i] == 92 and (m := re.match(rb"\\([0-7]{1,3})", body[i:])):
            out.append(int(m[1], 8) & 255)
            i += m.end()
        elif body[i] == 92 and i + 1 < len(body):
            out.append(names.get(chr(body[i + 1]), body[i + 1]))
            i += 2
        else:
            out.append(body[i])
            i += 1
    return out.decode("utf-8", "replace")


def projects(base: str, marker: str, depth: int = 4) -> list[str]:
    """Folders that hold a marker, at most depth below the base; nothing below one is searched."""
    out = []
    for folder, folders, files in os.walk(base):
        folders[:] = sorted(d for d in folders if d not in IGNORED_FOLDERS or d == marker)
        if marker in folders or marker in files:
            out.append(folder)
            folders[:] = []
        elif folder[len(base.rstrip("/")) :].count(os.sep) >= depth:
            folders[:] = []
    return out


_YES, _NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def coerced(value: Any, like: Any, allowed: tuple[str, ...] = ()) -> Any:
    """A setting's value as the kind of its default; raises where it cannot be one."""
    if allowed and value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    if isinstance(like, bool):
        if isinstance(value, bool):
            return value
        if str(value).lower() in _YES + _NO:
            return str(value).lower() in _YES
        raise ValueError(f"{value!r} is neither true nor false")
    return type(like)(value) if like is not None else value


def settings(defaults: dict[str, Any], files: list[str], overrides: dict[str, Any] | None = None, allowed: dict[str, tuple[str, ...]] | None = None) -> dict[str, Any]:
    """Defaults, then TOML files in order, then overrides; unknown names are an error."""
    out = dict(defaults)
    read = [tomllib.loads(Path(f).read_text("utf-8")) for f in files if Path(f).is_file()]
    for layer in [*read, overrides or {}]:
        for k, v in layer.items():
            if k not in defaults:
                raise KeyError(k)
            if v is not None:
                out[k] = coerced(v, defaults[k], (allowed or {}).get(k, ()))
    return out
