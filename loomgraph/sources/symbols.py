"""Compiler symbol indexes: the binary and the JSON form, symbol strings, ranges, and their import as evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

OCCURRENCE = "struct<symbol: string, range: array<int>, symbol_roles: int>"
RELATION = "struct<symbol: string, is_reference: boolean, is_implementation: boolean, is_type_definition: boolean, is_definition: boolean>"
DOCUMENTS = f"relative_path string, language string, position_encoding int, text string, occurrences array<{OCCURRENCE}>, symbols array<struct<symbol: string, kind: int, documentation: array<string>, relationships: array<{RELATION}>>>"
DEFINITION, IMPORT = 1, 2


class Damaged(ValueError):
    """A message ends before it should, or is no message."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Damaged("a number does not end")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a message; raises where it is cut off."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if not number:
            raise Damaged("field 0")
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if wire == 2:
                size, at = _varint(data, at)
            if size is None:
                raise Damaged(f"wire type {wire}")
            if at + size > len(data):
                raise Damaged("a field does not end")
            value, at = data[at : at + size], at + size
        yield number, wire, value


def _signed(n: int) -> int:
    n &= 0xFFFFFFFF
    return n - (1 << 32) if n >> 31 else n


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = _varint(data, at)
        out.append(_signed(n))
    return out


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _occurrence(data: bytes) -> dict:
    out: dict = {"symbol": "", "range": [], "symbol_roles": 0}
    for n, w, v in fields(data):
        if n == 1:
            out["range"] += _packed(v) if w == 2 else [_signed(v)]
        elif n == 2 and w == 2:
            out["symbol"] = _text(v)
        elif n == 3 and w == 0:
            out["symbol_roles"] = _signed(v)
    return out


def _relationship(data: bytes) -> dict:
    names = {2: "is_reference", 3: "is_implementation", 4: "is_type_definition", 5: "is_definition"}
    out: dict = {"symbol": "", **dict.fromkeys(names.values(), False)}
    for n, w, v in fields(data):
        if n == 1 and w == 2:
            out["symbol"] = _text(v)
        elif n in names and w == 0:
            out[names[n]] = bool(v)
    return out


def _information(data: bytes) -> dict:
    """A symbol's entry. Writers disagree on field 3: it is a relationship where it starts as one, else a text."""
    out: dict = {"symbol": "", "kind": 0, "documentation": [], "relationships": []}
    for n, w, v in fields(data):
        if n == 1 and w == 2:
            out["symbol"] = _text(v)
        elif n == 2 and w == 2:
            out["documentation"].append(_text(v))
        elif n == 3 and w == 2 and not v.startswith(b"\n"):
            out["documentation"].append(_text(v))
        elif n in (3, 4) and w == 2:
            out["relationships"].append(_relationship(v))
        elif n in (4, 17) and w == 0:
            out["kind"] = _signed(v)
    return out


def _document(data: bytes) -> dict:
    out: dict = {"relative_path": "", "language": "", "position_encoding": None, "text": "", "occurrences": [], "symbols": []}
    for n, w, v in fields(data):
        if w == 2 and n in (1, 4, 5):
            out[{1: "relative_path", 4: "language", 5: "text"}[n]] = _text(v)
        elif w == 2 and n == 2:
            out["occurrences"].append(_occurrence(v))
        elif w == 2 and n == 3:
            out["symbols"].append(_information(v))
        elif w == 0 and n == 6:
            out["position_encoding"] = _signed(v)
    return out


def parse_index(data: bytes) -> list[dict]:
    """The documents of a binary index; raises Damaged where it is cut off."""
    return [_document(v) for n, w, v in fields(data) if n == 2 and w == 2]


def read_binary(files: DataFrame) -> DataFrame:
    """One row a document of index files (content: binary), decoded on the executors, a document at a time."""
    schema = DOCUMENTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                for n, w, v in fields(bytes(data)):
                    if n == 2 and w == 2:
                        yield pd.DataFrame([_document(v)])

    return files.select("content").mapInPandas(run, schema)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of the JSON form, with snake_case or camelCase keys."""
    rel = "struct<symbol: string, is_reference: boolean, isReference: boolean, is_implementation: boolean, isImplementation: boolean, is_type_definition: boolean, isTypeDefinition: boolean, is_definition: boolean, isDefinition: boolean>"
    schema = (
        "documents array<struct<relative_path: string, relativePath: string, language: string, position_encoding: int, positionEncoding: int, text: string, occurrences: array<struct<symbol: string, range: array<int>, symbol_roles: int, symbolRoles: int>>, "
        f"symbols: array<struct<symbol: string, kind: int, documentation: array<string>, relationships: array<{rel}>>>>>"
    )
    d = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")
    either = lambda x, a, b: F.coalesce(x[a], x[b])
    said = lambda r, a, b: F.coalesce(r[a], r[b], F.lit(False)).alias(a)
    occ = F.transform(F.coalesce("occurrences", F.array().cast("array<struct<symbol: string, range: array<int>, symbol_roles: int, symbolRoles: int>>")), lambda o: F.struct(o["symbol"].alias("symbol"), o["range"].alias("range"), F.coalesce(either(o, "symbol_roles", "symbolRoles"), F.lit(0)).alias("symbol_roles")))
    rels = lambda s: F.transform(s["relationships"], lambda r: F.struct(r["symbol"].alias("symbol"), said(r, "is_reference", "isReference"), said(r, "is_implementation", "isImplementation"), said(r, "is_type_definition", "isTypeDefinition"), said(r, "is_definition", "isDefinition")))
    syms = F.transform("symbols", lambda s: F.struct(s["symbol"].alias("symbol"), F.coalesce(s["kind"], F.lit(0)).alias("kind"), s["documentation"].alias("documentation"), rels(s).alias("relationships")))
    return d.select(F.coalesce("relative_path", "relativePath").alias("relative_path"), "language", F.coalesce("position_encoding", "positionEncoding").alias("position_encoding"), "text", occ.alias("occurrences"), syms.alias("symbols"))


_ENDS = re.compile(r"(\(\)\.|\(\):|#|\.|/|\(.*?\)|\[.*?\])$")


def _unquoted(name: str) -> str:
    return name[1:-1].replace("``", "`") if len(name) >= 2 and name[0] == name[-1] == "`" else name


def _chunks(text: str) -> list[str]:
    """Descriptors, each with the sign that ends it; what stands in backticks is one name."""
    out, start, i, quoted = [], 0, 0, False
    while i < len(text):
        c = text[i]
        if c == "`":
            if quoted and text[i + 1 : i + 2] == "`":
                i += 1
            else:
                quoted = not quoted
        elif not quoted:
            ahead = text[i + 1 : i + 2]
            if c in "/#." or (c == ":" and text[i - 1 : i] == ")") or (c in ")]" and ahead not in (".", ":")):
                out.append(text[start : i + 1])
                start = i + 1
        i += 1
    return [*out, text[start:]] if start < len(text) else out


def parse_symbol(symbol: str) -> dict[str, str | bool | None]:
    """scheme, manager, package, version, descriptors, name, kind, parent, fqn, is_local of a symbol string."""
    out: dict = {"scheme": "", "manager": "", "package": "", "version": "", "descriptors": "", "name": symbol, "kind": "symbol", "parent": None, "fqn": "", "is_local": symbol.startswith("local ")}
    if not symbol or out["is_local"]:
        return out
    parts = re.findall(r"(?:`(?:``|[^`])*(?:`|$)|[^ `])+", symbol)
    if len(parts) >= 4:
        out.update(scheme=parts[0], manager=_unquoted(parts[1]), package=_unquoted(parts[2]), version=_unquoted(parts[3]))
    out["descriptors"] = " ".join(parts[4:]) if len(parts) >= 5 else parts[3] if len(parts) == 4 else symbol
    chunks = _chunks(out["descriptors"])
    if not chunks:
        return out
    last, names = chunks[-1], [_unquoted(_ENDS.sub("", c)) for c in chunks]
    out["kind"] = "method" if "()" in last else {"#": "class", "/": "package", ".": "field"}.get(last[-1:], "symbol")
    out.update(name=names[-1], fqn=".".join(names), parent=names[-2] if len(names) > 1 else None)
    return out


def parsed_symbol(symbol: Column) -> Column:
    """parse_symbol() of a column, in Arrow batches."""

    @pandas_udf("scheme string, manager string, package string, version string, descriptors string, name string, kind string, parent string, fqn string, is_local boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_symbol(x or "") for x in s], columns=["scheme", "manager", "package", "version", "descriptors", "name", "kind", "parent", "fqn", "is_local"])

    return run(symbol)


def span_of(range_: Column) -> Column:
    """(line_start, line_end, col_start, col_end) of three or four numbers: lines from 1, columns from 0; nulls for others."""
    at = lambda k: F.get(range_, F.lit(k))
    one = lambda a, b, c, d: F.struct(a.cast("int").alias("line_start"), b.cast("int").alias("line_end"), c.cast("int").alias("col_start"), d.cast("int").alias("col_end"))
    none = F.lit(None)
    return F.when(F.size(range_) == 3, one(at(0) + 1, at(0) + 1, at(1), at(2))).when(F.size(range_) >= 4, one(at(0) + 1, at(2) + 1, at(1), at(3))).otherwise(one(none, none, none, none))


def characters(units: int, line: str) -> int:
    """A column in UTF-16 units as a column in characters of the line."""
    return len(line.encode("utf-16-le", "surrogatepass")[: 2 * units].decode("utf-16-le", "ignore"))


def in_characters(column: Column, line_no: Column, text: Column) -> Column:
    """A UTF-16 column of a line (from 1) of a text as a column in characters; unchanged where there is no such line."""

    @pandas_udf("int")
    def run(c: pd.Series, n: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for col, k, whole in zip(c, n, t, strict=True):
            lines = whole.splitlines() if isinstance(whole, str) else []
            known = col is not None and not pd.isna(col) and k is not None and not pd.isna(k) and 0 < int(k) <= len(lines)
            out.append(characters(int(col), lines[int(k) - 1]) if known else col)
        return pd.Series(out, dtype="Int32")

    return run(column, line_no, text)


def occurrences(documents: DataFrame) -> DataFrame:
    """path, symbol, role, spans of every occurrence."""
    o = documents.select(F.col("relative_path").alias("path"), F.explode("occurrences").alias("o"))
    bit = lambda k: F.col("o.symbol_roles").bitwiseAND(k) == k
    role = F.when(bit(DEFINITION), "definition").when(bit(IMPORT), "import").otherwise("reference")
    return o.select("path", F.col("o.symbol").alias("symbol"), role.alias("role"), span_of(F.col("o.range")).alias("s")).select("path", "symbol", "role", "s.*")


def relations(documents: DataFrame) -> DataFrame:
    """path, src, dst, relation of every relationship."""
    s = documents.select(F.col("relative_path").alias("path"), F.explode("symbols").alias("s")).select("path", F.col("s.symbol").alias("src"), F.explode("s.relationships").alias("r"))
    kind = F.when(F.col("r.is_implementation"), "implements").when(F.col("r.is_type_definition"), "type_of").otherwise("references")
    return s.select("path", "src", F.col("r.symbol").alias("dst"), kind.alias("relation"))


def enclosed(found: DataFrame, lines: int = 4096) -> DataFrame:
    """References and imports with the definition they stand in: the last one of the file, by line and column, that begins at
    or before them and covers them or has no known end.

    Lines are dealt into bins. A bin carries its last definition forward, and the last one of the bins before is one row a
    bin, so a file with very many occurrences is many small sorts.
    """
    x = found.withColumn("bin", F.floor(F.coalesce("line_start", F.lit(0)) / lines))
    d = F.when(F.col("role") == "definition", F.struct("line_start", "col_start", "line_end", "symbol"))
    order = ["line_start", "col_start", F.when(F.col("role") == "definition", 0).otherwise(1), "symbol"]
    inside = Window.partitionBy("path", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("d", F.last(d, True).over(inside))
    last = x.groupBy("path", "bin").agg(F.max(d).alias("last"))
    before = last.withColumn("carried", F.last("last", True).over(Window.partitionBy("path").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))).select("path", "bin", "carried")
    y = x.join(before, ["path", "bin"]).withColumn("d", F.coalesce("d", "carried")).where("role <> 'definition'")
    covers = F.col("d.line_end").isNull() | (F.col("d.line_end") >= F.col("line_start"))
    return y.select("path", "symbol", "role", "line_start", "line_end", F.when(covers, F.col("d.symbol")).alias("owner"))


def as_evidence(documents: DataFrame, journal: DataFrame, provider: str, run_id: str, now: int) -> DataFrame:
    """Evidence rows of an index: definitions, references under the definition they stand in, and relationships, each with
    the digest that the journal has of its file."""
    o = occurrences(documents)
    blank = F.lit(None).cast("string")
    defs = o.where("role = 'definition'").select("path", F.col("symbol").alias("src"), blank.alias("dst"), F.lit("defines").alias("relation"), "line_start", "line_end")
    refs = enclosed(o.where("line_start is not null")).select("path", F.col("owner").alias("src"), F.col("symbol").alias("dst"), F.when(F.col("role") == "import", "imports").otherwise("references").alias("relation"), "line_start", "line_end")
    rels = relations(documents).select("path", "src", "dst", "relation", F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"))
    x = defs.unionByName(refs).unionByName(rels).join(journal.select("path", F.col("digest").alias("snapshot")), "path", "left")
    key = F.concat_ws("\x1f", F.lit(run_id), "path", F.coalesce("src", F.lit("")), F.coalesce("dst", F.lit("")), "relation", F.coalesce(F.col("line_start").cast("string"), F.lit("")))
    return x.distinct().select(
        F.substring(F.sha2(key, 256), 1, 32).alias("evidence_id"), F.lit(run_id).alias("run_id"), F.lit(provider).alias("provider"), "path", "src", "dst", "relation", "line_start", "line_end", "snapshot", F.lit(now).alias("created_at")
    )


def search_symbols(documents: DataFrame, text: str, limit: int) -> DataFrame:
    """symbol, name, fqn, path whose name, qualified name or symbol holds the text, one row more than the limit, so that a
    caller sees whether some were cut."""
    s = documents.select(F.col("relative_path").alias("path"), F.explode("symbols.symbol").alias("symbol")).distinct()
    x = s.withColumn("p", parsed_symbol(F.col("symbol")))
    low = text.lower()
    hit = F.contains(F.lower("p.name"), F.lit(low)) | F.contains(F.lower("p.fqn"), F.lit(low)) | F.contains(F.lower("symbol"), F.lit(low))
    return x.where(hit).select("symbol", F.col("p.name").alias("name"), F.col("p.fqn").alias("fqn"), "path").orderBy("symbol", "path").limit(limit + 1)


def index_usages(documents: DataFrame, symbol: str) -> DataFrame:
    return occurrences(documents).where((F.col("symbol") == symbol) & (F.col("role") != "definition"))


def index_coverage(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """path, indexed of the asked files."""
    held = documents.select(F.col("relative_path").alias("path")).distinct().withColumn("indexed", F.lit(True))
    return asked.select("path").distinct().join(held, "path", "left").select("path", F.coalesce("indexed", F.lit(False)).alias("indexed"))
