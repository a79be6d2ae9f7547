"""Python sources to nodes, edges and unresolved references, file by file on the executors."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "path string, sha256 string, outcome string, nodes array<struct<id string, kind string, symbol string, line_start int, line_end int>>, edges array<struct<src string, dst string, relation string, line int>>, pending array<struct<src string, dst_symbol string, relation string, line int, import_source string>>"


def parse(path: str, text: str) -> dict:
    """One file; a syntax error gives the file node alone."""
    space = hashlib.sha256(path.encode()).hexdigest()[:12]
    lines = max(1, text.count("\n") + 1)
    top = f"file:{space}"
    out = {"path": path, "sha256": hashlib.sha256(text.encode()).hexdigest(), "nodes": [(top, "file", path, 1, lines)], "edges": [], "pending": []}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out | {"outcome": "PARSE_ERROR"}
    own = lambda name: f"sym:{space}:{name}"
    defined: dict[str, str] = {}
    calls: list[tuple[str, str, int]] = []
    imports: dict[str, str] = {}

    def visit(node: ast.AST, owner: str, prefix: str) -> None:
        for x in ast.iter_child_nodes(node):
            inner, deeper = owner, prefix
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{prefix}.{x.name}" if prefix else x.name
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if prefix else "function"
                inner, deeper = own(name), name
                defined[name] = inner
                out["nodes"].append((inner, kind, name, x.lineno, x.end_lineno or x.lineno))
                out["edges"].append((owner, inner, "defines", x.lineno))
                if isinstance(x, ast.ClassDef):
                    out["pending"] += [(inner, ast.unparse(b), "extends", x.lineno, None) for b in x.bases]
            elif isinstance(x, ast.Import | ast.ImportFrom):
                source = "." * getattr(x, "level", 0) + (getattr(x, "module", None) or "")
                for a in x.names:
                    imports[a.asname or a.name] = source or a.name
                    out["pending"].append((top, a.name, "imports", x.lineno, source or a.name))
            elif isinstance(x, ast.Call):
                f = x.func
                name = f.id if isinstance(f, ast.Name) else f"{prefix.rpartition('.')[0]}.{f.attr}" if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("self", "cls") else f.attr if isinstance(f, ast.Attribute) else ""
                if name:
                    calls.append((owner, name, x.lineno))
            visit(x, inner, deeper)

    visit(tree, top, "")
    for src, name, line in calls:
        if name in defined:
            out["edges"].append((src, defined[name], "calls", line))
        else:
            out["pending"].append((src, name.rpartition(".")[2], "calls", line, imports.get(name)))
    still = []
    for src, name, relation, line, source in out["pending"]:
        if relation == "extends" and name in defined:
            out["edges"].append((src, defined[name], "extends", line))
        else:
            still.append((src, name, relation, line, source))
    return out | {"pending": still, "outcome": "COMPLETE" if len(out["nodes"]) > 1 else "VALID_EMPTY"}


def extract(files: DataFrame) -> DataFrame:
    """files: path, text. One row a file with arrays of nodes, edges and pending references."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = {"nodes": ("id", "kind", "symbol", "line_start", "line_end"), "edges": ("src", "dst", "relation", "line"), "pending": ("src", "dst_symbol", "relation", "line", "import_source")}
        for b in batches:
            rows = [parse(p, t or "") for p, t in zip(b["path"], b["text"], strict=True)]
            for r in rows:
                for k, names in fields.items():
                    r[k] = [dict(zip(names, v, strict=True)) for v in r[k]]
            yield pd.DataFrame(rows, columns=["path", "sha256", "outcome", "nodes", "edges", "pending"])

    return files.select("path", "text").mapInPandas(run, ROW)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges and pending as flat tables, each with its path."""
    return {k: parsed.select("path", F.explode(k).alias("r")).select("path", "r.*") for k in ("nodes", "edges", "pending")}
