"""Which provider answers a question: specs, ranks, plans, and the contract that providers keep.

A provider is an object whose methods take a request and give a DataFrame of claims; it never raises for a failure of its
own. Data that providers hand over are tables like any other (see ledger and identity).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Commands and what they need of a provider, other names of capabilities, methods in order of preference; fixed values.
COMMANDS = {"diff-impact": "impact", "usages": "callgraph", "trace": "callgraph", "explore": "callgraph", "search": "search_symbols", "symbols": "search_symbols"}
ALIASES = {"trace": ("callgraph", "call_graph"), "search_symbols": ("symbols", "search"), "impact": ("change_impact",), "usages": ("references",)}
METHODS = {"diff-impact": ("impact",), "usages": ("usages", "trace"), "trace": ("trace",), "explore": ("trace",), "search": ("search_symbols",), "symbols": ("search_symbols",)}
PROTOCOL = ("probe", "ensure_index", "search_symbols", "trace", "impact", "architecture", "coverage")
OUTCOMES = ("COMPLETE", "VALID_EMPTY", "PARTIAL_AST", "PARSE_ERROR", "PARSER_UNAVAILABLE")


@runtime_checkable
class Provider(Protocol):
    """What a provider has; methods beyond its capabilities need not be there."""

    name: str
    capabilities: tuple[str, ...]

    def probe(self, root: str) -> dict[str, Any]: ...


@dataclass
class Plan:
    mode: str
    name: str | None = None
    providers: list[Any] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    failure: str | None = None


def parse_spec(value: str | None) -> tuple[str, str | None]:
    """(mode, name) of builtin, auto, all, prefer:<name> or require:<name>."""
    if value in (None, "builtin"):
        return "builtin", None
    if value in ("auto", "all"):
        return value, None
    mode, _, name = value.partition(":")
    if mode in ("prefer", "require") and name.strip():
        return mode, name.strip()
    raise ValueError(f"{value!r} is none of builtin, auto, all, prefer:<name>, require:<name>")


def supports(provider: Any, method: str) -> bool:
    """Whether a provider has a method, by its capabilities or their other names."""
    held = tuple(getattr(provider, "capabilities", ()) or ())
    return method in held or any(a in held for a in ALIASES.get(method, ()))


def ranked(statuses: DataFrame, capability: str, allow_external: bool = True) -> DataFrame:
    """Names of providers that can do something, best first. statuses: name, capabilities, priority, installed, healthy, enabled,
    external."""
    ready = F.col("installed") & F.col("healthy") & F.coalesce("enabled", F.lit(True)) & (F.lit(allow_external) | ~F.col("external"))
    return statuses.where(ready & F.array_contains("capabilities", capability)).orderBy(F.desc("priority"), "name").select("name", "priority")


def plan(spec: str | None, command: str, available: list[Any], allow_external: bool = True) -> Plan:
    """Who is asked for a command; available: providers, best first. What must be there and is not fails, what is only
    preferred warns and leaves the graph's own answer."""
    try:
        mode, name = parse_spec(spec)
    except ValueError as e:
        return Plan("invalid", failure=str(e))
    out = Plan(mode, name)
    if mode == "builtin":
        return out

    def miss(why: str) -> None:
        if mode == "require":
            out.failure = f"{why}: failing closed"
        else:
            out.warnings.append(f"{why}; using the graph alone")

    if not allow_external:
        miss("external providers are not allowed")
        return out
    need = COMMANDS.get(command, "search_symbols")
    chosen = [p for p in available if (p.name == name if name else supports(p, need) or any(supports(p, m) for m in METHODS.get(command, ())))]
    if not chosen:
        miss(f"provider {name!r} is not there" if name else f"no provider for {command!r}")
    for p in chosen[:1] if mode == "auto" else chosen:
        status = p.probe("")
        if not status.get("healthy"):
            miss(f"provider {p.name!r} is not available")
        elif mode == "require" and not any(supports(p, m) for m in (need, *METHODS.get(command, ()))):
            miss(f"provider {p.name!r} cannot do {need!r}")
        else:
            out.providers.append(p)
    return out


def ask(found: Plan, command: str, **request: Any) -> tuple[DataFrame | None, str | None]:
    """(claims, method) of the planned provider's first method for the command that it supports."""
    if not found.providers:
        return None, None
    p = found.providers[0]
    for method in METHODS.get(command, ("search_symbols",)):
        if supports(p, method) and callable(getattr(p, method, None)):
            return getattr(p, method)(**request), method
    return None, None


def static_problems(cls: Any) -> list[str]:
    """What a provider lacks that can be seen without calling it."""
    out = [f"{n} is missing" for n in ("name", "capabilities") if not getattr(cls, n, None)]
    out += ["probe is missing"] if not callable(getattr(cls, "probe", None)) else []
    return out + [f"capability {c!r} has no method" for c in getattr(cls, "capabilities", ()) or () if c in PROTOCOL and not callable(getattr(cls, c, None))]


def contract_problems(build: Callable[[], Any], requests: dict[str, dict[str, Any]]) -> list[str]:
    """What a provider does that it must not: a method that raises or gives nothing."""
    p = build()
    out = static_problems(p)
    for method in PROTOCOL:
        if callable(getattr(p, method, None)):
            try:
                if getattr(p, method)(**requests.get(method, {})) is None:
                    out.append(f"{method} gives nothing")
            except Exception as e:  # a provider's failure must be data
                out.append(f"{method} raises {type(e).__name__}")
    return out


def plugins(group: str = "loomgraph.providers") -> tuple[dict[str, Any], list[str]]:
    """(classes by name, problems) of installed providers."""
    from importlib.metadata import entry_points

    good, bad = {}, []
    for e in entry_points(group=group):
        try:
            cls = e.load()
        except Exception as x:  # another package's fault
            bad.append(f"{e.name}: {x}")
            continue
        problems = static_problems(cls)
        bad += [f"{e.name}: {x}" for x in problems]
        if not problems:
            good[e.name] = cls
    return good, bad


def outcome(value: Column) -> Column:
    """A stored parser outcome; null for an unknown one."""
    return F.when(value.isin(*OUTCOMES), value)


def candidates(payload: DataFrame, provider: str) -> DataFrame:
    """provider, name, path, line, kind of each result in providers' JSON answers (payload: json)."""
    schema = "array<struct<qualified_name: string, fqn: string, name: string, path: string, file_path: string, start_line: int, line: int, kind: string>>"
    for_each = payload.select(F.explode_outer(F.from_json(F.coalesce(F.get_json_object("json", "$.results"), F.get_json_object("json", "$.symbols")), schema)).alias("r")).where("r is not null")
    return for_each.select(F.lit(provider).alias("provider"), F.coalesce("r.qualified_name", "r.fqn", "r.name").alias("name"), F.coalesce("r.path", "r.file_path").alias("path"), F.coalesce("r.start_line", "r.line").alias("line"), "r.kind")


class Store:
    """Receipts under a folder that all share, each named by the digest of its bytes; what is there is never overwritten."""

    def __init__(self, spark: Any, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def canonical(receipt: dict[str, Any]) -> bytes:
        import json

        from loomgraph.operators.assurance import VOLATILE

        def held(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: held(v) for k, v in x.items() if k not in VOLATILE}
            return [held(v) for v in x] if isinstance(x, list) else x

        return json.dumps(held({k: v for k, v in receipt.items() if k != "digest"}), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()

    def put(self, receipt: dict[str, Any]) -> str:
        import hashlib

        data = self.canonical(receipt)
        digest = hashlib.sha256(data).hexdigest()
        at = self._path(f"{self.root}/{digest}.json")
        if self._fs.exists(at):
            if self._read(at) != data:
                raise ValueError(f"other bytes are stored under {digest}")
            return digest
        out = self._fs.create(at, False)
        out.write(bytearray(data))
        out.close()
        return digest

    def _read(self, at: Any) -> bytes:
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def get(self, digest: str) -> dict[str, Any]:
        import hashlib
        import json
        import re

        if not re.fullmatch("[0-9a-f]{64}", digest):
            raise ValueError(f"{digest!r} is no digest")
        at = self._path(f"{self.root}/{digest}.json")
        if not self._fs.exists(at):
            raise KeyError(digest)
        data = self._read(at)
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"receipt {digest} is damaged")
        return json.loads(data)


def impact_claim(request: dict[str, Any], receipt: Callable[..., DataFrame], store: Store | None = None) -> dict[str, Any]:
    """A checked request, its receipt's one row, and the digest under which it is stored."""
    depth = request.get("depth", 2)
    if not request.get("target") or not isinstance(depth, int) or not 1 <= depth <= 4:
        raise ValueError("a claim needs a target and a depth of 1 to 4")
    rows = receipt(**request).limit(2).collect()  # one row
    out = {"request": request, "receipt": rows[0].asDict(recursive=True) if rows else None}
    return out | {"digest": store.put(out)} if store else out
