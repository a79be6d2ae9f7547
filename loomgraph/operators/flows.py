"""What code does, line by line: branches of user interfaces, steps of services, and traces through both.

A body becomes rows by posexplode; a line is classified by ordered patterns and what it inherits from lines before it is
carried by a window over its own body, so bodies are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.architecture import first_of

#: Patterns of user-interface lines; fixed values.
HANDLER = r"(?:const|function|async function)\s+([a-zA-Z0-9_]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>|function\s+([a-zA-Z0-9_]+)\s*\("
GUARD = r"if\s*\(([^)]*(?:error|invalid|null|undefined|!|<=|>=|<|>|===|!==)[^)]*)\)"
TOAST = r"(?:toast|notification|alert|message)\.(?:error|success|warning|info)\s*\(\s*[\"']([^\"']+)[\"']"
MODAL = r"(?:setOpen|setShow|openModal|showDialog|setIsVisible)\s*\(\s*(true|false|[^)]+)\)"
API_CALL = r"(?:api|client|fetch|axios|mutate|mutateAsync|useMutation)\.([a-zA-Z0-9_]+)\s*\(|([a-zA-Z0-9_]+Api)\.([a-zA-Z0-9_]+)\("
#: Backend steps of a trace: (category, data source, pattern), first match; fixed values.
STEPS = (
    ("VALIDATE", "NONE", r"@Valid|validate|IllegalArgumentException|if\s*\([^)]*(?:null|isEmpty|<=|0|isBlank)[^)]*\)"),
    ("LOCAL_DB", "PRIMARY_DB", r"(?i)repository\.find|repo\.find|repository\.select|entityManager\.find|query\.select|SELECT\s+.*FROM"),
    ("EXTERNAL_DB", "", r"(?i)bccs|bccsJdbc|restTemplate|webClient|feignClient|redisTemplate|kafkaTemplate|http\.get|http\.post"),
    ("BUSINESS_CHECK", "NONE", r"(?i)if\s*\([^)]*(?:limit|balance|status|exists|role|auth|debt|amount)[^)]*\)"),
    ("MUTATION", "PRIMARY_DB", r"(?i)repository\.save|repo\.save|repository\.update|repository\.delete|ledger|insert|update|recordTransaction"),
    ("AUDIT", "PRIMARY_DB", r"(?i)audit|auditLog|logger\.info|log\.info|eventPublisher\.publish"),
    ("EXCEPTION", "NONE", r"throw\s+new\s+[A-Za-z0-9_]*Exception"),
)
#: Steps of an effort table: (category, data source, pattern), first match; fixed values.
EFFORT_STEPS = (
    ("VALIDATE", "NONE", r"@Valid|validate|IllegalArgument|if\s*\([^)]*null"), ("LOCAL_DB", "PRIMARY_DB", r"(?i)find|select|repo\.|repository\."),
    ("EXTERNAL_DB", "BCCS_DATASOURCE", r"(?i)bccs|external|client\.|http|rest"), ("BUSINESS_CHECK", "NONE", r"if\s*\("), ("EXCEPTION", "NONE", r"throw\s+new"),
    ("MUTATION", "PRIMARY_DB", r"(?i)save|update|delete|record|ledger"), ("AUDIT", "PRIMARY_DB", r"(?i)log|audit"), ("RESPONSE", "NONE", r"return\s+"),
)
UI_FILES = (".tsx", ".jsx", ".vue", ".html")
SERVICE_FILES = (".java", ".php", ".py", ".ts", ".go", ".cs")


def lines_of(nodes: DataFrame, *more: str) -> DataFrame:
    """id, more, line (from 1), text of every line of every body."""
    return nodes.select("id", *more, F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r\n|\n|\r")).alias("k", "text")).select("id", *more, (F.col("k") + 1).alias("line"), "text")


def _found(text: Column, pattern: str, *groups: int) -> Column:
    """The first group that holds something; null where the pattern does not match."""
    got = F.coalesce(*[F.when(F.regexp_extract(text, pattern, g) != "", F.regexp_extract(text, pattern, g)) for g in groups]) if groups else None
    return F.when(F.rlike(text, F.lit(pattern)), F.coalesce(got, F.lit("")) if groups else F.lit(""))


def ui_branches(nodes: DataFrame) -> DataFrame:
    """id, line, type, handler, condition, effect, target: guards, toasts, dialogs and calls of a component's body, each
    under the last handler that began before it (render before the first)."""
    t = F.col("text")
    x = lines_of(nodes).withColumn("own", F.when(F.rlike(t, F.lit(HANDLER)), F.when(F.regexp_extract(t, HANDLER, 1) != "", F.regexp_extract(t, HANDLER, 1)).otherwise(F.regexp_extract(t, HANDLER, 2))))
    so_far = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("handler", F.coalesce(F.last("own", True).over(so_far), F.lit("render")))
    one = lambda kind, condition, effect, target: F.struct(F.lit(kind).alias("type"), condition.alias("condition"), F.lit(effect).alias("effect"), target.alias("target"))
    call = F.coalesce(_found(t, API_CALL, 1, 3), F.lit(""))
    found = F.array_compact(F.array(
        F.when(F.rlike(t, F.lit(GUARD)), one("VALIDATION_BRANCH", F.left(F.trim(F.regexp_extract(t, GUARD, 1)), F.lit(80)), "Branch / Guard Condition", F.lit("Inline Error / Fallback View"))),
        F.when(F.rlike(t, F.lit(TOAST)), one("TOAST_ALERT", F.lit("Action trigger"), "SHOW_TOAST", F.concat(F.lit("Toast: "), F.left(F.trim(F.regexp_extract(t, TOAST, 1)), F.lit(50))))),
        F.when(F.rlike(t, F.lit(MODAL)), one("MODAL_DIALOG", F.lit("State toggle"), "OPEN_MODAL", F.lit("Modal Dialog / Confirmation"))),
        F.when(F.rlike(t, F.lit(API_CALL)), one("API_DISPATCH", F.lit("Form Valid"), "DISPATCH_API_REQUEST", F.concat(F.lit("Call API: "), F.when(call != "", call).otherwise("fetch")))),
    ))
    return x.select("id", "line", "handler", F.explode(found).alias("b")).select("id", "line", "handler", "b.*")


def _steps(nodes: DataFrame, rules: tuple, skipped: str, width: int) -> DataFrame:
    s = F.trim("text")
    x = lines_of(nodes).withColumn("code", s).where((F.col("code") != "") & ~F.rlike("code", F.lit(skipped)))
    kinds = [(F.rlike("code", F.lit(p)), F.struct(F.lit(c).alias("category"), (F.lit(d) if d else F.when(F.contains(F.lower("code"), F.lit("bccs")), "BCCS_DATASOURCE").otherwise("EXTERNAL_API")).alias("datasource"))) for c, d, p in rules]
    x = x.withColumn("c", first_of(kinds)).where("c is not null")
    order = Window.partitionBy("id").orderBy("line")
    return x.select("id", F.row_number().over(order).alias("step"), "line", "c.category", "c.datasource", F.left("code", F.lit(width)).alias("code"))


def backend_steps(nodes: DataFrame) -> DataFrame:
    """id, step, line, category, datasource, code of a service's body; comments are no steps."""
    return _steps(nodes, STEPS, r"^(//|/\*|\*)", 120)


def effort_steps(nodes: DataFrame) -> DataFrame:
    """The finer table of steps from which effort is estimated."""
    return _steps(nodes, EFFORT_STEPS, r"^(//|/\*|\*|#|import |package )", 90)


def effort_rank(steps: DataFrame) -> DataFrame:
    """id, steps, rank by number of steps: up to 4, 5 to 8, 9 and more."""
    n = steps.groupBy("id").agg(F.count(F.lit(1)).alias("steps"))
    return n.select("id", "steps", F.when(F.col("steps") <= 4, "NVJ1").when(F.col("steps") <= 8, "NVJ2").otherwise("NVJ3").alias("rank"))


def backend_flow(nodes: DataFrame) -> DataFrame:
    """id, steps, datasources, checks of each service."""
    s = backend_steps(nodes)
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("steps"), F.array_join(F.sort_array(F.collect_set("datasource")), ",").alias("datasources"), F.count_if(F.col("category").isin("VALIDATE", "BUSINESS_CHECK")).alias("checks"))


def ui_tree(nodes: DataFrame) -> DataFrame:
    """id, branches, handlers, actions of each component."""
    b = ui_branches(nodes)
    return b.groupBy("id").agg(F.count(F.lit(1)).alias("branches"), F.array_join(F.sort_array(F.collect_set("handler")), ",").alias("handlers"), F.count_if(F.col("type") == "API_DISPATCH").alias("calls"))


def trace(nodes: DataFrame) -> DataFrame:
    """One row a side and node of the matched nodes: branches of interface files, steps of service files."""
    ends = lambda some: F.rlike("path", F.lit("(" + "|".join(e.replace(".", r"\.") for e in some) + ")$"))
    ui = ui_branches(nodes.where(ends(UI_FILES))).select(F.lit("ui").alias("side"), "id", "line", F.col("type").alias("what"), "target")
    service = backend_steps(nodes.where(ends(SERVICE_FILES) & ~ends((".tsx", ".jsx")))).select(F.lit("service").alias("side"), "id", "line", F.col("category").alias("what"), F.col("datasource").alias("target"))
    return ui.unionByName(service)


def trace_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("side", "what").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("nodes"))


def trace_markdown(target: str, summary: list[tuple[str, str, int, int]]) -> str:
    """The few rows of trace_summary() as text."""
    head = [f"# Trace: {target}", "", "| Side | What | Lines | Nodes |", "|---|---|---:|---:|"]
    return "\n".join([*head, *[f"| {a} | {b} | {n} | {m} |" for a, b, n, m in sorted(summary)]])
