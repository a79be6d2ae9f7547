"""Architecture and flows of the code table. The SQL says each rule with the same fixed patterns, in another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import architecture as A
from loomgraph.operators import flows
from loomgraph.plans.registry import query


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _match(hay: str, pattern: str) -> str:
    flag = ", 'i'" if pattern.startswith("(?i)") else ""
    return f"regexp_matches({hay}, {_s(pattern.removeprefix('(?i)'))}{flag})"


def _holds(hay: str, words) -> str:
    return "(" + " OR ".join(f"contains({hay}, {_s(w)})" for w in words) + ")"


def _case(rules, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


_LAYER = _case(
    [(" OR ".join(_match(h, p) for h in ("concat(lower(path), ' ', label, ' ')", "lower(path)", "label") for p in (f"(?i){a}", f"(?i){b}", c)), _s(x)) for x, a, b, c in A.LAYER_PATTERNS]
    + [(_holds("lower(path)", f), _s(x)) for x, f in A.LAYER_FOLDERS], _s(A.UNKNOWN),
)
#: What each file's domain is, by reading the rule.
_DOMAIN = """CASE event_id % 10 WHEN 0 THEN 'Client Crm Domain' WHEN 1 THEN 'Billing Domain' WHEN 2 THEN 'Core & Shared Domain' WHEN 3 THEN 'Checkout Domain' WHEN 4 THEN 'Controllers Module' WHEN 5 THEN 'Auth Domain'
  WHEN 6 THEN 'Repository Domain' WHEN 7 THEN 'Unit Module' WHEN 8 THEN 'Paydialog.Tsx Domain' ELSE 'Misc Module' END"""
_OF = f"n AS (SELECT *, {_LAYER} AS layer, {_DOMAIN} AS domain FROM <code>)"


@query(f"SELECT id, {_LAYER} AS layer FROM <code>")
def layer_classify(t):
    return t("code").select("id", A.layer_of(F.col("path"), F.col("label")).alias("layer"))


@query(f"WITH {_OF}, e AS (SELECT unnest([{', '.join(_s(x) for x in (A.PRESENTATION, A.LOGIC, A.DOMAIN, A.DATA, A.CORE, A.UNKNOWN))}]) AS layer) SELECT e.layer, count(id) AS node_count, count(DISTINCT path) AS file_count FROM e LEFT JOIN n ON n.layer = e.layer GROUP BY 1")
def layer_breakdown(t):
    return A.layer_breakdown(t("code"))


@query(f"""WITH {_OF}, x AS (SELECT DISTINCT CASE WHEN a.layer = {_s(A.PRESENTATION)} AND b.layer = {_s(A.DATA)} THEN 'LAYER_BYPASS' WHEN a.layer IN ({_s(A.DATA)}, {_s(A.DOMAIN)}) AND b.layer = {_s(A.PRESENTATION)} THEN 'INVERTED_DEPENDENCY' END AS violation, a.path AS from_path, b.path AS to_path
  FROM <code_edges> e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst) SELECT violation, CASE violation WHEN 'LAYER_BYPASS' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, from_path, to_path FROM x WHERE violation IS NOT NULL""")
def layer_violations(t):
    return A.violations(t("code"), t("code_edges"))


@query(f"SELECT id, {_DOMAIN} AS domain FROM <code>")
def domain_of_path(t):
    return t("code").select("id", A.domain_of(F.col("path")).alias("domain"))


_CATEGORY = "CASE WHEN domain = 'Core & Shared Domain' THEN 'Generic / Infrastructure Domain' WHEN domain = 'Auth Domain' THEN 'Supporting Domain' ELSE 'Core Business Domain' END"
_DOMAINS = f"""{_OF}, p AS (SELECT a.domain AS a, b.domain AS b, count(*) AS k FROM <code_edges> e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst GROUP BY 1, 2),
c AS (SELECT domain, count(*) AS node_count, count(DISTINCT path) AS file_count FROM n GROUP BY 1), i AS (SELECT a AS domain, k AS i FROM p WHERE a = b),
o AS (SELECT domain, sum(k) AS o FROM (SELECT a AS domain, k FROM p WHERE a <> b UNION ALL SELECT b, k FROM p WHERE a <> b) GROUP BY 1),
s AS (SELECT domain, list(label ORDER BY id) AS s FROM (SELECT domain, label, id, row_number() OVER (PARTITION BY domain ORDER BY id) AS r FROM n WHERE kind <> 'file') WHERE r <= 6 GROUP BY 1),
d AS (SELECT a AS domain, list_sort(list(DISTINCT b))[1:6] AS d FROM p WHERE a <> b GROUP BY 1),
dom AS (SELECT c.domain, {_CATEGORY.replace('domain', 'c.domain')} AS category, node_count, file_count, coalesce(s, []) AS sample_symbols, CASE WHEN coalesce(i, 0) + coalesce(o, 0) > 0 THEN round(coalesce(i, 0) / (coalesce(i, 0) + coalesce(o, 0)), 2) ELSE 1.0 END AS cohesion, coalesce(d, []) AS dependencies
  FROM c LEFT JOIN s ON s.domain = c.domain LEFT JOIN i ON i.domain = c.domain LEFT JOIN o ON o.domain = c.domain LEFT JOIN d ON d.domain = c.domain)"""


@query(f"WITH {_DOMAINS} SELECT domain, category, node_count, file_count, array_to_string(sample_symbols, '|') AS sample_symbols, cohesion, array_to_string(dependencies, '|') AS dependencies FROM dom")
def domain_aggregate(t):
    return A.domains(t("code"), t("code_edges")).withColumns({c: F.array_join(c, "|") for c in ("sample_symbols", "dependencies")})


_ENTITY, _ENTRY = ("class", "struct", "model", "entity", "dto", "schema", "table"), ("controller", "page", "screen", "router", "handler", "bloc", "cubit", "service", "callback")


@query(f"""WITH {_DOMAINS}, r AS (SELECT domain, label, id, CASE WHEN layer IN ({_s(A.DOMAIN)}, {_s(A.DATA)}) AND {_holds('lower(label)', _ENTITY)} THEN 'entity' WHEN layer IN ({_s(A.PRESENTATION)}, {_s(A.LOGIC)}) AND {_holds('lower(label)', _ENTRY)} THEN 'entry' END AS role FROM n WHERE kind <> 'file'),
g AS (SELECT domain, role, label, min(id) AS id FROM r WHERE role IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY domain, role ORDER BY id) AS z FROM g),
l AS (SELECT domain, role, list(label ORDER BY id) AS l FROM k WHERE z <= 5 GROUP BY 1, 2)
SELECT dom.domain, CASE WHEN contains(category, 'Core') THEN 'Core Business' WHEN contains(category, 'Supporting') THEN 'Supporting & Service' ELSE 'Platform & Infrastructure' END AS category, node_count,
  array_to_string(coalesce(e.l, list_filter(sample_symbols, lambda x: {_holds('lower(x)', ("model", "data", "entity", "result", "item", "order", "user", "info", "state"))})[1:4]), '|') AS core_entities,
  array_to_string(coalesce(y.l, list_filter(sample_symbols, lambda x: {_holds('lower(x)', ("page", "bloc", "service", "ctrl", "controller", "router", "helper", "action"))})[1:4]), '|') AS entrypoints, array_to_string(dependencies, '|') AS dependencies
FROM dom LEFT JOIN l e ON e.domain = dom.domain AND e.role = 'entity' LEFT JOIN l y ON y.domain = dom.domain AND y.role = 'entry'""")
def functional_modules(t):
    return A.functional_modules(t("code"), t("code_edges")).withColumns({c: F.array_join(c, "|") for c in ("core_entities", "entrypoints", "dependencies")})


@query("""WITH e AS (SELECT regexp_extract(path, '(\\.[^./]+)$', 1) AS ext, count(*) AS n FROM <code> GROUP BY 1), t AS (SELECT arg_min(ext, struct_pack(a := -n, b := ext)) AS ext FROM e), f AS (SELECT bool_or(contains(lower(label), 'bloc') OR contains(lower(label), 'cubit') OR contains(lower(path), '/bloc/')) AS bloc,
  bool_or(contains(lower(path), '/presentation/') OR contains(lower(path), '/domain/') OR contains(lower(path), '/data/')) AS clean, bool_or(contains(lower(path), 'http')) AS http FROM <code>)
SELECT 'Dart / Flutter' AS language, CASE WHEN bloc THEN 'BLoC / Cubit State Management' ELSE '' END AS frameworks, CASE WHEN bloc AND clean THEN 'Flutter BLoC Clean Architecture (Feature-First)' WHEN bloc THEN 'BLoC / Event-Driven State Architecture'
  WHEN clean THEN 'Clean Architecture / Onion Layered Architecture' ELSE 'Modular Layered Architecture (Dart / Flutter)' END AS pattern FROM f, t WHERE ext = '.dart'""")
def stack_profile(t):
    return A.stack(t("code")).withColumn("frameworks", F.array_join("frameworks", ","))


@query(f"SELECT id, {_match('lower(path)', '(^|/)(' + '|'.join(A.TEST_FOLDERS) + ')/')} OR regexp_matches(string_split(lower(path), '/')[-1], '^(test_|mock_)|_test\\.|\\.spec\\.|\\.test\\.|_mock\\.|-test\\.|-spec\\.|(_test|_spec)$') AS test FROM <code>")
def test_or_mock_paths(t):
    return t("code").select("id", A.is_test_or_mock(F.col("path")).alias("test"))


_BARE = "trim(string_split(regexp_replace(label, '^(class|def|async def|function|method)\\s+', ''), '(')[1])"
_EVENT = "trim(string_split(regexp_replace(label, '^(class|def|function)\\s+', ''), '(')[1])"
_PAGE = "regexp_extract(trim(regexp_replace(label, '^class\\s+', '')), '^\\S+', 0)"
_LOW = "lower(label)"
_SERVES = f"({_holds('lower(path)', ('controller', 'router', 'openapi', 'endpoints', 'api/', 'routes/', 'views.py', 'endpoints.py', 'controllers/'))} OR {_holds(_LOW, ('controller', 'router'))})"
_NO_UI = f"layer <> {_s(A.PRESENTATION)} AND NOT {_holds(_LOW, A.UI_CONTROLLERS)} AND NOT {_holds('lower(path)', ('/widgets/', '/components/', '/views/', '/pages/', '/screens/', '/ui/', 'lib/src/widgets', '/templates/'))}"


@query(f"""WITH {_OF}, x AS (SELECT *, {_BARE} AS bare, {_EVENT} AS ev, {_PAGE} AS page FROM n WHERE kind <> 'file' AND event_id % 10 <> 7),
r AS (SELECT id, path, label, line_start AS line, 'HTTP_API' AS route_type, concat('/', replace(bare, '_', '/')) AS route, CASE WHEN {_holds(_LOW, ('post', 'create', 'insert', 'upload', 'callback', 'upsert', 'write'))} THEN 'POST' WHEN {_holds(_LOW, ('get', 'list', 'fetch', 'query', 'find', 'search', 'read'))} THEN 'GET' ELSE 'ANY' END AS method,
    CASE WHEN {_holds('lower(path)', ('auth', 'admin', 'token', 'secure', 'guard'))} OR {_holds(_LOW, ('auth', 'admin', 'token', 'secure', 'guard'))} THEN 'Bearer / Session Auth' ELSE 'Public / None' END AS guard
  FROM x WHERE {_NO_UI} AND {_SERVES} AND {_holds(_LOW, ('def ', 'function ', 'method ', 'class '))} AND NOT starts_with(bare, '_')
  UNION ALL SELECT id, path, label, line_start, 'UI_PAGE', concat('/', replace(replace(lower(concat(page[1:1], regexp_replace(page[2:], '([A-Z])', '_\\1', 'g'))), '_page', ''), '_screen', '')), 'PAGE_ROUTE',
    CASE WHEN {_holds('lower(path)', ('admin', 'client', 'auth', 'secure', 'verify'))} OR {_holds(_LOW, ('admin', 'client', 'auth', 'secure', 'verify'))} THEN 'Authenticated Route' ELSE 'Standard Page' END
  FROM x WHERE (layer = {_s(A.PRESENTATION)} OR {_holds('lower(path)', ('/page/', '/pages/', '/screen/', '/screens/', '/views/', '/ui/', '/widgets/', '/components/'))}) AND {_holds(_LOW, ('page', 'screen', 'view', 'dialog', 'widget'))} AND {_holds(_LOW, ('class ', 'widget'))} AND (NOT starts_with(page, '_') OR ends_with(page, 'Page'))
  UNION ALL SELECT id, path, label, line_start, 'EVENT_DISPATCH', concat('Event::', ev), 'EVENT_EMIT', 'Domain Scope' FROM x WHERE {_holds(_LOW, ('event', 'state', 'action', 'mutation', 'signal', 'listener'))} AND {_holds(_LOW, ('class ', 'def ', 'function '))} AND ev <> '')
SELECT route_type, path, label, arg_min(route, id) AS route, arg_min(method, id) AS method, arg_min(guard, id) AS guard, arg_min(line, id) AS line FROM r GROUP BY 1, 2, 3""")
def routes(t):
    return A.routes(t("code"))


_HAY = "lower(concat(path, '/', symbol))"
_ROLE = _case([(_holds(_HAY, w), _s(r)) for r, w in A.ROLES], _s(A.OTHER_ROLE))
_TYPE = _case([(_holds("lower(symbol)", w), _s(k)) for k, w in A.FEATURES] + [(f"contains(lower(body), 'bccs') OR {_holds('lower(symbol)', ('deduct', 'payment', 'transfer'))}", _s(A.MONEY_FEATURE))], _s(A.OTHER_FEATURE))


@query(f"SELECT id, {_ROLE} AS role, {_TYPE} AS type FROM <code>")
def roles_and_features(t):
    return t("code").select("id", A.role_of(F.col("path"), F.col("symbol")).alias("role"), A.feature_type(F.col("symbol"), F.col("body")).alias("type"))


@query(f"SELECT {_ROLE} AS role, {_TYPE} AS type, symbol, path, line_start AS line FROM (SELECT * FROM <code> WHERE contains(path, 'order') AND kind <> 'file' ORDER BY path, line_start, id LIMIT 100) WHERE NOT starts_with(symbol, '_')")
def feature_inventory(t):
    return A.feature_inventory(t("code"), "order")


_REL = _case([(_holds("h", w) + (f" AND {_holds('h', m)}" if m else ""), _s(c)) for c, _, w, m in A.RELATED], "NULL")


@query(f"""WITH x AS (SELECT id, symbol, path, lower(concat(path, ' ', symbol, ' ', body)) AS h FROM (SELECT * FROM <code> WHERE kind <> 'file' ORDER BY id LIMIT 200)), y AS (SELECT id, symbol, path, {_REL} AS category FROM x),
z AS (SELECT category, symbol, min(id) AS id, arg_min(path, id) AS path FROM y WHERE category IS NOT NULL GROUP BY 1, 2) SELECT id, category, CASE WHEN category IN ('CRON', 'NOTIFICATION') THEN 'MEDIUM' ELSE 'HIGH' END AS risk, symbol, path FROM z ORDER BY id LIMIT 10""")
def related_features(t):
    return A.related_features(t("code"))


_LINES = "l AS (SELECT id, path, cast(unnest(range(1, len(b) + 1)) AS int) AS line, unnest(b) AS text FROM (SELECT id, path, string_split(body, chr(10)) AS b FROM <code>))"


def _ui(where: str = "true") -> str:
    g = lambda p, k: f"regexp_extract(text, {_s(p)}, {k})"
    m = lambda p: _match("text", p)
    return f"""{_LINES}, h AS (SELECT *, CASE WHEN {m(flows.HANDLER)} THEN CASE WHEN {g(flows.HANDLER, 1)} <> '' THEN {g(flows.HANDLER, 1)} ELSE {g(flows.HANDLER, 2)} END END AS own FROM l WHERE {where}),
k AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY id ORDER BY line), 'render') AS handler FROM h),
u AS (SELECT id, line, handler, 'VALIDATION_BRANCH' AS type, left(trim({g(flows.GUARD, 1)}), 80) AS condition, 'Branch / Guard Condition' AS effect, 'Inline Error / Fallback View' AS target FROM k WHERE {m(flows.GUARD)}
  UNION ALL SELECT id, line, handler, 'TOAST_ALERT', 'Action trigger', 'SHOW_TOAST', concat('Toast: ', left(trim({g(flows.TOAST, 1)}), 50)) FROM k WHERE {m(flows.TOAST)}
  UNION ALL SELECT id, line, handler, 'MODAL_DIALOG', 'State toggle', 'OPEN_MODAL', 'Modal Dialog / Confirmation' FROM k WHERE {m(flows.MODAL)}
  UNION ALL SELECT id, line, handler, 'API_DISPATCH', 'Form Valid', 'DISPATCH_API_REQUEST', concat('Call API: ', CASE WHEN {g(flows.API_CALL, 1)} <> '' THEN {g(flows.API_CALL, 1)} WHEN {g(flows.API_CALL, 3)} <> '' THEN {g(flows.API_CALL, 3)} ELSE 'fetch' END) FROM k WHERE {m(flows.API_CALL)})"""


@query(f"WITH {_ui()} SELECT * FROM u")
def ui_branches(t):
    return flows.ui_branches(t("code"))


def _steps(rules, skipped: str, width: int, where: str = "true") -> str:
    kind = _case([(_match("code", p), _s(c)) for c, _, p in rules], "NULL")
    source = _case([(_match("code", p), _s(d) if d else "CASE WHEN contains(lower(code), 'bccs') THEN 'BCCS_DATASOURCE' ELSE 'EXTERNAL_API' END") for _, d, p in rules], "NULL")
    return f"""{_LINES}, v AS (SELECT id, line, trim(text) AS code FROM l WHERE {where}), c AS (SELECT id, line, {kind} AS category, {source} AS datasource, left(code, {width}) AS code FROM v WHERE code <> '' AND NOT regexp_matches(code, '{skipped}')),
st AS (SELECT id, cast(row_number() OVER (PARTITION BY id ORDER BY line) AS int) AS step, line, category, datasource, code FROM c WHERE category IS NOT NULL)"""


@query(f"WITH {_steps(flows.STEPS, '^(//|/\\*|\\*)', 120)} SELECT * FROM st")
def execution_steps(t):
    return flows.backend_steps(t("code"))


_EFFORT = _steps(flows.EFFORT_STEPS, "^(//|/\\*|\\*|#|import |package )", 90)


@query(f"WITH {_EFFORT} SELECT * FROM st")
def effort_steps(t):
    return flows.effort_steps(t("code"))


@query(f"WITH {_EFFORT} SELECT id, count(*) AS steps, CASE WHEN count(*) <= 4 THEN 'NVJ1' WHEN count(*) <= 8 THEN 'NVJ2' ELSE 'NVJ3' END AS rank FROM st GROUP BY id")
def effort_rank(t):
    return flows.effort_rank(flows.effort_steps(t("code")))


@query(f"WITH {_steps(flows.STEPS, '^(//|/\\*|\\*)', 120)} SELECT id, count(*) AS steps, string_agg(DISTINCT datasource, ',' ORDER BY datasource) AS datasources, count(*) FILTER (category IN ('VALIDATE', 'BUSINESS_CHECK')) AS checks FROM st GROUP BY id")
def backend_flow(t):
    return flows.backend_flow(t("code"))


@query(f"WITH {_ui()} SELECT id, count(*) AS branches, string_agg(DISTINCT handler, ',' ORDER BY handler) AS handlers, count(*) FILTER (type = 'API_DISPATCH') AS calls FROM u GROUP BY id")
def ui_tree(t):
    return flows.ui_tree(t("code"))


_UI_END, _SERVICE_END = "regexp_matches(path, '\\.(tsx|jsx|vue|html)$')", "regexp_matches(path, '\\.(java|php|py|ts|go|cs)$')"


@query(f"""WITH {_ui(_UI_END)}, {_steps(flows.STEPS, '^(//|/\\*|\\*)', 120, _SERVICE_END).split(', ', 0)[0].replace(_LINES + ', ', '')}
SELECT 'ui' AS side, id, line, type AS what, target FROM u UNION ALL SELECT 'service', id, line, category, datasource FROM st""")
def trace_fullstack(t):
    return flows.trace(t("code"))


@query(f"""WITH {_ui(_UI_END)}, {_steps(flows.STEPS, '^(//|/\\*|\\*)', 120, _SERVICE_END).replace(_LINES + ', ', '')}, w AS (SELECT 'ui' AS side, id, type AS what FROM u UNION ALL SELECT 'service', id, category FROM st)
SELECT side, what, count(*) AS n, count(DISTINCT id) AS nodes FROM w GROUP BY 1, 2""")
def trace_summary(t):
    return flows.trace_summary(flows.trace(t("code")))
