"""The graph, ledger and corpus that the driver's tables play, as DataFrames and as shared SQL text.

One SQL text serves Spark and the SQL oracle; it uses no function of one dialect alone. FOR_SPARK has other texts for the same rows
where the shared one would make large shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomgraph.shared import kept

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NATION_PATH = "SELECT n_nationkey, n_name, lower(concat('src/', r_name, '/', n_name)) AS path FROM nation JOIN region ON r_regionkey = n_regionkey"

NODES = f"""
SELECT concat('file:', cast(n_nationkey AS string)) AS id, path, 'file' AS kind, n_name AS symbol, 1 AS line_start, 1000000 AS line_end FROM ({NATION_PATH}) np
UNION ALL SELECT concat('sup:', cast(s_suppkey AS string)), path, 'class', s_name, cast(1 + 10 * s_suppkey AS int), cast(10 + 10 * s_suppkey AS int)
  FROM supplier JOIN ({NATION_PATH}) np ON s_nationkey = n_nationkey
UNION ALL SELECT concat('cust:', cast(c_custkey AS string)), path, 'class', c_name, cast(1 + 10 * c_custkey AS int), cast(10 + 10 * c_custkey AS int)
  FROM customer JOIN ({NATION_PATH}) np ON c_nationkey = n_nationkey
UNION ALL SELECT concat('part:', cast(p_partkey AS string)), concat('lib/', p_brand), 'function', p_name, cast(1 + 10 * p_partkey AS int), cast(10 + 10 * p_partkey AS int) FROM part
UNION ALL SELECT concat('ord:', cast(o_orderkey AS string)), path, 'method', concat('Order#', cast(o_orderkey AS string)), cast(1 + 10 * (o_orderkey % 1000) AS int), cast(10 + 10 * (o_orderkey % 1000) AS int)
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN ({NATION_PATH}) np ON c_nationkey = n_nationkey
"""

EDGES = f"""
SELECT src, dst, relation, min(line) AS line FROM (
  SELECT concat('ord:', cast(l_orderkey AS string)) AS src, concat('part:', cast(l_partkey AS string)) AS dst, 'calls' AS relation, l_linenumber AS line FROM lineitem
  UNION ALL SELECT concat('part:', cast(l_partkey AS string)), concat('sup:', cast(l_suppkey AS string)), 'uses', l_linenumber FROM lineitem
  UNION ALL SELECT concat('ord:', cast(o_orderkey AS string)), concat('cust:', cast(o_custkey AS string)), 'extends', 1 FROM orders
  UNION ALL SELECT concat('file:', cast(c_nationkey AS string)), concat('cust:', cast(c_custkey AS string)), 'defines', 1 FROM customer
  UNION ALL SELECT concat('file:', cast(s_nationkey AS string)), concat('sup:', cast(s_suppkey AS string)), 'defines', 1 FROM supplier
  UNION ALL SELECT concat('cust:', cast(c_custkey AS string)), concat('file:', cast(c_nationkey AS string)), 'imports', 1 FROM customer
) e GROUP BY src, dst, relation
"""

#: The same rows for Spark: no pair of ends comes from two of these parts, so each is grouped by its numbers and named after that.
#: The shuffle then carries no names.
EDGES_BY_NUMBER = """
SELECT concat('ord:', cast(l_orderkey AS string)) AS src, concat('part:', cast(l_partkey AS string)) AS dst, 'calls' AS relation, line
  FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS line FROM lineitem GROUP BY l_orderkey, l_partkey) c
UNION ALL SELECT concat('part:', cast(l_partkey AS string)), concat('sup:', cast(l_suppkey AS string)), 'uses', line
  FROM (SELECT l_partkey, l_suppkey, min(l_linenumber) AS line FROM lineitem GROUP BY l_partkey, l_suppkey) u
UNION ALL SELECT concat('ord:', cast(o_orderkey AS string)), concat('cust:', cast(o_custkey AS string)), 'extends', 1 FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) x
UNION ALL SELECT DISTINCT src, dst, 'defines', 1 FROM (
  SELECT concat('file:', cast(c_nationkey AS string)) AS src, concat('cust:', cast(c_custkey AS string)) AS dst FROM customer
  UNION ALL SELECT concat('file:', cast(s_nationkey AS string)), concat('sup:', cast(s_suppkey AS string)) FROM supplier) d
UNION ALL SELECT concat('cust:', cast(c_custkey AS string)), concat('file:', cast(c_nationkey AS string)), 'imports', 1 FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer) i
"""

#: Directed part-to-part steps of one order; holds cycles of any length.
STEPS = """
SELECT DISTINCT concat('part:', cast(a.l_partkey AS string)) AS src, concat('part:', cast(b.l_partkey AS string)) AS dst, 'calls' AS relation
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey
"""

HUNKS = f"""
SELECT event_id, path, cast(1 + event_id * 7 % 15000 AS int) AS line_start, cast(1 + event_id * 7 % 15000 + event_id % 10 AS int) AS line_end
FROM events JOIN (SELECT n_nationkey, path FROM ({NATION_PATH}) p) np ON user_id % 25 = n_nationkey
"""

JOURNAL = f"""
SELECT path, concat('d', cast(n_nationkey AS string)) AS digest, 100 + n_nationkey AS size, 1 + n_nationkey % 3 AS generation,
  CASE n_nationkey % 5 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'VALID_EMPTY' WHEN 2 THEN 'PARTIAL_AST' WHEN 3 THEN 'PARSE_ERROR' END AS parser_outcome
FROM ({NATION_PATH}) np
"""

DISK = f"""
SELECT path, CASE WHEN n_nationkey % 6 = 0 THEN 'altered' ELSE concat('d', cast(n_nationkey AS string)) END AS digest,
  CASE WHEN n_nationkey % 4 = 1 THEN 1 ELSE 100 + n_nationkey END AS size FROM ({NATION_PATH}) np WHERE n_nationkey % 7 <> 0
UNION ALL SELECT 'src/new/a.py', 'da', 1 UNION ALL SELECT 'src/vendor/b.py', 'db', 2
"""

RUNS = """
SELECT concat(event_type, ':', cast(cast(ts AS date) AS string)) AS run_id, event_type AS provider, max(event_id) AS created_at,
  CASE WHEN count(*) % 2 = 0 THEN 'ok' ELSE 'failed' END AS status FROM events GROUP BY event_type, cast(ts AS date)
"""

EVIDENCE = """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(l_linenumber AS string)) AS evidence_id,
  event_type AS provider, concat(event_type, ':', cast(cast(ts AS date) AS string)) AS run_id,
  concat('ord:', cast(l_orderkey AS string)) AS src, concat('part:', cast(l_partkey AS string)) AS dst,
  CASE WHEN l_partkey % 20 = 0 THEN 'uses' ELSE 'calls' END AS relation,
  CASE WHEN l_suppkey % 20 = 0 THEN l_linenumber + 3 ELSE l_linenumber END AS span_line,
  CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE 'snap' END AS snapshot
FROM lineitem JOIN events ON l_orderkey = event_id
"""

#: Documents as nodes of a text index.
CORPUS = """
SELECT concat('doc:', cast(doc_id AS string)) AS id, doc_id, concat('docs/', coalesce(lang, ''), '/', coalesce(source, '')) AS path, CASE WHEN doc_id % 5 = 0 THEN 'file' ELSE 'function' END AS kind, coalesce(source, '') AS symbol,
  concat(coalesce(lang, ''), '.', coalesce(source, ''), '.d', cast(doc_id AS string)) AS fqn, concat(coalesce(source, ''), ' ', coalesce(lang, '')) AS label, coalesce(text, '') AS body, coalesce(lang, '') AS keywords, 1 AS line_start,
  doc_id * 7 % 1000 AS updated_at FROM documents
"""

#: Evidence on the documents, some of it dead.
DOC_EVIDENCE = f"""
SELECT event_id, path, label AS symbol, CASE WHEN event_id % 3 = 0 THEN event_id END AS invalidated_at, event_type AS provider FROM events JOIN ({CORPUS}) c ON doc_id = user_id
"""

#: Nodes with qualified names; methods of five classes; a note for each nation.
RICH = f"""
SELECT id, path, kind, symbol, concat(replace(path, '/', '.'), CASE WHEN kind = 'file' THEN '' ELSE concat('.', symbol) END) AS fqn, concat(kind, ' ', symbol) AS label, concat(kind, ' ', symbol, ' of ', path) AS body, line_start, line_end, line_start AS updated_at
FROM ({NODES}) n WHERE kind <> 'method'
UNION ALL SELECT concat('meth:', cast(s_suppkey AS string)), path, 'method', concat('Base', cast(s_suppkey % 5 AS string), '.m', cast(s_suppkey % 7 AS string)), concat(replace(path, '/', '.'), '.Base', cast(s_suppkey % 5 AS string), '.m', cast(s_suppkey % 7 AS string)),
  concat('Base', cast(s_suppkey % 5 AS string), '.m', cast(s_suppkey % 7 AS string)), 'a method', cast(1 + s_suppkey AS int), cast(9 + s_suppkey AS int), 5 FROM supplier JOIN ({NATION_PATH}) np ON s_nationkey = n_nationkey WHERE s_suppkey % 5 > 1 OR s_suppkey % 7 = 0
UNION ALL SELECT concat('note:', cast(n_nationkey AS string)), '', 'note', concat('note ', n_name), n_name, concat('about ', n_name), concat('remember ', n_name), cast(NULL AS int), cast(NULL AS int), n_nationkey * 3 % 11 FROM nation
"""

#: What files bring in, and which class extends which (a chain of five).
RICH_EDGES = f"""
SELECT path, concat('file:', cast(n_nationkey AS string)) AS src, concat('part:', cast(s_suppkey AS string)) AS dst, 'imports' AS relation, 1 AS line FROM supplier JOIN ({NATION_PATH}) np ON s_nationkey = n_nationkey
UNION ALL SELECT 'src/base.py', concat('sym:x:Base', cast(r_regionkey AS string)), concat('sym:x:Base', cast(r_regionkey + 1 AS string)), 'extends', 2 FROM region WHERE r_regionkey < 4
"""

#: References that the files of an order's customer make, one for each line.
REFS = f"""
SELECT path, concat('ord:', cast(o_orderkey AS string)) AS src,
  CASE WHEN l_suppkey % 4 = 0 THEN concat('m', cast(l_partkey % 8 AS string)) WHEN l_partkey % 50 = 7 THEN 'unknown symbol' WHEN l_partkey % 9 = 0 THEN p_name ELSE concat('lib.', p_brand, '.', p_name) END AS dst_symbol,
  CASE WHEN l_linenumber = 7 THEN 'imports' ELSE 'calls' END AS relation, l_linenumber AS line,
  CASE l_linenumber WHEN 1 THEN concat('lib.', p_brand) WHEN 3 THEN 'ext.pkg' WHEN 4 THEN concat('.nation_', cast(l_partkey % 25 AS string)) WHEN 5 THEN 'src.asia' WHEN 6 THEN concat('nation_', cast(l_suppkey % 25 AS string)) WHEN 7 THEN concat('nation_', cast(l_suppkey % 25 AS string)) END AS import_source,
  CASE WHEN l_suppkey % 4 = 0 THEN concat('sym:x:Base', cast(l_suppkey % 5 AS string)) END AS receiver
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN ({NATION_PATH}) np ON c_nationkey = n_nationkey
"""

#: Code: ten files, thirteen names and eleven lines, dealt over the events.
_CODE_PATHS = (
    "app/lib/features/client_crm/presentation/home_page.dart", "server/src/services/billing/invoice_service.java", "lib/core/network/api_client.dart", "web/src/pages/checkout/CartView.tsx", "api/controllers/order_controller.py",
    "app/lib/features/auth/domain/user_entity.dart", "server/src/repository/order_repository.java", "tests/unit/test_orders.py", "web/src/components/PayDialog.tsx", "misc/notes.txt",
)
_CODE_LABELS = (
    "class HomePage", "def list_orders(request)", "class OrderController", "function createInvoice(x)", "class PaymentEvent", "async def _private_get()", "class UserEntity", "OrderRepository", "def approve_order(id)", "class LoginScreen extends Widget",
    "function exportCsv(rows)", "class WebhookCallback", "helper",
)
_CODE_LINES = (
    "if (balance < limit) { throw new LimitException(); }", "const handleSubmit = async (e) => {", "  repository.save(order);", "  toast.error(\"Payment failed\");", "// a comment", "  setOpen(true); api.sendOrder(order);", "  return order;",
    "  repo.findById(id); logger.info(\"x\");", "  restTemplate.getForObject(url); // bccs", "@Scheduled cron for user data sync", "if (name == null || name.isEmpty()) validate(name);",
)


def _pick(column: str, values: tuple[str, ...]) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


CODE = f"""
SELECT concat('code:', cast(event_id AS string)) AS id, event_id, {_pick("event_id", _CODE_PATHS)} AS path, CASE event_id % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'file' END AS kind,
  {_pick("event_id", ("listOrders", "approveOrder", "_hidden", "exportCsv", "AdminController", "uploadFile", "payment", "doIt", "WebhookHandler"))} AS symbol, {_pick("event_id", _CODE_LABELS)} AS label,
  concat_ws(chr(10), {_pick("event_id", _CODE_LINES)}, {_pick("event_id * 3 + 1", _CODE_LINES)}, {_pick("user_id", _CODE_LINES)}, {_pick("event_id * 5 + user_id", _CODE_LINES)}) AS body, cast(1 + event_id % 90 AS int) AS line_start FROM events
"""

CODE_EDGES = "SELECT DISTINCT concat('code:', cast(event_id AS string)) AS src, concat('code:', cast(user_id AS string)) AS dst, 'calls' AS relation FROM events WHERE event_id <> user_id"

LEDGER_RUNS = f"""
SELECT run_id, provider, created_at, status, CASE WHEN created_at % 2 = 0 THEN '1.0' ELSE '1.1' END AS version, CASE WHEN created_at % 3 = 0 THEN 'SYMBOLS' ELSE 'CALLS' END AS capability, CASE WHEN created_at % 5 = 0 THEN '/b' ELSE '/a' END AS project,
  concat('snap', cast(created_at % 17 AS string)) AS snapshot_id FROM ({RUNS}) r
"""

SNAPSHOTS = "SELECT concat('snap', cast(user_id AS string)) AS snapshot_id, concat('/r', cast(user_id % 4 AS string)) AS root, max(event_id) AS captured_at FROM events GROUP BY user_id"

LEDGER = f"""
SELECT evidence_id, provider, run_id, CASE WHEN span_line % 2 = 1 THEN src END AS symbol, src, dst, CASE WHEN span_line % 3 = 1 THEN dst END AS target, relation, CASE WHEN span_line = 6 THEN NULL ELSE concat('src/f', cast(length(evidence_id) * 7 % 5 AS string), cast(span_line AS string), '.py') END AS path,
  CASE WHEN span_line = 5 THEN concat('src\\\\f1', cast(span_line AS string), '.py') END AS file_path, CASE WHEN span_line <> 4 THEN span_line END AS line_start, CASE WHEN span_line <> 4 THEN span_line + 3 END AS line_end, snapshot,
  CASE WHEN span_line = 2 THEN 77 END AS invalidated_at, CASE WHEN span_line = 2 THEN 'old' END AS invalidation_reason, length(evidence_id) * 100 + span_line AS created_at FROM ({EVIDENCE}) e
"""

_FILE = """concat(CASE o_custkey % 9 WHEN 0 THEN 'vendor/x' WHEN 1 THEN 'src/build' ELSE concat('src/p', cast(o_custkey % 40 AS string)) END, '/f', cast(o_orderkey AS string),
  CASE o_orderkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.min.js' WHEN 3 THEN '.tsx' WHEN 4 THEN '.md' ELSE '.bin' END)"""

#: A journal with a file an order, and what is on disk: files altered, touched, vanished and new.
FILES = f"""
SELECT {_FILE} AS path, concat('h', cast(o_orderkey AS string)) AS digest, 10 + o_orderkey % 1000 AS size, o_orderkey * 3 AS mtime_ms, 1 + o_orderkey % 7 AS generation,
  CASE o_orderkey % 11 WHEN 0 THEN 'PARTIAL_AST' WHEN 1 THEN 'PARSE_ERROR' WHEN 2 THEN 'VALID_EMPTY' WHEN 3 THEN 'PARSER_UNAVAILABLE' WHEN 4 THEN NULL ELSE 'COMPLETE' END AS parser_outcome FROM orders WHERE o_orderkey % 13 <> 0
"""

FILES_ON_DISK = f"""
SELECT {_FILE} AS path, CASE WHEN o_orderkey % 10 = 0 THEN 'other' ELSE concat('h', cast(o_orderkey AS string)) END AS digest, 10 + o_orderkey % 1000 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS size, o_orderkey * 3 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS mtime_ms,
  CASE o_orderkey % 4 WHEN 0 THEN 'x = getattr(a, b)' WHEN 1 THEN 'return reflect.TypeOf(v)' WHEN 2 THEN 'import(path)' ELSE 'plain text' END AS content FROM orders WHERE o_orderkey % 17 <> 0
"""

#: A graph over the journaled files: a node a file, notes, edges and references between files.
FILE_NODES = f"""
SELECT concat('f:', cast(o_orderkey AS string)) AS id, {_FILE} AS path, 'file' AS kind, concat('mod', cast(o_orderkey AS string)) AS symbol, concat('pkg.mod', cast(o_orderkey AS string)) AS fqn FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL SELECT concat('note:', cast(n_nationkey AS string)), '', 'note', n_name, n_name FROM nation
"""

FILE_EDGES = f"""
SELECT {_FILE} AS path, concat('f:', cast(l_orderkey AS string)) AS src, concat('f:', cast(l_partkey AS string)) AS dst, 'imports' AS relation, min(l_linenumber) AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 13 <> 0 GROUP BY 1, 2, 3
"""

FILE_PENDING = f"""
SELECT DISTINCT {_FILE} AS path, concat('f:', cast(l_orderkey AS string)) AS src, concat('mod', cast(l_suppkey AS string)) AS dst_symbol, 'calls' AS relation, 2 AS line, cast(NULL AS string) AS import_source, cast(NULL AS string) AS receiver, 'UNRESOLVED' AS resolution_state
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 2
"""

#: A log of three parts with a commit an order: a header, then a line a changed file.
_CHANGED = """CASE l_partkey % 12 WHEN 0 THEN 'src/auth/login.py' WHEN 1 THEN 'package.json' WHEN 2 THEN concat('db/migration/v', cast(l_suppkey AS string), '.sql') ELSE concat('./src/f', cast(l_partkey AS string), '.py') END"""
LOG = f"""
SELECT concat('log', cast(o_orderkey % 3 AS string)) AS log, o_orderkey * 100 AS line_no, concat_ws(chr(31), concat('h', cast(o_orderkey AS string)), 'short', concat('author', cast(o_custkey % 7 AS string)), cast(cast(o_orderdate AS date) AS string), o_orderpriority) AS line FROM orders
UNION ALL SELECT concat('log', cast(l_orderkey % 3 AS string)), l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice),
  concat_ws(chr(9), CASE WHEN l_suppkey % 10 = 0 THEN '-' ELSE cast(cast(l_quantity * 2 AS int) AS string) END, cast(cast(l_quantity AS int) AS string), {_CHANGED}) FROM lineitem
"""

#: Diffs of a few files each, four lines a hunk.
DIFFS = """
SELECT user_id AS diff, event_id * 4 + k AS line_no, CASE k WHEN 0 THEN concat('--- a/src/f', cast(event_id % 50 AS string), '.py') WHEN 1 THEN CASE WHEN event_id % 9 = 0 THEN '+++ /dev/null' ELSE concat('+++ b/src/f', cast(event_id % 50 AS string), '.py') END
  WHEN 2 THEN concat('@@ -', cast(1 + event_id % 70 AS string), ',4 +', cast(3 + event_id % 70 AS string), ',', cast(CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 5 END AS string), ' @@ def f') ELSE '-gone' END AS line
FROM events CROSS JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 4) q
"""

TEXTS = {
    "nodes": NODES, "edges": EDGES, "steps": STEPS, "hunks": HUNKS, "journal": JOURNAL, "disk": DISK, "runs": RUNS, "evidence": EVIDENCE,
    "corpus": CORPUS, "doc_evidence": DOC_EVIDENCE, "rich": RICH, "rich_edges": RICH_EDGES, "refs": REFS, "code": CODE, "log": LOG, "diffs": DIFFS, "files": FILES, "file_nodes": FILE_NODES, "file_edges": FILE_EDGES, "file_pending": FILE_PENDING, "files_on_disk": FILES_ON_DISK, "ledger": LEDGER, "ledger_runs": LEDGER_RUNS, "snapshots": SNAPSHOTS, "code_edges": CODE_EDGES,
}
#: Texts that Spark runs instead of those, for the same rows. The nations are a row each, so rows are not dealt out by nation to meet them.
FOR_SPARK = {"edges": EDGES_BY_NUMBER} | {n: re.sub(r"SELECT (?=concat\('(sup|cust|ord):'|event_id, path)", "SELECT /*+ BROADCAST(np) */ ", TEXTS[n]) for n in ("nodes", "hunks")}
#: Tables that a store would hold; derived from others once.
STORED = {"nodes", "edges", "steps", "hunks", "evidence", "rich", "refs", "ledger", "ledger_runs", "files", "files_on_disk", "file_nodes", "file_edges", "file_pending"}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; its base tables are views only while its plan is made. Stored ones are read from their files."""
    text = FOR_SPARK.get(name, TEXTS[name])

    def derived() -> DataFrame:
        for t in TABLES:
            if t in text:
                base(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    return kept(spark, f"{name} {sf_dir}", derived) if name in STORED else derived()


def oracle(sql: str) -> str:
    """A query over derived tables as SQL over base tables."""
    used = [n for n in TEXTS if f"<{n}>" in sql]
    head = ", ".join(f"fx_{n} AS ({TEXTS[n]})" for n in used).replace("\\\\", "\\")  # one backslash there is one there
    for n in used:
        sql = sql.replace(f"<{n}>", f"fx_{n}")
    sql = sql.strip()
    if not used:
        return sql
    return f"WITH RECURSIVE {head}, {sql[5:].removeprefix('RECURSIVE ')}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
