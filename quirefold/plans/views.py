"""Views that give the synthetic tables the shape of tickets, ledgers, records, spans, orders and uploads.

Each is one SQL text for Spark and for DuckDB; `{name}` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations")

VIEWS = {
    "f_tickets": """
SELECT l_orderkey % 64 AS batch_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey % 64 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS INT) AS row_no,
  'inv_' || CAST(l_partkey % 97 AS STRING) || '.xml' AS file_ref,
  CASE WHEN l_suppkey % 2 = 1 THEN lpad(CAST(l_suppkey AS STRING), 12, '0') WHEN l_suppkey % 10 = 0 THEN '12345' END AS code,
  CASE WHEN l_linenumber = 7 THEN NULL
       WHEN l_suppkey % 2 = 0 THEN '24' || CAST(11 + l_suppkey % 55 AS STRING) || lpad(CAST(l_orderkey % 3000 AS STRING), 16, '0')
       ELSE lpad(CAST(l_orderkey % 3000 AS STRING), 8, '0') END AS number,
  CASE WHEN l_linenumber = 6 THEN NULL
       ELSE CAST(CAST(l_orderkey % 3000 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DECIMAL(14,2)) AS STRING) END AS amount
FROM {lineitem}""",
    "f_ledger": """
SELECT o_orderkey AS ord,
  '24' || CAST(11 + (o_custkey % 100) % 55 AS STRING) || lpad(CAST(o_orderkey % 3000 AS STRING), 16, '0') AS number,
  CAST(NULL AS STRING) AS code,
  CAST(CAST(o_orderkey % 3000 AS DECIMAL(14,2)) AS STRING) AS amount,
  'old_' || CAST(o_orderkey AS STRING) || '.xml' AS first_name,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS first_day
FROM {orders} WHERE o_orderkey % 5 = 0""",
    "f_records": """
SELECT o_orderkey AS rec_id, o_orderkey % 50 AS batch_id,
  'f' || CAST(o_orderkey AS STRING) || '.pdf' AS source_file,
  CASE WHEN o_orderkey % 3 = 0 THEN '电子发票（增值税专用发票）' WHEN o_orderkey % 3 = 1 THEN '电子发票（普通发票）' END AS invoice_type,
  CASE WHEN o_orderkey % 11 = 0 THEN '123' ELSE lpad(CAST(o_orderkey % 4000 AS STRING), 20, '2') END AS invoice_number,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS issue_date,
  CASE WHEN o_orderkey % 17 = 0 THEN 'CON' WHEN o_orderkey % 19 = 0 THEN 'a/b:c..d' ELSE 'Customer ' || CAST(o_custkey AS STRING) END AS buyer_name,
  CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING) AS amount_without_tax,
  CAST(CAST(o_orderkey % 100 AS DECIMAL(14,2)) AS STRING) AS tax_amount,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL
       ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) + CAST(o_orderkey % 100 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(14,2)) AS STRING) END AS total_with_tax
FROM {orders}""",
    "f_survey": """
SELECT c_custkey AS arrival, md5(CAST(c_custkey % 900 AS STRING)) AS client_id, c_mktsegment AS source,
  (c_custkey * 37) % 10000 AS elapsed_ms, CASE WHEN c_custkey % 20 = 0 THEN 'spam' ELSE '' END AS website
FROM {customer}""",
    "f_spans": """
SELECT l_orderkey AS doc_id, 1 + l_linenumber % 3 AS page_no,
  CAST((l_partkey * 37) % 560 AS DOUBLE) AS x0, CAST((l_suppkey * 13) % 360 AS DOUBLE) AS y0,
  CAST((l_partkey * 37) % 560 AS DOUBLE) + 10 + l_quantity AS x1, CAST((l_suppkey * 13) % 360 AS DOUBLE) + 12 AS y1,
  CASE WHEN l_linenumber = 1 THEN lpad(CAST(l_orderkey AS STRING), 20, '2') ELSE CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) END AS text
FROM {lineitem}""",
    "f_pay_orders": """
SELECT 'SK' || lpad(CAST(o_orderkey AS STRING), 30, '0') AS out_trade_no,
  CASE WHEN o_orderstatus = 'O' THEN 'created' WHEN o_orderstatus = 'P' THEN 'verified' ELSE 'fulfilled' END AS status,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'merge' WHEN 1 THEN 'extract' WHEN 2 THEN 'rename' ELSE 'dedup' END AS op,
  CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING) AS amount, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS fulfilled_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN '{{"ok":1}}' END AS result_cache
FROM {orders}""",
    "f_uploads": """
SELECT l_orderkey AS task_id, l_linenumber - 1 AS idx, 4 AS total, CAST(l_quantity AS BIGINT) * 1048576 AS size, l_shipdate AS ts
FROM {lineitem}""",
    "f_invoice_xml": """
SELECT 'x' || CAST(rec_id AS STRING) || '.xml' AS path, CASE rec_id % 10
  WHEN 7 THEN '<!DOCTYPE a [<!ENTITY b "c">]>' || x WHEN 8 THEN replace(x, '</Header>', '') WHEN 9 THEN replace(x, 'EInvoice>', 'Other>') ELSE x END AS x
FROM (SELECT o_orderkey AS rec_id, '<?xml version="1.0"?><EInvoice><Header><EIid>9' || CAST(o_orderkey AS STRING) || '</EIid></Header><Data><InvoiceNumber>'
  || CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE lpad(CAST(o_orderkey AS STRING), 20, '2') END || '</InvoiceNumber><IssueTime>' || substr(CAST(o_orderdate AS STRING), 1, 10)
  || '</IssueTime><BuyerName> Customer ' || CAST(o_custkey AS STRING) || ' </BuyerName><TotalTaxAm>¥' || CAST(o_orderkey % 100 AS STRING) || '.5</TotalTaxAm>'
  || repeat('<IssuItemInformation/>', CAST(o_orderkey % 4 AS INT)) || '</Data></EInvoice>' AS x FROM {orders})""",
    "f_log_lines": """
SELECT substr(CAST(ts AS STRING), 1, 19) || ',' || lpad(CAST(event_id % 1000 AS STRING), 3, '0') || ' - app - ERROR - ' || CASE event_id % 3
  WHEN 0 THEN 'task 0a1b2c3d-0000-4000-8000-' || lpad(CAST(event_id AS STRING), 12, '0') || CASE WHEN event_id % 2 = 0 THEN ' rejected/failed: ' ELSE ' failed: ' END || event_type
  WHEN 1 THEN 'Request failed request_id=ab' || CAST(event_id AS STRING) || ' method=POST path=/x/' || CAST(user_id % 7 AS STRING) || ' status=' || CAST(500 + user_id % 3 AS STRING)
  ELSE 'all is well' END AS value
FROM {events}""",
    "f_zip_entries": """
SELECT l_orderkey AS archive_id,
  CASE WHEN l_linenumber = 7 AND l_suppkey % 9 = 0 THEN '../evil.xml' ELSE 'Doc_0/Pages/Page_' || CAST(l_linenumber AS STRING) || '/Content.xml' END AS entry,
  CAST(l_quantity AS BIGINT) * 4096 AS file_size,
  CASE WHEN l_partkey % 50 = 0 THEN CAST(8 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * 512 END AS compress_size,
  CASE WHEN l_suppkey % 40 = 0 THEN 1 ELSE 0 END AS flag_bits
FROM {lineitem}""",
}

_SPARK = VIEWS | {"f_doc_pages": "SELECT doc_id, pos + 1 AS page_no, col AS text FROM (SELECT doc_id, posexplode(split(text, '\\\\n')) FROM {documents})"}
_DUCK = VIEWS | {"f_doc_pages": "SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_no, unnest(string_split(text, chr(10))) AS text FROM {documents}"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _SPARK[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def duck(body: str, *views: str) -> str:
    """The SQL of `body`, with the views that it reads."""
    plain = {t: t for t in TABLES}
    found = [f"{v} AS ({_DUCK[v].format(**plain)})" for v in views]
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {', '.join(found)}{', ' if found else ''}{body[5:]}"
    return f"WITH {', '.join(found)} {body}" if found else body
