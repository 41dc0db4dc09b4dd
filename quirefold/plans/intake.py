"""Queries of scans, sinks and streams. What they write goes below the folder that executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forms
from ..operators import redact as R
from ..sources import files as S
from ..sources.shared import shared_folder
from ..streaming import stateful as SF
from ..streaming import streams as ST
from ..streaming.batches import batch_table
from .business import ORACLES as _BUSINESS
from .business import order_events
from .pages import _LEAVES, _leaves
from .redaction import ORACLES as _REDACTION
from .views import duck, table, view

#: Extensions and first bytes (hexadecimal) that the files of file_admission are put together from.
EXTENSIONS = (".pdf", ".ofd", ".xml", ".docx", ".doc", ".png", ".jpg", ".webp", ".exe")
HEADS = ("255044462D312E37", "504B0304", "504B0506", "EFBBBF203C3F786D6C", "D0CF11E0A1B11AE1", "89504E470D0A1A0A", "FFD8FFE0", "52494646000000005745425056", "524946460000000057415645", "4D5A")


def file_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d/f.x"), k.cast("string"), pick(EXTENSIONS, k % 9)).alias("path"),
        (k % 50 * 1000).alias("length"),
        F.unhex(pick(HEADS, F.floor(k / 9) % 10)).alias("content"),
    )
    rows = S.admitted(files, EXTENSIONS[:-1], 45_000)
    return rows.select("path", "length", "ext", "kind", "reason", F.hex("content").alias("content"))


#: The same for file_heads, kinds that only the first bytes tell among them.
HEAD_EXTENSIONS = (*EXTENSIONS, ".caj")
MORE_HEADS = (*HEADS, "C8616263", "4B444820", "484E2E2E", "43414A20")


def file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier is written, some of them large, and the folder scanned by heads; contents by their length."""
    k = F.col("s_suppkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    body = F.concat(F.unhex(pick(MORE_HEADS, k % 14)), F.encode(F.repeat(F.lit("x"), (k % 40 * 5000).cast("int")), "utf-8"))
    files = table(spark, sf_dir, "supplier").select(F.concat((k % 7).cast("string"), F.lit("/f"), k.cast("string"), pick(HEAD_EXTENSIONS, F.floor(k / 3) % 10)).alias("path"), body.alias("content"))
    folder = shared_folder(spark, "files")
    S.write_files(files, folder)
    rows = S.with_contents(S.scan_heads(spark, folder, tuple(e for e in HEAD_EXTENSIONS if e != ".exe"), 150_000), folder)
    return rows.select(F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("path"), "length", "ext", "kind", "reason", F.md5("content").alias("content_md5"))


def invoice_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "f_invoice_xml").select("path", F.col("x").cast("binary").alias("content"))
    return S.scan_invoice_xml(files).select("source_file", "invoice_number", "issue_date", "buyer_name", "tax_amount", "item_count", "reason")


def log_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines are written as text files and scanned."""
    path = shared_folder(spark, "logs")
    view(spark, sf_dir, "f_log_lines").write.text(path)
    rows = S.in_order(S.scan_logs(spark, [path]), "time", "task_id", "request_id")
    return rows.withColumn("time", F.unix_micros("time"))


def ledger_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as the fourteen columns, and read again."""
    path = shared_folder(spark, "ledger")
    r = view(spark, sf_dir, "f_records")
    odd = F.when(F.col("rec_id") % 5 == 0, F.concat(F.lit("=HYPERLINK(\""), "buyer_name", F.lit('")'))).otherwise(F.col("buyer_name"))
    r = r.withColumn("buyer_name", odd).withColumn("warnings", F.when(F.col("rec_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))))
    S.write_ledger_csv(r, path)
    back = spark.read.option("header", True).csv(path).toDF(*S.HEADERS)
    return back.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("source_file", "invoice_number", "issue_date", "buyer_name", "total_with_tax", "drawer", "warnings")))


def survey_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "survey")
    s = view(spark, sf_dir, "f_survey").select(F.col("arrival").alias("submitted_at"), "client_id", F.concat(F.lit('["'), "source", F.lit('","x"]')).alias("features"))
    S.write_survey_csv(s, path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("submitted_at").cast("bigint").alias("submitted_at"), "client_id", "features")


def daily_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all days, of which some are written a second time with other values."""
    path = shared_folder(spark, "daily")
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    S.write_daily(days, path)
    S.write_daily(days.where("n % 2 = 0").withColumn("n", -F.col("n")), path)
    return spark.read.schema("n bigint, day string").json(path).select("day", "n")


def on_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    last = lambda n: F.element_at(F.split("path", "/"), n)
    key = F.concat(F.lit("root/"), last(-2), F.lit("/"), last(-1), F.lit("/Yes"))
    asked = leaves.select("doc_id", key.alias("key")).unionByName(leaves.select("doc_id", F.concat(F.lit("x/"), last(-1)).alias("key"))).distinct()
    values = asked.withColumn("value", F.when(F.length("key") % 3 == 0, F.lit("0")).otherwise(F.lit("1")))
    return forms.translate_on_values(values, leaves.select("doc_id", "path", F.concat("path", F.lit("#")).alias("on_value")))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files. The pattern stands for a folder of files as well as for one file."""
    return ST.tail(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema, 1000)


def _survey_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stream(spark, sf_dir, "customer")
    return c.select(
        F.timestamp_seconds("c_custkey").alias("ts"), F.md5((F.col("c_custkey") % 900).cast("string").cast("binary")).alias("client_id"),
        (F.col("c_custkey") * 37 % 10000).alias("elapsed_ms"), F.when(F.col("c_custkey") % 20 == 0, F.lit("spam")).otherwise(F.lit("")).alias("website"),
    )


def stream_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ST.unique_clients(_survey_stream(spark, sf_dir), "36500 days")
    return ST.to_table(rows, shared_folder(spark, "stream")).select("client_id")


def stream_survey_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first response of each client for ever, by batches that look up what is there."""
    path = shared_folder(spark, "stream")
    ST.run_batches(_survey_stream(spark, sf_dir), ST.survey_batches(f"{path}/table"), path)
    return batch_table(spark, f"{path}/table").select("client_id", F.unix_seconds("ts").alias("arrival"))


def stream_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events")
    tasks = e.where("event_type = 'error'").select(F.col("event_id").alias("task_id"), "user_id", F.col("ts").cast("timestamp").alias("last_seen"))
    other = _stream(spark, sf_dir, "events")
    requests = other.where("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").cast("timestamp").alias("time"))
    rows = ST.correlated(tasks, requests, 12 * 3600, "36500 days")
    return ST.to_table(rows, shared_folder(spark, "stream")).select("user_id", "task_id", "request_id")


def stream_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have ended by the last upload, less the delay."""
    u = _stream(spark, sf_dir, "lineitem")
    parts = u.select(F.col("l_orderkey").alias("task_id"), (F.col("l_linenumber") - 1).alias("idx"), F.lit(4).alias("total"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    rows = ST.to_table(ST.upload_sessions(parts, "1 hour", "30 days"), shared_folder(spark, "stream"))
    return rows.select("task_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n_parts", "complete")


def _replayed(spark: SparkSession, rows: DataFrame, time: str, run) -> DataFrame:
    """run(stream) over rows that come in order of time, in several batches."""
    folder = shared_folder(spark, "stream")
    with SF.state_store(spark):
        return ST.to_table(run(ST.arrivals(rows, time, f"{folder}/in")), folder)


def stream_upload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's outcome as it comes, and sessions given up by the last upload, less the delay."""
    li = table(spark, sf_dir, "lineitem")
    parts = li.select(F.col("l_orderkey").alias("task_id"), ((F.col("l_linenumber") - 1) % 5).cast("int").alias("idx"), (2 + F.col("l_orderkey") % 3).cast("int").alias("total"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    rows = _replayed(spark, parts, "ts", lambda s: SF.upload_sessions(s, "90 minutes", "20 days"))
    return rows.select("task_id", F.col("idx").cast("bigint").alias("idx"), "at", "outcome", F.col("n_got").cast("bigint").alias("n_got"))


def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What falls due by the last event, less the delay."""
    o = table(spark, sf_dir, "orders")
    created, hours = F.col("o_orderdate").cast("timestamp"), (F.col("o_custkey") % 72).cast("int")
    later = lambda n: created + F.make_dt_interval(hours=n)
    base = o.select(F.concat(F.lit("SK"), F.lpad(F.col("o_orderkey").cast("string"), 30, "0")).alias("out_trade_no"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 2 == 0).alias("b"), created.alias("t0"), later(hours).alias("t1"), later(hours + 1).alias("t2"))
    pick = lambda kind, blob, time, only: base.where(F.col("s").isin(*only)).select("out_trade_no", F.lit(kind).alias("kind"), blob.alias("has_blob"), F.col(time).alias("ts"))
    events = pick("created", F.lit(False), "t0", "OPF").unionByName(pick("claimed", F.lit(False), "t1", "PF")).unionByName(pick("fulfilled", F.col("b"), "t2", "F"))
    return _replayed(spark, events, "ts", lambda s: SF.retention_timers(s, "90 minutes"))


def stream_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that can get no later request by the last event, less the delay."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).where("event_type IN ('error', 'purchase')")

    def run(s: DataFrame) -> DataFrame:
        tasks = s.where("event_type = 'error'").select("user_id", F.col("event_id").alias("task_id"), F.col("ts").alias("last_seen"))
        requests = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("request_id"), F.col("ts").alias("time"))
        return SF.as_of(tasks, requests, 12 * 3600, "1 hour")

    rows = _replayed(spark, e, "ts", run)
    return rows.select("user_id", F.col("task_id").cast("bigint").alias("task_id"), F.col("request_id").cast("bigint").alias("request_id"), "request_time")


def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of order_replay as they come."""
    folder = shared_folder(spark, "stream")
    order_events(spark, sf_dir).withColumn("at", F.timestamp_seconds("seq")).write.parquet(f"{folder}/all")
    rows = spark.read.parquet(f"{folder}/all")
    return _replayed(spark, rows, "at", lambda s: SF.order_lifecycle(s.drop("at")))


def _tickets(lines: DataFrame, base: Column | int = 0) -> DataFrame:
    return lines.select(
        F.concat(F.lit("inv_"), (F.col("l_partkey") % 97).cast("string")).alias("file_ref"), F.lit(None).cast("string").alias("code"),
        F.when(F.col("l_linenumber") != 7, F.lpad((F.col("l_orderkey") % 3000).cast("string"), 8, "0")).alias("number"),
        F.lit("1.00").alias("amount"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + base).alias("row_no"),
    )


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "stream")
    ST.run_batches(_tickets(_stream(spark, sf_dir, "lineitem")), ST.ledger_batches(f"{path}/table"), path)
    return batch_table(spark, f"{path}/table").select("key", "row_no")


def stream_ledger_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after seven batches of equal time, whose folders are merged by twos and fours on the way. Rows are
    numbered by day, so the first of a key is the same however they are dealt to batches."""
    path = shared_folder(spark, "stream")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("timestamp").alias("at"))
    tickets = _tickets(ST.arrivals(lines, "at", f"{path}/in", parts=7), F.expr("unix_seconds(at) div 86400 * 1000000000000"))
    ST.run_batches(tickets, ST.ledger_batches(f"{path}/table", every=2), path)
    return batch_table(spark, f"{path}/table").select("key", "row_no")


def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    rows = ST.to_table(ST.redacted(d), shared_folder(spark, "stream"))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("masked_md5"), F.length("text").cast("bigint").alias("n_chars"))


_ALL = (
    file_admission, file_heads, invoice_xml, log_failures, ledger_csv, survey_csv, daily_json, on_values, stream_survey, stream_survey_exact, stream_corr,
    stream_uploads, stream_upload_parts, stream_retention, stream_asof, stream_orders, stream_ledger, stream_ledger_merged, stream_redact,
)
QUERIES = {f.__name__: f for f in _ALL}

_ZIP = "regexp_matches(h, '^504B(0304|0506|0708)')"
_FIELD = "nullif(trim(regexp_extract(x, '<{0}>([^<]*)</{0}>', 1)), '')"
_PEOPLE = "website = '' AND elapsed_ms >= 3000"

ORACLES = {
    "file_admission": f"""
WITH f AS (SELECT o_orderkey AS k, {list(EXTENSIONS)}[o_orderkey % 9 + 1] AS ext, {list(HEADS)}[(o_orderkey // 9) % 10 + 1] AS h, o_orderkey % 50 * 1000 AS length FROM orders),
r AS (SELECT *, CASE WHEN ext = '.exe' THEN 'extension' WHEN length > 45000 THEN 'size' WHEN NOT CASE ext WHEN '.pdf' THEN h LIKE '255044462D%' WHEN '.xml' THEN regexp_matches(h, '^(EFBBBF)?(20|09|0A|0D)*3C')
  WHEN '.doc' THEN h LIKE 'D0CF11E0A1B11AE1%' WHEN '.png' THEN h LIKE '89504E470D0A1A0A%' WHEN '.jpg' THEN h LIKE 'FFD8FF%' WHEN '.webp' THEN h LIKE '52494646________57454250%' ELSE {_ZIP} END THEN 'content' END AS reason FROM f)
SELECT 'd/f.x' || k || ext AS path, length, ext, CASE WHEN h LIKE '25504446%' THEN 'pdf' WHEN h LIKE '504B0304%' THEN 'zip' WHEN h LIKE '89504E47%' THEN 'png' WHEN h LIKE 'FFD8FF%' THEN 'jpeg' ELSE 'unknown' END AS kind, reason,
  CASE WHEN reason IS NULL THEN h END AS content FROM r""",
    "file_heads": f"""
WITH f AS (SELECT s_suppkey AS k, {list(HEAD_EXTENSIONS)}[(s_suppkey // 3) % 10 + 1] AS ext, {list(MORE_HEADS)}[s_suppkey % 14 + 1] AS h, repeat('x', CAST(s_suppkey % 40 * 5000 AS INT)) AS x FROM supplier),
r AS (SELECT *, length(h) // 2 + length(x) AS length, CASE WHEN ext = '.exe' THEN 'extension' WHEN length(h) // 2 + length(x) > 150000 THEN 'size' WHEN NOT CASE ext WHEN '.pdf' THEN h LIKE '255044462D%' WHEN '.xml' THEN regexp_matches(h, '^(EFBBBF)?(20|09|0A|0D)*3C')
  WHEN '.doc' THEN h LIKE 'D0CF11E0A1B11AE1%' WHEN '.png' THEN h LIKE '89504E470D0A1A0A%' WHEN '.jpg' THEN h LIKE 'FFD8FF%' WHEN '.webp' THEN h LIKE '52494646________57454250%' WHEN '.caj' THEN regexp_matches(h, '^(25504446|C8|43414A|484E|4B4448)') ELSE {_ZIP} END THEN 'content' END AS reason FROM f)
SELECT k % 7 || '/f' || k || ext AS path, length, ext, CASE WHEN h LIKE '25504446%' THEN 'pdf' WHEN h LIKE 'C8%' THEN 'c8' WHEN h LIKE '4B4448%' THEN 'kdh' WHEN h LIKE '484E%' THEN 'hn' WHEN h LIKE '43414A%' THEN 'caj' WHEN h LIKE '504B0304%' THEN 'zip' WHEN h LIKE '89504E47%' THEN 'png' WHEN h LIKE 'FFD8FF%' THEN 'jpeg' ELSE 'unknown' END AS kind, reason,
  CASE WHEN reason IS NULL THEN md5(unhex(h || hex(encode(x)))) END AS content_md5 FROM r""",
    "invoice_xml": duck(
        f"""
WITH r AS (SELECT path, CASE WHEN contains(x, '<!DOCTYPE') THEN 'dtd' WHEN NOT contains(x, '</Header>') THEN 'malformed' WHEN NOT contains(x, '<EInvoice>') THEN 'root' END AS reason, x FROM f_invoice_xml)
SELECT path AS source_file, CASE WHEN reason IS NULL THEN coalesce({_FIELD.format('InvoiceNumber')}, {_FIELD.format('EIid')}) END AS invoice_number, CASE WHEN reason IS NULL THEN {_FIELD.format('IssueTime')} END AS issue_date,
  CASE WHEN reason IS NULL THEN {_FIELD.format('BuyerName')} END AS buyer_name, CASE WHEN reason IS NULL THEN replace({_FIELD.format('TotalTaxAm')}, '¥', '') || '0' END AS tax_amount,
  CASE WHEN reason IS NULL THEN CAST(nullif(len(regexp_extract_all(x, '<IssuItemInformation')), 0) AS INT) END AS item_count, reason FROM r""",
        "f_invoice_xml",
    ),
    "log_failures": duck(
        """
WITH p AS (SELECT epoch_us(CAST(replace(substr(value, 1, 23), ',', '.') AS TIMESTAMP)) AS time, nullif(regexp_extract(value, 'task ([0-9a-f-]{36}) ', 1), '') AS task_id, nullif(regexp_extract(value, 'failed: (.*)$', 1), '') AS message,
  nullif(regexp_extract(value, 'request_id=([0-9a-f]+)', 1), '') AS request_id, nullif(regexp_extract(value, 'method=([^ ]+)', 1), '') AS method, nullif(regexp_extract(value, 'path=([^ ]+)', 1), '') AS path,
  TRY_CAST(nullif(regexp_extract(value, 'status=([0-9]+)', 1), '') AS INT) AS status FROM f_log_lines)
SELECT * FROM p WHERE task_id IS NOT NULL OR request_id IS NOT NULL""",
        "f_log_lines",
    ),
    "ledger_csv": duck(
        """
SELECT source_file, invoice_number, coalesce(issue_date, '') AS issue_date, CASE WHEN rec_id % 5 = 0 THEN '''=HYPERLINK("' || buyer_name || '")' ELSE buyer_name END AS buyer_name, coalesce(total_with_tax, '') AS total_with_tax, '' AS drawer,
  CASE WHEN rec_id % 2 = 0 THEN 'a；b' ELSE '' END AS warnings FROM f_records""",
        "f_records",
    ),
    "survey_csv": duck("SELECT arrival AS submitted_at, client_id, source || '、x' AS features FROM f_survey", "f_survey"),
    "daily_json": "SELECT day, CASE WHEN n % 2 = 0 THEN -n ELSE n END AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)",
    "on_values": f"""
WITH {_LEAVES},
q AS (SELECT DISTINCT doc_id, 'root/' || array_to_string(string_split(path, '/')[3:], '/') || '/Yes' AS key FROM l UNION SELECT DISTINCT doc_id, 'x/' || string_split(path, '/')[4] FROM l),
v AS (SELECT doc_id, key, regexp_replace(key, '/(Yes|No)$', '') AS k FROM q WHERE length(key) % 3 <> 0),
s AS (SELECT doc_id, key, unnest(range(0, len(string_split(k, '/')))) AS cut, k FROM v),
x AS (SELECT s.doc_id, s.key, s.cut, count(l.path) AS n, min(l.path) AS path FROM s LEFT JOIN l ON l.doc_id = s.doc_id AND (l.path = array_to_string(string_split(s.k, '/')[s.cut + 1:], '/') OR ends_with(l.path, '/' || array_to_string(string_split(s.k, '/')[s.cut + 1:], '/'))) GROUP BY s.doc_id, s.key, s.cut),
g AS (SELECT doc_id, key, arg_min(path, cut) FILTER (n = 1) AS path FROM x GROUP BY 1, 2),
t AS (SELECT *, count(path) OVER (PARTITION BY doc_id, path) AS shared FROM g)
SELECT q.doc_id, q.key, CASE WHEN length(q.key) % 3 = 0 THEN '0' ELSE coalesce(t.path || '#', '1') END AS value FROM q LEFT JOIN t ON t.doc_id = q.doc_id AND t.key = q.key AND shared = 1""",
    "stream_survey": duck(f"SELECT DISTINCT client_id FROM f_survey WHERE {_PEOPLE}", "f_survey"),
    "stream_survey_exact": duck(f"SELECT client_id, min(arrival) AS arrival FROM f_survey WHERE {_PEOPLE} GROUP BY client_id", "f_survey"),
    "stream_corr": "SELECT t.user_id, t.event_id AS task_id, r.event_id AS request_id FROM events t JOIN events r ON r.user_id = t.user_id AND r.ts >= t.ts AND r.ts <= t.ts + INTERVAL 12 HOURS WHERE t.event_type = 'error' AND r.event_type = 'purchase'",
    "stream_uploads": """
WITH p AS (SELECT l_orderkey AS task_id, l_linenumber - 1 AS idx, l_shipdate AS ts, CASE WHEN l_shipdate <= lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) + INTERVAL 30 DAYS THEN 0 ELSE 1 END AS new FROM lineitem),
n AS (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM p),
g AS (SELECT task_id, k, min(ts) AS a, max(ts) + INTERVAL 30 DAYS AS b, count(*) AS n_parts, len(list_filter([0, 1, 2, 3], lambda x: NOT list_contains(list(idx), x))) = 0 AS complete FROM n GROUP BY 1, 2)
SELECT task_id, epoch_us(a) AS start, epoch_us(b) AS "end", n_parts, complete FROM g WHERE b <= (SELECT max(l_shipdate) - INTERVAL 1 HOUR FROM lineitem)""",
    "stream_upload_parts": """
WITH RECURSIVE p AS (SELECT l_orderkey AS task_id, (l_linenumber - 1) % 5 AS idx, 2 + l_orderkey % 3 AS total, epoch_us(l_shipdate) AS "at", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, (l_linenumber - 1) % 5) AS n FROM lineitem),
w AS (SELECT epoch_us(max(l_shipdate)) - 5400000000 AS w FROM lineitem),
r AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS "at", 'start' AS outcome, CAST(NULL AS BIGINT) AS last, CAST([] AS BIGINT[]) AS got, false AS done, CAST(NULL AS BIGINT) AS gone, CAST(NULL AS BIGINT) AS gone_n FROM p
  UNION ALL SELECT task_id, n, idx, "at", CASE WHEN idx >= total THEN 'invalid' WHEN list_contains(had, idx) THEN 'repeated' WHEN whole THEN 'complete' ELSE 'uploading' END,
    CASE WHEN idx >= total THEN last0 WHEN list_contains(had, idx) THEN last ELSE "at" END, CASE WHEN idx >= total THEN had0 WHEN list_contains(had, idx) THEN had ELSE list_append(had, idx) END,
    CASE WHEN idx >= total THEN done0 WHEN list_contains(had, idx) THEN was ELSE was OR whole END, CASE WHEN idx < total AND again AND NOT done0 THEN last0 + 1728000000000 END, len(had0) FROM (
    SELECT *, len(list_filter(range(0, total), lambda x: x <> idx AND NOT list_contains(had, x))) = 0 AS whole FROM (
      SELECT p.*, coalesce(p."at" - r.last > 1728000000000, false) AS again, r.last AS last0, r.got AS had0, r.done AS done0, CASE WHEN p."at" - r.last > 1728000000000 THEN NULL ELSE r.last END AS last,
        CASE WHEN p."at" - r.last > 1728000000000 THEN CAST([] AS BIGINT[]) ELSE r.got END AS had, CASE WHEN p."at" - r.last > 1728000000000 THEN false ELSE r.done END AS was FROM r JOIN p ON p.task_id = r.task_id AND p.n = r.n + 1))),
z AS (SELECT task_id, arg_max(last, n) AS last, arg_max(done, n) AS done, arg_max(len(got), n) AS k FROM r WHERE n > 0 GROUP BY task_id)
SELECT task_id, idx, "at", outcome, CASE WHEN outcome <> 'invalid' THEN len(got) END AS n_got FROM r WHERE n > 0
UNION ALL SELECT task_id, NULL, gone, 'abandoned', gone_n FROM r WHERE gone IS NOT NULL
UNION ALL SELECT task_id, NULL, last + 1728000000000, 'abandoned', k FROM z, w WHERE NOT done AND last + 1728000000000 < w""",
    "stream_retention": """
WITH o AS (SELECT 'SK' || lpad(CAST(o_orderkey AS STRING), 30, '0') AS otn, o_orderstatus AS s, o_orderkey % 2 = 0 AS b, epoch_us(o_orderdate) AS t, CAST(o_custkey % 72 AS BIGINT) * 3600000000 AS h FROM orders),
w AS (SELECT max(t + CASE WHEN s = 'O' THEN 0 WHEN s = 'P' THEN h ELSE h + 3600000000 END) - 5400000000 AS w FROM o),
d AS (SELECT otn AS out_trade_no, CASE WHEN s = 'O' OR h > 172800000000 THEN 'delete' WHEN s = 'F' AND b THEN 'clear' END AS action, CASE WHEN s = 'O' OR h > 172800000000 THEN t + 172800000000 ELSE t + h + 3600000000 + 7776000000000 END AS "at" FROM o)
SELECT out_trade_no, action, "at" FROM d, w WHERE action IS NOT NULL AND "at" < w""",
    "stream_asof": """
WITH t AS (SELECT * FROM events WHERE event_type = 'error'), r AS (SELECT * FROM events WHERE event_type = 'purchase'),
m AS (SELECT r.event_id AS rid, r.ts AS rts, t.event_id AS tid FROM r ASOF JOIN t ON r.user_id = t.user_id AND r.ts >= t.ts WHERE r.ts - t.ts <= INTERVAL 12 HOURS),
b AS (SELECT tid, arg_max(rid, rts) AS rid, max(rts) AS rts FROM m GROUP BY tid)
SELECT t.user_id, t.event_id AS task_id, rid AS request_id, epoch_us(rts) AS request_time FROM t LEFT JOIN b ON t.event_id = tid
WHERE t.ts + INTERVAL 12 HOURS < (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IN ('error', 'purchase'))""",
    "stream_orders": _BUSINESS["order_replay"],
    "stream_ledger": "SELECT lpad(CAST(l_orderkey % 3000 AS STRING), 8, '0') AS key, min(l_orderkey * 10 + l_linenumber) AS row_no FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1",
    "stream_ledger_merged": """
SELECT lpad(CAST(l_orderkey % 3000 AS STRING), 8, '0') AS key, min(epoch_us(l_shipdate) // 86400000000 * 1000000000000 + l_orderkey * 10 + l_linenumber) AS row_no FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1""",
    "stream_redact": _REDACTION["pii_mask"],
}
