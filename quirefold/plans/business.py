"""Queries of orders, payments, surveys, logs and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import pages as G
from ..functions import payments as Y
from ..functions import text as X
from ..operators import audits as A
from ..operators import logs as LG
from ..operators import orders as O
from ..operators import survey as S
from .views import duck, table, view

NOW = "2023-06-01 00:00:00"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "f_pay_orders").withColumn("resource_id", F.md5(F.col("out_trade_no").cast("binary")))


def order_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    trade = F.concat(F.lit("SK"), F.lpad(F.col("l_orderkey").cast("string"), 30, "0"))
    o = _orders(spark, sf_dir).select(F.col("out_trade_no").alias("k"), F.col("amount").alias("a"), F.col("op").alias("o"))
    p = li.withColumn("out_trade_no", F.when(F.col("l_partkey") % 13 == 0, F.lit("SKx")).otherwise(trade)).join(o, F.col("out_trade_no") == F.col("k"), "left")
    pay = p.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("trade_no"), "out_trade_no", (F.col("l_partkey") % 7 != 0).alias("active"),
        F.md5(F.when(F.col("l_partkey") % 17 == 0, F.lit("z")).otherwise(F.col("out_trade_no")).cast("binary")).alias("resource_id"),
        F.when(F.col("l_partkey") % 19 == 0, F.lit("0.01")).otherwise(F.col("a")).alias("amount"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("resume")).otherwise(F.col("o")).alias("op"),
    )
    return O.reconcile(pay, _orders(spark, sf_dir)).select("trade_no", "verdict")


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stale(_orders(spark, sf_dir), F.lit(NOW).cast("timestamp"), 48 * 200, 900)


def order_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.retention_stats(_stale(spark, sf_dir)).select("action", "n", F.date_format("oldest", "yyyy-MM-dd").alias("oldest"), F.date_format("newest", "yyyy-MM-dd").alias("newest"))


def order_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.retain(_stale(spark, sf_dir)).select("out_trade_no", "status", "result_cache")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("bigint")
    action = F.element_at(F.array(*map(F.lit, ("claim", "fulfil", "release", "claim"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    return li.select(F.col("l_orderkey").cast("string").alias("out_trade_no"), seq.alias("seq"), action.alias("action"))


def order_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.transitions(order_events(spark, sf_dir))


def orders_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir).select("out_trade_no", "status", "amount")
    n = F.substring("out_trade_no", 3, 30).cast("bigint")
    u = t.where(n % 3 == 0).withColumn("status", F.lit("verified")).withColumn("gone", n % 15 == 0)
    new = t.where(n % 20 == 1).select(F.concat(F.lit("NEW"), F.col("out_trade_no")).alias("out_trade_no"), "status", "amount", F.lit(False).alias("gone"))
    return O.upsert(t, u.unionByName(new), "out_trade_no", F.col("old.status") == "created", "gone")


def order_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("SK"), F.lpad(F.col("l_orderkey").cast("string"), 30, "0")).alias("out_trade_no"))
    return O.lookup(_orders(spark, sf_dir), keys).select("out_trade_no", "op", "amount")


def bill_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    n = F.substring("out_trade_no", 3, 30).cast("bigint") % 9 + 1
    fields = {"amount": F.when(n != 5, F.col("amount")), "currency": F.lit("CNY"), "goods_name": Y.goods_name(F.col("op"), n), "out_trade_no": F.col("out_trade_no"), "pay_before": F.lit("2026-11-16T10:00:00+08:00"), "resource_id": F.col("resource_id"), "seller_id": F.lit("2088"), "service_id": F.lit("s1")}
    text = Y.canonical_sign_string(fields)
    return o.select("out_trade_no", text.alias("signed"), Y.base64url(text).alias("encoded"))


def proof_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    n = F.substring("out_trade_no", 3, 30).cast("bigint")
    obj = F.concat(F.lit('{"protocol":{"payment_proof":"p'), F.col("amount"), F.when(n % 6 == 1, F.lit('"')).otherwise(F.concat(F.lit('","trade_no":"'), F.col("out_trade_no"), F.lit('"'))), F.lit('},"method":{"client_session":"'), F.when(n % 2 == 0, F.lit("c1")).otherwise(F.lit("")), F.lit('"}}'))
    header = F.when(n % 6 == 2, F.lit("")).when(n % 6 == 3, F.lit("!!not base64!!")).when(n % 6 == 4, Y.base64url(F.lit("plain words"))).when(n % 6 == 5, F.base64(F.encode(obj, "utf-8"))).otherwise(Y.base64url(obj))
    return o.select("out_trade_no", Y.decode_payment_proof(header).alias("p")).select("out_trade_no", "p.*")


def code_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = F.element_at(F.array(*map(F.lit, (*Y.MESSAGES, "NO_SUCH_CODE"))), (F.col("event_id") % (len(Y.MESSAGES) + 1) + 1).cast("int"))
    return e.select("event_id", Y.error_message(code).alias("message"), X.friendly(F.when(F.col("event_id") % 2 == 0, Y.error_message(code)).otherwise(code), "failed").alias("shown"))


def survey_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "f_survey").withColumn("client_id", F.when(F.col("arrival") % 31 == 0, F.lit("short")).otherwise(F.col("client_id")))
    k = F.col("arrival") % 4
    f = F.when(k == 0, F.array(F.lit("其他"))).when(k == 1, F.array(F.lit("PDF 转 Word"), F.lit("其他"))).when(k == 2, F.array(F.lit("其他"), F.lit("其他"))).otherwise(F.array(F.lit("nope")))
    s = s.withColumn("features", f).withColumn("feature_request", F.repeat(F.lit("x"), (F.col("arrival") % 600).cast("int")))
    j = S.judged(s, {"source": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")})
    return j.select("arrival", F.array_join("rules", ",").alias("rules"), "verdict")


def survey_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "f_survey")
    return S.new_clients(s.where("arrival > 100"), s.where("arrival <= 100"), "arrival").select("arrival", "client_id")


def log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r = LG.task_rollup(e.select(F.col("user_id").alias("task_id"), F.col("ts").alias("time"), F.concat(F.col("event_type"), F.lit(":"), F.col("event_id").cast("string")).alias("message")))
    return r.select("task_id", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_seen"), F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_seen"), "n_lines", F.md5(F.col("messages").cast("binary")).alias("messages_md5"))


def log_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tasks = e.where("event_type = 'error'").select(F.col("event_id").alias("task_id"), "user_id", F.col("ts").alias("last_seen"))
    requests = e.where("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("time"))
    return LG.correlate(tasks, requests, 12 * 3600, "user_id").select("task_id", "request_id", F.unix_micros(F.col("request_time").cast("timestamp")).alias("request_time"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("input_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"))
    return li.select(F.date_format("l_shipdate", "yyyy-MM").alias("day"), F.col("l_orderkey").alias("task_id"), name.alias("name"), (F.col("l_quantity").cast("bigint") * 1048576).alias("size")).distinct()


def archive_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LG.quota_copy(_files(spark, sf_dir))


def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM").alias("day"))
    files = _files(spark, sf_dir).withColumn("reason", F.when(F.col("size") > 40 * 1048576, F.lit("task_quota")))
    return LG.archive_summary(files, requests)


def archive_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("name")).distinct()
    odd = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    last = table(spark, sf_dir, "events").select(F.max(F.col("ts").cast("date")).alias("last")).first()["last"]
    return LG.prune(days.unionByName(odd), "name", F.lit(last), 10).select("name", "pruned")


def upload_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.upload_state(view(spark, sf_dir, "f_uploads"))


def zip_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.zip_audit(view(spark, sf_dir, "f_zip_entries"))


def batch_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.batch_quota(view(spark, sf_dir, "f_uploads").withColumn("batch", F.col("task_id") % 700), "batch")


def ticket_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.count_quota(view(spark, sf_dir, "f_tickets"), "batch_id", 940, "tickets")


def artifact_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = view(spark, sf_dir, "f_uploads")
    name = F.when(F.col("idx") == 5, F.lit("merged.pdf")).when(F.col("idx") == 3, F.lit("result.zip")).when(F.col("idx") == 0, F.lit("input.pdf")).otherwise(F.concat(F.lit("z"), F.col("idx").cast("string"), F.when(F.col("size") % 3 == 0, F.lit(".pdf")).otherwise(F.lit(".txt"))))
    return A.pick_artifact(u.withColumn("name", name), "task_id", "name", ["merged.pdf", "result.zip"])


def batch_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = view(spark, sf_dir, "f_uploads").select((F.col("task_id") % 2000).alias("batch_id"), F.concat(F.lit("s"), F.col("idx").cast("string")).alias("stored")).distinct()
    m = u.select("batch_id").distinct().select("batch_id", F.concat(F.lit('{"files":[{"name":"a","stored":"s0"},{"name":"b","stored":"s'), (F.col("batch_id") % 7).cast("string"), F.lit('"}]'), F.when(F.col("batch_id") % 2 == 0, F.lit(',"include_seller":true')).otherwise(F.lit("")), F.lit("}")).alias("manifest"))
    return A.restore(m, u)


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = view(spark, sf_dir, "f_uploads").select("task_id", F.concat(F.lit("s"), F.col("idx").cast("string")).alias("stored"))
    wanted = u.select("task_id").distinct().select("task_id", F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("stored"))
    return A.missing_files(wanted, u, ["task_id", "stored"])


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = A.text_layers(view(spark, sf_dir, "f_doc_pages"))
    d = layers.select(
        "doc_id", "n_pages", "image_pages", "has_text", "too_short", (F.col("n_chars") * 4000).alias("size"), (F.col("doc_id") % 3 == 0).alias("is_image"), (F.col("doc_id") % 400).alias("width"),
        F.lit(300).alias("height"), (F.col("doc_id") % 200).cast("double").alias("sharpness"), (F.col("doc_id") % 17 == 0).alias("encrypted"),
    )
    return A.ocr_admission(d).select("doc_id", "n_pages", "image_pages", "has_text", "too_short", "admitted", "note")


def op_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    n = F.substring("out_trade_no", 3, 30).cast("bigint")
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".ofd", ".xml", ".exe"))), (n / 4).cast("int") % 4 + 1)
    return A.op_allowed(o.withColumn("ext", ext)).select("out_trade_no", "reason")


def value_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    name = F.concat(F.lit("c:\\x/"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.lit("\x07")).otherwise(F.lit("")), F.lit(".pdf"))
    obj = F.when(F.col("event_id") % 2 == 0, F.lit('{"trade_no":"a"}')).otherwise(F.lit('{"tradeNo":"b"}'))
    return e.select("event_id", X.finite(v).alias("value"), F.size(F.filter(X.finite_all(F.array(v, F.lit(1.0))), lambda x: x.isNotNull())).cast("bigint").alias("n_finite"), N.clean_upload_name(name).alias("name"), Y.either_style(obj, "trade_no", "z").alias("trade"))


def size_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = view(spark, sf_dir, "f_zip_entries").groupBy("archive_id").agg(F.sum("file_size").alias("a"), F.sum("compress_size").alias("b"))
    return z.select("archive_id", G.size_reduction_pct(F.col("a"), F.col("b")).alias("saved"), F.least("a", "b").alias("kept"))


def skipped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import ledger as L

    r = view(spark, sf_dir, "f_records")
    name = F.concat(F.lit("n"), (F.col("rec_id") % 4).cast("string"), F.lit(".pdf"))
    return L.unique_names(r.where("rec_id % 2 = 0").select("rec_id", "batch_id", name.alias("name")), "batch_id", "name", "rec_id").select("rec_id", "unique_name")


def latest_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return A.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id")


def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_rows(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 10).select("user_id", "event_id", "nth")


_ALL = (
    order_reconcile, order_retention, order_retained, order_replay, orders_upsert, order_lookup, bill_sign, proof_decode, code_messages, survey_valid, survey_unique, log_rollup, log_asof, archive_quota, archive_summary, archive_prune,
    upload_complete, zip_audit, batch_quota, ticket_quota, artifact_pick, batch_restore, missing_files, admission, op_extensions, value_hygiene, size_change, skipped_names, latest_pick, first_messages,
)
QUERIES = {f.__name__: f for f in _ALL}

_K = "CAST(substr(out_trade_no, 3, 30) AS BIGINT)"
_STALE = f"""
s AS (SELECT *, CASE WHEN status = 'created' AND created_at < TIMESTAMP '{NOW}' - INTERVAL 9600 HOURS THEN 'delete' WHEN status = 'fulfilled' AND result_cache IS NOT NULL AND fulfilled_at < TIMESTAMP '{NOW}' - INTERVAL 900 DAYS THEN 'clear' ELSE 'keep' END AS action FROM f_pay_orders)"""
_GOODS = "CASE op " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Y.GOODS.items()) + " END"
_CODES = f"({', '.join(repr(x) for x in (*Y.MESSAGES, 'NO_SUCH_CODE'))})".replace("(", "[").replace(")", "]")
_TEXTS = "[" + ", ".join(f"'{x}'" for x in (*Y.MESSAGES.values(), Y.DEFAULT_MESSAGE)) + "]"
_B64 = "rtrim(replace(replace(to_base64(encode({})), '+', '-'), '/', '_'), '=')"
_FILES = "f AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS day, l_orderkey AS task_id, 'input_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS name, CAST(l_quantity AS BIGINT) * 1048576 AS size FROM lineitem)"

ORACLES = {
    "order_reconcile": duck(
        """
WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
p AS (SELECT *, CASE WHEN l_partkey % 13 = 0 THEN 'SKx' ELSE 'SK' || lpad(CAST(l_orderkey AS STRING), 30, '0') END AS otn FROM li)
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS trade_no, CASE WHEN o.op IS NULL THEN 'no_order' WHEN l_partkey % 7 = 0 THEN 'inactive' WHEN l_partkey % 17 = 0 THEN 'resource' WHEN l_partkey % 19 = 0 AND amount <> '0.01' THEN 'amount'
  WHEN l_linenumber % 2 = 0 AND op = 'dedup' THEN 'op' WHEN status = 'fulfilled' THEN 'replay' ELSE 'accepted' END AS verdict FROM p LEFT JOIN f_pay_orders o ON otn = out_trade_no""",
        "f_pay_orders",
    ),
    "order_retention": duck(f"WITH {_STALE} SELECT action, count(*) AS n, strftime(min(created_at), '%Y-%m-%d') AS oldest, strftime(max(created_at), '%Y-%m-%d') AS newest FROM s GROUP BY action", "f_pay_orders"),
    "order_retained": duck(f"WITH {_STALE} SELECT out_trade_no, status, CASE WHEN action <> 'clear' THEN result_cache END AS result_cache FROM s WHERE action <> 'delete'", "f_pay_orders"),
    "order_replay": """
WITH RECURSIVE e AS (SELECT CAST(l_orderkey AS STRING) AS otn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, ['claim', 'fulfil', 'release', 'claim'][l_partkey % 4 + 1] AS action FROM lineitem),
r AS (SELECT otn, CAST(0 AS BIGINT) AS seq, '' AS action, 'created' AS status, 'created' AS before FROM e WHERE seq = 1 UNION ALL
  SELECT e.otn, e.seq, e.action, CASE WHEN r.status = 'created' AND e.action = 'claim' THEN 'verified' WHEN r.status = 'verified' AND e.action = 'fulfil' THEN 'fulfilled' WHEN r.status = 'verified' AND e.action = 'release' THEN 'created' ELSE r.status END, r.status
  FROM r JOIN e ON e.otn = r.otn AND e.seq = r.seq + 1)
SELECT otn AS out_trade_no, seq, action, status, CASE WHEN status <> before THEN 'accepted' WHEN before = 'fulfilled' THEN 'replay' ELSE 'conflict' END AS outcome FROM r WHERE seq > 0""",
    "orders_upsert": duck(
        f"""
SELECT out_trade_no, CASE WHEN {_K} % 3 = 0 AND status = 'created' THEN 'verified' ELSE status END AS status, amount FROM f_pay_orders WHERE NOT ({_K} % 15 = 0 AND status = 'created')
UNION ALL SELECT 'NEW' || out_trade_no, status, amount FROM f_pay_orders WHERE {_K} % 20 = 1""",
        "f_pay_orders",
    ),
    "order_lookup": duck("SELECT out_trade_no, op, amount FROM f_pay_orders WHERE out_trade_no IN (SELECT 'SK' || lpad(CAST(l_orderkey AS STRING), 30, '0') FROM lineitem WHERE l_quantity >= 49)", "f_pay_orders"),
    "bill_sign": duck(
        f"""
WITH s AS (SELECT out_trade_no, CASE WHEN {_K} % 9 + 1 <> 5 THEN 'amount=' || amount || '&currency=CNY&goods_name=' || replace({_GOODS}, '{{n}}', CAST({_K} % 9 + 1 AS STRING)) || '&out_trade_no=' || out_trade_no || '&pay_before=2026-11-16T10:00:00+08:00&resource_id=' || md5(out_trade_no) || '&seller_id=2088&service_id=s1' END AS signed FROM f_pay_orders)
SELECT out_trade_no, signed, {_B64.format('signed')} AS encoded FROM s""",
        "f_pay_orders",
    ),
    "proof_decode": duck(
        f"""
SELECT out_trade_no, CASE WHEN {_K} % 6 IN (0, 5) THEN 'p' || amount END AS payment_proof, CASE WHEN {_K} % 6 IN (0, 5) THEN out_trade_no END AS trade_no, CASE WHEN {_K} % 6 IN (0, 5) AND {_K} % 2 = 0 THEN 'c1' END AS client_session,
  CASE {_K} % 6 WHEN 1 THEN 'incomplete' WHEN 2 THEN 'empty' WHEN 3 THEN 'not_base64' WHEN 4 THEN 'not_json' END AS reason FROM f_pay_orders""",
        "f_pay_orders",
    ),
    "code_messages": f"SELECT event_id, {_TEXTS}[event_id % {len(Y.MESSAGES) + 1} + 1] AS message, CASE WHEN event_id % 2 = 0 THEN {_TEXTS}[event_id % {len(Y.MESSAGES) + 1} + 1] ELSE 'failed' END AS shown FROM events",
    "survey_valid": duck(
        """
SELECT arrival, concat_ws(',', CASE WHEN arrival % 31 = 0 THEN 'client_id' END, CASE WHEN source NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN 'source' END, CASE WHEN arrival % 600 > 500 THEN 'feature_request' END, CASE WHEN arrival % 4 >= 2 THEN 'features' END) AS rules,
  CASE WHEN rules <> '' THEN 'rejected' WHEN website <> '' OR elapsed_ms < 3000 THEN 'bot' ELSE 'valid' END AS verdict FROM f_survey""",
        "f_survey",
    ),
    "survey_unique": duck("SELECT min(arrival) AS arrival, client_id FROM f_survey WHERE arrival > 100 AND client_id NOT IN (SELECT client_id FROM f_survey WHERE arrival <= 100) GROUP BY client_id", "f_survey"),
    "log_rollup": """
WITH e AS (SELECT user_id, ts, event_type || ':' || event_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type || ':' || event_id) AS n FROM events)
SELECT user_id AS task_id, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS n_lines, md5(string_agg(m, '|' ORDER BY n) FILTER (n <= 10)) AS messages_md5 FROM e GROUP BY user_id""",
    "log_asof": """
WITH t AS (SELECT * FROM events WHERE event_type = 'error'), r AS (SELECT * FROM events WHERE event_type = 'purchase'),
m AS (SELECT r.event_id AS rid, r.ts AS rts, t.event_id AS tid FROM r ASOF JOIN t ON r.user_id = t.user_id AND r.ts >= t.ts WHERE r.ts - t.ts <= INTERVAL 12 HOURS),
b AS (SELECT tid, arg_max(rid, rts) AS rid, max(rts) AS rts FROM m GROUP BY tid)
SELECT t.event_id AS task_id, rid AS request_id, epoch_us(rts) AS request_time FROM t LEFT JOIN b ON t.event_id = tid""",
    "archive_quota": f"""
WITH RECURSIVE {_FILES}, o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY task_id, name, size) AS n FROM f),
r AS (SELECT day, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS task_id, '' AS name, CAST(0 AS BIGINT) AS size, CAST(NULL AS STRING) AS reason, CAST(0 AS BIGINT) AS in_task, CAST(0 AS BIGINT) AS in_day FROM o WHERE n = 1
  UNION ALL SELECT day, n, task_id, name, size, reason, u + CASE WHEN reason IS NULL THEN size ELSE 0 END, in_day + CASE WHEN reason IS NULL THEN size ELSE 0 END FROM (
    SELECT *, CASE WHEN u + size > {LG.MOST_TASK_BYTES} THEN 'task_quota' WHEN in_day + size > {LG.MOST_DAY_BYTES} THEN 'day_quota' END AS reason FROM (
      SELECT o.day, o.n, o.task_id, o.name, o.size, CASE WHEN o.task_id = r.task_id THEN r.in_task ELSE 0 END AS u, r.in_day FROM r JOIN o ON o.day = r.day AND o.n = r.n + 1)))
SELECT day, task_id, name, size, reason FROM r WHERE n > 0""",
    "archive_summary": f"""
WITH {_FILES}, t AS (SELECT day, task_id, sum(CASE WHEN size <= 41943040 THEN size ELSE 0 END) AS b, count(*) FILTER (size <= 41943040) AS k FROM f GROUP BY 1, 2),
c AS (SELECT day, count(*) AS n_tasks, count(*) FILTER (k > 0) AS n_archived, CAST(sum(b) AS BIGINT) AS bytes FROM t GROUP BY day), r AS (SELECT strftime(ts, '%Y-%m') AS day, count(*) AS n_requests FROM events GROUP BY 1)
SELECT day, coalesce(n_requests, 0) AS n_requests, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_archived, 0) AS n_archived, coalesce(bytes, 0) AS bytes FROM r FULL JOIN c USING (day)""",
    "archive_prune": "SELECT name, pruned FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS name, CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) - 9 FROM events) AS pruned FROM events) UNION ALL SELECT n_name, false FROM nation",
    "upload_complete": duck(
        """
WITH g AS (SELECT task_id, count(*) AS n_parts, count(DISTINCT idx) AS d, list_filter([0, 1, 2, 3], lambda x: NOT list_contains(list(idx), x)) AS m FROM f_uploads GROUP BY task_id)
SELECT task_id, n_parts, n_parts > d AS repeated, array_to_string(m, ',') AS missing, len(m) = 0 AS complete FROM g""",
        "f_uploads",
    ),
    "zip_audit": duck(
        """
SELECT archive_id, count(*) AS n_entries, CAST(sum(file_size) AS BIGINT) AS n_bytes, CASE WHEN bool_or(flag_bits = 1) THEN 'encrypted' WHEN count(*) > 5000 THEN 'entries' WHEN sum(file_size) > 209715200 THEN 'bytes'
  WHEN bool_or(file_size >= 4096 AND file_size > 100 * compress_size) THEN 'ratio' WHEN bool_or(contains(entry, '..')) THEN 'traversal' END AS reason FROM f_zip_entries GROUP BY archive_id""",
        "f_zip_entries",
    ),
    "batch_quota": duck("SELECT task_id % 700 AS batch, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, max(size) AS largest, CASE WHEN count(*) > 50 THEN 'files' WHEN max(size) > 10485760 THEN 'file_size' WHEN sum(size) > 104857600 THEN 'batch_size' END AS reason FROM f_uploads GROUP BY 1", "f_uploads"),
    "ticket_quota": duck("SELECT batch_id, count(*) AS n, CASE WHEN count(*) > 940 THEN 'tickets' END AS reason FROM f_tickets GROUP BY batch_id", "f_tickets"),
    "artifact_pick": duck(
        """
WITH n AS (SELECT task_id, CASE idx WHEN 5 THEN 'merged.pdf' WHEN 3 THEN 'result.zip' WHEN 0 THEN 'input.pdf' ELSE 'z' || idx || CASE WHEN size % 3 = 0 THEN '.pdf' ELSE '.txt' END END AS name FROM f_uploads)
SELECT task_id, arg_min(name, struct_pack(r := CASE name WHEN 'merged.pdf' THEN 1 WHEN 'result.zip' THEN 2 ELSE 3 END, n := name)) AS name FROM n WHERE name IN ('merged.pdf', 'result.zip') OR (ends_with(name, '.pdf') AND NOT starts_with(name, 'input')) GROUP BY task_id""",
        "f_uploads",
    ),
    "batch_restore": duck(
        """
WITH u AS (SELECT DISTINCT task_id % 2000 AS b, idx FROM f_uploads), m AS (SELECT DISTINCT b FROM u)
SELECT *, n_found = 2 AS restorable FROM (SELECT b AS batch_id, CAST(2 AS BIGINT) AS n_files, CAST(EXISTS (SELECT 1 FROM u WHERE u.b = m.b AND idx = 0) AS BIGINT) + CAST(EXISTS (SELECT 1 FROM u WHERE u.b = m.b AND idx = m.b % 7) AS BIGINT) AS n_found, b % 2 = 0 AS include_seller FROM m)""",
        "f_uploads",
    ),
    "missing_files": duck("SELECT task_id, s AS stored FROM (SELECT DISTINCT task_id, unnest(['s0', 's1']) AS s FROM f_uploads) w WHERE NOT EXISTS (SELECT 1 FROM f_uploads u WHERE u.task_id = w.task_id AND 's' || idx = w.s)", "f_uploads"),
    "admission": duck(
        """
WITH p AS (SELECT doc_id, length(trim(coalesce(text, ''))) AS n FROM f_doc_pages), g AS (SELECT doc_id, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_chars, count(*) FILTER (n < 5) AS image_pages, bool_or(n > 50) AS has_text FROM p GROUP BY doc_id),
r AS (SELECT *, n_chars < 50 AS too_short, CASE WHEN n_chars * 4000 > 20971520 THEN 'size' WHEN doc_id % 3 = 0 AND doc_id % 400 < 200 THEN 'resolution' WHEN doc_id % 3 <> 0 AND doc_id % 17 = 0 THEN 'encrypted' WHEN doc_id % 3 <> 0 AND n_pages > 10 THEN 'pages' END AS no FROM g)
SELECT doc_id, n_pages, image_pages, has_text, too_short, no IS NULL AS admitted, coalesce(no, CASE WHEN doc_id % 3 = 0 AND doc_id % 200 < 100 THEN 'blurry' WHEN doc_id % 3 <> 0 AND has_text THEN 'has_text_layer' END, '') AS note FROM r""",
        "f_doc_pages",
    ),
    "op_extensions": duck(
        f"""
WITH e AS (SELECT *, ['.pdf', '.ofd', '.xml', '.exe'][({_K} // 4) % 4 + 1] AS ext FROM f_pay_orders)
SELECT out_trade_no, CASE WHEN (op = 'merge' AND ext IN ('.pdf', '.ofd')) OR (op IN ('extract', 'rename') AND ext <> '.exe') THEN NULL WHEN ext = '.xml' THEN 'xml_not_merged' ELSE 'extension' END AS reason FROM e""",
        "f_pay_orders",
    ),
    "value_hygiene": "SELECT event_id, CASE WHEN event_id % 7 > 1 THEN value END AS value, CASE WHEN event_id % 7 > 1 AND value IS NOT NULL THEN 2 ELSE 1 END AS n_finite, event_type || '.pdf' AS name, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS trade FROM events",
    "size_change": duck("SELECT archive_id, round((1 - sum(compress_size) / sum(file_size)) * 100, 1) AS saved, CAST(least(sum(file_size), sum(compress_size)) AS BIGINT) AS kept FROM f_zip_entries GROUP BY archive_id", "f_zip_entries"),
    "skipped_names": duck("WITH n AS (SELECT rec_id, 'n' || (rec_id % 4) AS s, row_number() OVER (PARTITION BY batch_id, rec_id % 4 ORDER BY rec_id) AS nth FROM f_records WHERE rec_id % 2 = 0) SELECT rec_id, s || CASE WHEN nth > 1 THEN '__' || nth ELSE '' END || '.pdf' AS unique_name FROM n", "f_records"),
    "latest_pick": "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id",
    "first_messages": "SELECT user_id, event_id, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM events) WHERE nth <= 10",
}
