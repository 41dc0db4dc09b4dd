"""Queries of what is accepted and what is rejected, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payments as Y
from ..functions import text as X
from ..operators import logs as LG
from ..operators import orders as O
from ..operators import pages as P
from ..operators import redact as R
from ..operators import survey as S
from .business import _STALE, _stale
from .redaction import _HITS, _OVER, _RECTS, _rects
from .views import duck, table, view

KEYWORDS = ["GNU", "licensed under", "the "]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "f_doc_pages").select("doc_id", F.col("page_no").cast("bigint").alias("page_no"), "text")


def _by_turn(n: str, values: tuple):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.expr(n) + 1).cast("int"))


ORDERS = ("2:90,1,2:90", " , ", "1:45", "abc", "1:90:90", "99999", " 1, ,+1 ", "1:x", "1," * 1001)
SPLITS = (("all", ""), ("ranges", "1-2, 1"), ("ranges", "1,2-1"), ("fixed", "2"), ("fixed", "0"), ("ranges", "1," * 201), ("ranges", "1-x"), ("halves", ""), ("ranges", "1,5-900"), ("ranges", "1" * 4097), ("fixed", ""))


def _order_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return n.withColumn("spec", _by_turn(f"doc_id % {len(ORDERS)}", ORDERS))


def page_order_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.order_reasons(_order_specs(spark, sf_dir)).select("doc_id", "n_pages", "reason")


def page_order_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.accepted_order(_pages(spark, sf_dir), _order_specs(spark, sf_dir))


def _split_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    k = f"doc_id % {len(SPLITS)}"
    return n.withColumn("mode", _by_turn(k, tuple(m for m, _ in SPLITS))).withColumn("value", _by_turn(k, tuple(v for _, v in SPLITS)))


def page_split_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_reasons(_split_specs(spark, sf_dir)).select("doc_id", "mode", "n_pages", "reason")


def page_split_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.accepted_split(_pages(spark, sf_dir), _split_specs(spark, sf_dir))


def survey_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All choices of the form, with its own domains, after white space is stripped."""
    odd = lambda k, good, bad: F.when(F.col("arrival") % k == 0, F.lit(bad)).otherwise(F.lit(good))
    s = view(spark, sf_dir, "f_survey").withColumns({
        "client_id": F.concat(F.lit(" 　"), "client_id", F.lit("\n")),
        "frequency": odd(5, "每月几次", "每月"),
        "source": F.lit("其他"),
        "pricing_model": odd(7, "按月或按年订阅", None),
        "price_range": odd(11, "19.9 元", "20 元"),
        "task_outcome": F.lit("没有成功"),
        "usage_scenario": odd(13, "其他", ""),
        "page_path": odd(17, "/merge-pdf/result", "/merge-pdf"),
        "schema_version": F.when(F.col("arrival") % 19 == 0, F.lit("v2")).when(F.col("arrival") % 2 == 0, F.lit("v1")),
        "contact": F.concat(F.lit("  "), F.repeat(F.lit("c"), F.when(F.col("arrival") % 23 == 0, 101).otherwise(100)), F.lit("\t")),
        "features": F.array(F.lit(" 其他"), odd(29, "PDF 转 Word", "其他 ")),
        "bot_trap": F.when(F.col("arrival") % 37 == 0, F.lit("x")),
    })
    v = S.violations(S.stripped(s), extra=("bot_trap",))
    return v.select("arrival", F.array_join("rules", ",").alias("rules"))


def original_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    head = _by_turn("l_partkey % 5", ("input_", "Invoice_", "merged_invoices.pdf", "INPUT", "result_"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 5 == 2, head).otherwise(F.concat(head, F.col("l_partkey").cast("string"))).alias("name"))
    return LG.original_files(rows).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def retention_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.retention_list(_stale(spark, sf_dir)).withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))


def fault_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _by_turn("event_id % 6", ("missing", "int_parsing", "less_than", "finite_number", "odd", None))
    return table(spark, sf_dir, "events").select("event_id", Y.fault_message(kind, F.col("event_type")).alias("message"))


def finite_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    deep = F.struct(F.create_map(F.lit("a"), v, F.lit("b"), F.lit(1.0)).alias("m"), F.array(F.struct(F.array(v, F.lit(2.0)).alias("x"))).alias("l"), F.col("event_type").alias("t"))
    rows = table(spark, sf_dir, "events").select("event_id", deep.alias("d"))
    rows = rows.withColumn("d", X.finite_deep(F.col("d"), rows.schema["d"].dataType))
    return rows.select("event_id", F.element_at("d.m", F.lit("a")).alias("in_map"), F.element_at("d.m", F.lit("b")).alias("other"), F.expr("d.l[0].x[0]").alias("in_list"), F.col("d.t").alias("kind"))


def _all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    found = R.preset_hits(pages).unionByName(R.keyword_hits(pages, KEYWORDS))
    rect = R.rect_hits(view(spark, sf_dir, "f_spans"), _rects(spark, sf_dir))
    rect = rect.select("doc_id", F.col("page_no").cast("bigint").alias("page_no"), F.lit("rect").alias("source"), F.lit(None).cast("string").alias("preset"), F.col("text").alias("literal"))
    return found.unionByName(rect)


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets, keywords and rectangles that hit, and attachments that go, of each document."""
    attached = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))
    return R.redaction_report(_all_hits(spark, sf_dir), _pages(spark, sf_dir), attachments=attached)


def redaction_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return R.outcome(pages, R.keyword_hits(pages, KEYWORDS))


_ALL = (
    page_order_reasons, page_order_accepted, page_split_reasons, page_split_accepted, survey_rules, original_files, retention_list,
    fault_messages, finite_deep, redaction_counts, redaction_outcome,
)
QUERIES = {f.__name__: f for f in _ALL}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_N = "d AS (SELECT doc_id, count(*) AS n_pages FROM f_doc_pages GROUP BY doc_id)"
_TRIMMED = "list_filter(list_transform(string_split({}, ','), lambda x: trim(x)), lambda x: x <> '')"
_ORDER = f"""
{_N}, s AS (SELECT *, {_TRIMMED.format(f"({_list(ORDERS)})[doc_id % {len(ORDERS)} + 1]")} AS items FROM d),
w AS (SELECT *, list_filter(list_transform(items, lambda x: CASE WHEN len(string_split(x, ':')) > 2 OR NOT regexp_matches(string_split(x, ':')[1], '^[+-]?[0-9]+$') THEN 'format'
  WHEN TRY_CAST(string_split(x, ':')[1] AS BIGINT) < 1 OR TRY_CAST(string_split(x, ':')[1] AS BIGINT) > n_pages THEN 'range'
  WHEN contains(x, ':') AND string_split(x, ':')[2] NOT IN ('90', '180', '270') THEN 'angle' END), lambda r: r IS NOT NULL) AS wrong FROM s),
o AS (SELECT *, CASE WHEN len(items) = 0 THEN 'empty' WHEN len(wrong) > 0 THEN wrong[1] WHEN len(items) > 1000 THEN 'too_many' END AS reason FROM w)"""
_K = f"doc_id % {len(SPLITS)} + 1"
_SPLIT = f"""
{_N}, v AS (SELECT *, ({_list(m for m, _ in SPLITS)})[{_K}] AS mode, ({_list(v for _, v in SPLITS)})[{_K}] AS value FROM d),
s AS (SELECT *, {_TRIMMED.format("value")} AS items FROM v),
w AS (SELECT *, list_filter(list_transform(items, lambda x: CASE WHEN NOT regexp_matches(x, '^[0-9]{{1,18}}(-[0-9]{{1,18}})?$') THEN 'format'
  WHEN contains(x, '-') AND TRY_CAST(string_split(x, '-')[1] AS BIGINT) > TRY_CAST(string_split(x, '-')[2] AS BIGINT) THEN 'backwards'
  WHEN TRY_CAST(string_split(x, '-')[1] AS BIGINT) > n_pages OR (NOT contains(x, '-') AND TRY_CAST(x AS BIGINT) < 1) THEN 'range' END), lambda r: r IS NOT NULL) AS wrong FROM s),
o AS (SELECT *, CASE WHEN mode = 'ranges' THEN CASE WHEN length(value) > 4096 THEN 'too_long' WHEN len(items) > 200 THEN 'too_many' ELSE wrong[1] END
  WHEN mode = 'fixed' THEN CASE WHEN value <> '' AND NOT coalesce(TRY_CAST(value AS BIGINT) >= 1, false) THEN 'fixed' END WHEN mode <> 'all' THEN 'mode' END AS reason FROM w)"""
_KEY = " + ".join(f"(length(text) - length(replace(text, '{k}', ''))) // {len(k)}" for k in KEYWORDS)

ORACLES = {
    "page_order_reasons": duck(f"WITH {_ORDER} SELECT doc_id, n_pages, reason FROM o", "f_doc_pages"),
    "page_order_accepted": duck(
        f"""WITH {_ORDER}, i AS (SELECT doc_id, n_pages, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS pos FROM o WHERE reason IS NULL)
SELECT doc_id, pos, CAST(string_split(item, ':')[1] AS BIGINT) AS page_no, CASE WHEN contains(item, ':') THEN CAST(string_split(item, ':')[2] AS INT) ELSE 0 END AS angle FROM i""",
        "f_doc_pages",
    ),
    "page_split_reasons": duck(f"WITH {_SPLIT} SELECT doc_id, mode, n_pages, reason FROM o", "f_doc_pages"),
    "page_split_accepted": duck(
        f"""WITH {_SPLIT}, g AS (SELECT * FROM o WHERE reason IS NULL), i AS (SELECT doc_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS part_no FROM g WHERE mode = 'ranges')
SELECT doc_id, CASE WHEN mode = 'all' OR value = '' THEN page_no ELSE (page_no + CAST(value AS BIGINT) - 1) // CAST(value AS BIGINT) END AS part_no, page_no FROM g JOIN f_doc_pages USING (doc_id) WHERE mode <> 'ranges'
UNION ALL SELECT i.doc_id, part_no, page_no FROM i JOIN f_doc_pages p ON p.doc_id = i.doc_id AND page_no BETWEEN CAST(string_split(item, '-')[1] AS BIGINT) AND CAST(string_split(item, '-')[-1] AS BIGINT)""",
        "f_doc_pages",
    ),
    "survey_rules": duck(
        """
SELECT arrival, concat_ws(',', CASE WHEN arrival % 5 = 0 THEN 'frequency' END, CASE WHEN arrival % 7 = 0 THEN 'pricing_model' END, CASE WHEN arrival % 11 = 0 THEN 'price_range' END,
  CASE WHEN arrival % 13 = 0 THEN 'usage_scenario' END, CASE WHEN arrival % 17 = 0 THEN 'page_path' END, CASE WHEN arrival % 19 = 0 THEN 'schema_version' END, CASE WHEN arrival % 23 = 0 THEN 'contact' END,
  CASE WHEN arrival % 29 = 0 THEN 'features' END, CASE WHEN arrival % 37 = 0 THEN 'extra:bot_trap' END) AS rules FROM f_survey""",
        "f_survey",
    ),
    "original_files": """
WITH f AS (SELECT CASE l_partkey % 5 WHEN 0 THEN 'input_' || l_partkey WHEN 1 THEN 'Invoice_' || l_partkey WHEN 2 THEN 'merged_invoices.pdf' WHEN 3 THEN 'INPUT' || l_partkey ELSE 'result_' || l_partkey END AS name FROM lineitem)
SELECT name, count(*) AS n FROM f WHERE lower(name) LIKE 'input%' OR (lower(name) LIKE 'invoice\\_%' ESCAPE '\\' AND lower(name) <> 'merged_invoices.pdf') GROUP BY name""",
    "retention_list": duck(
        f"WITH {_STALE} SELECT action, out_trade_no, epoch_us(CASE action WHEN 'delete' THEN created_at ELSE fulfilled_at END) AS at FROM s WHERE action <> 'keep'",
        "f_pay_orders",
    ),
    "fault_messages": """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '缺少必填参数' WHEN 1 THEN '应为整数' WHEN 2 THEN '数值超过上限' WHEN 3 THEN '数值无效（不接受 NaN/Infinity）' ELSE event_type END AS message FROM events""",
    "finite_deep": "SELECT event_id, CASE WHEN event_id % 7 > 1 THEN value END AS in_map, CAST(1.0 AS DOUBLE) AS other, CASE WHEN event_id % 7 > 1 THEN value END AS in_list, event_type AS kind FROM events",
    "redaction_counts": duck(
        f"""WITH {_HITS}, {_RECTS}, k AS (SELECT *, {_KEY} AS n_key FROM h),
p AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (length(trim(coalesce(text, ''))) < 5) AS image_pages, CAST(sum(n_id) AS BIGINT) AS n_id, CAST(sum(n_phone) AS BIGINT) AS n_phone,
  CAST(sum(n_email) AS BIGINT) AS n_email, CAST(sum(n_key) AS BIGINT) AS n_keyword FROM k GROUP BY doc_id),
q AS (SELECT s.doc_id, count(*) AS n_rect FROM f_spans s JOIN r ON {_OVER} GROUP BY s.doc_id), c AS (SELECT conv_id AS doc_id, count(*) AS n_attachments FROM conversations GROUP BY 1)
SELECT p.*, coalesce(n_rect, 0) AS n_rect, coalesce(n_attachments, 0) AS n_attachments FROM p LEFT JOIN q USING (doc_id) LEFT JOIN c USING (doc_id)""",
        "f_doc_pages",
        "f_spans",
    ),
    "redaction_outcome": duck(f"SELECT doc_id, CAST(sum({_KEY}) AS BIGINT) AS n_hits, CASE WHEN sum({_KEY}) = 0 THEN 'no_hit_keywords' END AS reason FROM f_doc_pages GROUP BY doc_id", "f_doc_pages"),
}
