"""Queries of the invoice ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import invoices as I
from ..functions import names as N
from ..functions import text as X
from ..operators import ledger as L
from .views import duck, table, view


def dedup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dedup_tickets(view(spark, sf_dir, "f_tickets"), view(spark, sf_dir, "f_ledger"))


def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dedup_summary(dedup_status(spark, sf_dir))


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger_entries(view(spark, sf_dir, "f_tickets"))


def amount_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("row_no") % 3 == 0, F.lit("¥")).when(F.col("row_no") % 3 == 1, F.lit("￥ ")).otherwise(F.lit("")), F.col("amount"))
    raw = F.when(F.col("row_no") % 7 == 0, F.regexp_replace(raw, "\\.[0-9]+$", "")).when(F.col("row_no") % 11 == 0, F.concat(raw, F.lit("x"))).otherwise(raw)
    t = view(spark, sf_dir, "f_tickets").withColumn("raw", raw)
    return t.select("batch_id", "row_no", I.clean_amount_fixed2(F.col("raw")).alias("fixed2"), I.clean_amount_keep(F.col("raw")).alias("kept"))


def amount_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "f_records")
    return r.select("rec_id", I.add_amounts(F.col("amount_without_tax"), F.col("tax_amount")).alias("total"), I.add_amounts(F.col("total_with_tax"), F.lit(None).cast("string")).alias("one_side"))


def invoice_no_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "f_tickets")
    n, c = F.col("number"), F.col("code")
    return t.select("batch_id", "row_no", I.is_valid_e_invoice_no(n).alias("electronic"), I.is_classic_no(n).alias("classic_no"), I.is_classic_code(c).alias("classic_code"), I.tax_id_ok(n).alias("tax_id"), I.make_key(n, c).alias("key"))


def dates_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    y, m, d = (F.date_format("d", f) for f in ("yyyy", "MM", "dd"))
    bad = F.when(F.col("o_orderkey") % 5 == 0, F.lit("13")).otherwise(m)
    name = F.concat(F.lit("dzfp_"), F.col("o_orderkey").cast("string"), F.lit("_"), y, bad, d, F.lit("095513.ofd"))
    text = F.concat(F.lit("开票 2026年13月1日 于 20"), F.substring(y, 3, 2), F.lit("年"), m.cast("int").cast("string"), F.lit("月"), d.cast("int").cast("string"), F.lit("日 止"))
    form = F.when(F.col("o_orderkey") % 4 == 0, F.concat_ws("-", y, bad, d)).when(F.col("o_orderkey") % 4 == 1, F.concat(y, bad, d)).when(F.col("o_orderkey") % 4 == 2, F.concat_ws("/", y, bad, d)).otherwise(F.concat(y, F.lit("年"), bad, F.lit("月"), d, F.lit("日")))
    return o.select("o_orderkey", I.date_from_file_name(name).alias("by_name"), I.cn_date_from_text(text).alias("in_text"), I.normalize_date(form).alias("normal"))


def record_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "f_records")
    w = I.record_warnings(*(F.col(c) for c in ("invoice_number", "issue_date", "amount_without_tax", "tax_amount", "total_with_tax")))
    return r.select("rec_id", F.array_join(w, ";").alias("warnings"))


def same_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.same_number(view(spark, sf_dir, "f_records")).select("rec_id", "n_same", "same_number")


def target_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.name_of(view(spark, sf_dir, "f_records"), F.lit(".pdf"), prefix=F.repeat(F.lit("p"), (F.col("rec_id") % 60).cast("int")), kind=F.col("invoice_type"), total=F.col("total_with_tax"))
    return r.select("rec_id", "target", "truncated", N.extension(F.col("source_file")).alias("ext"))


def _raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "f_records")
    name = F.when(F.col("rec_id") % 9 == 0, F.concat(F.lit("n"), (F.col("rec_id") % 4).cast("string"), F.lit("__2.pdf"))).when(F.col("rec_id") % 10 == 0, F.lit("plain")).otherwise(F.concat(F.lit("n"), (F.col("rec_id") % 4).cast("string"), F.lit(".pdf")))
    return r.select("rec_id", "batch_id", name.alias("name"))


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unique_names(_raw_names(spark, sf_dir), "batch_id", "name", "rec_id").select("rec_id", "batch_id", "unique_name")


def placed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records; each third one is rejected, so that rejected and accepted ones share names."""
    rows = _raw_names(spark, sf_dir).withColumn("rejected", F.col("rec_id") % 3 == 0)
    return L.placed_names(rows, "batch_id", "name", "rec_id", "rejected").select("rec_id", "batch_id", "rejected", "unique_name")


def cells_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "f_records")
    cell = F.when(F.col("rec_id") % 3 == 0, F.concat(F.lit("="), F.col("buyer_name"))).when(F.col("rec_id") % 3 == 1, F.concat(F.col("buyer_name"), F.lit('"x'))).otherwise(F.lit("  "))
    return r.select("rec_id", X.sanitize_cell(cell).alias("safe"), X.excel_text(cell).alias("formula"), X.cell_value(cell).alias("cell"), X.as_number(F.concat(F.lit("¥"), F.col("tax_amount"))).alias("number"))


def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "f_records")
    label = F.concat(F.lit("名称："), F.when(F.col("rec_id") % 2 == 0, F.lit("陈秋生")).otherwise(F.col("buyer_name")))
    kind = F.concat(F.coalesce("invoice_type", F.lit("普通发票")), F.lit(" 第一联"))
    return r.select("rec_id", I.detect_invoice_type(kind).alias("kind"), I.type_short_label(F.col("invoice_type")).alias("short"), I.strip_label(label).alias("name"), I.looks_like_name(label).alias("is_name"), X.has_cjk(F.col("buyer_name")).alias("cjk"))


def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "f_records")
    reason = F.when(F.col("invoice_number") == "123", F.lit("bad_number")).when(F.col("total_with_tax").isNull(), F.lit("no_total"))
    r = r.withColumn("reason", reason)
    return L.extract_summary(r.where("reason IS NULL"), r.where("reason IS NOT NULL"))


def record_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "f_records")
    xml = r.where("rec_id % 3 = 0").select("rec_id", "invoice_number", "buyer_name", F.lit("xml").alias("format"))
    ofd = r.where("rec_id % 3 = 1").select("rec_id", "invoice_number", F.lit("ofd").alias("format"))
    pdf = r.where("rec_id % 3 = 2").select("rec_id", "invoice_number", "issue_date", F.lit("pdf").alias("format"))
    return L.one_shape(xml, ofd, pdf)


def export_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.export_limits(view(spark, sf_dir, "f_records").select("invoice_number", "issue_date", "buyer_name", "total_with_tax"))


QUERIES = {f.__name__: f for f in (dedup_status, dedup_summary, ledger_entries, amount_clean, amount_add, invoice_no_check, dates_from_text, record_warnings, same_number, target_names, unique_names, placed_names, cells_export, text_fields, extract_summary, record_union, export_limits)}

_KEYED = """
CASE WHEN coalesce(number, '') = '' THEN '' WHEN regexp_matches(coalesce(code, ''), '^[0-9]{10,12}$') THEN code || '-' || number ELSE number END"""
_STATUS = f"""
WITH t AS (SELECT *, {_KEYED} AS key, coalesce(amount, '') AS amt FROM f_tickets),
w AS (SELECT *, row_number() OVER (PARTITION BY batch_id, key, file_ref ORDER BY row_no) AS nth,
  min(row_no) OVER (PARTITION BY batch_id, key) AS first_row,
  first_value(amt) OVER (PARTITION BY batch_id, key ORDER BY row_no) AS first_amount FROM t),
l AS (SELECT key, arg_min(amount, ord) AS ledger_amount, arg_min(first_name, ord) AS first_name, arg_min(first_day, ord) AS first_day
  FROM (SELECT *, {_KEYED} AS key FROM f_ledger) GROUP BY key),
s AS (SELECT batch_id, row_no, file_ref, w.key, amt AS amount,
  CASE WHEN w.key = '' THEN 'unrecognized' WHEN nth > 1 THEN 'duplicate'
    WHEN l.key IS NOT NULL THEN CASE WHEN amt <> '' AND amt <> ledger_amount THEN 'suspicious' ELSE 'duplicate' END
    WHEN row_no > first_row THEN CASE WHEN amt <> '' AND first_amount <> '' AND amt <> first_amount THEN 'suspicious' ELSE 'duplicate' END
    ELSE 'ok' END AS status,
  CASE WHEN w.key = '' THEN NULL WHEN nth > 1 THEN 'file' WHEN l.key IS NOT NULL THEN 'ledger:' || first_name || '@' || first_day
    WHEN row_no > first_row THEN 'row:' || CAST(first_row AS STRING) END AS note
  FROM w LEFT JOIN l ON w.key = l.key)"""

_UNIQUE = """
WITH n AS (SELECT rec_id, batch_id, CASE WHEN rec_id % 9 = 0 THEN 'n' || CAST(rec_id % 4 AS STRING) || '__2.pdf' WHEN rec_id % 10 = 0 THEN 'plain' ELSE 'n' || CAST(rec_id % 4 AS STRING) || '.pdf' END AS name FROM f_records),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, name ORDER BY rec_id) AS nth, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM n),
a AS (SELECT batch_id, list(DISTINCT name) AS names FROM n GROUP BY batch_id)
SELECT rec_id, r.batch_id, CASE WHEN nth = 1 THEN name ELSE stem || '__' || CAST(list_filter(range(2, 2 + nth + len(names)), lambda k: NOT list_contains(names, stem || '__' || CAST(k AS STRING) || substr(name, length(stem) + 1)))[nth - 1] AS STRING) || substr(name, length(stem) + 1) END AS unique_name
FROM r JOIN a USING (batch_id)"""

_SERIAL = "list_filter(range(2, 2 + nth + len(names)), lambda k: NOT list_contains(names, stem || '__' || CAST(k AS STRING) || ext))[nth - 1]"
_PLACED = f"""
WITH n AS (SELECT rec_id, batch_id, rec_id % 3 = 0 AS rejected, CASE WHEN rec_id % 9 = 0 THEN 'n' || CAST(rec_id % 4 AS STRING) || '__2.pdf' WHEN rec_id % 10 = 0 THEN 'plain' ELSE 'n' || CAST(rec_id % 4 AS STRING) || '.pdf' END AS name FROM f_records),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, rejected, name ORDER BY rec_id) AS nth, regexp_replace(name, '\\.[^.]*$', '') AS stem, substr(name, length(stem) + 1) AS ext FROM n),
a AS (SELECT batch_id, list(DISTINCT name) FILTER (NOT rejected) AS names FROM n GROUP BY batch_id),
u AS (SELECT r.*, CASE WHEN nth = 1 THEN name ELSE stem || '__' || CAST({_SERIAL} AS STRING) || ext END AS unique_name FROM r JOIN a USING (batch_id) WHERE NOT rejected),
p AS (SELECT batch_id, list(unique_name) AS placed FROM u GROUP BY batch_id),
b AS (SELECT batch_id, list(DISTINCT name) AS own FROM n WHERE rejected GROUP BY batch_id),
s AS (SELECT r.* EXCLUDE (nth), nth + CASE WHEN list_contains(coalesce(placed, []), name) THEN 1 ELSE 0 END AS nth, list_concat(coalesce(placed, []), own) AS names FROM r JOIN b USING (batch_id) LEFT JOIN p USING (batch_id) WHERE rejected)
SELECT rec_id, batch_id, rejected, unique_name FROM u
UNION ALL SELECT rec_id, batch_id, rejected, CASE WHEN nth = 1 THEN name ELSE stem || '__' || CAST({_SERIAL} AS STRING) || ext END FROM s"""

_SAFE = lambda c, n: f"CASE WHEN {c} IS NULL THEN '' ELSE substr(CASE WHEN {c} = 'CON' THEN '_CON' ELSE replace(regexp_replace({c}, '[/:]', '_', 'g'), '..', '_') END, 1, {n}) END"

ORACLES = {
    "dedup_status": duck(_STATUS + " SELECT * FROM s", "f_tickets", "f_ledger"),
    "dedup_summary": duck(
        _STATUS + " SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'duplicate') AS n_duplicate, count(*) FILTER (status = 'suspicious') AS n_suspicious, count(*) FILTER (status = 'unrecognized') AS n_unrecognized FROM s GROUP BY ROLLUP (batch_id)",
        "f_tickets",
        "f_ledger",
    ),
    "ledger_entries": duck(f"SELECT batch_id, key, min(row_no) AS row_no, arg_min(file_ref, row_no) AS file_ref, arg_min(amt, row_no) AS amount FROM (SELECT *, {_KEYED} AS key, coalesce(amount, '') AS amt FROM f_tickets) WHERE key <> '' GROUP BY batch_id, key", "f_tickets"),
    "amount_clean": duck(
        """
WITH p AS (SELECT *, CASE row_no % 3 WHEN 0 THEN '¥' WHEN 1 THEN '￥ ' ELSE '' END || amount AS r0 FROM f_tickets),
q AS (SELECT *, CASE WHEN row_no % 7 = 0 THEN regexp_replace(r0, '\\.[0-9]+$', '') WHEN row_no % 11 = 0 THEN r0 || 'x' ELSE r0 END AS raw FROM p),
c AS (SELECT *, regexp_replace(raw, '[¥￥, ]', '', 'g') AS t FROM q)
SELECT batch_id, row_no,
  CASE WHEN regexp_matches(t, '^-?[0-9]+(\\.[0-9]{1,2})?$') THEN split_part(t, '.', 1) || '.' || rpad(split_part(t, '.', 2), 2, '0') END AS fixed2,
  CASE WHEN regexp_matches(t, '^-?[0-9]{1,12}(\\.[0-9]{1,2})?$') THEN CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) || '.' || rpad(split_part(t, '.', 2), 2, '0') ELSE t END END AS kept
FROM c""",
        "f_tickets",
    ),
    "amount_add": duck("SELECT rec_id, CAST(CAST(amount_without_tax AS DECIMAL(14,2)) + CAST(tax_amount AS DECIMAL(14,2)) AS STRING) AS total, total_with_tax AS one_side FROM f_records", "f_records"),
    "invoice_no_check": duck(
        f"""
SELECT batch_id, row_no,
  coalesce(regexp_matches(number, '^[0-9]{{20}}$') AND substr(number, 1, 2) BETWEEN '23' AND '28' AND substr(number, 3, 2) BETWEEN '11' AND '65', false) AS electronic,
  coalesce(regexp_matches(number, '^[0-9]{{8}}$'), false) AS classic_no, coalesce(regexp_matches(code, '^[0-9]{{10,12}}$'), false) AS classic_code,
  coalesce(regexp_matches(number, '^[0-9A-HJ-NP-RT-UW-Y]{{15,20}}$'), false) AS tax_id, {_KEYED} AS key FROM f_tickets""",
        "f_tickets",
    ),
    "dates_from_text": """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS by_name,
  '20' || substr(strftime(o_orderdate, '%Y-%m-%d'), 3) AS in_text, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS normal FROM orders""",
    "record_warnings": duck(
        """
SELECT rec_id, concat_ws(';', CASE WHEN NOT regexp_matches(invoice_number, '^[0-9]{20}$') THEN 'number_not_20_digits' END, CASE WHEN issue_date IS NULL THEN 'no_date' END,
  CASE WHEN abs(CAST(amount_without_tax AS DECIMAL(14,2)) + CAST(tax_amount AS DECIMAL(14,2)) - CAST(total_with_tax AS DECIMAL(14,2))) > 0.02 THEN 'amounts_differ' END,
  CASE WHEN total_with_tax IS NULL THEN 'no_total' END) AS warnings FROM f_records""",
        "f_records",
    ),
    "same_number": duck("SELECT rec_id, count(*) OVER (PARTITION BY batch_id, invoice_number) AS n_same, count(*) OVER (PARTITION BY batch_id, invoice_number) > 1 AS same_number FROM f_records", "f_records"),
    "target_names": duck(
        f"""
WITH p AS (SELECT rec_id, substr(repeat('p', CAST(rec_id % 60 AS BIGINT)), 1, 50) AS p,
  concat_ws('_', {_SAFE('invoice_number', 20)}, {_SAFE('buyer_name', 30)}, issue_date,
    CASE WHEN contains(invoice_type, '专用发票') THEN '专票' WHEN contains(invoice_type, '普通发票') THEN '普票' END, total_with_tax || '元') AS s FROM f_records),
q AS (SELECT *, length(p) + length(s) + 4 > 100 AS truncated FROM p),
c AS (SELECT *, CASE WHEN truncated THEN substr(p, 1, greatest(0, 96 - length(s))) ELSE p END AS p2 FROM q)
SELECT rec_id, p2 || CASE WHEN truncated AND length(s) > 96 - length(p2) THEN regexp_replace(substr(s, 1, 96 - length(p2)), '[._ ]+$', '') ELSE s END || '.pdf' AS target, truncated, '.pdf' AS ext FROM c""",
        "f_records",
    ),
    "unique_names": duck(_UNIQUE, "f_records"),
    "placed_names": duck(_PLACED, "f_records"),
    "cells_export": duck(
        """
WITH c AS (SELECT *, CASE rec_id % 3 WHEN 0 THEN '=' || buyer_name WHEN 1 THEN buyer_name || '"x' ELSE '  ' END AS c FROM f_records)
SELECT rec_id, CASE WHEN c[1] = '=' THEN '''' || c ELSE c END AS safe, '="' || replace(c, '"', '""') || '"' AS formula, CASE WHEN trim(c) <> '' THEN c END AS cell, CAST(tax_amount AS DOUBLE) AS number FROM c""",
        "f_records",
    ),
    "text_fields": duck(
        """
SELECT rec_id, coalesce(invoice_type, '电子发票（普通发票）') AS kind, CASE WHEN contains(invoice_type, '专用发票') THEN '专票' WHEN contains(invoice_type, '普通发票') THEN '普票' ELSE '' END AS short,
  CASE WHEN rec_id % 2 = 0 THEN '陈秋生' ELSE trim(buyer_name) END AS name, rec_id % 2 = 0 AS is_name, false AS cjk FROM f_records""",
        "f_records",
    ),
    "extract_summary": duck(
        """
WITH r AS (SELECT batch_id, CASE WHEN invoice_number = '123' THEN 'bad_number' WHEN total_with_tax IS NULL THEN 'no_total' END AS reason FROM f_records),
b AS (SELECT batch_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY batch_id, reason),
s AS (SELECT batch_id, CAST(sum(n) AS BIGINT) AS n_bad, string_agg(reason || '=' || CAST(n AS STRING), ',' ORDER BY reason) AS reasons FROM b GROUP BY batch_id)
SELECT batch_id, count(*) FILTER (reason IS NULL) AS n_good, coalesce(any_value(n_bad), 0) AS n_bad, coalesce(any_value(reasons), '') AS reasons FROM r LEFT JOIN s USING (batch_id) GROUP BY batch_id""",
        "f_records",
    ),
    "record_union": duck("SELECT rec_id, invoice_number, CASE WHEN rec_id % 3 = 0 THEN buyer_name END AS buyer_name, CASE rec_id % 3 WHEN 0 THEN 'xml' WHEN 1 THEN 'ofd' ELSE 'pdf' END AS format, CASE WHEN rec_id % 3 = 2 THEN issue_date END AS issue_date FROM f_records", "f_records"),
    "export_limits": duck("SELECT count(*) AS n_rows, CAST(coalesce(sum(length(invoice_number) + coalesce(length(issue_date), 0) + length(buyer_name) + coalesce(length(total_with_tax), 0)), 0) AS BIGINT) AS n_chars, count(*) <= 10000 AND n_chars <= 20000000 AS allowed FROM f_records", "f_records"),
}
