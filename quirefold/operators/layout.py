"""Fields from placed texts: zones, best spans, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import invoices as I

# fixed values: zones of the official layout in points (name, y from, y below, x from)
ZONES = (
    ("number_date", 24.0, 64.0, 400.0),
    ("name", 86.0, 114.0, 0.0),
    ("tax_id", 114.0, 150.0, 0.0),
    ("items", 150.0, 254.0, 0.0),
    ("totals", 248.0, 272.0, 0.0),
    ("vat", 272.0, 296.0, 0.0),
    ("remark", 296.0, 354.0, 0.0),
)
MIDDLE = 298.0


def in_zones(spans: DataFrame) -> DataFrame:
    """A row for each zone that the middle of a span lies in, half open; and its side. The zones are constants."""
    mid = (F.col("y0") + F.col("y1")) / 2
    zones = F.array_compact(F.array(*(F.when((mid >= a) & (mid < b) & (F.col("x0") >= x), F.lit(z)) for z, a, b, x in ZONES)))
    side = F.when((F.col("x0") + F.col("x1")) / 2 < MIDDLE, F.lit("buyer")).otherwise(F.lit("seller"))
    return spans.select("*", side.alias("side"), F.explode(zones).alias("zone"))


def zone_fields(spans: DataFrame) -> DataFrame:
    """One row a page: the number, the widest name of either side, the first tax id of either, leftmost and rightmost of
    the totals, the rightmost grand total, items counted, and the remark in reading order. Ties go by place, then text."""
    z = in_zones(spans).withColumn("clean", I.strip_label(F.col("text")))
    amount = F.col("text").rlike(I.AMOUNT_SPAN)
    value = I.clean_amount_keep(F.regexp_extract("text", I.AMOUNT_SPAN, 1))
    here = lambda zone, cond=F.lit(True): (F.col("zone") == zone) & cond
    place = F.struct("y0", "x0", "text")
    width = lambda side: F.max_by(F.when(here("name", I.looks_like_name(F.col("text")) & (F.col("side") == side)), F.col("clean")), F.when(here("name", I.looks_like_name(F.col("text")) & (F.col("side") == side)), F.struct(F.col("x1") - F.col("x0"), -F.col("y0"), -F.col("x0"), F.col("text"))))
    tax = lambda side: F.min_by("clean", F.when(here("tax_id", I.tax_id_ok(F.col("clean")) & (F.col("side") == side)), place))
    digits = F.regexp_extract("clean", "[0-9]{20}", 0)
    total = here("totals", amount)
    n_total = F.count_if(total)
    left = F.min_by(value, F.when(total, F.struct("x0", "y0", "text")))
    right = F.max_by(value, F.when(total, F.struct("x0", "y0", "text")))
    remark = here("remark", ~amount & ~F.col("text").rlike("^[备注]\\s*$") & ~F.contains(F.col("text"), F.lit("下载次数")))
    agg = z.groupBy("doc_id", "page_no").agg(
        F.min_by(digits, F.when(here("number_date", digits != ""), place)).alias("invoice_number"),
        width("buyer").alias("buyer_name"),
        width("seller").alias("seller_name"),
        tax("buyer").alias("buyer_tax_id"),
        tax("seller").alias("seller_tax_id"),
        F.when(n_total >= 2, left).alias("amount_without_tax"),
        F.when(n_total >= 2, right).alias("tax_amount"),
        F.max_by(value, F.when(here("vat", amount), F.struct("x0", "y0", "text"))).alias("total_with_tax"),
        F.nullif(F.count_if(here("items", F.startswith(F.col("text"), F.lit("*")))), F.lit(0)).alias("item_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(remark, place))), lambda p: p["text"]), " ").alias("remark"),
    )
    return agg.withColumn("remark", F.when(F.trim("remark") != "", F.trim("remark")))


# fixed values: zones of the fixed-layout form in millimetres (name, y from, y below, x from as a share of the page's width)
FIXED_ZONES = (
    ("name", 26.0, 46.0, 0.0),
    ("tax_id", 38.0, 60.0, 0.0),
    ("items", 55.0, 92.0, 0.0),
    ("totals", 88.0, 98.0, 0.0),
    ("vat", 96.0, 113.0, 0.55),
)


def fixed_zone_fields(placed: DataFrame) -> DataFrame:
    """placed (doc_id, pos, x, y, text, page_width), in millimetres, pos the order in the file: a record a document. The
    first text of 20 digits is the number, the shortest text that is a date the date; the first tax id from the left of
    either half of the page, but for the number; the longest name of either half; leftmost and rightmost of two totals or
    more; the rightmost grand total of the right part; items counted; the kind from all texts. Ties go from left to
    right, then by the order in the file. reason: unsupported, if neither a number nor a grand total was found."""
    text, mid = F.col("text"), F.col("page_width") / 2
    zones = F.array_compact(F.array(*(F.when((F.col("y") >= a) & (F.col("y") < b) & (F.col("x") >= F.col("page_width") * x), F.lit(z)) for z, a, b, x in FIXED_ZONES)))
    label = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), I.NAME_LABEL, ""))
    p = placed.select(
        "doc_id", "pos", "x", text, zones.alias("zones"), label.alias("clean"), F.when(F.col("x") < mid, "buyer").otherwise("seller").alias("side"),
        text.rlike("^[0-9]{20}$").alias("is_number"), text.rlike("^[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日$").alias("is_date"), I.tax_id_ok(text).alias("is_tax"),
        I.looks_like_name(text, I.NAME_LABEL, I.NAME_EXCLUDE).alias("is_name"), I.clean_amount_keep(text).alias("amount"),
    )
    here = lambda zone: F.array_contains("zones", zone)
    left = F.struct("x", "pos")
    name = lambda side: F.max_by("clean", F.when(here("name") & F.col("is_name") & (F.col("side") == side), F.struct(F.length("text"), -F.col("x"), -F.col("pos"))))
    taxes = lambda side: F.array_sort(F.collect_list(F.when(here("tax_id") & F.col("is_tax") & (F.col("side") == side), F.struct("x", "pos", "text"))))
    total = here("totals") & F.col("amount").isNotNull()
    agg = p.groupBy("doc_id").agg(
        F.min_by("text", F.when(F.col("is_number"), F.col("pos"))).alias("invoice_number"),
        I.normalize_date(F.min_by("text", F.when(F.col("is_date"), F.struct(F.length("text"), "pos")))).alias("issue_date"),
        name("buyer").alias("buyer_name"),
        name("seller").alias("seller_name"),
        taxes("buyer").alias("buyer_taxes"),
        taxes("seller").alias("seller_taxes"),
        F.when(F.count_if(total) >= 2, F.min_by("amount", F.when(total, left))).alias("amount_without_tax"),
        F.when(F.count_if(total) >= 2, F.max_by("amount", F.when(total, left))).alias("tax_amount"),
        F.max_by("amount", F.when(here("vat") & F.col("amount").isNotNull(), F.struct(F.col("x"), -F.col("pos")))).alias("total_with_tax"),
        F.nullif(F.count_if(here("items") & F.startswith("text", F.lit("*"))), F.lit(0)).alias("item_count"),
        I.detect_invoice_type(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), "")).alias("invoice_type"),
    )
    first = lambda c: F.get(F.filter(c, lambda t: F.col("invoice_number").isNull() | (t["text"] != F.col("invoice_number"))), F.lit(0))["text"]
    agg = agg.withColumn("buyer_tax_id", first("buyer_taxes")).withColumn("seller_tax_id", first("seller_taxes")).drop("buyer_taxes", "seller_taxes")
    return agg.withColumn("reason", F.when(F.col("invoice_number").isNull() & F.col("total_with_tax").isNull(), "unsupported"))


def resolve_references(tags: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_id, field, text, last_amount): the texts of the objects that a field's tags name, in order, and the last of
    them that looks like an amount."""
    t = tags.join(objects.select(F.col("doc_id").alias("__d"), F.col("obj_id").alias("__o"), F.col("text").alias("__t")), (F.col("doc_id") == F.col("__d")) & (F.col("obj_id") == F.col("__o")))
    amount = F.when(F.col("__t").rlike(I.AMOUNT_SPAN), F.col("pos"))
    g = t.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("__t").alias("t")))).alias("all"), F.max_by("__t", amount).alias("last_amount"))
    return g.select("doc_id", "field", F.array_join(F.transform("all", lambda x: x["t"]), "").alias("text"), "last_amount")


def single_page(candidates: DataFrame) -> DataFrame:
    """(doc_id, page_no, reason): the one page of a document that yields a record; several are named, none gives the first
    page's error."""
    ok = F.col("error").isNull()
    g = candidates.groupBy("doc_id").agg(F.count_if(ok).alias("n"), F.sort_array(F.collect_set(F.when(ok, F.col("page_no")))).alias("pages"), F.min_by("error", F.when(~ok, F.col("page_no"))).alias("first"))
    listed = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")
    return g.select("doc_id", F.when(F.col("n") == 1, F.get("pages", F.lit(0))).alias("page_no"), F.when(F.col("n") > 1, F.concat(F.lit("several:"), listed)).when(F.col("n") == 0, F.col("first")).alias("reason"))
