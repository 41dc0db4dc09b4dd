"""Relations of pages: select, remove, reorder, split, number, impose, concatenate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pages import normalize_rotation


def with_total(pages: DataFrame) -> DataFrame:
    return pages.withColumn("n_pages", F.max("page_no").over(Window.partitionBy("doc_id")))


def numbers_of(spec: Column, n_pages: Column) -> Column:
    """Page numbers of a text such as '1,3-5', clamped to 1..n before ranges are expanded; each once."""

    def one(part: Column) -> Column:
        a = F.regexp_extract(part, "^([0-9]{1,9})(?:-([0-9]{1,9}))?$", 1).try_cast("int")
        last = F.regexp_extract(part, "^([0-9]{1,9})(?:-([0-9]{1,9}))?$", 2)
        b = F.when(last == "", a).otherwise(last.try_cast("int"))
        lo, hi = F.greatest(a, F.lit(1)), F.least(b, n_pages.cast("int"))
        return F.when(a.isNotNull() & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(spec, "\\s", ""), ","), one)))


def select_pages(pages: DataFrame, spec: Column) -> DataFrame:
    """The pages of each document that its spec names."""
    rows = with_total(pages)
    return rows.where(F.array_contains(numbers_of(spec, F.col("n_pages")), F.col("page_no").cast("int"))).drop("n_pages")


def remove_pages(pages: DataFrame, spec: Column) -> DataFrame:
    """The pages that the spec doesn't name; documents that would have none left are untouched and say so."""
    rows = with_total(pages).withColumn("__gone", F.array_contains(numbers_of(spec, F.col("n_pages")), F.col("page_no").cast("int")))
    left = F.count_if(~F.col("__gone")).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("rejected", left == 0)
    return rows.where(~F.col("__gone") | F.col("rejected")).drop("__gone", "n_pages")


def reorder(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """specs (doc_id, spec): '3,1,2:90'. (doc_id, pos, page_no, angle, ...): repeats stay, pages left out vanish."""
    items = specs.select(F.col("doc_id").alias("__d"), F.posexplode(F.split(F.regexp_replace("spec", "\\s", ""), ",")).alias("pos", "item"))
    items = items.select("__d", (F.col("pos") + 1).alias("pos"), F.split_part("item", F.lit(":"), F.lit(1)).try_cast("bigint").alias("__p"), F.coalesce(F.split_part("item", F.lit(":"), F.lit(2)).try_cast("int"), F.lit(0)).alias("turn"))
    rest = [c for c in pages.columns if c not in ("doc_id", "page_no")]
    return items.join(pages, (F.col("doc_id") == F.col("__d")) & (F.col("page_no") == F.col("__p"))).select("doc_id", "pos", "page_no", normalize_rotation(F.col("turn")).alias("angle"), *rest)


ANGLES = (90, 180, 270)
MOST_OUTPUT_PAGES, MOST_RANGES, MOST_RANGE_CHARS = 1_000, 200, 4_096
_INT = r"^\s*[+-]?[0-9]{1,18}\s*$"


def _int(s: Column) -> Column:
    return F.when(s.rlike(_INT), F.trim(s).try_cast("bigint"))


def _items(spec: Column) -> Column:
    """The items of a comma list, trimmed; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def _first_reason(items: Column, reason) -> Column:
    return F.get(F.filter(F.transform(items, reason), lambda x: x.isNotNull()), F.lit(0))


def order_reasons(specs: DataFrame, most: int = MOST_OUTPUT_PAGES) -> DataFrame:
    """specs (doc_id, spec, n_pages), spec: '3,1,2:90'. Adds reason, null if the order is accepted: of the first item that
    is wrong (format, range, angle), else empty or too_many."""

    def reason(item: Column) -> Column:
        seg = F.split(item, ":")
        page, angle = _int(F.get(seg, 0)), _int(F.get(seg, 1))
        return (
            F.when((F.size(seg) > 2) | page.isNull(), F.lit("format"))
            .when(~page.between(1, F.col("n_pages")), F.lit("range"))
            .when((F.size(seg) == 2) & ~F.coalesce(angle.isin(*ANGLES), F.lit(False)), F.lit("angle"))
        )

    rows = specs.withColumn("__items", _items(F.col("spec")))
    wrong = F.when(F.size("__items") == 0, F.lit("empty")).otherwise(_first_reason(F.col("__items"), reason))
    return rows.withColumn("reason", F.coalesce(wrong, F.when(F.size("__items") > most, F.lit("too_many")))).drop("__items")


def accepted_order(pages: DataFrame, specs: DataFrame, most: int = MOST_OUTPUT_PAGES) -> DataFrame:
    """(doc_id, pos, page_no, angle): the pages in the orders that order_reasons accepts; other documents have none."""
    good = order_reasons(specs, most).where("reason IS NULL")
    items = good.select("doc_id", F.posexplode(_items(F.col("spec"))).alias("pos", "item"))
    seg = F.split("item", ":")
    rows = items.select("doc_id", (F.col("pos") + 1).alias("pos"), _int(F.get(seg, 0)).alias("page_no"), F.coalesce(_int(F.get(seg, 1)), F.lit(0)).cast("int").alias("angle"))
    return rows.join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"]).select("doc_id", "pos", "page_no", "angle")


def split_reasons(specs: DataFrame) -> DataFrame:
    """specs (doc_id, mode, value, n_pages), mode: all, ranges or fixed. Adds reason, null if the split is accepted: empty,
    mode, fixed, too_long, too_many, or of the first range that is wrong: format, backwards or range."""

    def reason(item: Column) -> Column:
        ends = F.split(item, "-")
        single = ~F.contains(item, F.lit("-"))
        a, b = _int(F.get(ends, 0)), F.when(single, _int(F.get(ends, 0))).otherwise(_int(F.get(ends, 1)))
        inside = (F.greatest(a, F.lit(1)) <= F.least(b, F.col("n_pages"))) & (~single | (a >= 1))
        return F.when((F.size(ends) > 2) | a.isNull() | b.isNull(), F.lit("format")).when(a > b, F.lit("backwards")).when(~inside, F.lit("range"))

    value = F.coalesce("value", F.lit(""))
    rows = specs.withColumn("__items", _items(F.col("value")))
    ranges = F.when(F.length(value) > MOST_RANGE_CHARS, F.lit("too_long")).when(F.size("__items") > MOST_RANGES, F.lit("too_many")).otherwise(_first_reason(F.col("__items"), reason))
    fixed = F.when((value != "") & ~F.coalesce(_int(value) >= 1, F.lit(False)), F.lit("fixed"))
    out = F.when(F.col("n_pages") < 1, F.lit("empty")).when(F.col("mode") == "ranges", ranges).when(F.col("mode") == "fixed", fixed).when(F.coalesce(F.col("mode") != "all", F.lit(True)), F.lit("mode"))
    return rows.withColumn("reason", out).drop("__items")


def accepted_split(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """(doc_id, part_no, page_no) of the splits that split_reasons accepts: each page a part, or parts of `value` pages
    (one if it is blank), or a part for each range, clamped to the document."""
    good = split_reasons(specs).where("reason IS NULL")
    p = pages.select(F.col("doc_id").alias("__d"), "page_no")
    whole = good.where("mode <> 'ranges'").join(p, F.col("doc_id") == F.col("__d"))
    size = F.when(F.col("mode") == "all", F.lit(1)).otherwise(F.coalesce(_int(F.coalesce("value", F.lit(""))), F.lit(1)))
    by_size = whole.select("doc_id", F.ceil(F.col("page_no") / size).cast("bigint").alias("part_no"), "page_no")
    ranges = good.where("mode = 'ranges'").select("doc_id", F.posexplode(_items(F.col("value"))).alias("i", "item"))
    ends = F.split("item", "-")
    ranges = ranges.select("doc_id", (F.col("i") + 1).cast("bigint").alias("part_no"), _int(F.get(ends, 0)).alias("a"), F.coalesce(_int(F.get(ends, 1)), _int(F.get(ends, 0))).alias("b"))
    by_range = ranges.join(p, (F.col("doc_id") == F.col("__d")) & F.col("page_no").between(F.col("a"), F.col("b"))).select("doc_id", "part_no", "page_no")
    return by_size.unionByName(by_range)


def order_rules(specs: DataFrame, available: str, order: str) -> DataFrame:
    """Adds allowed: the order is a subset of what is available, nothing twice."""
    o = F.col(order)
    return specs.withColumn("allowed", (F.size(F.array_distinct(o)) == F.size(o)) & (F.size(F.array_except(o, F.col(available))) == 0) & (F.size(o) > 0))


def split_every(pages: DataFrame, k: int) -> DataFrame:
    return pages.withColumn("part_no", F.ceil(F.col("page_no") / k).cast("bigint"))


def split_ranges(pages: DataFrame, ranges: Column) -> DataFrame:
    """ranges: '1-3,5'; each gives a part, in order. A page may be in several parts; a range beyond the document none."""
    rows = with_total(pages).withColumn("__r", F.split(F.regexp_replace(ranges, "\\s", ""), ","))
    rows = rows.select("*", F.posexplode("__r").alias("__i", "__one")).drop("__r")
    inside = F.array_contains(numbers_of(F.col("__one"), F.col("n_pages")), F.col("page_no").cast("int"))
    return rows.where(inside).withColumn("part_no", (F.col("__i") + 1).cast("bigint")).drop("__i", "__one", "n_pages")


def number_pages(pages: DataFrame, start: int = 1, first: int = 1) -> DataFrame:
    """Adds number: start on page `first`, then on; null before. And n_pages."""
    return with_total(pages).withColumn("number", F.when(F.col("page_no") >= first, F.col("page_no") - first + start))


def ordinals(pages: DataFrame, group: str, file: str, page: str = "page_no") -> DataFrame:
    """Adds ordinal: place of each page in its group, files in order. Offsets are sums of page counts by file, so the
    running sum is over files and not over pages."""
    sizes = pages.groupBy(group, file).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(group).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias("__g"), F.col(file).alias("__f"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    rows = pages.withColumn("__k", F.row_number().over(Window.partitionBy(group, file).orderBy(page)))
    return rows.join(sizes, (F.col(group) == F.col("__g")) & (F.col(file) == F.col("__f"))).withColumn("ordinal", F.col("__before") + F.col("__k")).drop("__g", "__f", "__before", "__k")


def impose(placed: DataFrame, columns: int, rows: int) -> DataFrame:
    """Adds sheet, slot, col and row of a page by its ordinal."""
    i, per = F.col("ordinal") - 1, columns * rows
    slot = F.pmod(i, F.lit(per))
    return placed.withColumn("sheet", F.floor(i / per) + 1).withColumn("slot", slot).withColumn("col", F.pmod(slot, F.lit(columns))).withColumn("row", F.floor(slot / columns))


def page_totals(files: DataFrame, group: str, pages: str, per_page: int, most: int = 100) -> DataFrame:
    """Pages in all, sheets that they need, and whether they are within the limit."""
    t = files.groupBy(group).agg(F.sum(pages).alias("n_pages"))
    return t.withColumn("n_sheets", F.ceil(F.col("n_pages") / per_page)).withColumn("allowed", F.col("n_pages") <= most)


def image_objects(images: DataFrame, most: int = 500) -> DataFrame:
    """Each object of a document once, on its first page, numbered and named; the first `most` of a document (the cap is
    what the operation is asked for)."""
    first = images.groupBy("doc_id", "xref").agg(F.min(F.struct("page_no", "ext")).alias("f")).select("doc_id", "xref", "f.page_no", "f.ext")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "xref"))
    return first.withColumn("seq", seq).where(F.col("seq") <= most).withColumn("name", F.format_string("p%03d_img%02d.%s", "page_no", "seq", "ext"))
