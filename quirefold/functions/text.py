"""Text, cells and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def once(value: Column, of) -> Column:
    """of(value), in which the value is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def excel_text(s: Column) -> Column:
    """A formula that a spreadsheet shows as this text; '' for null and ''."""
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit('="'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def sanitize_cell(s: Column) -> Column:
    """Without control characters, and not taken for a formula."""
    t = F.regexp_replace(s, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    return F.when(t.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), t)).otherwise(t)


def cell_value(s: Column) -> Column:
    return F.when(F.trim(s) != "", s)


def as_number(s: Column) -> Column:
    return F.regexp_replace(s, "[,¥￥]", "").try_cast("double")


def has_cjk(s: Column) -> Column:
    """A Chinese character, its punctuation or a full-width form."""
    return F.coalesce(s, F.lit("")).rlike("[\\u3000-\\u303f\\u3400-\\u4dbf\\u4e00-\\u9fff\\uff00-\\uffef]")


VARIABLES = ("filename", "date", "year", "page", "pages")


def render_vars(template: Column, values: dict[str, Column]) -> Column:
    """Puts values in place of {filename} {date} {year} {page} {pages}, in one pass: what is put in is not read again."""
    token = "\\{(" + "|".join(VARIABLES) + ")\\}"
    names = F.regexp_extract_all(template, F.lit(token), F.lit(1))
    known = F.create_map(*(x for k in VARIABLES for x in (F.lit(k), values[k].cast("string"))))
    filled = F.transform(names, lambda n: F.element_at(known, n))
    pieces = F.zip_with(F.split(template, token, -1), filled, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.array_join(pieces, "")


#: fixed values: how page numbers are written
PAGE_FORMATS = ("plain", "slash", "cn", "cn_total")


def format_page_number(fmt: Column, num: Column, total: Column) -> Column:
    """Null for an unknown format."""
    n, m = num.cast("string"), total.cast("string")
    return (
        F.when(fmt == "plain", n)
        .when(fmt == "slash", F.concat(n, F.lit(" / "), m))
        .when(fmt == "cn", F.concat(F.lit("第 "), n, F.lit(" 页")))
        .when(fmt == "cn_total", F.concat(F.lit("第 "), n, F.lit(" 页 共 "), m, F.lit(" 页")))
    )


def xml_text_ok(s: Column) -> Column:
    """Only characters that XML 1.0 allows."""
    return ~F.coalesce(s, F.lit("")).rlike("[^\\x09\\x0a\\x0d\\x20-\\ud7ff\\ue000-\\ufffd\\x{10000}-\\x{10ffff}]")


def finite(x: Column) -> Column:
    """NaN and infinity become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_all(a: Column) -> Column:
    return F.transform(a, finite)


def finite_deep(x: Column, kind: DataType) -> Column:
    """NaN and infinity become null, at any depth of arrays, maps (values) and structs; kind: the column's type."""
    if isinstance(kind, (DoubleType, FloatType)):
        return finite(x)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda v: finite_deep(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, v: finite_deep(v, kind.valueType))
    if isinstance(kind, StructType):
        inside = F.struct(*(finite_deep(x[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(x.isNotNull(), inside)
    return x


def preview(s: Column, n: int = 500) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def friendly(message: Column, fallback: str = "request failed") -> Column:
    """A message that is ASCII only is an internal one: the fallback stands for it."""
    return F.when(F.coalesce(message, F.lit("")).rlike("^[\\x00-\\x7F]*$"), F.lit(fallback)).otherwise(message)
