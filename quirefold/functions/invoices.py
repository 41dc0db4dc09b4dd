"""Amounts, numbers, keys and dates of invoices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

# fixed values: full-width forms and their ASCII counterparts
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

MONEY = "decimal(14,2)"


def normalize_text(s: Column) -> Column:
    """Full-width characters become ASCII, all white space goes; null becomes ''."""
    other = lambda t: F.regexp_replace(F.translate(t, FULL_WIDTH, ASCII), r"(?U)\s+", "")
    return once(F.coalesce(s, F.lit("")), lambda t: F.when(t.rlike(r"[^\x21-\x7E]"), other(t)).otherwise(t))  # most are plain


def clean_amount_fixed2(s: Column) -> Column:
    """'¥1,234.5' as '1234.50'; null if it isn't an amount of two decimals at most."""

    def amount(t: Column) -> Column:
        whole, part = F.split_part(t, F.lit("."), F.lit(1)), F.split_part(t, F.lit("."), F.lit(2))
        return F.when(t.rlike(r"^-?[0-9]+(\.[0-9]{1,2})?$"), F.concat(whole, F.lit("."), F.rpad(part, 2, "0")))

    return once(F.regexp_replace(normalize_text(s), "[¥￥,，]", ""), amount)


def clean_amount_keep(s: Column) -> Column:
    """As clean_amount_fixed2, but ASCII commas only, 12 digits at most, and no decimals where none were written."""
    t = F.regexp_replace(F.coalesce(s, F.lit("")), "[¥￥, ]", "")
    whole, part = F.split_part(t, F.lit("."), F.lit(1)), F.split_part(t, F.lit("."), F.lit(2))
    return F.when(t.rlike(r"^-?[0-9]{1,12}(\.[0-9]{1,2})?$"), F.when(F.contains(t, F.lit(".")), F.concat(whole, F.lit("."), F.rpad(part, 2, "0"))).otherwise(t))


def money(s: Column) -> Column:
    return s.try_cast(MONEY)


def add_amounts(a: Column, b: Column) -> Column:
    """Sum in cents of two amounts as text; null counts as 0 beside a value, two nulls give null."""
    x, y = money(clean_amount_fixed2(a)), money(clean_amount_fixed2(b))
    total = (F.coalesce(x, F.lit(0).cast(MONEY)) + F.coalesce(y, F.lit(0).cast(MONEY))).cast(MONEY)
    return F.when(x.isNotNull() | y.isNotNull(), total.cast("string"))


def is_valid_e_invoice_no(n: Column) -> Column:
    """20 digits: a year from 23 to 28, then a province from 11 to 65."""
    t = F.coalesce(n, F.lit(""))
    return t.rlike("^[0-9]{20}$") & F.substring(t, 1, 2).between("23", "28") & F.substring(t, 3, 2).between("11", "65")


def is_classic_no(n: Column) -> Column:
    return F.coalesce(n, F.lit("")).rlike("^[0-9]{8}$")


def is_classic_code(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("^[0-9]{10,12}$")


def tax_id_ok(t: Column) -> Column:
    return F.coalesce(t, F.lit("")).rlike("^[0-9A-HJ-NP-RT-UW-Y]{15,20}$")


def make_key(number: Column, code: Column | None = None) -> Column:
    """The normalised number, after the code if that has 10 to 12 digits; '' without a number."""
    code = normalize_text(code if code is not None else F.lit(None).cast("string"))
    key = lambda n, c: F.when(n == "", F.lit("")).when(is_classic_code(c), F.concat_ws("-", c, n)).otherwise(n)
    return once(normalize_text(number), lambda n: once(code, lambda c: key(n, c)))


def _is_plain(s: Column) -> Column:
    """normalize_text leaves it as it is."""
    return ~F.coalesce(s, F.lit("")).rlike(r"[^\x21-\x7E]")


def column_key(number: Column, code: Column) -> Column:
    """make_key of two columns of a table (it names them several times): where both are plain, as most are, nothing is
    normalised."""
    key = F.when(F.coalesce(number, F.lit("")) == "", F.lit("")).when(is_classic_code(code), F.concat_ws("-", code, number)).otherwise(number)
    return F.when(_is_plain(number) & _is_plain(code), key).otherwise(make_key(number, code))


def column_fixed2(amount: Column) -> Column:
    """clean_amount_fixed2 of a column of a table: one that is written so already stays."""
    return F.when(amount.rlike(r"\A-?[0-9]+\.[0-9]{2}\z"), amount).otherwise(clean_amount_fixed2(amount))


def _iso(y: Column, m: Column, d: Column) -> Column:
    """ISO text of a real date; null otherwise."""
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.date_format(F.call_function("try_to_date", F.when(y != "", text), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def date_from_file_name(name: Column) -> Column:
    """Of the last part of a name between underscores, without extension: its first eight digits, if they are a date."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]*$", "")
    digits = F.regexp_extract(F.element_at(F.split(stem, "_"), -1), "^([0-9]{8})", 1)
    return _iso(F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))


def cn_date_from_text(text: Column) -> Column:
    """The first date of the form 20YY年M月D日 that is real."""
    pattern = "(20[0-9]{2})年([0-9]{1,2})月([0-9]{1,2})日"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    dates = F.transform(found, lambda s: _iso(*(F.regexp_extract(s, pattern, k) for k in (1, 2, 3))))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def normalize_date(raw: Column) -> Column:
    """Y年M月D日, Y-M-D, YYYYMMDD or Y/M/D at the start of a text, as an ISO date."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    forms = ("^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", "^([0-9]{4})([0-9]{2})([0-9]{2})$", "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})")
    return F.coalesce(*(_iso(*(F.regexp_extract(t, p, k) for k in (1, 2, 3))) for p in forms))


def record_warnings(number: Column, issue_date: Column, net: Column, tax: Column, total: Column, before: Column | None = None) -> Column:
    """Codes of what is doubtful in a record, each once, in order, after those it had."""
    n, x, t = money(net), money(tax), money(total)
    rules = F.array(
        F.when(~F.coalesce(number, F.lit("")).rlike("^[0-9]{20}$"), F.lit("number_not_20_digits")),
        F.when(issue_date.isNull(), F.lit("no_date")),
        F.when(F.abs(n + x - t) > F.lit("0.02").cast(MONEY), F.lit("amounts_differ")),
        F.when(t.isNull(), F.lit("no_total")),
    )
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(before, F.array().cast("array<string>")), rules) if before is not None else rules))


def detect_invoice_type(text: Column) -> Column:
    """The title 电子发票（…）, or what a text says of special or common invoices."""
    title = F.regexp_extract(F.coalesce(text, F.lit("")), "电子发票（[^）]*）", 0)
    return F.coalesce(F.when(title != "", title), F.when(F.contains(text, F.lit("专用发票")), F.lit("电子发票（增值税专用发票）")), F.when(F.contains(text, F.lit("普通发票")), F.lit("电子发票（普通发票）")))


def type_short_label(kind: Column) -> Column:
    k = F.coalesce(kind, F.lit(""))
    return F.when(F.contains(k, F.lit("专用发票")), F.lit("专票")).when(F.contains(k, F.lit("普通发票")), F.lit("普票")).otherwise(F.lit(""))


#: fixed values: labels that may stand before a field
LABEL = r"^(?:发票号码|开票日期|名称|统一社会信用代码/?纳税人识别号)[：:]\s*"
AMOUNT_SPAN = r"^[¥￥]?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)$"


def strip_label(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), LABEL, ""))


#: fixed values: the label of a name in the other layout, and what no name holds there
NAME_LABEL = r"^名称[：:]\s*"
NAME_EXCLUDE = ("名称", "代码", "识别号", "发票", "合计", "备注", "开票人", "价税")


def looks_like_name(t: Column, label: str = LABEL, exclude: tuple[str, ...] = ()) -> Column:
    """Two characters or more without the label, one of them Chinese, and neither a tax id nor an amount; nor with any of
    the words of `exclude`."""
    s = F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), label, ""))
    good = (F.length(s) >= 2) & s.rlike("[\\u4e00-\\u9fff]") & ~tax_id_ok(s) & ~s.rlike(AMOUNT_SPAN)
    return good & ~s.rlike("|".join(exclude)) if exclude else good
