"""File names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .invoices import type_short_label

MAX_NAME = 100
# fixed values: names that Windows reserves, characters it forbids, characters that cannot be seen
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
ILLEGAL = '[<>:"/\\\\|?*\\x00-\\x1f]'
INVISIBLE = "[\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\u2066-\\u2069\\ufeff]"


def let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, "^[. ]+|[. ]+$", "")


def _safe(s: Column) -> Column:
    reserved = F.upper(F.split_part(s, F.lit("."), F.lit(1))).isin(*RESERVED)
    return F.when(s == "", F.lit("_")).when(reserved, F.concat(F.lit("_"), s)).otherwise(s)


def sanitize_component(text: Column, most: int) -> Column:
    """A part of a file name that is safe everywhere; '' for null and ''."""

    def clean(x: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(x, INVISIBLE, ""), ILLEGAL, "_")
        whole = let(_strip(F.replace(t, F.lit(".."), F.lit("_"))), _safe)
        return F.when(x == "", F.lit("")).otherwise(let(_strip(F.substring(whole, 1, most)), _safe))

    return let(F.coalesce(text, F.lit("")), clean)


def extension(name: Column) -> Column:
    """The lower-case extension with its dot; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"^.+(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    n = F.coalesce(name, F.lit(""))
    return F.substring(n, F.lit(1), F.length(n) - F.length(extension(n)))


def target_name(number: Column, buyer: Column, date: Column, ext: Column, prefix: Column | None = None, seller: Column | None = None, kind: Column | None = None, total: Column | None = None) -> Column:
    """(name, truncated): prefix, then number, buyer, seller, date, type and amount that are there, then the extension.
    Of more than MAX_NAME characters the prefix is cut first, then the end of the stem; the extension stays."""
    there = lambda c: let(c, lambda x: F.when(x != "", x))
    part = lambda c, n: there(sanitize_component(c, n))
    parts = [F.coalesce(part(number, 20), F.lit("unknown")), F.coalesce(part(buyer, 30), F.lit("unknown"))]
    parts += [part(seller, 30)] if seller is not None else []
    parts += [part(date, 10)]
    parts += [there(type_short_label(kind))] if kind is not None else []
    parts += [F.concat(part(total, 20), F.lit("元"))] if total is not None else []
    dot = F.when(F.startswith(ext, F.lit(".")), ext).otherwise(F.concat(F.lit("."), ext))
    first = F.struct((sanitize_component(prefix, 50) if prefix is not None else F.lit("")).alias("p"), F.concat_ws("_", *parts).alias("s"), dot.alias("e"))

    def cut(x: Column) -> Column:
        over = F.length(x["p"]) + F.length(x["s"]) + F.length(x["e"]) > MAX_NAME
        p = F.when(over, _strip(F.substring(x["p"], F.lit(1), F.greatest(F.lit(0), MAX_NAME - F.length(x["s"]) - F.length(x["e"]))))).otherwise(x["p"])
        room = MAX_NAME - F.length(p) - F.length(x["e"])
        short = F.regexp_replace(F.substring(x["s"], F.lit(1), F.greatest(F.lit(0), room)), "[._ ]+$", "")
        s = F.when(over & (F.length(x["s"]) > room), F.when(short == "", F.lit("_")).otherwise(short)).otherwise(x["s"])
        return F.struct(F.concat(p, s, x["e"]).alias("name"), over.alias("truncated"))

    return let(first, cut)


def clean_upload_name(name: Column) -> Column:
    """The last part of a path, printable characters only, 200 at most; blank becomes null."""
    base = F.element_at(F.split(F.translate(F.coalesce(name, F.lit("")), "\\", "/"), "/"), -1)
    t = F.substring(F.trim(F.regexp_replace(base, "\\p{C}", "")), 1, 200)
    return F.when(t != "", t)
