"""Rules whose next step depends on all steps before, without reading a key's rows one after another in one task.

Rows are dealt by ranges of key and order, so a key with many rows is spread over tasks. Where a step can be written as a
value that joins associatively with those before it (a map of states, a stack that gives way to another, a sum), blocks
of rows are joined first, then blocks of blocks, and each row gets what its own block and all earlier blocks come to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: A block has 2 ** BITS rows at most, and a block of blocks as many blocks.
BITS = 8
#: Rows of a key that first_fit folds in one row.
FOLDED = 4096


def ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with `pos`, which ascends in order of the keys and of `order`, as a written table, so that it stays as it is. Each
    range of rows is numbered by itself: 2 ** BITS successive numbers are never of two ranges."""
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return written(dealt.withColumn("pos", F.monotonically_increasing_id()), "ordered")


def scan(rows: DataFrame, keys: list[str], value: str, join: Callable[[Column, Column], Column], empty: Column) -> DataFrame:
    """rows, which have `pos`, with `before`: what the values of the key's earlier rows come to, joined in order by an
    associative `join`, of which `empty` is the identity. A task holds a block's rows and its values' joins at a time."""
    rest = [c for c in rows.columns if c not in (*keys, "pos")]
    kind = rows.schema[value].dataType
    blocks = _blocks(rows.select(*keys, "pos", F.shiftright("pos", BITS).alias("block"), *rest), keys, rest, value, join, empty.cast(kind))
    sums = blocks.select(*keys, "block", F.element_at("joins", -1).alias("value"))
    # blocks of keys that have several
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("block"))
    several = sums.select(*keys, "block", "value", (number - 1).cast("bigint").alias("pos"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n")).where("n > 1")
    several = written(several, "blocks")
    bases = _bases(several.drop("n"), keys, join, empty.cast(kind))
    named = bases.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("block").alias("__block"), "base")
    same = (F.col("block") == F.col("__block")) & _equal(keys)
    at = blocks.join(named, same, "left").select(*keys, "items", "joins", F.coalesce("base", empty.cast(kind)).alias("base"))
    each = at.select(*keys, "joins", "base", F.posexplode("items").alias("i", "item"))
    own = F.get("joins", F.col("i"))
    return each.select(*(F.col(c) if c in keys else F.col(f"item.{c}") for c in rows.columns), join(F.col("base"), own).alias("before"))


def _equal(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


def _blocks(rows: DataFrame, keys: list[str], rest: list[str], value: str, join, empty: Column) -> DataFrame:
    """(keys, block, items in order, joins): joins are what comes before each item, and last of all of them together."""
    items = F.array_sort(F.collect_list(F.struct("pos", *rest)))
    grow = lambda found, x: F.array_append(found, join(F.element_at(found, -1), x[value]))
    return rows.groupBy(*keys, "block").agg(items.alias("items")).withColumn("joins", F.aggregate("items", F.array(empty), grow))


def _bases(rows: DataFrame, keys: list[str], join, empty: Column) -> DataFrame:
    """(keys, block, base): the joins of earlier rows' values, for rows numbered by `pos` from 0 within their key."""
    dealt = rows.withColumnRenamed("block", "own").withColumn("block", F.shiftright("pos", BITS))
    if rows.agg(F.max("pos")).first()[0] in (None, *range(1 << BITS)):  # one number
        groups = _blocks(dealt, keys, ["own", "value"], "value", join, empty).withColumn("base", empty)
    else:
        groups = _blocks(dealt, keys, ["own", "value"], "value", join, empty)
        above = written(groups.select(*keys, "block", F.element_at("joins", -1).alias("value"), F.col("block").alias("pos")), "blocks")
        named = _bases(above, keys, join, empty).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("block").alias("__block"), "base")
        groups = groups.join(named, (F.col("block") == F.col("__block")) & _equal(keys))
    each = groups.select(*keys, "joins", "base", F.posexplode("items").alias("i", "item"))
    return each.select(*keys, F.col("item.own").alias("block"), join(F.col("base"), F.get("joins", F.col("i"))).alias("base"))


def running_sums(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with `before`, the sum of the key's earlier values (bigint, not null)."""
    return scan(rows, keys, value, lambda a, b: a + b, F.lit(0).cast("bigint"))


def first_fit(rows: DataFrame, keys: list[str], more: tuple[str, ...] = (), size: str = "s", capacity: str = "capacity") -> DataFrame:
    """(keys, pos, more columns, s, taken): rows are taken in order while they fit; one that is larger than what is left of the key's
    capacity is passed over, and smaller ones go on. Sizes are bigint, 0 or more.

    Keys of FOLDED rows at most are folded as they are, and so are the first rows of others; what no longer fits after these
    is out for good, often all. The rest goes by phases: with r left, rows above r are out for good; those above r / 2 are
    large, the others small. Small ones are all taken, and large ones passed over, up to the first row with which what is
    left comes below r / 2: a large one that fits, or the small one that brings it there. So each phase halves what is left,
    and there are as many as a capacity has binary digits."""
    own = ("pos", *more, "s")
    rows = rows.select(*keys, "pos", *more, F.col(size).alias("s"), F.col(capacity).alias("left"))
    blocks = rows.groupBy(*keys, F.shiftright("pos", BITS).alias("block")).agg(F.max("left").alias("left"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*own))).alias("items"))
    blocks = written(blocks, "groups")
    named = [F.col(k).alias(f"__{k}") for k in keys]
    large = written(blocks.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") > FOLDED).select(*named), "large")

    def take(state: Column, x: Column) -> Column:
        fits = x["s"] <= state["left"]
        return F.struct(F.when(fits, state["left"] - x["s"]).otherwise(state["left"]).alias("left"), F.concat(state["taken"], F.when(fits, "1").otherwise("0")).alias("taken"))

    def folded(some: DataFrame) -> DataFrame:
        whole = some.groupBy(*keys).agg(F.max("left").alias("left"), F.array_sort(F.collect_list(F.struct("block", "items"))).alias("blocks"))
        whole = whole.select(*keys, "left", F.flatten(F.transform("blocks", lambda b: b["items"])).alias("items"))
        return whole.withColumn("state", F.aggregate("items", F.struct(F.col("left").alias("left"), F.lit("").alias("taken")), take))

    def each(state: DataFrame) -> DataFrame:
        items = state.select(*keys, "state.taken", F.posexplode("items").alias("i", "item"))
        return items.select(*keys, *(f"item.{c}" for c in own), (F.substring("taken", F.col("i") + 1, F.lit(1)) == "1").alias("taken"))

    if large.isEmpty():
        return each(folded(blocks))
    parts = [each(folded(blocks.join(large, _equal(keys), "left_anti")))]
    many = written(blocks.join(large, _equal(keys), "left_semi"), "many")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("block"))
    heads = many.select(*keys, "block", number.alias("i")).where(F.col("i") <= max(1, FOLDED >> BITS))
    heads = written(heads.select(*named, F.col("block").alias("__block")), "heads")
    in_head = _equal(keys) & (F.col("block") == F.col("__block"))
    begun = written(folded(many.join(heads, in_head, "left_semi")), "begun")
    parts.append(each(begun))
    later = many.join(heads, in_head, "left_anti").select(*keys, F.explode("items").alias("x")).select(*keys, *(f"x.{c}" for c in own))
    later = later.join(begun.select(*named, F.col("state.left").alias("left")), _equal(keys)).select(*keys, *own, "left")
    parts.append(later.where("s > left").select(*keys, *own, F.lit(False).alias("taken")))
    rest = written(later.where("s <= left"), "rest")
    while rest.limit(1).count():
        parts.append(rest.where("s > left").select(*keys, *own, F.lit(False).alias("taken")))
        fits = rest.where("s <= left").withColumn("small", F.when(F.col("s") * 2 <= F.col("left"), F.col("s")).otherwise(F.lit(0)))
        seen = written(running_sums(fits, keys, "small").withColumn("r", F.col("left") - F.col("before")).withColumn("is_small", F.col("s") * 2 <= F.col("left")), "seen")
        ends = seen.where((~F.col("is_small") & (F.col("s") <= F.col("r"))) | (F.col("is_small") & ((F.col("r") - F.col("s")) * 2 < F.col("left"))))
        ends = ends.groupBy(*keys).agg(F.min("pos").alias("end"), F.min_by(F.col("r") - F.col("s"), "pos").alias("after"))
        ends = ends.select(*(F.col(k).alias(f"__{k}") for k in keys), "end", "after")
        met = seen.join(ends, _equal(keys), "left")
        parts.append(met.where("end IS NULL OR pos <= end").select(*keys, *own, (F.col("is_small") | (F.col("pos") == F.coalesce("end", F.lit(-1)))).alias("taken")))
        rest = written(met.where("pos > end").select(*keys, *own, F.col("after").alias("left")), "rest")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
