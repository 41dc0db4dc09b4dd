"""Form leaves: sibling indexes, keys by suffix, values, and audits of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sibling_index(nodes: DataFrame, parent: str = "parent", name: str = "name", order: str = "pos") -> DataFrame:
    """Adds label: name[i] where siblings share a name, else the name."""
    n = F.count(F.lit(1)).over(Window.partitionBy(parent, name))
    i = F.row_number().over(Window.partitionBy(parent, name).orderBy(order)) - 1
    return nodes.withColumn("label", F.when(n > 1, F.concat(F.col(name), F.lit("["), i.cast("string"), F.lit("]"))).otherwise(F.col(name)))


def suffixes(path: Column) -> Column:
    """All '/'-suffixes of a path, the longest (itself) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolve(keys: DataFrame, leaves: DataFrame, key: str = "key", path: str = "path", doc: str = "doc_id") -> DataFrame:
    """(doc, key, path, reason): the leaf whose path is the key, else the leaf that alone has the longest suffix of the
    key; without that, again without a trailing /Yes or /No; reasons are none, ambiguous and taken (two keys, one leaf)."""
    k = keys.select(doc, key, F.posexplode(F.array_distinct(F.array(F.col(key), F.regexp_replace(key, "/(Yes|No)$", "")))).alias("variant", "k"))
    asked = k.select(doc, key, "variant", F.posexplode(suffixes(F.col("k"))).alias("cut", "suffix"))
    had = leaves.select(F.col(doc).alias("__d"), F.col(path).alias("__p"), F.explode(suffixes(F.col(path))).alias("__s"))
    by = had.groupBy("__d", "__s").agg(F.count(F.lit(1)).alias("n"), F.min("__p").alias("path"), F.max(F.when(F.col("__p") == F.col("__s"), F.col("__p"))).alias("exact"))
    met = asked.join(by, (F.col(doc) == F.col("__d")) & (F.col("suffix") == F.col("__s")), "left")
    whole = (F.col("cut") == 0) & F.col("exact").isNotNull()
    found = F.when(whole, F.col("exact")).when(F.col("n") == 1, F.col("path"))
    rank = F.struct("variant", F.when(whole, -1).otherwise(F.col("cut")))
    g = met.groupBy(doc, key).agg(F.min_by(found, F.when(found.isNotNull(), rank)).alias("path"), F.max(F.coalesce("n", F.lit(0))).alias("most"))
    shared = F.count("path").over(Window.partitionBy(doc, "path"))
    reason = F.when(F.col("path").isNull(), F.when(F.col("most") > 1, F.lit("ambiguous")).otherwise(F.lit("none"))).when(F.col("shared") > 1, F.lit("taken"))
    return g.withColumn("shared", shared).select(doc, key, F.when(reason.isNull(), F.col("path")).alias("path"), reason.alias("reason"))


def translate_on_values(values: DataFrame, on_values: DataFrame) -> DataFrame:
    """values (doc_id, key, value): '1' becomes the on-value of the field that the key resolves to, if it has one."""
    r = resolve(values.where("value = '1'").select("doc_id", "key"), on_values.select("doc_id", "path")).where("path IS NOT NULL").select("doc_id", "key", "path")
    on = r.join(on_values.select("doc_id", "path", "on_value"), ["doc_id", "path"]).select("doc_id", "key", "on_value")
    return values.join(on, ["doc_id", "key"], "left").select("doc_id", "key", F.when(F.col("value") == "1", F.coalesce("on_value", "value")).otherwise(F.col("value")).alias("value"))


def leaf_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaves that only one side has, as often as it has more of them: both sides are counted in one pass."""
    one = lambda side, n: side.select("doc_id", "path", F.lit(n).cast("bigint").alias("n"))
    more = one(before, 1).unionByName(one(after, -1)).groupBy("doc_id", "path").agg(F.sum("n").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, F.lit("before")).otherwise(F.lit("after"))
    return more.select("doc_id", "path", side.alias("side"), F.explode(F.array_repeat(F.lit(True), F.abs("n").cast("int"))).alias("__one")).drop("__one")


def change_audit(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, same_leaves, only_targets, all_set): the leaves are the same, only targets changed, and each target has
    the value that was submitted; null and '' are equal."""
    v = lambda c: F.coalesce(F.col(c), F.lit(""))
    both = before.select("doc_id", "path", F.col("value").alias("b"), F.lit(True).alias("in_b")).join(after.select("doc_id", "path", F.col("value").alias("a"), F.lit(True).alias("in_a")), ["doc_id", "path"], "full_outer")
    all_ = both.join(targets.select("doc_id", "path", F.col("value").alias("t"), F.lit(True).alias("in_t")), ["doc_id", "path"], "full_outer")
    return all_.groupBy("doc_id").agg(
        F.bool_and(F.coalesce("in_b", F.lit(False)) == F.coalesce("in_a", F.lit(False))).alias("same_leaves"),
        F.bool_and((v("a") == v("b")) | F.coalesce("in_t", F.lit(False))).alias("only_targets"),
        F.bool_and(F.col("in_t").isNull() | (F.coalesce("in_a", F.lit(False)) & (v("a") == v("t")))).alias("all_set"),
    )
