"""Tickets against batch and ledger, record warnings, unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import invoices as I
from ..functions import names as N


def keyed(df: DataFrame, normalize_amounts: bool = True) -> DataFrame:
    """Adds key and amount: two decimals, or as written; '' where there is none."""
    amount = I.column_fixed2(F.col("amount")) if normalize_amounts else F.col("amount")
    return df.withColumn("key", I.column_key(F.col("number"), F.col("code"))).withColumn("amount", F.coalesce(amount, F.lit("")))


def ledger_by_key(ledger: DataFrame, order: str, normalize_amounts: bool = True) -> DataFrame:
    """The first entry of each key; aggregated before it is shuffled."""
    rows = keyed(ledger, normalize_amounts).where("key <> ''")
    first = rows.groupBy("key").agg(F.min_by(F.struct("amount", "first_name", "first_day"), F.col(order)).alias("e"))
    return first.select("key", F.col("e.amount").alias("ledger_amount"), F.col("e.first_name").alias("first_name"), F.col("e.first_day").alias("first_day"))


def dedup_tickets(tickets: DataFrame, ledger: DataFrame, ledger_order: str = "ord", normalize_amounts: bool = True) -> DataFrame:
    """Status of every ticket: unrecognized, duplicate, suspicious or ok; and against what.

    Earlier in the same file, else in the ledger, else the first of its key in the batch. Equal amounts, or one that is
    missing, make a duplicate; unequal ones are suspicious. Windows run by (batch, key), so one batch is not one task.
    """
    t = keyed(tickets, normalize_amounts)
    # tickets without a number meet nobody: each is a key of its own, so that they do not share one task
    t = t.withColumn("__key", F.when(F.col("key") == "", F.concat_ws("\0", F.lit(""), "batch_id", "row_no")).otherwise(F.col("key")))
    by_key = Window.partitionBy("batch_id", "__key").orderBy("row_no")
    by_file = Window.partitionBy("batch_id", "__key", "file_ref").orderBy("row_no")
    t = t.withColumn("in_file", F.row_number().over(by_file) > 1).withColumn("first_row", F.first("row_no").over(by_key)).withColumn("first_amount", F.first("amount").over(by_key))
    t = t.join(ledger_by_key(ledger, ledger_order, normalize_amounts).withColumnRenamed("key", "__key"), "__key", "left")
    differ = lambda other: F.when((F.col("amount") != "") & (other != "") & (F.col("amount") != other), F.lit("suspicious")).otherwise(F.lit("duplicate"))
    status = (
        F.when(F.col("key") == "", F.lit("unrecognized"))
        .when(F.col("in_file"), F.lit("duplicate"))
        .when(F.col("ledger_amount").isNotNull(), differ(F.col("ledger_amount")))
        .when(F.col("row_no") > F.col("first_row"), differ(F.col("first_amount")))
        .otherwise(F.lit("ok"))
    )
    against = (
        F.when(F.col("key") == "", F.lit(None))
        .when(F.col("in_file"), F.lit("file"))
        .when(F.col("ledger_amount").isNotNull(), F.concat(F.lit("ledger:"), F.col("first_name"), F.lit("@"), F.col("first_day")))
        .when(F.col("row_no") > F.col("first_row"), F.concat(F.lit("row:"), F.col("first_row").cast("string")))
    )
    return t.select("batch_id", "row_no", "file_ref", "key", "amount", status.alias("status"), against.alias("note"))


STATUSES = ("ok", "duplicate", "suspicious", "unrecognized")


def dedup_summary(statuses: DataFrame) -> DataFrame:
    """Counts by batch, zero where there are none, and a total row (null batch)."""
    return statuses.rollup("batch_id").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES))


def ledger_entries(tickets: DataFrame) -> DataFrame:
    """What a batch adds to the ledger: the first ticket of each key, whatever its status."""
    rows = keyed(tickets).where("key <> ''")
    return rows.groupBy("batch_id", "key").agg(F.min_by(F.struct("row_no", "file_ref", "amount"), F.col("row_no")).alias("e")).select("batch_id", "key", "e.*")


def same_number(records: DataFrame) -> DataFrame:
    """Adds n_same, and the warning same_number to every record whose number another one of its batch has."""
    n = F.count(F.lit(1)).over(Window.partitionBy("batch_id", "invoice_number"))
    return records.withColumn("n_same", n).withColumn("same_number", F.col("invoice_number").isNotNull() & (n > 1))


def unique_names(df: DataFrame, group: str, name: str, order: str, reserved: DataFrame | None = None) -> DataFrame:
    """Adds unique_name: the first of equal names keeps its own; the n-th takes __k before the extension, with the
    (n-1)-th k from 2 whose name nobody has. Serials are looked up only among names of one stem and extension.
    reserved (columns group and name): names already placed, which nobody keeps or takes."""
    n, s, e = F.col(name), N.stem(F.col(name)), N.extension(F.col(name))
    rows = df.withColumn("__e", e).withColumn("__nth", F.row_number().over(Window.partitionBy(group, name).orderBy(order)))
    # a name of the form stem__k.ext takes serial k from stem.ext
    base, k = F.regexp_extract(s, r"^(.+)__([0-9]{1,9})$", 1), F.regexp_extract(s, r"^(.+)__([0-9]{1,9})$", 2)
    serial = k.try_cast("int")
    known = df.select(group, name)
    if reserved is not None:
        placed = reserved.select(F.col(group).alias("__g"), F.col(name).alias("__name")).distinct().withColumn("__placed", F.lit(1))
        rows = rows.join(placed, F.col(group).eqNullSafe(F.col("__g")) & (F.col(name) == F.col("__name")), "left")
        rows = rows.withColumn("__nth", F.col("__nth") + F.coalesce("__placed", F.lit(0))).drop("__g", "__name", "__placed")
        known = known.unionByName(reserved.select(group, name))
    names = known.select(F.col(group).alias("__g"), base.alias("__b"), e.alias("__e"), serial.alias("__k"), k.alias("__text")).where("__b <> '' AND __k >= 2 AND __text = CAST(__k AS STRING)")
    # the j-th taken serial (from 0) has serial - 2 - j free ones from 2 below it; the n-th row takes the (n-2)-th (from 0),
    # which all taken ones with as many free ones below or fewer move on by one. Serials and rows meet by this number.
    taken = names.select("__g", F.concat("__b", "__e").alias("__name"), "__k").distinct()
    taken = taken.select("__g", "__name", (F.col("__k") - 1 - F.row_number().over(Window.partitionBy("__g", "__name").orderBy("__k"))).alias("__at"), F.lit(1).alias("__one"))
    columns = rows.columns
    both = rows.withColumn("__g", F.col(group)).withColumn("__name", n).withColumn("__at", F.col("__nth") - 2).withColumn("__one", F.lit(0)).unionByName(taken, allowMissingColumns=True)
    before = F.sum("__one").over(Window.partitionBy("__g", "__name").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumn("__before", before).where("__one = 0").select(*columns, "__before")
    free = F.col("__nth") + F.col("__before")
    new = F.when(F.col("__nth") == 1, n).otherwise(F.concat(s, F.lit("__"), free.cast("string"), F.substring(n, F.length(s) + 1, F.length(n))))
    return rows.withColumn("unique_name", new).drop("__e", "__nth", "__before")


def placed_names(df: DataFrame, group: str, name: str, order: str, rejected: str) -> DataFrame:
    """Adds unique_name to all rows: first the accepted ones are named, then those that the boolean column rejected
    marks, which keep their names unless a placed or another rejected file has them. A null counts as accepted."""
    out = F.coalesce(F.col(rejected), F.lit(False))
    accepted = unique_names(df.where(~out), group, name, order)
    reserved = accepted.select(group, F.col("unique_name").alias(name))
    return accepted.unionByName(unique_names(df.where(out), group, name, order, reserved))


def extract_summary(good: DataFrame, bad: DataFrame, batch: str = "batch_id", reason: str = "reason") -> DataFrame:
    """Records and failures by batch, with the reasons and their counts in order."""
    g = good.groupBy(batch).agg(F.count(F.lit(1)).alias("n_good"))
    by = bad.groupBy(batch, reason).agg(F.count(F.lit(1)).alias("n"))
    b = by.groupBy(batch).agg(F.sum("n").alias("n_bad"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(reason, "n"))), lambda x: F.concat(x[reason], F.lit("="), x["n"].cast("string"))), ",").alias("reasons"))
    return g.join(b, batch, "full_outer").select(batch, F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def one_shape(*sources: DataFrame) -> DataFrame:
    """Records of several source formats as one table; columns that a source lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def export_limits(rows: DataFrame, most_rows: int = 10_000, most_chars: int = 20_000_000) -> DataFrame:
    """One row: rows, characters and whether both are within the limits."""
    texts = [F.coalesce(F.length(c), F.lit(0)) for c, kind in rows.dtypes if kind == "string"]
    chars = texts[0]
    for x in texts[1:]:
        chars = chars + x
    r = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(chars), F.lit(0)).alias("n_chars"))
    return r.withColumn("allowed", (F.col("n_rows") <= most_rows) & (F.col("n_chars") <= most_chars))


def name_of(df: DataFrame, ext: Column, **parts: Column) -> DataFrame:
    """Adds target and truncated."""
    made = N.target_name(F.col("invoice_number"), F.col("buyer_name"), F.col("issue_date"), ext, **parts)
    return df.withColumn("__m", made).withColumn("target", F.col("__m.name")).withColumn("truncated", F.col("__m.truncated")).drop("__m")
