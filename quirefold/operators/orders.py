"""Payment orders: reconciliation, retention, replay, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import ordered, scan

FILE_OPS = ("merge", "extract", "rename")


def reconcile(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """payments (trade_no, out_trade_no, active, resource_id, amount, op): adds verdict, the first check that fails."""
    o = orders.select(F.col("out_trade_no").alias("__k"), F.col("resource_id").alias("__r"), F.col("amount").alias("__a"), F.col("op").alias("__op"), F.col("status").alias("__s"))
    j = payments.join(o, F.col("out_trade_no") == F.col("__k"), "left")
    same_op = (F.col("op") == F.col("__op")) | ((F.col("op") == "resume") & F.col("__op").isin(*FILE_OPS))
    verdict = (
        F.when(F.col("__k").isNull(), "no_order")
        .when(~F.coalesce("active", F.lit(False)), "inactive")
        .when(~F.coalesce(F.col("resource_id") == F.col("__r"), F.lit(False)), "resource")
        .when(~F.coalesce(F.col("amount") == F.col("__a"), F.lit(False)), "amount")
        .when(~F.coalesce(same_op, F.lit(False)), "op")
        .when(F.col("__s") == "fulfilled", "replay")
        .otherwise("accepted")
    )
    return j.select(*payments.columns, verdict.alias("verdict"))


def stale(orders: DataFrame, now: Column, created_hours: int = 48, blob_days: int = 90) -> DataFrame:
    """Adds action: delete (created before the cutoff), clear (fulfilled with a blob before the other), else keep."""
    old = (F.col("status") == "created") & (F.col("created_at") < now - F.expr(f"INTERVAL {created_hours} HOURS"))
    blob = (F.col("status") == "fulfilled") & F.col("result_cache").isNotNull() & (F.col("fulfilled_at") < now - F.expr(f"INTERVAL {blob_days} DAYS"))
    return orders.withColumn("action", F.when(old, "delete").when(blob, "clear").otherwise("keep"))


def retention_stats(marked: DataFrame) -> DataFrame:
    """What a retention run would do, by action: the dry run."""
    return marked.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def retention_list(marked: DataFrame) -> DataFrame:
    """The orders that a retention run would change, (action, out_trade_no, at): what is deleted by creation, what is
    cleared by fulfilment, each in order of time. Sorted by ranges, so no list of them is held in one place."""
    at = F.when(F.col("action") == "delete", F.col("created_at")).otherwise(F.col("fulfilled_at"))
    return marked.where("action <> 'keep'").select("action", "out_trade_no", at.alias("at")).orderBy("action", "at", "out_trade_no")


def retain(marked: DataFrame) -> DataFrame:
    """The table after the run."""
    return marked.where("action <> 'delete'").withColumn("result_cache", F.when(F.col("action") != "clear", F.col("result_cache"))).drop("action")


def upsert(table: DataFrame, updates: DataFrame, key: str, guard: Column | None = None, delete: str | None = None) -> DataFrame:
    """The table with updates put in by key. guard: a condition on `old` and `new` rows under which an existing row is
    changed. delete: a boolean column of updates that removes the row. One full outer join."""
    columns = table.columns
    t = table.select(F.col(key).alias("__k"), F.struct(*columns).alias("old"))
    u = updates.select(F.col(key).alias("__u"), F.struct(*(columns + ([delete] if delete else []))).alias("new"))
    j = t.join(u, F.col("__k") == F.col("__u"), "full_outer")
    change = F.col("new").isNotNull() & (F.col("old").isNull() | (F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True)))
    if delete:
        j = j.where(~(change & F.coalesce(F.col(f"new.{delete}"), F.lit(False))))
    return j.select(*(F.when(change, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns))


def lookup(orders: DataFrame, keys: DataFrame, key: str = "out_trade_no") -> DataFrame:
    return orders.join(keys.select(key).distinct(), key, "left_semi")


#: What an action does to an order: the status it must have, and the one it gets.
STEPS = {("created", "claim"): "verified", ("verified", "fulfil"): "fulfilled", ("verified", "release"): "created"}
STATUSES = ("created", "verified", "fulfilled")
#: A map of the statuses is a text of digits: its k-th is the number of the status that the k-th becomes.
_SAME = "".join(map(str, range(len(STATUSES))))


def step_maps(action: Column) -> Column:
    """The map that each action is; that of an unknown one leaves all as they are."""
    out = F.lit(_SAME)
    for name in sorted({a for _, a in STEPS}):
        out = F.when(action == name, "".join(str(STATUSES.index(STEPS.get((s, name), s))) for s in STATUSES)).otherwise(out)
    return out


def after(first: Column, then: Column) -> Column:
    """The map of `first`, followed by `then`: each digit is looked up."""
    return F.call_function("translate", first, F.lit(_SAME), then)


def transitions(events: DataFrame, status: str | None = None) -> DataFrame:
    """events (out_trade_no, seq, action) in order: adds status and outcome after each. claim: created -> verified;
    fulfil: verified -> fulfilled; release: verified -> created; what comes after fulfilment is a replay; all else a
    conflict. status: a column with the status that an order has before all its events, else created.

    Each action is a map of the statuses, and maps follow each other associatively (scans.scan), so an order of any
    number of events is spread over tasks."""
    start = [F.col(status).alias("start")] if status else [F.lit(STATUSES[0]).alias("start")]
    rows = events.select("out_trade_no", F.col("seq").cast("bigint").alias("seq"), "action", step_maps(F.col("action")).alias("step"), *start)
    found = scan(ordered(rows, ["out_trade_no"], ["seq", "action"]), ["out_trade_no"], "step", after, F.lit(_SAME))
    names = F.array(*map(F.lit, STATUSES))
    of = lambda m, s: F.element_at(names, F.substring(m, F.array_position(names, s).cast("int"), F.lit(1)).cast("int") + 1)
    found = found.withColumn("was", of(F.col("before"), F.col("start"))).withColumn("status", of(F.col("step"), F.col("was")))
    outcome = F.when(F.col("status") != F.col("was"), "accepted").when(F.col("was") == "fulfilled", "replay").otherwise("conflict")
    return found.select("out_trade_no", "seq", "action", "status", outcome.alias("outcome"))
