"""Task and request logs: rollup, correlation, quotas, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

MESSAGES, MESSAGE_CHARS = 10, 2_000
MOST_TASK_BYTES, MOST_DAY_BYTES = 64 << 20, 512 << 20


def task_rollup(lines: DataFrame) -> DataFrame:
    """lines (task_id, time, message): first and last time, lines, and the first messages by time, cut. Each task keeps
    MESSAGES of them, ranked before they are gathered, so a task of millions of lines is not gathered whole."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("time", "message"))
    some = lines.select("task_id", "time", F.substring("message", 1, MESSAGE_CHARS).alias("message"), rank.alias("n")).where(F.col("n") <= MESSAGES)
    m = some.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "message"))), lambda x: x["message"]), "|").alias("messages"))
    t = lines.groupBy("task_id").agg(F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.count(F.lit(1)).alias("n_lines"))
    return t.join(m, "task_id")


def correlate(tasks: DataFrame, requests: DataFrame, seconds: int, key: str | None = None) -> DataFrame:
    """(task columns, request_id, request_time): each request goes to the latest task whose last_seen is at most
    `seconds` before it; of several requests on a task the latest stays. Tasks without one have nulls.

    An as-of join by union and one window: by key if there is one, else by slots of `seconds` that requests look up in
    their own and the one before, so the work is that of the neighbours and not of all pairs."""
    slot = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")
    t = tasks.select(F.struct(*tasks.columns).alias("task"), F.col("task_id").alias("__t"), F.col("last_seen").alias("__seen"), *([F.col(key).alias("__key")] if key else []), slot(F.col("last_seen")).alias("__slot"))
    r = requests.select("request_id", F.col("time").alias("request_time"), *([F.col(key).alias("__rkey")] if key else []), F.explode(F.array(slot(F.col("time")), slot(F.col("time")) - 1)).alias("__rslot"))
    near = (F.col("__slot") == F.col("__rslot")) & (F.col("request_time") >= F.col("__seen")) & (F.col("request_time") <= F.col("__seen") + F.expr(f"INTERVAL {seconds} SECONDS"))
    if key:
        near = near & (F.col("__key") == F.col("__rkey"))
    met = r.join(t, near).groupBy("request_id", "request_time").agg(F.max(F.struct("__seen", "__t")).alias("m"))
    by_task = met.groupBy(F.col("m.__t").alias("__t")).agg(F.max(F.struct("request_time", "request_id")).alias("q"))
    return tasks.join(by_task, F.col("task_id") == F.col("__t"), "left").select(*tasks.columns, F.col("q.request_id").alias("request_id"), F.col("q.request_time").alias("request_time"))


def is_original(name: Column) -> Column:
    n = F.lower(name)
    return F.startswith(n, F.lit("input")) | (F.startswith(n, F.lit("invoice_")) & (n != "merged_invoices.pdf"))


def quota_copy(files: DataFrame, day: str = "day", task: str = "task_id", name: str = "name", size: str = "size", per_task: int = MOST_TASK_BYTES, per_day: int = MOST_DAY_BYTES) -> DataFrame:
    """Adds reason: null if a file is archived. Files are taken in order of task and name; one that would exceed a quota is
    skipped and smaller ones go on. The quotas are what the operation is asked for; a size of null counts as 0.

    While a day has room for a whole task's quota, the day's quota rejects nothing, so tasks are filled by themselves and
    at once (scans.first_fit), and the day's use before each is a running sum over tasks. From the first task on for
    which a full quota may not be left, what is left is below a task's quota: there a file is taken if the day has room
    for it, whatever its task, and the rest of the day is filled as one. No day is read row by row in one task."""
    rows = files.select(F.col(day).alias("d"), F.col(task).alias("t"), F.col(name).alias("n"), F.col(size).alias("s0"), F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")).alias("s"))
    rows = scans.ordered(rows, ["d"], ["t", "n", "s0"])
    taken = scans.written(scans.first_fit(rows.withColumn("capacity", F.lit(per_task).cast("bigint")), ["d", "t"], ("n", "s0")), "taken")
    used = taken.groupBy("d", "t").agg(F.min("pos").alias("pos"), F.sum(F.when(F.col("taken"), F.col("s")).otherwise(0)).alias("used"))
    tight = scans.running_sums(used, ["d"], "used").where(F.col("before") + per_task > per_day)
    tight = tight.groupBy(F.col("d").alias("__d")).agg(F.min("pos").alias("since"), F.min_by(F.lit(per_day) - F.col("before"), "pos").alias("capacity"))
    marked = taken.join(scans.written(tight, "tight"), F.col("d").eqNullSafe(F.col("__d")), "left").drop("__d")
    free = marked.where("since IS NULL OR pos < since").select("d", "t", "n", "s0", F.when(~F.col("taken"), "task_quota").alias("reason"))
    last = scans.written(scans.first_fit(marked.where("pos >= since").drop("taken"), ["d"], ("t", "n", "s0")), "last")
    # what the task has used before a file tells the reasons apart; only tasks with a file taken here have used anything
    here = last.where("taken").select(F.col("d").alias("__d"), F.col("t").alias("__t")).distinct()
    same = F.col("d").eqNullSafe(F.col("__d")) & F.col("t").eqNullSafe(F.col("__t"))
    own = F.when(F.col("taken"), F.col("s")).otherwise(F.lit(0).cast("bigint"))
    some = scans.running_sums(last.join(here, same, "left_semi").withColumn("own", own), ["d", "t"], "own").drop("own")
    last = last.join(here, same, "left_anti").withColumn("before", F.lit(0).cast("bigint")).unionByName(some)
    reason = F.when(~F.col("taken"), F.when(F.col("before") + F.col("s") > per_task, "task_quota").otherwise("day_quota"))
    return free.unionByName(last.select("d", "t", "n", "s0", reason.alias("reason"))).toDF(day, task, name, size, "reason")


def original_files(files: DataFrame, name: str = "name") -> DataFrame:
    """The files that are somebody's upload and not a result."""
    return files.where(is_original(F.col(name)))


def archive_summary(copied: DataFrame, requests: DataFrame, day: str = "day") -> DataFrame:
    """By day: requests, tasks, tasks with a file, and bytes archived."""
    by_task = copied.groupBy(day, "task_id").agg(F.sum(F.when(F.col("reason").isNull(), F.col("size")).otherwise(0)).alias("b"), F.count_if(F.col("reason").isNull()).alias("k"))
    c = by_task.groupBy(day).agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("k") > 0).alias("n_archived"), F.sum("b").alias("bytes"))
    r = requests.groupBy(day).agg(F.count(F.lit(1)).alias("n_requests"))
    return r.join(c, day, "full_outer").na.fill(0, ["n_requests", "n_tasks", "n_archived", "bytes"])


def prune(folders: DataFrame, name: str, target: Column, keep_days: int) -> DataFrame:
    """Adds pruned: a folder named by a date that is older than the days kept, the target day among them."""
    day = F.call_function("try_to_date", F.when(F.col(name).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col(name)), F.lit("yyyy-MM-dd"))
    return folders.withColumn("pruned", F.coalesce(day < F.date_sub(target, keep_days - 1), F.lit(False)))
