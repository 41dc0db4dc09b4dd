"""Stateful operators over unbounded input. Watermarks are parameters: the batch forms know no lateness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import redact as R
from ..operators.survey import is_bot
from . import stateful
from .batches import EVERY, first_batches


def tail(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_clients(responses: DataFrame, delay: str, time: str = "ts") -> DataFrame:
    """Responses of people, the first of each client within the watermark."""
    return responses.where(~is_bot()).withWatermark(time, delay).dropDuplicatesWithinWatermark(["client_id"])


def correlated(tasks: DataFrame, requests: DataFrame, seconds: int, delay: str, key: str = "user_id") -> DataFrame:
    """Pairs of a task and a request at most `seconds` after it; the latest of each is picked by the batch form."""
    t = tasks.select(F.col(key).alias("k"), "task_id", "last_seen").withWatermark("last_seen", delay)
    r = requests.select(F.col(key).alias("rk"), "request_id", F.col("time").alias("request_time")).withWatermark("request_time", delay)
    near = (F.col("k") == F.col("rk")) & (F.col("request_time") >= F.col("last_seen")) & (F.col("request_time") <= F.col("last_seen") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return t.join(r, near).select(F.col("k").alias(key), "task_id", "last_seen", "request_id", "request_time")


def upload_sessions(parts: DataFrame, delay: str, idle: str = "2 hours") -> DataFrame:
    """Sessions of piecewise uploads: a gap of `idle` starts anew; complete when all indexes are there."""
    s = parts.withWatermark("ts", delay).groupBy("task_id", F.session_window("ts", idle).alias("w"))
    g = s.agg(F.max("total").alias("total"), F.collect_set(F.col("idx").cast("int")).alias("got"), F.count(F.lit(1)).alias("n_parts"))
    whole = F.size(F.array_except(F.sequence(F.lit(0), F.col("total").cast("int") - 1), "got")) == 0
    return g.select("task_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_parts", whole.alias("complete"))


def redacted(pages: DataFrame, presets: tuple[str, ...] = tuple(R.PRESETS), text: str = "text") -> DataFrame:
    """Pages without personal data; no state."""
    return pages.withColumn(text, R.mask(F.col(text), presets))


def ledger_batches(ledger_path: str, every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends what each micro-batch adds to the ledger, the first ticket of a key that it doesn't have."""

    def first(batch: DataFrame) -> DataFrame:
        # tickets of one number as it is written are one key, so each such number is normalised once
        own = batch.groupBy("number", "code").agg(F.min_by(F.struct("file_ref", "amount", "row_no"), F.col("row_no")).alias("e")).select("number", "code", "e.*")
        rows = L.keyed(own).where("key <> ''")
        return rows.groupBy("key").agg(F.min_by(F.struct("file_ref", "amount", "row_no"), F.col("row_no")).alias("e")).select("key", "e.*")

    return first_batches(ledger_path, first, "key", every=every)


def survey_batches(path: str, order: str = "ts", every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the first response of each client for ever, not only within a watermark."""

    def first(batch: DataFrame) -> DataFrame:
        people = batch.where(~is_bot())
        return people.groupBy("client_id").agg(F.min_by(F.struct(*people.columns), F.col(order)).alias("r")).select("r.*")

    return first_batches(path, first, "client_id", every=every)


#: Rows of a file of arrivals, about: a step's files follow its rows, so that no task writes a fixed share of the table.
FILE_ROWS = 1_000_000


def arrivals(df: DataFrame, time: str, folder: str, parts: int = 3, files: int = 4) -> DataFrame:
    """A stream over the rows of a table as if they came in order of time: they are written in `parts` steps of equal
    time, of `files` files each, more for many rows (FILE_ROWS), which are read as many at a time."""
    span = df.agg(F.min(time).alias("low"), F.max(time).alias("high"), F.count(F.lit(1)).alias("n")).first()
    files = max(files, -(-span["n"] // (parts * FILE_ROWS)))
    dealt = df.withColumn("part", stateful.in_order(F.col(time), parts, span["low"], span["high"]))
    for k in range(parts):
        dealt.where(F.col("part") == k).drop("part").repartition(files).write.mode("append").parquet(folder)
    return tail(df.sparkSession, folder, df.schema, files)


def to_table(df: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what there is into Parquet below a folder that executors share, and reads it."""
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], folder: str) -> None:
    df.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, and gives what came out: for tests and bounded replays."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
