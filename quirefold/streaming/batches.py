"""Tables that micro-batches append to: a folder for each batch, merged by tiers, so that files grow with rows and not with
the number of batches. Nothing is renamed: a folder counts once Spark has marked it complete, so any store will do."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Batches that are merged into one, such into one again, and so on; and parts of a table by the hash of its key.
EVERY = 16
BUCKETS = 64

#: Numbers of the first and the last batch of a folder.
Span = tuple[int, int]


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folder(path: str, span: Span) -> str:
    return os.path.join(path, f"span=b{span[0]}_{span[1]}")


def _complete(spark: SparkSession, path: str) -> list[Span]:
    """Folders that were written to the end."""
    fs, place = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    found = [tuple(map(int, m.groups())) for m in (re.fullmatch(r"span=b(\d+)_(\d+)", n) for n in names) if m]
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(s for s in found if fs.exists(path_of(_folder(path, s), "_SUCCESS")))


def _within(inner: Span, outer: Span) -> bool:
    return inner != outer and outer[0] <= inner[0] and inner[1] <= outer[1]


def live(spans: list[Span]) -> list[Span]:
    """Those that no other holds."""
    return [s for s in spans if not any(_within(s, o) for o in spans)]


def batch_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of all batches, each once, also while folders are being merged. A table without a row needs the schema."""
    return _read(spark, path, live(_complete(spark, path)), schema)


def _read(spark: SparkSession, path: str, spans: list[Span], schema: StructType | None) -> DataFrame:
    if not spans and schema is not None:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", path)
    reader = reader if schema is None else reader.schema(schema)
    return reader.parquet(*(_folder(path, s) for s in spans)).drop("span")


def _write(rows: DataFrame, path: str, span: Span) -> None:
    """Files of a bucket are as many as its size asks."""
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(_folder(path, span))


def merge(spark: SparkSession, path: str, batch_id: int, every: int, schema: StructType) -> None:
    """Merges the last `every` batches before a batch whose number `every` divides, the last every * every where its square
    does, and so on: a row is written again once a tier, and folders to read are fewer than `every` a tier.

    Folders stay for one merge more after they were merged, for those who are reading them. If it is run again, it goes on
    where it was stopped."""
    span = every
    while batch_id and batch_id % (span * every) == 0:
        span *= every
    if not batch_id or batch_id % span:
        return
    have = _complete(spark, path)
    new = (batch_id - span, batch_id - 1)
    if new in have:
        return
    now = live(have)
    fs, _ = _file_system(spark, path)
    for old in set(have) - set(now):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(_folder(path, old)), True)
    parts = [s for s in now if _within(s, new)]
    if len(parts) > 1:
        _write(_read(spark, path, parts, schema), path, new)


def first_batches(path: str, rows_of: Callable[[DataFrame], DataFrame], key: str, buckets: int = BUCKETS, every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends those of rows_of(batch), one a key, whose key the table at `path` doesn't have; exact
    whatever comes late. The table is partitioned by batch and by a hash of the key, and a batch reads only the buckets of
    its own keys. Each batch replaces what it wrote if it is run again. Read the table by batch_table.

    A table belongs to one checkpoint: a batch whose number is merged already is an error, as it could not be replaced."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = (batch_id, batch_id)
        first = rows_of(batch).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if any(_within(own, s) for s in _complete(spark, path)):
            raise ValueError(f"batch {batch_id} of {path} was merged before: a table can't be shared by two checkpoints")
        merge(spark, path, batch_id, every, first.schema)
        others = [s for s in live(_complete(spark, path)) if s != own]
        if not others:
            _write(first, path, own)
            return
        first = first.persist()
        try:
            mine = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # `buckets` numbers at most
            known = _read(spark, path, others, first.schema).where(F.col("bucket").isin(mine)).select(key)
            _write(first.join(known, key, "left_anti").select(first.columns), path, own)
        finally:
            first.unpersist()

    return run
