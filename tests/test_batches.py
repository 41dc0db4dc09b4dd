"""Tables of micro-batches: the first row of each key whatever is merged, stopped or run again."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirefold.streaming import batches as B

SCHEMA = "key string, n int"


def folders(path):
    return sorted(f for f in os.listdir(path) if f.startswith("span="))


def files(path, names):
    return sum(f.endswith(".parquet") for n in names for _, _, found in os.walk(os.path.join(path, n)) for f in found)


def dealt(batches, keys, seed=1):
    r = random.Random(seed)
    return [[(f"k{r.randrange(keys)}", b * 1000 + i) for i in range(r.choice([0, 3, 8]))] for b in range(batches)]


def firsts(rows):
    got = {}
    for batch in rows:
        for k, n in sorted(batch, key=lambda x: x[1]):
            got.setdefault(k, n)
    return sorted(got.items())


def runner(path, every=3):
    return B.first_batches(path, lambda b: b.groupBy("key").agg(F.min("n").alias("n")), "key", buckets=2, every=every)


def held(spark, path):
    return sorted((r.key, r.n) for r in B.batch_table(spark, path, StructType.fromDDL(SCHEMA)).collect())


def test_tiers(spark, tmp_path):
    path, rows = str(tmp_path / "t"), dealt(21, 60)
    run, most = runner(path), 0
    for b, batch in enumerate(rows):
        run(spark.createDataFrame(batch, SCHEMA), b)
        most = max(most, len(B.live(B._complete(spark, path))))
        if b in (0, 3, 9, 20):
            assert held(spark, path) == firsts(rows[: b + 1])
    assert B.live(B._complete(spark, path)) == [(0, 8), (9, 17), (18, 18), (19, 19), (20, 20)]
    assert most <= 7 and files(path, ["span=b0_8"]) <= 4  # a file or two for each bucket, not one for each batch


def test_run_again_stopped_and_shared(spark, tmp_path):
    path, rows = str(tmp_path / "t"), dealt(5, 20, 2)
    run = runner(path)
    for b in range(4):
        run(spark.createDataFrame(rows[b], SCHEMA), b)
    assert folders(path) == ["span=b0_0", "span=b0_2", "span=b1_1", "span=b2_2", "span=b3_3"]  # merged ones stay for a while
    run(spark.createDataFrame(rows[3], SCHEMA), 3)  # a batch run again replaces itself
    assert held(spark, path) == firsts(rows[:4])
    os.remove(os.path.join(path, "span=b0_2", "_SUCCESS"))  # a merge that was stopped doesn't count
    assert held(spark, path) == firsts(rows[:4])
    run(spark.createDataFrame(rows[3], SCHEMA), 3)  # and is done again
    assert (0, 2) in B._complete(spark, path) and held(spark, path) == firsts(rows[:4])
    for gone in ("span=b0_0", "span=b1_1", "span=b2_2"):
        shutil.rmtree(os.path.join(path, gone))
    run(spark.createDataFrame(rows[4], SCHEMA), 4)
    assert held(spark, path) == firsts(rows)
    with pytest.raises(ValueError, match="merged before"):
        run(spark.createDataFrame(rows[1], SCHEMA), 1)


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    run = runner(path, 2)
    for b in range(5):
        run(spark.createDataFrame([], SCHEMA), b)
    schema = StructType.fromDDL(SCHEMA)
    assert B.batch_table(spark, path, schema).count() == 0 and B.batch_table(spark, str(tmp_path / "none"), schema).count() == 0
