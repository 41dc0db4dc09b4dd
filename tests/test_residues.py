"""Values and targets of a document that contain each other: directly and by an index of grams, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import redact


def texts(seed, n, letters="ab c张\n", longest=24):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(n)]


def kept_by_hand(values, targets, least):
    near = lambda v, t: len(t) >= least and len(v) >= (least if least > 2 else 1) and (t in v or v in t)
    plain = lambda s: "".join((s or "").split()).lower()
    wanted = {}
    for d, t in targets:
        wanted.setdefault(d, set()).add(plain(t))
    return sorted((i, d) for i, d, v in values if d is None or not any(near(plain(v), t) for t in wanted.get(d, ())))


@pytest.mark.parametrize("least", [2, 3])
@pytest.mark.parametrize("few", [0, 20, 256])
def test_scrub_equals_all_pairs(spark, least, few):
    values = [(i, i % 4 if i % 11 else None, v) for i, v in enumerate([*texts(1, 260), *texts(2, 60, "Xyz", 3), None, "", " ", "x" * 40])]
    targets = [(i % 3, t) for i, t in enumerate([*texts(3, 90, longest=9), *texts(4, 30, "xYZ", 40), None, "", "A"])] + [(None, "ab"), (3, "zz")]
    v = spark.createDataFrame(values, "n int, g int, hay string")  # names that the operator uses within
    t = spark.createDataFrame(targets, "g int, target string")
    got = redact.scrub(v, t, "g", "hay", least, few=few)
    assert got.columns == v.columns
    want = kept_by_hand(values, targets, least)
    assert 0 < len(want) < len(values)
    assert sorted((r.n, r.g) for r in got.collect()) == want


def test_containments_of_long_texts_and_shared_beginnings(spark, monkeypatch):
    monkeypatch.setattr(redact, "SEGMENT", 50)
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh") for _ in range(1000))
    needles = [long[40:70], long[44:61], long[990:], long, "q" * 16, long[:49] + "!", *("start" * 9 + str(i) for i in range(40)), ""]
    hays = [long, long + "?", "start" * 9 + "7", "", None]
    h = spark.createDataFrame([(1, x) for x in hays] + [(2, "q" * 17)], "g int, hay string")
    n = spark.createDataFrame([(1, x) for x in needles] + [(2, "q" * 16), (2, "q" * 16)], "g int, needle string")
    got = sorted((x.g, x.hay, x.needle) for x in redact.containments(h, n).collect())
    want = [(1, x, y) for x in hays if x for y in needles if y and y in x] + [(2, "q" * 17, "q" * 16)]
    assert got == sorted(want)


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], "g int, hay string")
    assert redact.containments(none, none.withColumnRenamed("hay", "needle")).count() == 0
    v = spark.createDataFrame([(1, "a")], "doc int, title string")
    assert redact.scrub(v, v.select("doc", F.col("title").alias("target")).where("false"), "doc", "title", few=0).count() == 1
