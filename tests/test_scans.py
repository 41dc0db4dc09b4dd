"""Scans and first fit against loops, over keys of many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import logs, orders, redact, scans


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(scans, "BITS", 2)
    monkeypatch.setattr(scans, "FOLDED", 5)


def rows_of(seed, n=120):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 8 + ["a", "b", None]), k, r.randrange(40)) for k in range(n)]


def test_running_sums(spark, small):
    rows = rows_of(1)
    df = scans.ordered(spark.createDataFrame(rows, "k string, n int, s long"), ["k"], ["n"])
    got = sorted(((r.k, r.n, r.before) for r in scans.running_sums(df, ["k"], "s").collect()), key=repr)
    seen, want = {}, []
    for k, n, s in rows:
        want.append((k, n, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + s
    assert got == sorted(want, key=repr)
    assert scans.running_sums(df.where("false"), ["k"], "s").count() == 0


@pytest.mark.parametrize("capacity", [0, 150])
def test_first_fit(spark, small, capacity):
    rows = [r for r in rows_of(capacity + 2) if r[0]]
    df = scans.ordered(spark.createDataFrame(rows, "k string, n int, s long"), ["k"], ["n"]).withColumn("capacity", F.lit(capacity).cast("bigint"))
    got = sorted((r.k, r.n, r.taken) for r in scans.first_fit(df, ["k"], ("n",)).collect())
    left, want = {}, []
    for k, n, s in rows:
        fits = s <= left.setdefault(k, capacity)
        left[k] -= s * fits
        want.append((k, n, fits))
    assert got == sorted(want)


def test_order_of_many_blocks(spark, small):
    r = random.Random(3)
    rows = [("hot", k, r.choice(["claim", "release", "claim", "odd"] + ["fulfil"] * (k > 100))) for k in range(130)] + [("b", k, r.choice(["claim", "fulfil", "release"])) for k in range(5)]
    got = sorted(map(tuple, orders.transitions(spark.createDataFrame(rows, "out_trade_no string, seq long, action string").repartition(5)).collect()))
    status, want = {}, []
    for o, k, a in rows:
        now = status.get(o, "created")
        status[o] = new = orders.STEPS.get((now, a), now)
        want.append((o, k, a, new, "accepted" if new != now else "replay" if now == "fulfilled" else "conflict"))
    assert got == sorted(want)


def test_outline_of_many_blocks(spark, small):
    r = random.Random(4)
    rows = [(d, k, r.randint(1, 9), "t", 1) for d, n in ((1, 140), (2, 3)) for k in range(n)]
    got = sorted((x.doc_id, x.pos, x.level) for x in redact.relevel(spark.createDataFrame(rows, "doc_id long, pos long, level int, title string, page_no int").repartition(5)).collect())
    open_, want = {}, []
    for d, k, level, *_ in rows:
        stack = open_.setdefault(d, [])
        while stack and stack[-1] >= level:
            stack.pop()
        stack.append(level)
        want.append((d, k, len(stack)))
    assert got == sorted(want)


def test_quota_of_many_blocks(spark, small):
    r = random.Random(5)
    rows = [(r.choice(["d1"] * 5 + ["d2"]), r.randrange(12), f"n{k}", r.choice([None, 0, 1, 3, 8, 20, 41])) for k in range(120)]
    got = {(x.day, x.task_id, x.name): x.reason for x in logs.quota_copy(spark.createDataFrame(rows, "day string, task_id int, name string, size int"), per_task=40, per_day=150).collect()}
    in_day, in_task, want = {}, {}, {}
    for d, t, n, s in sorted(rows, key=lambda x: x[:3]):
        s = s or 0
        a, b = in_task.get((d, t), 0), in_day.get(d, 0)
        want[d, t, n] = "task_quota" if a + s > 40 else "day_quota" if b + s > 150 else None
        if want[d, t, n] is None:
            in_task[d, t], in_day[d] = a + s, b + s
    assert got == want
