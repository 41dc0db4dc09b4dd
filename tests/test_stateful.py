"""Streams with timers: literals with rows out of order and late, and the batch forms."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.operators import logs, orders, redact
from quirefold.streaming import stateful as S
from quirefold.streaming import streams as X

DAY = datetime(2026, 1, 1, tzinfo=timezone.utc)
HOUR = 3_600_000_000
START = int(DAY.timestamp()) * 1_000_000


def replay(spark, tmp_path, batches, schema, run):
    """Each list of rows is a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with S.state_store(spark):
        return X.to_table(run(X.tail(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)), str(tmp_path)).collect()


def at(hours):
    return DAY + timedelta(hours=hours)


def test_state_store_setting_comes_back(spark):
    before = spark.conf.get(S._PROVIDER)
    with pytest.raises(ValueError), S.state_store(spark):
        raise ValueError
    assert spark.conf.get(S._PROVIDER) == before


def test_uploads(spark, tmp_path):
    a = [("a", 1, 2, at(0)), ("a", 0, 2, at(0.5)), ("b", 0, 2, at(0)), ("b", 0, 2, at(0.1)), ("b", 5, 2, at(0.2)), ("c", 0, 1, at(0)), ("d", None, 1, at(0))]
    b = [("b", 1, 2, at(4)), ("b", 0, 2, at(4.5)), ("e", 0, 2, at(4))]
    late = [("z", 0, 1, at(60)), ("a", 0, 2, at(0))]  # the second is behind the watermark
    got = replay(spark, tmp_path, [a, b, [("z", 0, 1, at(30))], late], "task_id string, idx int, total int, ts timestamp", lambda s: S.upload_sessions(s, "1 hour"))
    hours = lambda t: (t - START) / HOUR
    assert sorted(((r.task_id, hours(r.at), r.outcome, r.n_got) for r in got), key=repr) == sorted(
        [
            ("a", 0.0, "uploading", 1), ("a", 0.5, "complete", 2), ("b", 0.0, "uploading", 1), ("b", 0.1, "repeated", 1), ("b", 0.2, "invalid", None), ("b", 2.0, "abandoned", 1),
            ("b", 4.0, "uploading", 1), ("b", 4.5, "complete", 2), ("c", 0.0, "complete", 1), ("d", 0.0, "invalid", None), ("e", 4.0, "uploading", 1), ("e", 6.0, "abandoned", 1),
            ("z", 30.0, "complete", 1), ("z", 60.0, "complete", 1),
        ],
        key=repr,
    )


def test_retention_like_the_batch_form(spark, tmp_path):
    r = random.Random(7)
    events, table = [], []
    for k in range(60):
        t0, n = r.uniform(0, 2000), f"o{k}"
        events.append((n, "created", None, at(t0)))
        t1 = t0 + r.choice([1, 30, 47.5, 50])
        kind, blob = r.choice(["created", "verified", "fulfilled"]), r.random() < 0.7
        if kind != "created":
            events.append((n, "claimed", None, at(t1)))
        if kind == "fulfilled":
            events.append((n, "fulfilled", blob, at(t1 + 1)))
        table.append((n, t0, t1, kind, blob))
    events.sort(key=lambda e: e[3])
    batches = [events[i : i + 40] for i in range(0, len(events), 40)]
    for b in batches:
        r.shuffle(b)
    last = at(9000)
    got = replay(spark, tmp_path, [*batches, [("end", "other", None, last)]], "out_trade_no string, kind string, has_blob boolean, ts timestamp", lambda s: S.retention_timers(s, "1 hour"))
    for hour in (60, 700, 2300, 5000):
        rows = []  # the table as it is at that hour, if every due order went before
        for n, t0, t1, kind, blob in table:
            late = t1 > t0 + 48
            status = "created" if kind == "created" or late or t1 > hour else "verified" if kind == "verified" or t1 + 1 > hour else "fulfilled"
            rows.append((n, status, at(t0), at(t1 + 1) if status == "fulfilled" else None, "x" if status == "fulfilled" and blob else None))
        df = spark.createDataFrame([x for x in rows if x[2] < at(hour)], "out_trade_no string, status string, created_at timestamp, fulfilled_at timestamp, result_cache string")
        want = {(x.out_trade_no, x.action) for x in orders.stale(df, F.lit(at(hour))).where("action <> 'keep'").collect()}
        assert {(x.out_trade_no, x.action) for x in got if x.at < START + hour * HOUR} == want


def test_as_of_like_the_batch_form(spark, tmp_path):
    r = random.Random(3)
    rows = sorted((r.uniform(0, 40), r.random() < 0.5, f"{k:03}", r.choice([1, 1, 1, 2, None])) for k in range(240))
    rows += [(10.0, True, "900", 3), (10.0, False, "901", 3), (13.0, False, "902", 3)]
    rows.sort(key=lambda x: x[0])
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for i in range(len(batches) - 1):  # some come a batch later, within the delay
        moved = [x for x in batches[i] if batches[i + 1][0][0] - x[0] < 1]
        batches[i] = [x for x in batches[i] if x not in moved]
        batches[i + 1] = moved + batches[i + 1]
    made = [[(u, is_task, i, at(t)) for t, is_task, i, u in b] for b in [*batches, [(200.0, True, "999", 9)]]]

    def run(s):
        tasks = s.where("is_task").select("user_id", F.col("id").alias("task_id"), F.col("ts").alias("last_seen"))
        return S.as_of(tasks, s.where("NOT is_task").select("user_id", F.col("id").alias("request_id"), F.col("ts").alias("time")), 3 * 3600, "3 hours")

    got = replay(spark, tmp_path, made, "user_id int, is_task boolean, id string, ts timestamp", run)
    all_ = spark.createDataFrame([x for b in made for x in b], "user_id int, is_task boolean, id string, ts timestamp").where("id <> '999'")
    tasks = all_.where("is_task").select("user_id", F.col("id").alias("task_id"), F.col("ts").alias("last_seen"))
    want = logs.correlate(tasks, all_.where("NOT is_task").select("user_id", F.col("id").alias("request_id"), F.col("ts").alias("time")), 3 * 3600, "user_id")
    named = want.where("user_id IS NOT NULL").select("task_id", "request_id", F.unix_micros("request_time")).collect()
    assert sorted(map(tuple, named), key=repr) == sorted(((x.task_id, x.request_id, x.request_time) for x in got if x.user_id is not None), key=repr)
    assert {(x.request_id, x.request_time) for x in got if x.user_id is None} == {(None, None)} or any(x.user_id is None for x in got)


def test_orders_like_the_batch_form(spark, tmp_path):
    events = [("a", k, x) for k, x in enumerate(("claim", "claim", "release", "claim", "fulfil", "claim"))] + [("b", 0, "fulfil"), ("b", 1, None)]
    got = replay(spark, tmp_path, [events[:3], events[3:]], "out_trade_no string, seq bigint, action string", S.order_lifecycle)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, orders.transitions(spark.createDataFrame(events, "out_trade_no string, seq bigint, action string")).collect()), key=repr)


def test_orders_are_stepped_in_columns():
    """A bucket's rows cost no look-up each, and agree with a loop: long orders, nulls, ties, and states between batches."""

    class Steps(dict):
        calls = 0

        def get(self, *of):
            Steps.calls += 1
            return super().get(*of)

    r, store, made = random.Random(4), Store(), S._Order(Steps(orders.STEPS))
    made.init(store)
    now = {}
    for _ in range(3):
        rows = [(r.choice(["a", "b", "c", None, "d" * 9]), r.randrange(900), r.choice(["claim", "fulfil", "release", "claim", "release", None, "", "x"])) for _ in range(3000)]
        rows += [("e", 1, "fulfil"), ("only", 0, None)]
        frames = [pd.DataFrame(part, columns=["key", "seq", "action"]).astype({"key": object, "action": object}) for part in (rows[:1000], rows[1000:])]
        got = [x for f in made.handleInputRows((0,), iter(frames), None) for x in zip(*(f[c].tolist() for c in made.ANSWERS))]
        want = []
        for k, seq, action in sorted(rows, key=lambda x: (x[1], x[2] or "")):
            old = now.get(k, "created")
            now[k] = orders.STEPS.get((old, action), old)
            want.append((k, seq, action, now[k], "accepted" if now[k] != old else "replay" if old == "fulfilled" else "conflict"))
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert Steps.calls <= 20


def test_keywords_from_a_table(spark, monkeypatch):
    monkeypatch.setattr(redact, "SEGMENT", 40)
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abAB 中é") for _ in range(n))
    texts = [word(r.randrange(0, 300)) for _ in range(30)] + ["", None, "x" * 100, "x" * 100]
    words = [w for t in texts if t for w in (t[3:4], t[5:9], t[10:30], t[30:47])] + ["", None, "xx", "zz", "xx"]
    pages = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, keyword string")
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    for ignore_case in (False, True):
        low = (lambda s: s.lower()) if ignore_case else (lambda s: s)
        want = {(i, w, low(t).count(low(w))) for i, t in enumerate(texts) if t for w in set(words) if w and low(w) in low(t)}
        found = redact.keyword_table_hits(pages, keywords, ignore_case=ignore_case).groupBy("doc_id", "literal").count().collect()
        assert {tuple(x) for x in found} == want
    assert redact.keyword_table_hits(pages, keywords.where("false")).count() == 0
    masked = redact.mask_hits(pages.select("doc_id", "text"), redact.keyword_table_hits(pages.select("doc_id", "text"), keywords), ["doc_id"])
    for x in masked.collect():
        t = texts[x.doc_id]
        for w in sorted({w for w in words if w and t and w in t}, key=lambda w: (-len(w), w)):
            t = t.replace(w, "")
        assert x.text == t


def test_keywords_are_searched_where_texts_lie(spark, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("ab é") for _ in range(r.randrange(0, 400))) for _ in range(40)] + ["aaaaaaa", "", None]
    words = sorted({t[i : i + n] for t in texts if t for i, n in ((0, 1), (3, 2), (5, 7), (9, 33), (20, 70), (1, 130))} - {""}) + ["aaa", "nowhere"]
    pages, keywords = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame([(w,) for w in words], "keyword string")
    want = {(i, w, t.count(w)) for i, t in enumerate(texts) if t for w in words if w in t}
    for segment in (1 << 16, 7):
        monkeypatch.setattr(redact, "SEGMENT", segment)
        hits = redact.keyword_table_hits(pages, keywords)
        assert {tuple(x) for x in hits.groupBy("doc_id", "literal").count().collect()} == want
    # texts stay where they are: what is dealt are stretches that may be keywords
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "MapInArrow" in plan


class Store:
    """A store of one bucket, which counts calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.calls, self.timers = self.calls + 1, [*self.timers, at]

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None


def test_calls_to_the_store_follow_buckets():
    store, made = Store(), S._Retention(48 * HOUR, 90 * 24 * HOUR)
    made.init(store)
    rows = pd.DataFrame([(f"o{k}", k, 0, False) for k in range(1000)], columns=["key", "at", "rank", "has_blob"])
    assert list(made.handleInputRows((0,), iter([rows]), None)) == []
    assert store.calls == 3 and len(store.timers) == 1


def test_keys_that_share_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 1)
    batches = [[(1, "created", None, at(0)), (2, "created", None, at(1)), (None, "created", None, at(2))], [(1, "claimed", None, at(47)), (3, "created", None, at(60))], [(9, "other", None, at(75))], [(9, "other", None, at(200))]]
    got = replay(spark, tmp_path, batches, "out_trade_no bigint, kind string, has_blob boolean, ts timestamp", lambda s: S.retention_timers(s, "1 hour"))
    assert sorted(((r.out_trade_no, r.action, (r.at - START) / HOUR) for r in got), key=repr) == [(2, "delete", 49.0), (3, "delete", 108.0), (None, "delete", 50.0)]


class Group:
    """What applyInPandasWithState hands in for a bucket."""

    _timeout_conf, exists = "EventTimeTimeout", True

    def __init__(self, value, watermark, timed_out=False):
        self.getOption, self.watermark, self.hasTimedOut, self.timer = value, watermark, timed_out, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.getOption = value

    def remove(self):
        self.getOption = None

    def setTimeoutTimestamp(self, at):
        assert at >= self.watermark  # Spark refuses earlier ones
        self.timer = at


def test_states_travel_with_the_rows():
    """No call to a store: a bucket's value comes and goes with its rows, what is due goes in the same batch, and the timer
    is set anew each time, as Spark forgets it."""
    made, hours = S._Retention(48 * HOUR, 90 * 24 * HOUR), 3_600_000
    rows = lambda *of: iter([pd.DataFrame(of, columns=["key", "at", "rank", "has_blob"])])
    first = Group(None, 0)
    assert list(made.bucket((0,), rows(("a", HOUR, 0, False), ("b", 30 * HOUR, 0, False)), first)) == [] and first.timer == 49 * hours
    second = Group(first.getOption, 10 * hours)
    assert list(made.bucket((0,), rows(("b", 31 * HOUR, 1, False)), second)) == [] and second.timer == 49 * hours
    third = Group(second.getOption, 60 * hours)
    (gone,) = made.bucket((0,), rows(("c", 1 * HOUR, 0, False), ("d", 60 * HOUR, 0, False)), third)
    assert sorted(gone["key"].tolist()) == ["a", "c"] and third.timer == 108 * hours
    last = Group(third.getOption, 200 * hours, timed_out=True)
    (gone,) = made.bucket((0,), iter([]), last)
    assert gone["key"].tolist() == ["d"] and last.timer is None and last.getOption is not None  # b is verified and stays


def test_arrivals_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "FILE_ROWS", 10)
    X.arrivals(spark.range(300).withColumn("ts", F.timestamp_seconds("id")), "ts", str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 30
