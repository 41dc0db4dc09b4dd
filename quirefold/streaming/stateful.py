"""Operators that keep a state for each key and set event-time timers. A state goes when its timer fires, so what is held
follows the keys that are open within the idle time, the retention or the tolerance, and the watermark's delay.

Keys are dealt to buckets by hash. The states of a bucket's keys are one value of the store and the earliest time that
falls due is its timer; a batch reads and writes the open states of the buckets that it meets. Values travel with the rows
in Arrow batches and back with the answers, so Python makes no call to the store.

They keep more than fits in memory in a store on disk: see state_store.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside use RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def micros(duration: str) -> int:
    """Microseconds of a fixed span such as '2 hours'."""
    n, unit = duration.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


#: Buckets of keys. Fewer make fewer calls, more make smaller states.
BUCKETS = 1024


def _late_ms(at: int) -> int:
    """The first whole millisecond at or after a time in microseconds."""
    return -(-at // 1000)


class _Bucketed(StatefulProcessor):
    """The states of a bucket's keys by key. taken(key, rows, state) gives an answer's rows and sets state[key];
    expired(key, state, now) the same for what is due at a time in microseconds, and due(state[key]) is the time at which a
    key's state falls due, or None. Rows are tuples of the columns FIELDS, answers tuples of the columns ANSWERS."""

    FIELDS: tuple[str, ...]
    ANSWERS: tuple[str, ...]

    def init(self, handle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "states binary, timer bigint")

    def taken(self, key, rows, state):
        raise NotImplementedError

    def expired(self, key, state, now):
        raise NotImplementedError

    def due(self, value) -> int | None:
        return None

    def _held(self) -> tuple[dict, int | None]:
        packed, timer = self.states.get() or (None, None)
        return pickle.loads(packed) if packed else {}, timer

    def _keep(self, state: dict, timer: int | None) -> None:
        """timer: the one that is set already, if any."""
        due = min((_late_ms(d) for d in map(self.due, state.values()) if d is not None), default=None)
        if due is not None and (timer is None or due < timer):
            self.handle.registerTimer(due)
            timer = due
        if state:
            self.states.update((pickle.dumps(state, 5), timer))
        else:
            self.states.clear()

    def _frames(self, answers: list[tuple]) -> Iterator[pd.DataFrame]:
        if answers:
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(self.ANSWERS, zip(*answers))})

    def handleInputRows(self, key, rows, timerValues):
        by_key = defaultdict(list)
        for frame in rows:
            for k, *row in zip(*(frame[c].tolist() for c in ("key", *self.FIELDS))):
                by_key[k].append(row)
        state, timer = self._held()
        answers = [a for k, new in by_key.items() for a in self.taken(k, new, state)]
        self._keep(state, timer)
        yield from self._frames(answers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        fired = expiredTimerInfo.getExpiryTimeInMs()
        state, timer = self._held()
        if timer is None or fired < timer:  # one that an earlier one has stood in for
            return
        # all that is earlier than this has come: the watermark is behind it
        now = max(fired, timerValues.getCurrentWatermarkInMs() - 1)
        due = [k for k, v in state.items() if (d := self.due(v)) is not None and _late_ms(d) <= now]
        answers = [a for k in due for a in self.expired(k, state, now * 1000)]
        self._keep(state, None)
        yield from self._frames(answers)

    def close(self) -> None:
        pass

    def bucket(self, key, rows, group) -> Iterator[pd.DataFrame]:
        """For applyInPandasWithState: the bucket's rows, if it has any, and then what is due at the watermark."""
        store = _Store(group)
        self.init(store)
        if not group.hasTimedOut:
            yield from self.handleInputRows(key, rows, store)
        if store.due():
            yield from self.handleExpiredTimer(key, store, store)
        store.close()


class _Store:
    """A bucket's value and timer, as they came with its rows, in place of the store; close() hands them back. The timer is
    a part of the value."""

    def __init__(self, group):
        self.group = group
        self.value = group.getOption
        self.timed = group._timeout_conf != GroupStateTimeout.NoTimeout

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value) -> None:
        self.value = value

    def clear(self) -> None:
        self.value = None

    def registerTimer(self, at) -> None:
        pass

    def getCurrentWatermarkInMs(self) -> int:
        return self.group.getCurrentWatermarkMs()

    def getExpiryTimeInMs(self) -> int:
        return self.value[1]

    def due(self) -> bool:
        return self.timed and self.value is not None and self.value[1] is not None and self.value[1] < self.getCurrentWatermarkInMs()

    def close(self) -> None:
        if self.value is not None:
            self.group.update(self.value)
            if self.timed and self.value[1] is not None:
                self.group.setTimeoutTimestamp(max(self.value[1], 1))  # it must be above 0
        elif self.group.exists:
            self.group.remove()


def _at() -> Column:
    return F.coalesce(F.unix_micros("ts"), F.raise_error(F.lit("a row without a time")).cast("bigint"))


def _run(rows: DataFrame, processor: _Bucketed, schema: str, timeout: str = GroupStateTimeout.EventTimeTimeout) -> DataFrame:
    """rows: key, the processor's fields, of which no number or boolean is null, and perhaps the watermark's column. Keys
    travel as text; they come back as `key` in their own type."""
    kind = rows.schema["key"].dataType
    dealt = rows.withColumn("key", F.col("key").cast("string")).withColumn("__bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    form = f"key string, {schema}"

    def run(key, frames, group):
        yield from processor.bucket(key, frames, group)

    found = dealt.groupBy("__bucket").applyInPandasWithState(run, form, "states binary, timer bigint", "append", timeout)
    return found.withColumn("key", F.col("key").cast(kind))


# -- uploads -----------------------------------------------------------------------------------------------------------


class _Uploads(_Bucketed):
    FIELDS = ("at", "has_idx", "idx", "total")
    ANSWERS = ("key", "idx", "at", "outcome", "n_got")

    def __init__(self, idle: int):
        self.idle = idle

    def due(self, value):
        return value[0] + self.idle

    def taken(self, key, rows, state):
        last, bits, complete = state.get(key, (None, 0, False))
        for at, has_idx, idx, total in sorted(rows, key=lambda r: (r[0], not r[1], r[2])):
            if not has_idx or not 0 <= idx < total:
                yield key, idx if has_idx else None, at, "invalid", None
                continue
            if last is not None and at - last > self.idle:  # the idle session is given up and begins anew
                if not complete:
                    yield key, None, last + self.idle, "abandoned", bits.bit_count()
                last, bits, complete = None, 0, False
            if bits >> idx & 1:
                yield key, idx, at, "repeated", bits.bit_count()
                continue
            last, bits = max(at, last or at), bits | 1 << idx
            whole = bits & (1 << total) - 1 == (1 << total) - 1
            complete = complete or whole
            yield key, idx, at, "complete" if whole else "uploading", bits.bit_count()
        if last is not None:
            state[key] = (last, bits, complete)

    def expired(self, key, state, now):
        last, bits, complete = state.pop(key)
        if not complete:
            yield key, None, last + self.idle, "abandoned", bits.bit_count()


def upload_sessions(parts: DataFrame, delay: str, idle: str = "2 hours") -> DataFrame:
    """parts (task_id, idx, total, ts) of piecewise uploads, as they come: (task_id, idx, at in microseconds, outcome,
    n_got). A part is `uploading`, or `complete` the moment its session has all indexes from 0 to total - 1; an index that
    the session has is `repeated` and one outside of 0 to total - 1 `invalid`, and neither counts as activity (an invalid one belongs to no
    session and has no n_got). After
    `idle` without an accepted part a session ends; one that was never complete gives a row `abandoned`, without index. A
    session's state is one bit an index."""
    idx, total = F.col("idx").cast("int"), F.col("total").cast("int")
    numbers = (idx.isNotNull().alias("has_idx"), F.coalesce(idx, F.lit(-1)).alias("idx"), F.coalesce(total, F.lit(0)).alias("total"))
    rows = parts.select(F.col("task_id").alias("key"), *numbers, _at().alias("at"), "ts").withWatermark("ts", delay)
    return _run(rows, _Uploads(micros(idle)), "idx int, at bigint, outcome string, n_got int").withColumnRenamed("key", "task_id")


# -- retention ---------------------------------------------------------------------------------------------------------


class _Retention(_Bucketed):
    FIELDS = ("at", "rank", "has_blob")
    ANSWERS = ("key", "action", "at")
    RANK = {"created": 0, "claimed": 1, "fulfilled": 2}

    def __init__(self, created: int, blob: int):
        self.created, self.blob = created, blob

    def due(self, value):
        return value[1]

    def taken(self, key, rows, state):
        status, due = state.get(key, (None, None))
        for at, rank, has_blob in sorted(rows, key=lambda r: r[:2]):
            if status is None and rank == 0:
                status, due = "created", at + self.created
            elif status == "created" and rank == 1 and at <= due:
                status, due = "verified", None
            elif status == "verified" and rank == 2:
                status, due = "fulfilled", at + self.blob if has_blob else None
        if status is not None:
            state[key] = (status, due)
        return ()

    def expired(self, key, state, now):
        status, due = state.pop(key)
        yield key, "delete" if status == "created" else "clear", due


def retention_timers(events: DataFrame, delay: str, created_hours: int = 48, blob_days: int = 90) -> DataFrame:
    """events (out_trade_no, kind, has_blob, ts): (out_trade_no, action, at in microseconds) when an order is due. `delete`
    `created_hours` after a created order was not claimed (a claim at that very time is in time, a later one finds no
    order); `clear` `blob_days` after an order with a blob was fulfilled. A batch run at a time `now` would do what is due
    before it (orders.stale). An order that is claimed and never fulfilled is kept, as the rules ask; one whose timer has
    fired is forgotten."""
    rank = F.lit(9)
    for kind, k in _Retention.RANK.items():
        rank = F.when(F.col("kind") == kind, k).otherwise(rank)
    rows = events.select(F.col("out_trade_no").alias("key"), rank.alias("rank"), F.coalesce("has_blob", F.lit(False)).alias("has_blob"), _at().alias("at"), "ts").withWatermark("ts", delay)
    made = _Retention(created_hours * micros("1 hour"), blob_days * micros("1 day"))
    return _run(rows, made, "action string, at bigint").withColumnRenamed("key", "out_trade_no")


# -- as-of join --------------------------------------------------------------------------------------------------------


class _AsOf(_Bucketed):
    FIELDS = ("at", "is_request", "id")
    ANSWERS = ("key", "task_id", "last_seen", "request_id", "request_time")

    def __init__(self, reach: int):
        self.reach = reach

    def due(self, value):
        return min(at for at, _, _ in value) + self.reach  # a request without a task goes then too

    def taken(self, key, rows, state):
        state[key] = state.get(key, []) + list(map(tuple, rows))
        return ()

    def expired(self, key, state, now):
        rows = sorted(state.pop(key))
        found, last = {}, None
        for at, is_request, id_ in rows:  # in order of time, a task before a request of the same time
            if not is_request:
                last = (at, id_)
                found[last] = None
            elif last and at - last[0] <= self.reach:
                found[last] = (at, id_)  # of several the latest
        kept = [x for x in rows if x[0] + self.reach > now]
        if kept:
            state[key] = kept
        for (at, id_), request in found.items():
            if at + self.reach <= now:
                yield key, id_, at, request and request[1], request and request[0]


def as_of(tasks: DataFrame, requests: DataFrame, seconds: int, delay: str, key: str = "user_id") -> DataFrame:
    """tasks (key, task_id, last_seen) and requests (key, request_id, time): (key, task_id, last_seen, request_id,
    request_time), times in microseconds. Each request belongs to the latest task of its key at most `seconds` before it;
    of several requests of a task the latest stays. A task is given once, when the watermark has passed the last request
    that it might get, so rows that come out of order within `delay` make no difference. What is held of a key are the
    tasks and requests of the last `seconds` and the delay.

    The batch form (logs.correlate) gives the same for what is due."""
    one = lambda df, is_request, id_, time: df.select(F.col(key).alias("key"), F.lit(is_request).alias("is_request"), F.col(id_).cast("string").alias("id"), F.col(time).cast("timestamp").alias("ts"))
    rows = one(tasks, False, "task_id", "last_seen").unionByName(one(requests, True, "request_id", "time")).withColumn("at", _at()).withWatermark("ts", delay)
    schema = "task_id string, last_seen bigint, request_id string, request_time bigint"
    return _run(rows, _AsOf(seconds * 1_000_000), schema).withColumnRenamed("key", key)


# -- orders ------------------------------------------------------------------------------------------------------------


class _Order(_Bucketed):
    """A state is the number of an order's status. A bucket's rows are stepped in columns: each action is a map of the
    statuses, and an order's maps are joined over 1, 2, 4 rows and so on, so one order of many events is no loop either."""

    FIELDS = ("seq", "action")
    ANSWERS = ("key", "seq", "action", "status", "outcome")

    def __init__(self, steps: dict):
        names = dict.fromkeys(("created", *(s for s, _ in steps), *steps.values()))
        self.names, self.maps = np.array(list(names), dtype=object), {}
        number = {s: k for k, s in enumerate(names)}
        for a in {a for _, a in steps}:
            self.maps[a] = [number[steps.get((s, a), s)] for s in names]
        self.done = number.get("fulfilled", -1)

    def handleInputRows(self, key, rows, timerValues):
        packed, _ = self.states.get() or (None, None)
        known, had = pickle.loads(packed) if packed else (np.zeros(0, object), np.zeros(0, np.int8))
        columns = [[f["key"].to_numpy(object), f["seq"].to_numpy(np.int64), f["action"].to_numpy(object)] for f in rows]
        keys, seq, action = map(np.concatenate, zip(*columns))
        code, keys_of = pd.factorize(np.concatenate([known, keys]), use_na_sentinel=False)
        status = np.zeros(len(keys_of), np.int8)
        status[code[: len(known)]] = had
        code = code[len(known) :]
        kind, kinds = pd.factorize(action, use_na_sentinel=False)
        named = [a if isinstance(a, str) else "" for a in kinds]  # an action that is null comes as an empty one
        rank = np.unique(np.array(named, dtype=object), return_inverse=True)[1]
        order = np.lexsort((rank[kind], seq, code))
        code, kind = code[order], kind[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        lengths = np.diff(first, append=len(code))
        place = np.arange(len(code)) - np.repeat(first, lengths)
        same = list(range(len(self.names)))
        steps = np.array([self.maps.get(a, same) for a in named], np.int8)[kind]
        reach = 1
        while reach < lengths.max():
            later = np.flatnonzero(place >= reach)
            steps[later] = np.take_along_axis(steps[later], steps[later - reach].astype(np.intp), 1)
            reach *= 2
        new = steps[np.arange(len(code)), status[code]]
        was = np.where(place == 0, status[code], np.roll(new, 1))
        last = first + lengths - 1
        status[code[last]] = new[last]
        self.states.update((pickle.dumps((keys_of, status), 5), None))
        outcome = np.where(new != was, "accepted", np.where(was == self.done, "replay", "conflict")).astype(object)
        yield pd.DataFrame(dict(zip(self.ANSWERS, (keys[order], seq[order], action[order], self.names[new], outcome))))


def order_lifecycle(events: DataFrame) -> DataFrame:
    """events (out_trade_no, seq, action) as they come: status and outcome after each, by the rules of orders.transitions.
    The state is the number of an order's status."""
    from ..operators.orders import STEPS

    seq = F.coalesce(F.col("seq").cast("bigint"), F.raise_error(F.lit("an event without a number")).cast("bigint"))
    rows = events.select(F.col("out_trade_no").alias("key"), seq.alias("seq"), "action")
    return _run(rows, _Order(STEPS), "seq bigint, action string, status string, outcome string", GroupStateTimeout.NoTimeout).withColumnRenamed("key", "out_trade_no")


def in_order(time: Column, parts: int, low, high) -> Column:
    """The number of the equal part of the time from low to high in which a row lies, 0 to parts - 1: how a table is dealt
    out to be replayed as a stream."""
    share = (F.unix_micros(time.cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp"))) / F.greatest(F.lit(1), F.unix_micros(F.lit(high).cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp")) + 1)
    return F.least(F.lit(parts - 1), F.floor(share * parts)).cast("int")
