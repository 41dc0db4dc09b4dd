"""Where the texts of a table hold the keywords of another: whole columns of bytes are tested at a time.

A keyword of w to 2 w - 1 bytes, w a power of two, is known by its first w bytes, its last w bytes and its length. Hashes of
all stretches of w bytes come from those of w / 2, so each width costs one reading. A place is looked at closely where the
first w bytes are marked; there each length that keywords have is tested by its own mark. Marks only leave out: what
passes is given as it stands in the text, and the caller joins it with the keywords.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of either table, as a power of two: what the driver holds and tasks get is 4 MB each, whatever the keywords.
MARKS = 25
_A, _B, _C = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


@dataclass
class Marks:
    """Both tables, and the lengths in bytes that keywords have, by width."""

    tables: Broadcast
    lengths: dict[int, list[int]]


def _width(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def _hashes(data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(w, hashes of the w bytes from each place on) for w = 1, 2, 4 to `most`; at the end there is none."""
    h, w = (data.astype(np.uint64) + np.uint64(1)) * _A, 1
    while True:
        yield w, h
        if 2 * w > most or len(h) <= w:
            return
        h = (h[:-w] * _B + h[w:]) * _A
        h ^= h >> np.uint64(29)
        w *= 2


def _first(h: np.ndarray) -> np.ndarray:
    return ((h * _C) >> np.uint64(64 - MARKS)).astype(np.int64)


def _whole(first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    h = (first * _B + last + np.uint64(length)) * _A
    h ^= h >> np.uint64(31)
    return ((h * _C) >> np.uint64(64 - MARKS)).astype(np.int64)


def _set(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1)


def marks(needles: DataFrame) -> Marks:
    """Of a table of one binary column, none of them null or empty. Only slots reach the driver, each once."""

    def slots(batches):
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                w = _width(len(x))
                data = np.frombuffer(x, np.uint8)
                h = next(h for k, h in _hashes(data, w) if k == w)
                out += [(0, int(_first(h[:1])[0]), len(x)), (1, int(_whole(h[:1], h[-1:], len(x))[0]), len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*out)] if out else [pa.array([], pa.int32())] * 3, names=["t", "slot", "length"])

    rows = needles.mapInArrow(slots, "t int, slot int, length int")
    words = rows.groupBy("t", F.shiftright("slot", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, slot & 7)")).alias("bits"), F.collect_set("length").alias("lengths"))
    tables, lengths = np.zeros((2, 1 << (MARKS - 3)), np.uint8), set()
    for r in words.toLocalIterator():
        tables[r["t"], r["at"]] = r["bits"]
        lengths.update(r["lengths"])
    by_width = defaultdict(list)
    for n in sorted(lengths):
        by_width[_width(n)].append(n)
    return Marks(needles.sparkSession.sparkContext.broadcast(tables), dict(by_width))


def _places(data: np.ndarray, ends: np.ndarray, marked: tuple, segment: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text, place, length) of what is marked in joined texts that end at `ends`; places of a text and a length ascend."""
    tables, lengths = marked
    longest = max(n for ns in lengths.values() for n in ns)
    for start in range(0, len(data), segment):
        part = data[start : start + segment + longest - 1]
        for w, h in _hashes(part, max(lengths)):
            if w not in lengths:
                continue
            at = np.flatnonzero(_set(tables[0], _first(h[:segment])))
            for n in lengths[w]:
                own = at[: np.searchsorted(at, len(h) - (n - w))]
                own = own[_set(tables[1], _whole(h[own], h[own + (n - w)], n)) != 0]
                text = np.searchsorted(ends, own + start, side="right")
                inside = own + (start + n) <= ends[text]
                yield text[inside], own[inside] + start, n


def found(rows: DataFrame, hay: str, marked: Marks, segment: int) -> DataFrame:
    """Of rows with a binary column, not null: (other columns, __needle, __n), a row for each different stretch of a text that
    may be a keyword, and how often it stands there, from left to right and without overlaps."""
    keys = [c for c in rows.columns if c != hay]
    tables, lengths = marked.tables, marked.lengths
    form = rows.select(*keys, F.col(hay).alias("__needle"), F.lit(0).alias("__n")).schema
    empty = [pa.array([], pa.binary()), pa.array([], pa.int32())]

    def search(batches):
        for batch in batches:
            texts = batch.column(len(keys)).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
            raw, seen = data.tobytes(), {}
            for text, place, n in _places(data, ends[1:] - ends[0], (tables.value, lengths), segment) if lengths else ():
                for r, at in zip(text.tolist(), place.tolist()):
                    k = (r, raw[at : at + n])
                    have = seen.get(k)
                    if have is None:
                        seen[k] = [at + n, 1]
                    elif at >= have[0]:
                        have[:] = at + n, have[1] + 1
            of = pa.array([r for r, _ in seen], pa.int64())
            new = [pa.array([x for _, x in seen], pa.binary()), pa.array([n for _, n in seen.values()], pa.int32())] if seen else empty
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[: len(keys)]), *new], names=[*keys, "__needle", "__n"])

    return rows.select(*keys, hay).mapInArrow(search, form)


def without(rows: DataFrame, text: str, gone: str, by: bytes) -> DataFrame:
    """rows with `by` in place of each of an array of stretches in a binary column, one after the other. Drops the array."""
    names = [c for c in rows.columns if c != gone]
    at, listed = rows.columns.index(text), rows.columns.index(gone)
    form = rows.drop(gone).schema

    def replaced(batches):
        for batch in batches:
            out = batch.column(at).to_pylist()
            for k, stretches in enumerate(batch.column(listed).to_pylist()):
                if stretches and out[k] is not None:
                    t = out[k]
                    for x in stretches:
                        t = t.replace(x, by)
                    out[k] = t
            columns = [pa.array(out, pa.binary()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(replaced, form)
