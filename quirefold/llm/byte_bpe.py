"""Byte-level BPE encoding and decoding (operator 1).

Pre-tokens are exploded with their positions by Spark's own regular expressions. A chunk of documents sends each of its
distinct words once, to the bucket of the word's hash; there each distinct word of the corpus is encoded once, whatever
number of chunks asks. The ids are joined back to the chunk's positions and reassembled. Decoding joins the token-byte
table, whose size is that of the vocabulary file.

Defined results: null text counts as empty; an empty text has no ids; every input row gives one row, also where ids
repeat or are null; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Words of a chunk at most, unless one document has more.
CHUNK_WORDS = 500_000

_encoders: dict = {}


def java_pattern(pattern: str) -> str:
    r"""Java's \s is ASCII; the tokenizer's is Unicode's White_Space."""
    return pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(ranks: dict[bytes, int], pattern: str):
    if (key := (len(ranks), pattern)) not in _encoders:
        import tiktoken

        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, lists of words) of CHUNK_WORDS words at most, or of one longer document. Where a chunk ends depends on the
    order of the rows alone, not on how they are cut into batches."""
    ids, lists, held = [], [], 0
    for batch in batches:
        ends = np.cumsum(np.concatenate(([0], np.asarray(batch.column(1).value_lengths()))))
        at = 0
        while at < len(batch):
            to = max(at, int(np.searchsorted(ends, ends[at] + CHUNK_WORDS - held, side="right")) - 1)
            to = to if ids else max(to, at + 1)
            if to > at:
                ids.append(batch.column(0).slice(at, to - at))
                lists.append(batch.column(1).slice(at, to - at))
                held += ends[to] - ends[at]
            if to < len(batch):
                yield pa.concat_arrays(ids), pa.concat_arrays(lists)
                ids, lists, held = [], [], 0
            at = to
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(lists)


def _chunks(batches: Iterator[pa.RecordBatch], n_buckets: int):
    """(chunk, ids of rows, words of rows, distinct words by bucket, their numbers by bucket, place of each position's word)."""
    part = TaskContext.get().partitionId()
    for k, (ids, lists) in enumerate(_cut(batches)):
        coded = lists.flatten().dictionary_encode()
        words, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        hashes = C.string_hashes(words)
        bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        mark = hashlib.blake2b(hashes.tobytes() + place.tobytes(), digest_size=8).hexdigest()
        yield f"{part}-{k}-{mark}", ids, np.asarray(lists.value_lengths()), words.take(pa.array(order)), np.bincount(bucket, minlength=n_buckets), rank[place]


def _asked(n_buckets: int):
    def run(batches):
        for chunk, _, _, words, counts, _ in _chunks(batches, n_buckets):
            ends = np.cumsum(counts)
            full = np.flatnonzero(counts)
            blobs = [C.pack_strings(words.slice(ends[b] - counts[b], counts[b])) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.string()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "words"])

    return run


def _placed(n_buckets: int):
    def run(batches):
        for chunk, ids, lengths, words, _, places in _chunks(batches, n_buckets):
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([C.pack(lengths)], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([C.pack(places)], pa.binary())], ["chunk", "ids", "lengths", "n_words", "places"])

    return run


def _encode_words(ranks, pattern: str):
    """All that chunks ask of one bucket: each distinct word is encoded once."""

    def run(asked: pa.Table) -> pa.Table:
        encode = _encoder(ranks.value, pattern)._encode_single_piece
        lists = [C.unpack_strings(b) for b in asked["words"].to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        ids = pa.array([encode(w) for w in coded.dictionary.to_pylist()], pa.list_(pa.int32()))
        out, at = [], 0
        for words in lists:
            mine = ids.take(coded.indices.slice(at, len(words)))
            at += len(words)
            out.append(C.pack(np.concatenate((np.asarray(mine.value_lengths()), np.asarray(mine.flatten())))))
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "n": pa.array([len(x) for x in lists], pa.int64()), "coded": pa.array(out, pa.binary())})

    return run


def _reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
    rows_ids, rows_coded = [], []
    answers = sorted(zip(right["bucket"].to_pylist(), right["n"].to_pylist(), right["coded"].to_pylist(), strict=True))
    parts = [(n, C.unpack(b)) for _, n, b in answers]
    lengths = np.concatenate([np.zeros(0, np.int64), *(p[:n].astype(np.int64) for n, p in parts)])
    flat = np.concatenate([np.zeros(0, np.uint32), *(p[n:].astype("<u4") for n, p in parts)])
    starts = np.cumsum(lengths) - lengths
    if left.num_rows != 1 or left["n_words"][0].as_py() != len(lengths):
        raise RuntimeError("a chunk was cut differently in two readings; write the input as a table first")
    places = C.unpack(left["places"][0].as_py()).astype(np.int64)
    tokens = flat[C.ragged(starts[places], lengths[places])]
    by_word = np.concatenate(([0], np.cumsum(lengths[places])))
    ends = by_word[np.concatenate(([0], np.cumsum(C.unpack(left["lengths"][0].as_py()).astype(np.int64))))]
    for doc, a, b in zip(left["ids"][0].as_py(), ends[:-1], ends[1:], strict=True):
        rows_ids.append(doc)
        rows_coded.append(tokens[a:b].tobytes())
    return pa.table({"doc_id": pa.array(rows_ids, left["ids"].type.value_type), "ids": pa.array(rows_coded, pa.binary())})


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids binary): token ids of each whole text as little-endian unsigned 32-bit integers. The input is read
    twice and must come in the same order both times, as a table does, however its rows are cut into batches; a
    difference stops the job."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    n = C.buckets_for(C.text_bytes(docs, text))
    split = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(java_pattern(pattern)), F.lit(0)).alias("pre"))
    id_type = split.schema["doc_id"].dataType.simpleString()
    asked = split.mapInArrow(_asked(n), "bucket int, chunk string, words binary")
    coded = asked.groupBy("bucket").applyInArrow(_encode_words(ranks, pattern), "chunk string, bucket int, n bigint, coded binary")
    placed = split.mapInArrow(_placed(n), f"chunk string, ids array<{id_type}>, lengths binary, n_words bigint, places binary")
    return placed.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(_reassemble, f"doc_id {id_type}, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded binary). The token-byte table has as many rows as the vocabulary file and is broadcast."""
    ranks = read_ranks(ranks_path)
    by_id = sorted((i, b) for b, i in ranks.items())
    lengths = np.zeros(by_id[-1][0] + 1, np.int64)
    lengths[[i for i, _ in by_id]] = [len(b) for _, b in by_id]
    small = encoded.sparkSession.sparkContext.broadcast((lengths, np.frombuffer(b"".join(b for _, b in by_id), np.uint8)))

    def run(batches):
        lengths, data = small.value
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            for part in C.slices(iter([batch]), "ids", 8 << 20):
                offsets, raw = C.string_buffers(part.column(1))
                ids = raw.view("<u4").astype(np.int64) if raw.flags["C_CONTIGUOUS"] and not raw.ctypes.data % 4 else np.frombuffer(raw.tobytes(), "<u4").astype(np.int64)
                out = data[C.ragged(starts[ids], lengths[ids])]
                ends = np.concatenate(([0], np.cumsum(lengths[ids])))[offsets // 4]
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), column.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids binary, decoded binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select(
        "doc_id",
        *more,
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(C.table(spark, sf_dir, "documents"), ranks), ranks))
