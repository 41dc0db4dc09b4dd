"""Alignment of two tokenizers (operator 11).

A byte-level BPE (A) reads a space and the text, a sentence-piece model (B) reads the text and adds the space itself, so
both cut the same bytes. Every token points to the token that overlaps it and reaches farthest to the right, an A token
that ends with its B token to itself; vectorised doubling of the successors (s = s[s]) brings every token to the last one
of its component, which labels its group: the groups between places where both have an end.

Texts are gathered to chunks of about CHUNK_BYTES and cut at spaces that neither tokenizer crosses, where a group ends as
well. The different pieces of a chunk are encoded and aligned once; a text's numbers are sums over its pieces. A chunk is
written as one row: its texts' numbers, which pieces each text holds and how often, and the chunk's different linked id
pairs with the number of its texts that hold them. Spark adds these up over the corpus, finds each A id's highest count,
and joins the counts back to the chunks, where they are summed over links.

Defined results: null text counts as empty; texts that are empty, or whose A or B tokens don't join to a space and the
text, have no tokens (zeros and ''); every input row gives one row and counts as a document of its own, also where ids
repeat or are null; an empty table gives no rows; other columns of the input are not read. A run without such a space is
one piece, so memory follows the longest such run; work in all else is by pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import pieces as P

CHUNK_BYTES = 8 << 20
#: Rows of (text, pair) that are sorted at a time to count the texts that hold a pair, unless one text has more.
BLOCK_PAIRS = 1 << 20


# -- what ids stand for ------------------------------------------------------------------------------------------------


def byte_of_sign() -> dict[str, int]:
    """The bytes that the signs of a byte-level vocabulary stand for: visible Latin-1 signs for themselves, the others, in
    order, for the signs from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    starts: np.ndarray
    lengths: np.ndarray
    data: np.ndarray

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[C.ragged(self.starts[ids], self.lengths[ids])]


def _vocabulary(tokens: list[bytes]) -> Vocabulary:
    lengths = np.array([len(t) for t in tokens], np.int64)
    return Vocabulary(np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(tokens), np.uint8))


def byte_level_vocabulary(tokenizer) -> Vocabulary:
    sign, by_id = byte_of_sign(), {i: t for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    return _vocabulary([bytes(sign[c] for c in by_id[i]) if i in by_id else b"" for i in range(max(by_id) + 1)])


def piece_vocabulary(model) -> Vocabulary:
    token = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return _vocabulary([token(i) for i in range(model.get_piece_size())])


@cache
def _digits(n: int) -> Vocabulary:
    return _vocabulary([b"%d" % i for i in range(n)])


# -- aligning pieces ---------------------------------------------------------------------------------------------------


def terminals(successor: np.ndarray) -> np.ndarray:
    """Where each node's chain of successors ends, by doubling: as many rounds as the longest chain has binary digits."""
    while True:
        further = successor[successor]
        if (further == successor).all():
            return successor
        successor = further


@dataclass
class Aligned:
    """Of each piece: numbers of tokens, groups and links, whether it is sound, its groups as text ending in ';'; and the
    links of all pieces in order, as A id * n_b_ids + B id."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    sound: np.ndarray
    text: list[bytes]
    links: np.ndarray


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[ends])


def _same_bytes(ids: np.ndarray, counts: np.ndarray, v: Vocabulary, expected: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each piece: whether its tokens join to its bytes."""
    same = _sums(v.lengths[ids], counts) == lengths
    token, byte = np.repeat(same, counts), np.repeat(same, lengths)
    differs = v.joined(ids[token]) != expected[byte]
    if differs.any():
        place = np.repeat(np.flatnonzero(same), lengths[same])
        same[place[differs]] = False
    return same


def align_pieces(words: pa.Array, a_ids: np.ndarray, n_a: np.ndarray, b_ids: np.ndarray, n_b: np.ndarray, a: Vocabulary, b: Vocabulary) -> Aligned:
    """words: pieces without the space before them; ids of either tokenizer for the space and each piece, one after another."""
    offsets, data = C.string_buffers(words)
    lengths = np.diff(offsets) + 1
    expected = np.full(len(data) + len(words), 0x20, np.uint8)
    spaced = np.ones(len(expected), bool)
    spaced[np.cumsum(lengths) - lengths] = False
    expected[spaced] = data
    sound = _same_bytes(a_ids, n_a, a, expected, lengths) & _same_bytes(b_ids, n_b, b, expected, lengths)
    a_ids, b_ids = a_ids[np.repeat(sound, n_a)], b_ids[np.repeat(sound, n_b)]
    n_a, n_b = np.where(sound, n_a, 0), np.where(sound, n_b, 0)
    a_ends, b_ends = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])

    # farthest-right overlapping token: the other side's that holds the token's last byte
    last_b = np.searchsorted(b_ends, a_ends)
    last_a = np.searchsorted(a_ends, b_ends)
    own = np.arange(len(a_ids))
    to_b = b_ends[last_b] > a_ends
    label = terminals(np.concatenate((np.where(to_b, len(a_ids) + last_b, own), last_a)))
    ends = np.flatnonzero(~to_b)  # A tokens that point to themselves
    group_a, group_b = np.searchsorted(ends, label[: len(a_ids)]), np.searchsorted(ends, label[len(a_ids) :])
    piece_of_a = np.repeat(np.arange(len(words)), n_a)
    n_groups = np.bincount(piece_of_a[ends], minlength=len(words))

    # links: from the B token that holds the first byte to the one that holds the last
    first_b = np.searchsorted(b_ends, a_ends - a.lengths[a_ids], side="right")
    met = last_b - first_b + 1
    links = np.repeat(a_ids.astype(np.int64), met) * len(b.lengths) + b_ids[C.ragged(first_b, met)]
    n_links = _sums(met, n_a)

    # a1,a2|b1; of each group: tokens are put side by side, each with the sign after it
    of_a, of_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
    at = np.cumsum(of_a + of_b) - of_a - of_b
    tokens, sign = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
    tokens[(at - np.cumsum(of_a) + of_a)[group_a] + own] = a_ids
    tokens[(at + of_a - np.cumsum(of_b) + of_b)[group_b] + np.arange(len(b_ids))] = b_ids
    sign[at + of_a - 1], sign[at + of_a + of_b - 1] = ord("|"), ord(";")
    digits = _digits(max(len(a.lengths), len(b.lengths)))
    width = digits.lengths[tokens]
    stop = np.cumsum(width + 1)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    out[C.ragged(stop - width - 1, width)] = digits.joined(tokens)
    out[stop - 1] = sign
    bounds = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
    raw = out.tobytes()
    text = [raw[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    return Aligned(n_a, n_b, n_groups, n_links, sound, text, links)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


class Pair:
    """The two tokenizers, in a worker."""

    def __init__(self, a_blob: bytes, b_blob: bytes):
        self.a, self.b = P.json_tokenizer(a_blob, plain=True), P.piece_tokenizer(b_blob)
        self.a_words, self.b_words = byte_level_vocabulary(self.a), piece_vocabulary(self.b)

    def align(self, words: pa.Array) -> Aligned:
        parts: list[list] = [[], [], [], []]
        for batch in P.by_bytes(words):
            a = _flat([e.ids for e in self.a.encode_batch_fast([" " + w for w in batch], add_special_tokens=False)])
            for held, x in zip(parts, (*a, *_flat(self.b.encode(batch, num_threads=1))), strict=True):
                held.append(x)
        a_ids, n_a, b_ids, n_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in parts)
        return align_pieces(words, a_ids, n_a, b_ids, n_b, self.a_words, self.b_words)


# -- chunks ------------------------------------------------------------------------------------------------------------

_CODED = "chunk string, ids array<{0}>, numbers binary, groups array<string>, bags binary, links binary, pairs binary"


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, once each, and how often each occurs."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def _texts_with(bag: np.ndarray, links: np.ndarray, link: np.ndarray, n_pairs: int) -> np.ndarray:
    """Of each pair, how many texts hold it. bag: ascending text * number of pieces + piece; links: of each piece, how many
    pairs; link: which. Texts are taken in blocks, as each counts once whatever the others hold."""
    m = max(1, len(links))
    own, _ = _distinct(np.repeat(np.arange(len(links)), links) * n_pairs + link)
    n_own = np.bincount(own // n_pairs, minlength=m)
    at_own, own = np.cumsum(n_own) - n_own, own % n_pairs
    docs = np.zeros(n_pairs, np.int64)
    size = np.cumsum(n_own[bag % m])
    at = 0
    while at < len(bag):
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_PAIRS, side="right"))
        text = bag[min(max(to, at), len(bag) - 1)] // m  # the text in which the block is full goes to the next one, unless it is alone
        to = len(bag) if to >= len(bag) else max(int(np.searchsorted(bag, text * m)), int(np.searchsorted(bag, (bag[at] // m + 1) * m)))
        piece = bag[at:to] % m
        held = np.repeat(bag[at:to] // m, n_own[piece]) * n_pairs + own[C.ragged(at_own[piece], n_own[piece])]
        docs += np.bincount(_distinct(held)[0] % n_pairs, minlength=n_pairs)
        at = to
    return docs


def _coded(rows: pa.RecordBatch, pair: Pair, safe: bool, digest: bool) -> list:
    """Of a chunk's texts: (ids, numbers, groups, bags, links, pairs)."""
    offsets, data = C.string_buffers(rows.column(1))
    words, first = P.cut(offsets, data, P.space_cuts(offsets, data) if safe else np.zeros(0, np.int64), drop=True)
    coded = words.dictionary_encode()
    place, n_pieces = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first)
    found = pair.align(coded.dictionary)
    whole = (_sums(~found.sound[place], n_pieces) == 0) & (n_pieces > 0)  # texts with an unsound piece have no tokens
    numbers = [np.where(whole, _sums(n[place], n_pieces), 0) for n in (found.n_a, found.n_b, found.n_groups, found.n_links)]
    groups = []
    for good, s, e in zip(whole.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        text = b"".join(map(found.text.__getitem__, place[s:e].tolist()))[:-1] if good else b""
        groups.append(hashlib.sha256(text).hexdigest() if digest and text else text.decode())
    bag, times = _distinct((np.repeat(np.arange(len(rows)) * max(1, len(coded.dictionary)), n_pieces) + place)[np.repeat(whole, n_pieces)])
    pairs, link = np.unique(found.links, return_inverse=True)
    docs = _texts_with(bag, found.n_links, link, max(1, len(pairs)))[: len(pairs)]
    per_piece = np.concatenate(([len(found.n_links)], found.n_links, link))
    return [rows.column(0).to_pylist(), C.pack_columns(numbers), groups, C.pack_columns([bag, times]), C.pack(per_piece), C.pack_columns([pairs, docs])]


def _chunks(a_blob, b_blob, safe: bool, chunk_bytes: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part = Pair(a_blob.value, b_blob.value), TaskContext.get().partitionId()
        names = ["chunk", "ids", "numbers", "groups", "bags", "links", "pairs"]
        for k, rows in enumerate(C.gathered(batches, "text", chunk_bytes)):
            kinds = pa.string(), pa.list_(rows.column(0).type), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()
            row = [f"{part}-{k}", *_coded(rows, pair, safe, digest)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    return run


def _pairs(n_b: int, places: bool):
    """A row for each pair of a chunk; places: as questions of the chunk, else as counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, docs = (x.astype(np.int64) for x in C.unpack_columns(packed))
                for at in range(0, len(pairs), 100_000):
                    p = pairs[at : at + 100_000]
                    ids = [pa.array(p // n_b, pa.int32()), pa.array(p % n_b, pa.int32())]
                    if places:
                        head = [pa.array([chunk] * len(p), pa.string()), pa.array(np.arange(at, at + len(p)), pa.int32())]
                        yield pa.RecordBatch.from_arrays([*head, *ids], ["chunk", "place", "a", "b"])
                    else:
                        yield pa.RecordBatch.from_arrays([*ids, pa.array(docs[at : at + 100_000], pa.int64())], ["a", "b", "n"])

    return run


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk and the corpus-wide counts of its pairs: the rows of its texts."""
    row = left.to_pylist()[0]
    order = np.argsort(right["place"].to_numpy())
    count, best = right["n"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
    links = C.unpack(row["links"]).astype(np.int64)
    per_piece, link = links[1 : 1 + links[0]], links[1 + links[0] :]
    m, n_docs = max(1, len(per_piece)), len(row["ids"])
    bag, times = (x.astype(np.int64) for x in C.unpack_columns(row["bags"]))
    by_text = lambda values: _sums(times * _sums(values[link], per_piece)[bag % m], np.bincount(bag // m, minlength=n_docs)) if len(bag) else np.zeros(n_docs, np.int64)
    numbers = [pa.array(x.astype(np.int64)) for x in C.unpack_columns(row["numbers"])]
    ids = pa.array(row["ids"], left["ids"].type.value_type)
    columns = [ids, *numbers, pa.array(by_text(best)), pa.array(by_text(count)), pa.array(row["groups"], pa.string())]
    return pa.table(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def chunked(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", digest: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The corpus encoded and aligned, a row a chunk, written as a table: what pair_counts and aligned read."""
    a_blob, b_blob = P.read_file(a_path), P.read_file(b_path)
    if not P.is_byte_level(a_blob):
        raise ValueError("the first tokenizer must be a byte-level BPE")
    share = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    run = _chunks(share(a_blob), share(b_blob), P.is_spaced(b_blob), chunk_bytes, digest)
    return C.written(rows.mapInArrow(run, _CODED.format(rows.schema["doc_id"].dataType.simpleString())), "chunks")


def pair_counts(chunks: DataFrame, n_b: int) -> DataFrame:
    """(a, b, n, best): linked ids, the number of texts that hold them linked, and whether no pair of the A id has more. The
    highest counts have a row for each A id, so at most as many as its vocabulary, and are broadcast."""
    totals = chunks.select("chunk", "pairs").mapInArrow(_pairs(n_b, False), "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    totals = C.written(totals, "pairs")
    most = totals.groupBy("a").agg(F.max("n").alias("most"))
    return totals.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(chunks: DataFrame, n_b: int) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    asked = chunks.select("chunk", "pairs").mapInArrow(_pairs(n_b, True), "chunk string, place int, a int, b int")
    answers = asked.join(pair_counts(chunks, n_b), ["a", "b"]).select("chunk", "place", "n", "best")
    id_type = chunks.schema["ids"].dataType.elementType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    own = chunks.select("chunk", "ids", "numbers", "groups", "bags", "links")
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_summed, f"doc_id {id_type}, {numbers}, groups string")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    n_b = P.piece_tokenizer(P.read_file(b)).get_piece_size()
    chunks = chunked(C.table(spark, sf_dir, "documents"), a, b, digest=True)
    return aligned(chunks, n_b).withColumnRenamed("groups", "groups_sha256")
