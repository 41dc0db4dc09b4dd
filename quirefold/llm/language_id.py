"""Language identification by words first, shorter and shorter character n-grams after (operator 10).

A word that the model knows counts with its log frequency in each language. Any other word backs off: its character
4-grams, or if none is known its 3-grams, 2-grams, 1-grams, count with their mean log frequency. Words are runs of
letters (general category L), in lower case.

Bound, a parameter: the model learns from SAMPLE_DOCS labelled rows at most (in expectation, by hash), the same number for
every language, all rows of a language that has fewer. Every word and n-gram of the sample and every language in it is in
the model, as sorted hashes with a sparse row of languages each; the sample bounds it, so it is broadcast. Prediction
reads every whole text.

Defined results: null text, and text without a letter, is `und` with score 0; so is every text if nothing was learned.
Ties go to the language that sorts first. Rows repeat as they do in the input; null ids stay; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from . import common as C

SAMPLE_DOCS = 20_000
LONGEST_GRAM = 4
#: Words of evidence that a document's score counts at most, so that a long text is not always certain.
EVIDENCE = 20
#: Bytes of the table of languages up to which it is broadcast: about 80,000 languages.
MOST_BROADCAST = 8 << 20
#: Rows of blobs in which the model's counts reach the driver.
PARTS = 16

_BETWEEN = r"\P{L}+"
_SCALE = 1 << 40
_EDGE = np.array([ord("<"), ord(">")], np.uint32)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and the place of each word's text."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _BETWEEN)
    words = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.asarray(lists.value_lengths()))
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), owner[np.asarray(full)]


def word_keys(words: pa.Array) -> np.ndarray:
    return C.string_hashes(words)


def gram_keys(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's character n-grams, and the place of their word. Words have edges, but not for n = 1."""
    code = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    sizes = np.asarray(pc.utf8_length(words)).astype(np.int64)
    if n > 1:
        starts = np.cumsum(sizes) - sizes
        code = np.insert(code, np.concatenate((starts, starts + sizes)), np.repeat(_EDGE, len(words)))
        sizes = sizes + 2
    begin, grams = np.cumsum(sizes) - sizes, np.maximum(sizes - n + 1, 0)
    at = C.ragged(begin, grams)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = C.mix(h + code[at + k] * np.uint64(0x9E3779B97F4A7C15))
    return h, np.repeat(np.arange(len(words)), grams)


@dataclass
class Model:
    """Row i of keys has entries indptr[i] to indptr[i + 1] of lang and gain: how far the log frequency there is above
    `least`, that of an entry which the language never has. `least` has a row for words and one for each n."""

    langs: list[str]
    keys: list[np.ndarray]
    indptr: list[np.ndarray]
    lang: list[np.ndarray]
    gain: list[np.ndarray]
    least: np.ndarray

    def rows(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where the model lacks it."""
        own = self.keys[kind]
        if not len(own):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, at, -1)

    def logs(self, words: pa.Array, owner: np.ndarray, n: int) -> np.ndarray:
        """Summed log frequencies of n texts (a row each) in the languages, from their words and those words' texts."""
        coded = words.dictionary_encode()
        distinct, place = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        pair, times = np.unique(owner * max(len(distinct), 1) + place, return_counts=True)
        doc, word = np.divmod(pair, max(len(distinct), 1))
        total, base = np.zeros(n * len(self.langs)), np.zeros((n, LONGEST_GRAM + 1))
        found = self.rows(0, word_keys(distinct))
        known = found >= 0
        kind = np.where(known, 0, -1)
        self._add(total, 0, found[word[known[word]]], doc[known[word]], times[known[word]])
        left = np.flatnonzero(~known)
        for k in range(LONGEST_GRAM, 0, -1):
            if not len(left):
                break
            keys, at = gram_keys(distinct.take(pa.array(left)), k)
            rows = self.rows(k, keys)
            at, rows = at[rows >= 0], rows[rows >= 0]
            n_known = np.bincount(at, minlength=len(left))
            kind[left[n_known > 0]] = k
            mine = np.full(len(distinct), -1)
            mine[left[n_known > 0]] = np.flatnonzero(n_known > 0)
            use = np.flatnonzero(mine[word] >= 0)
            begin, size = np.cumsum(n_known) - n_known, n_known[mine[word[use]]]
            self._add(total, k, rows[C.ragged(begin[mine[word[use]]], size)], np.repeat(doc[use], size), np.repeat(times[use] / size, size))
            left = left[n_known == 0]
        for k in range(LONGEST_GRAM + 1):
            some = kind[word] == k
            base[:, k] = np.bincount(doc[some], times[some], minlength=n)
        return total.reshape(n, len(self.langs)) + base @ self.least

    def _add(self, total: np.ndarray, kind: int, rows: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        begin, size = self.indptr[kind][rows], np.diff(self.indptr[kind])[rows]
        entries = C.ragged(begin, size)
        place = np.repeat(doc * len(self.langs), size) + self.lang[kind][entries]
        total += np.bincount(place, self.gain[kind][entries] * np.repeat(weight, size), minlength=len(total))


def _counts(batches):
    """(lang, word, n) of each batch of (lang, text)."""
    for batch in C.slices(batches, "text"):
        words, owner = words_of(batch.column(1))
        if len(words):
            found = pa.table({"lang": batch.column(0).take(pa.array(owner)), "word": words}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from found.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()


def _keyed(batches):
    """(kind, key, lang, n) of words (kind 0) and of their n-grams (kind n), from (lang place, word, n)."""
    for batch in batches:
        lang, words, n = np.asarray(batch.column(0)), batch.column(1), np.asarray(batch.column(2))
        for kind in range(LONGEST_GRAM + 1):
            keys, at = gram_keys(words, kind) if kind else (word_keys(words), np.arange(len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(lang[at]), pa.array(n[at])], ["kind", "key", "lang", "n"])


def _packed(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("key", "ascending"), ("lang", "ascending")])
    blobs = [C.pack(np.asarray(rows[c].combine_chunks()).astype(np.int64).view(np.uint64)) for c in ("key", "lang", "n")]
    return pa.table({"kind": rows["kind"].slice(0, 1), **{c: pa.array([b], pa.binary()) for c, b in zip(("keys", "langs", "counts"), blobs, strict=True)}})


def _sample(labelled: DataFrame, sample_docs: int) -> tuple[list[str], DataFrame]:
    """The languages, and (lang place, text) of labelled rows (lang, text, doc_id), as many of each language."""
    spark = labelled.sparkSession
    found = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    each = sample_docs / max(len(found), 1)
    shares = [(x, i, int(min(1.0, each / found[x]) * _SCALE)) for i, x in enumerate(sorted(found))]
    table = spark.createDataFrame(shares, "lang string, place int, share bigint")
    # a join by language would send all texts of a language to one task
    table = F.broadcast(table) if sum(len(x.encode()) + 100 for x in found) < MOST_BROADCAST else table
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SCALE)) < F.col("share")
    return sorted(found), labelled.join(table, "lang").where(drawn).select(F.col("place").alias("lang"), "text")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from labelled rows; the id decides only which rows are in the sample."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    names, chosen = _sample(labelled, sample_docs)
    words = chosen.mapInArrow(_counts, "lang int, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    keyed = words.mapInArrow(_keyed, "kind int, key bigint, lang int, n bigint").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    parts = keyed.groupBy("kind", F.pmod("key", F.lit(PARTS)).alias("part")).applyInArrow(_packed, "kind int, keys binary, langs binary, counts binary").collect()
    signed = lambda blob: C.unpack(blob).view(np.int64)
    columns = []
    for kind in range(LONGEST_GRAM + 1):
        mine = [p for p in parts if p["kind"] == kind]
        key, at, n = (np.concatenate([np.zeros(0, np.int64), *(signed(p[c]) for p in mine)]) for c in ("keys", "langs", "counts"))
        order = np.lexsort((at, key.view(np.uint64)))
        columns.append((key.view(np.uint64)[order], at[order], n[order]))
    seen = np.unique(columns[0][1])  # languages with a word in the sample
    langs = [names[i] for i in seen]
    keys, indptr, lang_at, gain, least = [], [], [], [], np.zeros((LONGEST_GRAM + 1, len(langs)))
    for kind, (key, at, n) in enumerate(columns):
        own, first = np.unique(key, return_index=True)
        at = np.searchsorted(seen, at)
        keys.append(own)
        indptr.append(np.append(first, len(key)))
        lang_at.append(at.astype(np.int32))
        gain.append(np.log((n + 0.5) / 0.5))
        least[kind] = np.log(0.5 / (np.bincount(at, n, minlength=len(langs)) + 0.5 * len(own) + 1))
    return Model(langs, keys, indptr, lang_at, gain, least)


def _free(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of `keep`, and lang_pred, score (under these names): the posterior of that language, from EVIDENCE words at most."""
    small = docs.sparkSession.sparkContext.broadcast(model)
    own = _free([*keep, *names], "text")

    def run(batches):
        known = small.value
        for batch in C.slices(batches, own):
            words, owner = words_of(batch.column(0))
            n_words = np.bincount(owner, minlength=len(batch))
            named, scores = np.full(len(batch), "und", object), np.zeros(len(batch))
            some = np.flatnonzero(n_words)
            if known.langs and len(some):
                logs = known.logs(words, owner, len(batch))[some]
                logs *= (np.minimum(n_words[some], EVIDENCE) / n_words[some])[:, None]
                best = logs.argmax(axis=1)
                named[some] = np.array(known.langs, object)[best]
                scores[some] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(named.tolist(), pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], *names])

    kept = docs.select(F.coalesce(F.col(text), F.lit("")).alias(own), *keep)
    schema = StructType(kept.schema.fields[1:]).add(names[0], StringType()).add(names[1], "double")
    return kept.mapInArrow(run, schema)


def held_out(doc_id: str, parts: int, part: int):
    """A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 3, 1))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("doc_id", "held_out"))


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised: not `und`, and with that posterior at least; their own columns."""
    columns = docs.columns
    model = train(docs.where(~held_out("doc_id", 3, 1)))
    names = (_free(columns, "__lang"), _free(columns, "__score"))
    kept = predict(docs, model, keep=tuple(columns), names=names)
    return kept.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*columns)
