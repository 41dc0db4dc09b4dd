"""Token counts (operator 12).

Texts are gathered to chunks of about CHUNK_BYTES, whatever the Arrow batches are, and cut into pieces at places that no
token crosses, long texts as well as short ones. The different pieces of a chunk go to the tokenizer in batches balanced
by bytes; only the lengths of what it gives are kept, and a text's count is the sum over its pieces. Nothing is shuffled:
Spark balances the tasks by the bytes of the files.

A tokenizer for which no safe place is known (see pieces.py) gets whole texts, in the same batches.

Defined results: null text counts as empty; an empty text has no tokens; every input row gives one row, also where ids
repeat or are null; an empty table gives no rows; other columns of the input are not read. A run without a safe place is
encoded in one piece, so memory follows the longest such run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import pieces as P

CHUNK_BYTES = 8 << 20
#: Tokens that a text may have.
LIMIT = 1024


def _lengths(words: pa.Array, encode) -> np.ndarray:
    """Tokens of each word; the tokens themselves are dropped batch by batch."""
    return np.fromiter((n for batch in P.by_bytes(words) for n in encode(batch)), np.int64, len(words))


def _count(blob, is_json: bool, safe: bool, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if is_json:
            tokenizer = P.json_tokenizer(blob.value, plain=False)
            encode = lambda words: (len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False))
        else:
            tokenizer = P.piece_tokenizer(blob.value)
            encode = lambda words: map(len, tokenizer.encode(words, num_threads=1))
        for rows in C.gathered(batches, "text", chunk_bytes):
            offsets, data = C.string_buffers(rows.column(1))
            cuts = (P.byte_level_cuts if is_json else P.space_cuts)(offsets, data) if safe else np.zeros(0, np.int64)
            words, first = P.cut(offsets, data, cuts, drop=not is_json)
            coded = words.dictionary_encode()
            each = _lengths(coded.dictionary, encode)[coded.indices.to_numpy(zero_copy_only=False)]
            total = np.concatenate(([0], np.cumsum(each)))[first]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(total), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each whole text by the tokenizer in the file: a .json of the tokenizers library, its
    special tokens recognised inside texts as it does, or else a sentence-piece model. Nothing is put around a text."""
    blob, is_json = P.read_file(path), path.endswith(".json")
    safe = P.is_byte_level(blob) if is_json else P.is_spaced(blob)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    run = _count(docs.sparkSession.sparkContext.broadcast(blob), is_json, safe, chunk_bytes)
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
