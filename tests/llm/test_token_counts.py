import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirefold.llm import common as C
from quirefold.llm import pieces as P
from quirefold.llm import token_counts as T

JSON, MODEL, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["", " ", "  a  b ", "a ", "x▁ y", "a  b", "é b", "　 c", "it's 'stuff 's5 ab12cd", "<|endoftext|>", "a <|endoftext|>b1<|endo text|>", "a\x1c b\x0b c", "\r\n\n\ta", "你好。 世界", "a" * 3000, "ab 1" * 900]
texts = st.text(st.sampled_from(list("ab1 '\n\t 　▁\u0085\x1cé你<|>!s")), max_size=40)


def by_library(path):
    if path.endswith(".json"):
        t = Tokenizer.from_file(path)
        return lambda s: len(t.encode(s, add_special_tokens=False).ids)
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda s: len(m.encode(s))


@pytest.mark.parametrize("path", [JSON, MODEL])
@settings(max_examples=200, deadline=None)
@given(found=st.lists(texts, min_size=1, max_size=4))
def test_pieces_add_up(path, found):
    is_json, count = path == JSON, by_library(path)
    offsets, data = C.string_buffers(pa.array(found))
    cuts = (P.byte_level_cuts if is_json else P.space_cuts)(offsets, data)
    words, first = P.cut(offsets, data, cuts, drop=not is_json)
    each = [count(w) for w in words.to_pylist()]
    assert [sum(each[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)] == [count(s) for s in found]


@pytest.mark.parametrize("path", [JSON, MODEL, WORDS])
def test_counts_as_the_library(spark, sf, path):
    rows = [(i, s) for i, s in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again"), (99, None)]
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] if path == JSON else []
    docs = spark.createDataFrame(rows + table, "doc_id bigint, text string").withColumn("n_tokens", docs_clash())
    count = by_library(path)
    want = sorted(((i, len((s or "").encode()), count(s or "")) for i, s in rows + table), key=repr)
    got = T.count_tokens(docs, path, chunk_bytes=50_000).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def docs_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_where_cuts_are_safe():
    assert P.is_byte_level(P.read_file(JSON)) and not P.is_byte_level(P.read_file(WORDS)) and P.is_spaced(P.read_file(MODEL))


def test_query(spark, sf):
    got = T.op12_token_counts(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got.where("over_limit <> (n_tokens > 1024)").count() == 0 and got.where("over_limit").count() > 0
    assert T.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), JSON).count() == 0
