import math
from collections import Counter, defaultdict

import numpy as np
import regex

from quirefold.llm import language_id as L


def words_of(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def grams(word, n):
    edged = f"<{word}>"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)] if n > 1 else list(word)


def brute(train, texts):
    """(lang, score) of each text, from dictionaries of all counts."""
    counts = [defaultdict(Counter) for _ in range(5)]
    for text, lang in train:
        for w in words_of(text) if lang is not None else []:
            counts[0][w][lang] += 1
            for n in range(1, 5):
                for g in grams(w, n):
                    counts[n][g][lang] += 1
    langs = sorted({x for c in counts[0].values() for x in c})
    totals = [sum(c.values(), Counter()) for c in counts]

    def logs(kind, entry):
        return [math.log((counts[kind][entry][x] + 0.5) / (totals[kind][x] + 0.5 * len(counts[kind]) + 1)) for x in langs]

    def word(w):
        if w in counts[0]:
            return logs(0, w)
        for n in range(4, 0, -1):
            rows = [logs(n, g) for g in grams(w, n) if g in counts[n]]
            if rows:
                return [sum(c) / len(rows) for c in zip(*rows, strict=True)]
        return [0.0] * len(langs)

    out, seen = [], {}
    for t in texts:
        words = words_of(t)
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(langs)
        for w, n in Counter(words).items():
            seen[w] = seen[w] if w in seen else word(w)
            total = [a + n * b for a, b in zip(total, seen[w], strict=True)]
        total = [x * min(len(words), L.EVIDENCE) / len(words) for x in total]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], 1 / sum(math.exp(x - total[best]) for x in total)))
    return out


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in L.op10_language_id(spark, sf).collect()}
    want = brute([(d.text, d.lang) for d in docs if not got[d.doc_id].held_out], [d.text for d in docs])
    assert len(got) == len(docs)
    for d, (lang, score) in zip(docs, want, strict=True):
        assert got[d.doc_id].lang_pred == lang and abs(got[d.doc_id].score - score) < 1e-9


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in L.op10_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out and words_of(d.text)]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    train = [(1, "the cat and the dog", "en", 0.1), (2, "le chat et le chien", "fr", 0.1), (3, "the end", "en", 0.1), (4, None, "en", 0.1), (5, "xx", None, 0.1)]
    df = spark.createDataFrame(train, "doc_id bigint, text string, lang string, score double")
    model = L.train(df)
    assert model.langs == ["en", "fr"]
    tests = [(1, None), (2, ""), (3, "123 !!"), (3, "² ½ Ⅷ ①"), (4, "the the"), (5, "chats"), (5, "chats"), (None, "le"), (6, "日本"), (7, "the " * 100_000)]
    got = L.predict(spark.createDataFrame(tests, "doc_id bigint, text string"), model).collect()
    want = brute([(t, x) for _, t, x, _ in train], [t for _, t in tests])
    assert [r.lang_pred for r in got] == [x for x, _ in want] and [x for x, _ in want][:4] == ["und"] * 4
    assert np.allclose([r.score for r in got], [s for _, s in want])
    nothing = L.train(df.limit(0))
    assert {r.lang_pred for r in L.predict(df, nothing).collect()} == {"und"}
    odd = df.withColumnRenamed("score", "__lang")
    kept = L.known_language(odd)
    assert kept.columns == odd.columns and 4 not in {r.doc_id for r in kept.collect()}


def test_many_languages_and_a_rare_one(spark):
    """A hundred languages of one word each and a large one; the sample has rows of every language."""
    letter = lambda i: chr(0x4E00 + i)
    rows = [(i, f"{letter(i)}{letter(i)}", f"l{i:03}") for i in range(100)] + [(1000 + i, "common words of the large language", "large") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.train(df, sample_docs=500)
    assert len(model.langs) == 101
    got = {r.doc_id: r.lang_pred for r in L.predict(df, model).collect()}
    assert got == {d: x for d, _, x in rows}
