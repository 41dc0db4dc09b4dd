import corpus_pipeline as P
from quirefold.llm import common, mixing

from .test_byte_bpe import expected
from .test_language_id import words_of
from .test_near_dup import brute as classes
from .test_secrets import brute as secrets


def masked(text):
    spans = [tuple(map(int, s.split(":")[1:])) for s in secrets(text)[4].split(",") if s]
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + (text or "")[at:] if spans else text


def test_stages_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents").cache()
    columns = docs.columns
    kept = {name: None for name, _ in P.STAGES}
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = common.written(stage(spark, docs, sf), name)
        kept[name] = rows = [tuple(r) for r in docs.collect()]
        if name == "language_id":
            assert docs.columns == columns and set(rows) <= set(before)
            gone = set(before) - set(rows)
            assert all(not words_of(r[1]) or len(words_of(r[1])) < 40 for r in gone) and len(gone) < 0.1 * len(before)
        elif name == "minhash":
            by = classes([(r[0], r[1]) for r in before])
            assert docs.columns == columns and sorted(rows) == sorted(r for r in before if by[r[0]] == r[0])
        elif name == "secrets":
            assert docs.columns == columns
            assert sorted((r[0], r[1], r[2], r[3]) for r in rows) == sorted((r[0], masked(r[1]), r[2], r[3]) for r in before)
        elif name == "mixing":
            assert docs.columns == columns and set(rows) <= set(before)
            size = lambda rs: sum(len((r[1] or "").split()) for r in rs)
            assert abs(size(rows) / size(before) - 1) < 0.1 and all(rows.count(r) <= 3 for r in rows)
        else:
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == sorted((r[0], *expected(r[1])) for r in before)
    assert mixing.CEILING == 3 and all(kept.values())


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
    assert len(P.STAGES) == 5


def test_odd_documents(spark, sf):
    """Null texts and ids, empty and repeated rows, and columns named like those the stages add."""
    real = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    odd = [(9001, None, "en", "web", 0), (9002, "", "en", None, 0), (9003, "12 34", None, "web", 5), (None, real[3][1], "en", "web", real[3][4]), real[5], real[5]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for rows in (real + odd, []):
        docs = spark.createDataFrame(rows, schema).selectExpr("*", "'clash' AS node", "1 AS mark", "2 AS size", "'x' AS spans")
        columns = docs.columns
        for k, (name, stage) in enumerate(P.STAGES):
            docs = common.written(stage(spark, docs, sf), name)
            assert k == len(P.STAGES) - 1 or docs.columns == columns
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            if name == "language_id":
                assert not {9001, 9002, 9003} & set(ids) and ids.count(real[5][0]) in (0, 3)
            elif name == "minhash":
                assert ids.count(real[5][0]) <= 1 and ids.count(None) == 0
        assert bool(ids) == bool(rows)
