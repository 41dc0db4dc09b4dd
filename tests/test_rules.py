"""Literals of what is accepted and rejected, and long groups in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quirefold.operators import forms, logs, orders, pages, redact, survey
from quirefold.sources import files
from quirefold.streaming import streams
from quirefold.streaming.batches import batch_table


@pytest.mark.parametrize(
    ("spec", "n", "reason"),
    [
        ("3,1,2", 3, None), ("2:90,1,2:90", 2, None), ("", 3, "empty"), (" , ", 3, "empty"), (None, 3, "empty"), ("0", 3, "range"), ("4", 3, "range"), ("1:45", 3, "angle"),
        ("1:-90", 3, "angle"), ("abc", 3, "format"), ("1:90:90", 3, "format"), ("1:x", 3, "angle"), ("4,abc", 3, "range"), ("1," * 1000, 3, None), ("1," * 1001, 3, "too_many"),
    ],
)
def test_page_orders(spark, spec, n, reason):
    df = spark.createDataFrame([(1, spec, n)], "doc_id bigint, spec string, n_pages bigint")
    assert pages.order_reasons(df).first().reason == reason


@pytest.mark.parametrize(
    ("mode", "value", "n", "reason"),
    [
        ("all", "", 3, None), ("all", "", 0, "empty"), ("ranges", "1-3,5", 4, "range"), ("ranges", "2-9", 4, None), ("ranges", "3-2", 4, "backwards"), ("ranges", "1-x", 4, "format"),
        ("ranges", "1-2-3", 4, "format"), ("ranges", "1," * 201, 4, "too_many"), ("ranges", "1" * 4097, 4, "too_long"), ("fixed", "0", 4, "fixed"), ("fixed", "x", 4, "fixed"), ("fixed", "", 4, None),
        ("other", "", 4, "mode"), (None, "", 4, "mode"), ("ranges", None, 4, None),
    ],
)
def test_splits(spark, mode, value, n, reason):
    df = spark.createDataFrame([(1, mode, value, n)], "doc_id bigint, mode string, value string, n_pages bigint")
    assert pages.split_reasons(df).first().reason == reason


def test_parts_of_a_split(spark):
    p = spark.createDataFrame([(d, k) for d in (1, 2, 3, 4) for k in range(1, 5)], "doc_id bigint, page_no bigint")
    specs = spark.createDataFrame([(1, "all", None, 4), (2, "fixed", "3", 4), (3, "ranges", "2-9,1", 4), (4, "ranges", "9", 4)], "doc_id bigint, mode string, value string, n_pages bigint")
    got = sorted(map(tuple, pages.accepted_split(p, specs).collect()))
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 1, 1), (2, 1, 2), (2, 1, 3), (2, 2, 4), (3, 1, 2), (3, 1, 3), (3, 1, 4), (3, 2, 1)]


def test_survey_choices(spark):
    good = {
        "client_id": "a" * 32, "frequency": "每月几次", "source": "其他", "pricing_model": "按月或按年订阅", "price_range": "不确定", "task_outcome": "没有成功", "usage_scenario": "其他",
        "page_path": "/merge-pdf/result", "schema_version": None, "elapsed_ms": 5000, "website": "", "features": [" 其他 "], "contact": " " * 200,
    }
    schema = ", ".join(f"{c} {'array<string>' if c == 'features' else 'bigint' if c == 'elapsed_ms' else 'string'}" for c in good)
    for column, value in (("frequency", "never"), ("page_path", None), ("schema_version", "v2"), ("price_range", ""), ("contact", "c" * 101), ("features", ["其他", "其他 "]), ("client_id", "x")):
        rows = spark.createDataFrame([tuple(good.values()), tuple((good | {column: value}).values())], schema)
        assert [r.rules for r in survey.violations(survey.stripped(rows)).collect()] == [[], [column]]


def test_heads_of_files(spark):
    rows = [
        ("a.docx", b"PK\x05\x06x", None), ("b.doc", b"PK\x03\x04", "content"), ("c.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", None), ("d.webp", b"RIFF\0\0\0\0WEBP", None),
        ("e.webp", b"RIFF\0\0\0\0WAVE", "content"), ("f.pdf", b"%PDF", "content"), ("g.xml", b"\xef\xbb\xbf \n<a/>", None), ("h.png", b"\x89PNG\r\n", "content"), ("i.xml", None, None),
    ]
    df = spark.createDataFrame([(p, c and len(c), c) for p, c, _ in rows], "path string, length int, content binary")
    got = {r.path: r.reason for r in files.admitted(df, (".docx", ".doc", ".xls", ".webp", ".pdf", ".xml", ".png"), 100).collect()}
    assert got == {p: r for p, _, r in rows}


def test_nothing_found_is_an_error(spark):
    p = spark.createDataFrame([(1, 1, "a secret"), (2, 1, "nothing"), (3, 1, None)], "doc_id int, page_no int, text string")
    got = {r.doc_id: r.reason for r in redact.outcome(p, redact.keyword_hits(p, ["secret"])).collect()}
    assert got == {1: None, 2: "no_hit_keywords", 3: "no_hit_keywords"}


def test_long_groups_take_linear_time(spark):
    n = 40_000
    events = spark.range(n).select(F.lit("a").alias("out_trade_no"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "claim").otherwise("release").alias("action"))
    outline = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), (F.col("id") % 5 + 1).cast("int").alias("level"), F.lit("t").alias("title"), F.lit(1).alias("page_no"))
    day = spark.range(n).select(F.lit("d").alias("day"), F.col("id").alias("task_id"), F.lit("n").alias("name"), F.lit(20_000).alias("size"))
    for df, want in ((orders.transitions(events).where("outcome = 'accepted'"), n), (redact.relevel(outline).where("level = 5"), n // 5), (logs.quota_copy(day).where("reason IS NULL"), (512 << 20) // 20_000)):
        began = time.time()
        assert df.count() == want and time.time() - began < 20


def test_rectangles_by_cells(spark):
    r = random.Random(2)
    box = lambda: (x := r.uniform(-300, 4000), y := r.uniform(-300, 900), x + r.choice([0, 5, 70, 900]), y + r.choice([0, 12, 200]))
    spans = [(1, r.choice([1, 1, 2]), *box(), f"t{k}") for k in range(150)] + [(1, 1, None, 0.0, 5.0, 5.0, "null"), (1, 1, 64.0, 64.0, 128.0, 128.0, "cell")]
    rects = [(1, r.choice([1, 2]), k, *box()) for k in range(60)] + [(1, 1, 99, -1e9, -1e9, 1e9, 100.0), (1, 1, 98, 128.0, 128.0, 130.0, 130.0)]
    s = spark.createDataFrame(spans, "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double, text string")
    t = spark.createDataFrame(rects, "doc_id int, page_no int, rect_id int, x0 double, y0 double, x1 double, y1 double")
    want = sorted((a[6], b[2]) for a in spans for b in rects if None not in a and a[1] == b[1] and a[2] < b[5] + 1 and a[4] > b[3] - 1 and a[3] < b[6] + 1 and a[5] > b[4] - 1)
    assert sorted((x.text, x.rect_id) for x in redact.rect_hits(s, t).collect()) == want and len(want) > 50
    assert sorted(x.text for x in redact.mask_by_rect(s, t).collect()) == sorted({a[6] for a in spans} - {x for x, _ in want})


def test_rectangles_of_crowded_and_other_pages(spark, monkeypatch):
    r = random.Random(4)
    box = lambda: (x := r.uniform(-300, 900), y := r.uniform(-300, 900), x + r.choice([-9, 0, 70, 900]), y + r.choice([0, 12, 200]))
    spans = [(r.choice([1, 1, 2, None]), r.choice([1, 2, 3]), *box(), f"t{k}") for k in range(200)]
    rects = [(1, r.choice([1, 1, 1, 2]), k, *box()) for k in range(30)] + [(2, 3, 99, *box())]
    s = spark.createDataFrame(spans, "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double, text string")
    t = spark.createDataFrame(rects, "doc_id int, page_no int, rect_id int, x0 double, y0 double, x1 double, y1 double")
    fit = lambda a, b: a[2] <= a[4] and b[3] - 1 <= b[5] + 1 and a[2] < b[5] + 1 and a[4] > b[3] - 1 and a[3] < b[6] + 1 and a[5] > b[4] - 1
    want = sorted((a[6], b[2]) for a in spans for b in rects if a[:2] == b[:2] and fit(a, b))
    for few in (64, 12, 0):
        monkeypatch.setattr(redact, "FEW_RECTS", few)
        hits = redact.rect_hits(s, t)
        assert sorted((x.text, x.rect_id) for x in hits.collect()) == want and len(want) > 20
        assert sorted(x.text for x in redact.mask_by_rect(s, t).collect()) == sorted({a[6] for a in spans} - {x for x, _ in want})
        # spans are dealt as they are where no page is crowded, not once for each cell
        assert ("Generate" in hits._jdf.queryExecution().optimizedPlan().toString()) == (few < 64)


def test_leaves_of_both_sides_are_counted_once(spark):
    form = "doc_id int, path string"
    before = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "c")], form)
    after = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "b"), (2, None), (3, "d")], form)
    diff = forms.leaf_diff(before, after)
    assert sorted(map(tuple, diff.collect()), key=repr) == sorted([(1, "a", "before"), (None, "c", "before"), (1, "b", "after"), (1, "b", "after"), (3, "d", "after")], key=repr)
    assert diff._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_ledger_batches_normalise_each_written_number_once(spark, tmp_path, monkeypatch):
    seen = []
    keyed = streams.L.keyed
    monkeypatch.setattr(streams.L, "keyed", lambda df, *a: seen.append(df.count()) or keyed(df, *a))
    rows = [("12345678", None, f"f{k}", "1", k) for k in range(50, 0, -1)] + [(" 12345678 ", None, "g", "2", 0), (None, None, "h", "3", 99)]
    batch = spark.createDataFrame(rows, "number string, code string, file_ref string, amount string, row_no int")
    streams.ledger_batches(str(tmp_path / "t"))(batch, 0)
    got = [(x.key, x.row_no, x.file_ref) for x in batch_table(spark, str(tmp_path / "t")).collect()]
    assert got == [("12345678", 0, "g")] and seen == [3]
