"""Literals whose answers are known: texts with full-width characters, currency signs and Chinese, and edges."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import invoices as I
from quirefold.functions import names as N
from quirefold.functions import pages as G
from quirefold.functions import payments as Y
from quirefold.functions import text as X
from quirefold.operators import audits, forms, ledger, logs, redact, survey

CASES = {
    "normalize": (I.normalize_text, [("１２ ３　ａ\u00a0", "123a"), (None, ""), ("a\tb\n", "ab")]),
    "fixed2": (I.clean_amount_fixed2, [("¥736,792.00", "736792.00"), ("￥270", "270.00"), ("1,234.5", "1234.50"), ("abc", None), (None, None), ("-1.5", "-1.50"), ("1.234", None)]),
    "keep": (I.clean_amount_keep, [("¥1,234", "1234"), ("12.5", "12.50"), ("1，2", None), ("1234567890123", None)]),
    "electronic": (I.is_valid_e_invoice_no, [("24312000000012345678", True), ("26112000001182262471", True), ("2431200000001234567", False), ("20312000000012345678", False), ("24662000000012345678", False), (None, False)]),
    "file_date": (I.date_from_file_name, [("dzfp_x_20260902095513.ofd", "2026-09-02"), ("dzfp_20261302.ofd", None), ("plain", None), (None, None)]),
    "cn_date": (I.cn_date_from_text, [("2026年13月1日 2026年8月25日", "2026-08-25"), ("none", None), (None, None)]),
    "normal_date": (I.normalize_date, [("2026年3月6日", "2026-03-06"), ("2026-3-6 10:00", "2026-03-06"), ("20260306", "2026-03-06"), ("2026/03/06", "2026-03-06"), ("2026-02-30", None), ("x", None)]),
    "component": (lambda c: N.sanitize_component(c, 5), [("a/b", "a_b"), ("..", "_"), (" . ", "_"), ("CON", "_CON"), ("con.txt", "_con."[:4] if False else "_con"), ("ab\u200bcd", "abcd"), ("abcdefgh", "abcde"), (None, ""), ("", ""), ("a\x01", "a_")]),
    "extension": (N.extension, [("A.PDF", ".pdf"), ("noext", ""), ("a.b.Xml", ".xml"), (None, "")]),
    "upload": (N.clean_upload_name, [("c:\\x\\a.pdf", "a.pdf"), ("/t/\u0007b.pdf", "b.pdf"), ("  ", None), (None, None)]),
    "cell": (X.sanitize_cell, [("=1", "'=1"), ("\x00a", "a"), ("ok", "ok"), ("-2", "'-2"), (None, None)]),
    "excel": (X.excel_text, [('a"b', '="a""b"'), (None, ""), ("", "")]),
    "cjk": (X.has_cjk, [("abc", False), ("中", True), ("ＡＢ", True), (None, False)]),
    "xml": (X.xml_text_ok, [("a\x0b", False), ("ok\n🙂", True), (None, True)]),
    "name": (I.looks_like_name, [("名称：陈秋生", True), ("中", False), ("91310000123456789X", False), ("￥270.00", False)]),
    "label": (I.strip_label, [("发票号码：123", "123"), ("统一社会信用代码/纳税人识别号: 9", "9")]),
    "kind": (I.detect_invoice_type, [("电子发票（普通发票） x", "电子发票（普通发票）"), ("x 专用发票", "电子发票（增值税专用发票）"), ("x", None)]),
    "b64": (lambda c: Y.from_base64url(Y.base64url(c)), [("发票合并" * 40, "发票合并" * 40), ("a", "a"), ("", "")]),
    "message": (Y.error_message, [("TRADE_NOT_FOUND", "交易已关闭或不存在，请重新发起"), ("zzz", Y.DEFAULT_MESSAGE), (None, Y.DEFAULT_MESSAGE)]),
    "original": (logs.is_original, [("Input_1.pdf", True), ("invoice_1.pdf", True), ("merged_invoices.pdf", False), ("x", False)]),
    "mask": (redact.mask, [("id 110101199003077757!", "id !"), ("13812345678", ""), ("12345678901", "12345678901"), ("bad-mail-at-nowhere", "bad-mail-at-nowhere"), (None, None)]),
}
CASES["component"][1][4] = ("con.txt", "_con")


@pytest.mark.parametrize("name", sorted(CASES))
def test_scalar(spark, name):
    f, cases = CASES[name]
    kind = "boolean" if isinstance(cases[0][1], bool) else "string"
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string").select("i", f(F.col("a")).cast(kind).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [b for _, b in cases]


def test_keys_and_sums(spark):
    df = spark.createDataFrame([("１２３４５６７８", "011001900111", "-1.50", None), ("12345678", "12345", "0.10", "0.20"), (None, "011001900111", None, None)], "n string, c string, a string, b string")
    got = df.select(I.make_key(F.col("n"), F.col("c")).alias("k"), I.add_amounts(F.col("a"), F.col("b")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("011001900111-12345678", "-1.50"), ("12345678", "0.30"), ("", None)]


def test_long_names(spark):
    df = spark.createDataFrame([("n" * 20, "b" * 40, "2026-01-01", "p" * 60), ("1", "x", None, "")], "n string, b string, d string, p string")
    got = df.select(N.target_name(F.col("n"), F.col("b"), F.col("d"), F.lit("xml"), prefix=F.col("p"), seller=F.lit("s" * 30)).alias("m")).select("m.*").collect()
    assert len(got[0].name) == 100 and got[0].truncated and got[0].name.endswith(".xml") and got[1].name == "1_x_" + "s" * 30 + ".xml" and not got[1].truncated


def test_tickets(spark):
    t = spark.createDataFrame([(1, k + 1, f, None, n, a) for k, (f, n, a) in enumerate([("a", "12345678", "270"), ("b", "12345678", "270.00"), ("c", "12345678", "271.00"), ("d", None, "1"), ("e", "22222222", None), ("e", "22222222", "5"), ("f", "99999999", "1.00"), ("g", "99999999", None)])], "batch_id int, row_no int, file_ref string, code string, number string, amount string")
    led = spark.createDataFrame([(1, "99999999", None, "1.00", "old", "2026-08-15"), (2, "99999999", None, "9.00", "newer", "2026-08-16")], "ord int, number string, code string, amount string, first_name string, first_day string")
    got = [(r.status, r.note) for r in ledger.dedup_tickets(t, led).orderBy("row_no").collect()]
    assert got == [("ok", None), ("duplicate", "row:1"), ("suspicious", "row:1"), ("unrecognized", None), ("ok", None), ("duplicate", "file"), ("duplicate", "ledger:old@2026-08-15"), ("duplicate", "ledger:old@2026-08-15")]
    raw = [r.status for r in ledger.dedup_tickets(t, led, normalize_amounts=False).orderBy("row_no").collect()]
    assert raw[1] == "suspicious"
    total = ledger.dedup_summary(ledger.dedup_tickets(t, led)).where("batch_id IS NULL").first()
    assert (total.total, total.n_ok, total.n_duplicate, total.n_suspicious, total.n_unrecognized) == (8, 2, 4, 1, 1)


def test_names_of_equal_tickets(spark):
    names = ["a.pdf", "a.pdf", "a.pdf", "a__2.pdf", "a.xml", "x", "x", "a__2.pdf"]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "g int, i int, n string")
    got = [r.unique_name for r in ledger.unique_names(df, "g", "n", "i").orderBy("i").collect()]
    assert got == ["a.pdf", "a__3.pdf", "a__4.pdf", "a__2.pdf", "a.xml", "x", "x__2", "a__2__2.pdf"]


def test_rejected_files_are_named_against_placed_ones(spark):
    rows = [(1, 0, "a.pdf", True), (1, 1, "a.pdf", False), (1, 2, "a.pdf", False), (1, 3, "a.pdf", True), (1, 4, "b.pdf", True), (1, 5, "a__3.pdf", False), (1, 6, "a__3.pdf", True), (2, 7, "a.pdf", True), (None, 8, "x", True), (None, 9, "x", None)]
    df = spark.createDataFrame(rows, "g int, i int, n string, out boolean")
    got = [r.unique_name for r in ledger.placed_names(df, "g", "n", "i", "out").orderBy("i").collect()]
    assert got == ["a__4.pdf", "a.pdf", "a__2.pdf", "a__5.pdf", "b.pdf", "a__3.pdf", "a__3__2.pdf", "a.pdf", "x__2", "x"]


def test_variables_are_read_once(spark):
    v = {k: F.lit(x) for k, x in (("filename", "{page}"), ("date", "d"), ("year", "y"), ("page", "3"), ("pages", "9"))}
    r = spark.range(1).select(X.render_vars(F.lit("{filename} {page}/{pages} {nope} {date}"), v).alias("t"), X.format_page_number(F.lit("cn_total"), F.lit(1), F.lit(2)).alias("p"), X.format_page_number(F.lit("?"), F.lit(1), F.lit(2)).alias("q")).first()
    assert tuple(r) == ("{page} 3/9 {nope} d", "第 1 页 共 2 页", None)


def test_keywords_rects_and_verification(spark):
    pages = spark.createDataFrame([(1, 1, "keep aXb aXb"), (1, 2, "secret 138 1234"), (1, 3, "5678"), (2, 1, "clean")], "doc_id int, page_no int, text string")
    hits = redact.keyword_hits(pages, ["aXb", "zz"])
    assert sorted((r.page_no, r.literal) for r in hits.collect()) == [(1, "aXb"), (1, "aXb")]
    assert {tuple(r) for r in redact.locate_report(hits).collect()} == {(1, 1, 2), (1, None, 2)}
    masked = pages.withColumn("text", redact.mask(F.col("text"), (), ("aXb",)))
    got = {r.doc_id: (r.verdict, r.residue_pages) for r in redact.verify(masked, hits, ("phone",)).collect()}
    assert got == {1: ("residue", "all"), 2: ("ok", None)}  # the number runs across two pages
    assert {r.doc_id: r.verdict for r in redact.verify(masked.where("page_no <> 3"), hits, ("phone",)).collect()} == {1: "ok", 2: "ok"}
    spans = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, "in"), (1, 1, 12.5, 0.0, 20.0, 10.0, "near"), (1, 2, 0.0, 0.0, 10.0, 10.0, "other")], "doc_id int, page_no int, x0 double, y0 double, x1 double, y1 double, text string")
    rects = spark.createDataFrame([(1, 1, 7, 5.0, 5.0, 11.0, 9.0)], "doc_id int, page_no int, rect_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.text for r in redact.mask_by_rect(spans, rects).collect()) == ["near", "other"]


def test_metadata_and_outline(spark):
    v = spark.createDataFrame([(1, "title", "张 三的简历"), (1, "author", "x"), (1, "phone", "13812345678"), (2, "title", "张三")], "doc_id int, key string, value string")
    t = spark.createDataFrame([(1, "张三")], "doc_id int, target string")
    assert sorted((r.doc_id, r.key) for r in redact.scrub(v, t, "doc_id", "value", 2, ("phone",)).collect()) == [(1, "author"), (2, "title")]
    o = spark.createDataFrame([(1, 1, 1, "a", 1), (1, 2, 3, "b", 1), (1, 3, 2, "c", 1), (1, 4, 1, "d", 1)], "doc_id int, pos int, level int, title string, page_no int")
    assert [r.level for r in redact.relevel(o).orderBy("pos").collect()] == [1, 2, 2, 1]


def test_on_values(spark):
    on = spark.createDataFrame([(1, "f/a/Choice[0]", "Yes"), (1, "f/b/Choice[0]", "On"), (1, "g/c", "2")], "doc_id int, path string, on_value string")
    v = spark.createDataFrame([(1, "x/a/Choice[0]", "1"), (1, "Choice[0]", "1"), (1, "g/c", "1"), (1, "g/d", "1"), (1, "f/b/Choice[0]", "0")], "doc_id int, key string, value string")
    assert {r.key: r.value for r in forms.translate_on_values(v, on).collect()} == {"x/a/Choice[0]": "Yes", "Choice[0]": "1", "g/c": "2", "g/d": "1", "f/b/Choice[0]": "0"}


def test_survey_rules(spark):
    ok = ("a" * 32, "其他", ["其他"], "", 5000, "")
    rows = [ok, ("short", *ok[1:]), (*ok[:1], "nope", *ok[2:]), (*ok[:2], [], *ok[3:]), (*ok[:2], ["其他", "其他"], *ok[3:]), (*ok[:3], "x" * 501, *ok[4:]), (*ok[:4], 1000, ""), (*ok[:5], "spam")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, client_id string, source string, features array<string>, feature_request string, elapsed_ms int, website string")
    got = [(r.rules, r.verdict) for r in survey.judged(df).orderBy("i").collect()]
    assert got == [([], "valid"), (["client_id"], "rejected"), (["source"], "rejected"), (["features"], "rejected"), (["features"], "rejected"), (["feature_request"], "rejected"), ([], "bot"), ([], "bot")]


def test_archives_and_budgets(spark):
    z = spark.createDataFrame([("e", None, None, None, None, None), ("l", "a", 1, 1, 1, 1), ("b", "a", 500_000, 100, 0, 500_000), ("t", "a/../b", 1, 1, 0, 1), ("w", "C:\\x", 1, 1, 0, 1), ("f", "a", 10, 5, 0, 11), ("ok", "a", 10, 5, 0, 10)], "archive_id string, entry string, file_size long, compress_size long, flag_bits int, actual_size long")
    assert {r.archive_id: r.reason for r in audits.zip_audit(z).collect()} == {"e": "empty", "l": "encrypted", "b": "ratio", "t": "traversal", "w": "absolute", "f": "forged", "ok": None}
    r = spark.range(1).select(G.pixel_budget_ok(F.lit(595.3), F.lit(842.0), 150).alias("a"), G.pixel_budget_ok(F.lit(20000.0), F.lit(20000.0), 150).alias("b"), G.normalize_rotation(F.lit(-90)).alias("c"), G.size_reduction_pct(F.lit(0), F.lit(5)).alias("d")).first()
    assert tuple(r) == (True, False, 270, 0.0)


def test_taken_serials_are_not_copied_to_rows(spark):
    """Taken serials meet rows by number, so no row carries a list of them."""
    names = ["a.pdf"] * 40 + [f"a__{k}.pdf" for k in (2, 3, 5, 7, 8, 9, 30, 31, 1000)] + ["A.pdf", "a__03.pdf", None, None]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "g int, i int, n string")
    found = ledger.unique_names(df, "g", "n", "i")
    free = (k for k in range(2, 100) if f"a__{k}.pdf" not in names)
    assert [r.unique_name for r in found.orderBy("i").collect()][:40] == ["a.pdf", *(f"a__{next(free)}.pdf" for _ in range(39))]
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_proof_is_decoded_once(spark):
    """Each step stood in the plan as often as later steps name it, in proof_decode many times over."""
    from quirefold.functions import payments

    rows = spark.createDataFrame([("a",)], "h string").select(payments.decode_payment_proof(F.concat("h", F.lit("x"))).alias("p")).select("p.*")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rpad(") == 1 and plan.count("from_json(") + plan.count("jsontostructs(") == 1


def test_a_key_is_normalised_once(spark):
    """Number and code are each put into plain form in one place of the plan; plain texts are left as they are."""
    rows = spark.createDataFrame([("１２ 3", "1234567890"), ("a\n", None), ("　", "x")], "n string, c string").select(I.make_key(F.concat("n", F.lit("")), F.concat("c", F.lit(""))).alias("k"))
    assert [r.k for r in rows.collect()] == ["1234567890-123", "a", ""]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2


def test_columns_that_are_plain(spark):
    """Keys and amounts of columns, most of which are as they should be, are those of the general forms."""
    texts = ["", None, " ", "12", "１２", "1 2", "12\n", "1234567890", "1234567890\n", "１234567890", "123456789012", "1234567890123", "a-b", "\x7f", "é"]
    rows = spark.createDataFrame([(n, c) for n in texts for c in texts], "number string, code string")
    for r in rows.select(I.column_key(F.col("number"), F.col("code")).alias("got"), I.make_key(F.col("number"), F.col("code")).alias("want")).collect():
        assert r.got == r.want
    amounts = ["1.00", "1.00\n", "-0.10", "1.0", "1", "１.00", "¥1.00", "1,000.00", "1.000", ".00", "--1.00", "\n1.00", "1.00x", "٣.00", "", None]
    rows = spark.createDataFrame([(a,) for a in amounts], "amount string")
    found = rows.select(I.column_fixed2(F.col("amount")).alias("got"), I.clean_amount_fixed2(F.col("amount")).alias("want")).collect()
    assert [r.got for r in found] == [r.want for r in found] and found[1].got == "1.00"
    plan = ledger.keyed(rows.select(F.lit("1").alias("number"), F.col("amount").alias("code"), "amount"))._jdf.queryExecution().optimizedPlan().toString()
    assert r"\A-?[0-9]+\.[0-9]{2}\z" in plan
