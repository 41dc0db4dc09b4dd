"""Sources, sinks and streams on literals and on files written by the test."""

import json

import duckdb
from pyspark.sql import functions as F

from quirefold.operators import orders
from quirefold.plans import intake
from quirefold.sources import files as S
from quirefold.streaming import streams as X

INVOICE = """<?xml version="1.0" encoding="UTF-8"?>
<EInvoice><Header><EIid>26112000001182262471</EIid><InherentLabel><GeneralOrSpecialVAT><LabelName>普通发票</LabelName></GeneralOrSpecialVAT></InherentLabel></Header>
<TaxSupervisionInfo><InvoiceNumber>26112000001182262471</InvoiceNumber><IssueTime>2026-03-26</IssueTime></TaxSupervisionInfo>
<EInvoiceData><BuyerInformation><BuyerName>买方</BuyerName></BuyerInformation><BasicInformation><TotalAmWithoutTax>254.72</TotalAmWithoutTax><TotalTaxAm>15.28</TotalTaxAm><TotalTax-includedAmount>270.00</TotalTax-includedAmount></BasicInformation>
<IssuItemInformation/><IssuItemInformation/></EInvoiceData></EInvoice>"""


def test_admitted_files(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"nope", "c.exe": b"MZ", "d.xml": INVOICE.encode(), "e.pdf": b"%PDF" + b"x" * 3000}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.reason, r.kind, r.content is not None) for r in S.scan_files(spark, str(tmp_path), (".pdf", ".xml"), 2000).collect()}
    assert got == {"a.pdf": (None, "pdf", True), "b.pdf": ("content", "unknown", False), "c.exe": ("extension", "unknown", False), "d.xml": (None, "unknown", True), "e.pdf": ("size", "pdf", False)}
    heads = spark.createDataFrame([(b"\xc8abc", "c8"), (b"KDH 1", "kdh"), (b"HN..", "hn"), (b"CAJ", "caj"), (b"PK\x03\x04", "zip"), (b"", "unknown")], "content binary, kind string")
    assert heads.where(S.sniff(F.col("content")) != F.col("kind")).count() == 0


def test_invoice_xml(spark):
    bad = [("dtd", '<!DOCTYPE x [<!ENTITY a "b">]><EInvoice/>'), ("malformed", "<EInvoice><a></EInvoice>"), ("root", "<Other/>")]
    rows = [("ok", INVOICE), *bad]
    df = spark.createDataFrame([(n, x.encode()) for n, x in rows], "path string, content binary")
    got = {r.source_file: r for r in S.scan_invoice_xml(df).collect()}
    r = got["ok"]
    assert (r.invoice_number, r.issue_date, r.amount_without_tax, r.tax_amount, r.total_with_tax, r.item_count, r.buyer_name, r.reason) == ("26112000001182262471", "2026-03-26", "254.72", "15.28", "270.00", 2, "买方", None)
    assert all(got[n].reason == n and got[n].invoice_number is None for n, _ in bad)


def test_logs(spark, tmp_path):
    task = "0a1b2c3d-0000-4000-8000-0123456789ab"
    (tmp_path / "a.log").write_text(f"2026-11-16 10:00:00,100 - app - ERROR - task {task} failed: boom\n2026-11-16 10:00:00,200 - app - ERROR - Request failed request_id=ab12 method=POST path=/x status=500\n2026-11-15 09:00:00,000 - app - ERROR - task {task} failed: old\nnoise\n")
    got = S.scan_logs(spark, [str(tmp_path)], "2026-11-16").orderBy("time").collect()
    assert [(r.task_id, r.message, r.request_id, r.status) for r in got] == [(task, "boom", None, None), (None, None, "ab12", 500)]


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("f.pdf", "=cmd", ["a", "b"])], "source_file string, buyer_name string, warnings array<string>")
    S.write_ledger_csv(r, str(tmp_path / "ledger"))
    text = "".join(p.read_text() for p in (tmp_path / "ledger").glob("*.csv"))
    assert text.startswith('"﻿来源文件","票种"') and "\"'=cmd\"" in text and '"a；b"' in text and text.splitlines()[0].count(",") == 13
    s = spark.createDataFrame([(2, json.dumps(["x", "y"])), (1, "[]")], "submitted_at int, features string")
    S.write_survey_csv(s, str(tmp_path / "survey"))
    assert sorted("".join(p.read_text() for p in (tmp_path / "survey").glob("*.csv")).split()) == sorted(['submitted_at,features', '1,""', "2,x、y", *(["submitted_at,features"] * ("".join(p.read_text() for p in (tmp_path / "survey").glob("*.csv")).count("submitted_at") - 1))])
    for rows in ([("d1", 1), ("d2", 2)], [("d2", 3)]):
        S.write_daily(spark.createDataFrame(rows, "day string, n int"), str(tmp_path / "daily"))
    assert sorted((r.day, r.n) for r in spark.read.json(str(tmp_path / "daily")).collect()) == [("d1", 1), ("d2", 3)]


def stream(spark, tmp_path, rows, schema, parts=2):
    df = spark.createDataFrame(rows, schema)
    df.repartition(parts).write.parquet(str(tmp_path))
    return X.tail(spark, str(tmp_path), df.schema)


def test_survey_stream(spark, tmp_path):
    s = stream(spark, tmp_path / "in", [("a", 5000, "", "2026-01-01 00:00:00"), ("a", 5000, "", "2026-01-01 00:00:01"), ("b", 100, "", "2026-01-01 00:00:02"), ("c", 5000, "spam", "2026-01-01 00:00:03"), ("d", 5000, "", "2026-01-01 00:00:04")], "client_id string, elapsed_ms int, website string, t string")
    got = X.to_memory(X.unique_clients(s.withColumn("ts", F.to_timestamp("t")), "1 hour"), "survey")
    assert sorted(r.client_id for r in got.collect()) == ["a", "d"]


def test_correlation_stream(spark, tmp_path):
    t = stream(spark, tmp_path / "t", [(1, 10, "2026-01-01 00:00:00"), (1, 11, "2026-01-01 01:00:00")], "user_id int, task_id int, s string").withColumn("last_seen", F.to_timestamp("s"))
    r = stream(spark, tmp_path / "r", [(1, 20, "2026-01-01 00:00:05"), (1, 21, "2026-01-01 00:00:30"), (2, 22, "2026-01-01 01:00:01")], "user_id int, request_id int, s string").withColumn("time", F.to_timestamp("s"))
    assert [(r.task_id, r.request_id) for r in X.to_memory(X.correlated(t, r, 10, "2 hours"), "corr").collect()] == [(10, 20)]


def test_redaction_stream(spark, tmp_path):
    s = stream(spark, tmp_path / "in", [(1, "call 13812345678 or zhangsan@example.com, id 110101199003077757"), (2, "12345678901 bad-mail-at-nowhere 112233445566778")], "doc_id int, text string")
    got = {r.doc_id: r.text for r in X.to_memory(X.redacted(s), "red").collect()}
    assert got == {1: "call  or , id ", 2: "12345678901 bad-mail-at-nowhere 112233445566778"}


def test_upload_sessions(spark, tmp_path):
    rows = [("a", k, 3, f"2026-01-01 00:0{k}:00") for k in range(3)] + [("b", 0, 2, "2026-01-01 00:00:00"), ("b", 1, 2, "2026-01-01 05:00:00"), ("z", 0, 1, "2026-01-03 00:00:00")]
    s = stream(spark, tmp_path / "in", rows, "task_id string, idx int, total int, t string", 1).withColumn("ts", F.to_timestamp("t"))
    got = sorted((r.task_id, r.n_parts, r.complete) for r in X.to_memory(X.upload_sessions(s, "1 hour"), "up").collect())
    assert got == [("a", 3, True), ("b", 1, False), ("b", 1, False)]


def test_ledger_stream(spark, tmp_path):
    rows = [("f1", None, "12345678", "1.00", 1), ("f2", None, "12345678", "1.00", 2), ("f3", None, "87654321", "2", 3), ("f4", None, None, "2", 4)]
    s = stream(spark, tmp_path / "in", rows, "file_ref string, code string, number string, amount string, row_no int", 2)
    q = s.writeStream.foreachBatch(X.ledger_batches(str(tmp_path / "ledger"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "ledger")).select("key", "amount").collect()
    assert sorted(map(tuple, got)) == [("12345678", "1.00"), ("87654321", "2.00")]


def test_sql_of_stream_uploads_leaves_no_ties_to_chance():
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT 1 + k // 4 AS l_orderkey, 1 + k % 2 AS l_linenumber, TIMESTAMP '2000-01-01' + CASE WHEN k % 4 > 1 THEN INTERVAL 90 DAYS ELSE INTERVAL 0 DAYS END AS l_shipdate FROM range(40) r(k) UNION ALL SELECT 99, 1, TIMESTAMP '2001-01-01'")
    sql = intake.ORACLES["stream_uploads"]
    assert "FROM lineitem),\nn AS" in sql
    for order in ("new", "new DESC"):  # in which rows of one time come to the sum must make no difference
        got = con.execute(sql.replace("FROM lineitem),\nn AS", f"FROM lineitem ORDER BY {order}),\nn AS")).fetchall()
        assert sorted((task, n) for task, _, _, n, _ in got) == [(t, 2) for t in range(1, 11) for _ in range(2)]


def test_invoice_xml_is_parsed_once(spark):
    x = "<EInvoice><Data><InvoiceNumber> </InvoiceNumber><InvoiceNumber> a<b>1</b> </InvoiceNumber><BuyerName/><Drawer>\t</Drawer><Remark>&lt;,&amp;</Remark><EIid>9</EIid></Data></EInvoice>"
    df = S.scan_invoice_xml(spark.createDataFrame([("f", x.encode())], "path string, content binary"))
    r = df.first()
    assert (r.invoice_number, r.buyer_name, r.drawer, r.remark, r.item_count, r.reason) == ("a1", None, None, "<,&", None, None)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("XPathStringEvaluator") == 1
