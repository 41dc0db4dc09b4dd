import time

import duckdb

from quirefold.llm import chat


def brute(rows):
    by = {}
    for c, t, r, x in set(rows):
        if c is not None:
            by.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    seqs = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in by.items()}
    out = {}
    for c, s in seqs.items():
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()) and c == min(k for k, o in seqs.items() if o == s):
            chat_ = "".join(f"<|{r[1] if r[0] else 'unknown'}|>\n{x[1]}\n<|end|>\n" for r, x in s)
            out[c] = (len(s), sum(o == s for o in seqs.values()), chat_)
    return out


def test_against_sql(spark, sf):
    got = sorted(map(tuple, chat.op3_chat(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == sorted(con.execute(chat.ORACLE).fetchall()) and got


def test_edges(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "user", "other"), (4, 0, "user", "other"),
        (5, 5, "user", "hi"), (5, 9, "bot", "yo"), (5, 10, None, None), (6, None, "user", ""), (None, 0, "user", "lost"), (7, 0, "user", "x" * 100_000),
    ] + [(8, i, "user", "t") for i in range(300)] + [(9, i, "user", "t") for i in range(299)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns int")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chat.maximal(df).select("conv_id", "n_turns", "n_copies", chat.rendered(chat.F.col("turns")).alias("chat")).collect()}
    assert got == brute(rows)
    assert chat.maximal(df.limit(0)).collect() == []


def test_a_conversation_of_40000_turns(spark):
    turns = spark.range(40_000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "'t' AS text")
    began = time.time()
    got = chat.maximal(turns.unionByName(turns.where("turn < 39000").selectExpr("2L AS conv_id", "turn", "role", "text"))).select("conv_id", "n_turns").collect()
    assert [tuple(r) for r in got] == [(1, 40_000)] and time.time() - began < 40


def test_null_is_not_a_text(spark):
    rows = [(1, 0, None, "a"), (2, 0, "\0", "a"), (2, 1, "x", "b"), (3, 0, "+", None), (4, 0, "+", "-"), (4, 1, "x", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert sorted(r.conv_id for r in chat.maximal(df).collect()) == [1, 2, 3, 4]
