"""Chat formatting (operator 3): logged snapshots of conversations collapse to the longest, which are rendered.

Each turn gets the hash of all turns up to it: two sums of hashes of (place, role, text), so that a prefix's hash rolls
on from the one before. A conversation is a snapshot of a longer one if its last hash and length are those of a prefix
there. Anti-joins drop snapshots; of equal conversations the one with the smallest id stays.

Defined results: turns are ordered by number, then role and text, nulls first; equal rows of a conversation are one turn;
a null role renders as `unknown`, a null text as an empty one; rows without a conversation id are left out, as nothing
says what they belong to; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")
#: Sums of 2**22 turns stay below 2**63.
_BITS = 41
BLOCK = 256


def _rolled(turns: Column, seed: int) -> Column:
    """Of each prefix, the sum of the hashes of its turns; by blocks, so that no prefix is added up anew."""
    given = lambda x: F.coalesce(F.concat(F.lit("+"), x), F.lit("-"))
    hashes = F.transform(turns, lambda t, i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), i, given(t["role"]), given(t["text"])), 64 - _BITS))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def sums(h: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(h) - 1)), lambda b: total(F.slice(h, b * BLOCK + 1, BLOCK)))
        upto = lambda before, i: total(F.slice(before, F.lit(1), block(i))) + total(F.slice(h, block(i) * BLOCK + 1, i % BLOCK + 1))
        return let(blocks, lambda before: F.transform(h, lambda _, i: upto(before, i)))

    return let(hashes, sums)


def conversations_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, prefixes): a conversation is one row here, as it is in the result."""
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    return by.select("conv_id", "turns", F.arrays_zip(_rolled(F.col("turns"), 1).alias("h1"), _rolled(F.col("turns"), 2).alias("h2")).alias("prefixes"))


def maximal(turns: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, n_turns, turns, n_copies) of the conversations that no other one continues or repeats."""
    by = C.written(conversations_of(turns, **columns), "conversations")
    whole = by.select("conv_id", F.size("turns").alias("n"), F.element_at("prefixes", -1).alias("h"))
    parts = by.select(F.posexplode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("n", "h")).select((F.col("n") + 1).alias("n"), "h").distinct()
    distinct = whole.groupBy("n", "h").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    kept = distinct.join(parts, ["n", "h"], "left_anti").select("conv_id", "n_copies")
    return by.join(kept, "conv_id").select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), "turns", "n_copies")


def rendered(turns: Column) -> Column:
    before, between, after = TEMPLATE
    one = lambda t: F.concat(F.lit(before), F.coalesce(t["role"], F.lit("unknown")), F.lit(between), F.coalesce(t["text"], F.lit("")), F.lit(after))
    return F.array_join(F.transform(turns, one), "")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal(C.table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "n_copies", rendered(F.col("turns")).alias("chat"))


ORACLE = """
WITH ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
), marked AS (
  SELECT *, coalesce(md5(role), '-') || coalesce(md5(text), '-') AS m FROM ordered
), rolled AS (
  SELECT conv_id, place, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix, max(place) OVER (PARTITION BY conv_id) AS n FROM marked
), whole AS (
  SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM rolled WHERE place = n GROUP BY prefix, n
), kept AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.place < r.n AND r.prefix = whole.prefix)
)
SELECT k.conv_id, k.n AS n_turns, k.n_copies,
  string_agg('<|' || coalesce(o.role, 'unknown') || '|>' || chr(10) || coalesce(o.text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY o.place) AS chat
FROM kept k JOIN ordered o USING (conv_id) GROUP BY k.conv_id, k.n, k.n_copies
"""
