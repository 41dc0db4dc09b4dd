"""Document fingerprints (operator 7): bottom-k sketches of shingle hashes, in native expressions.

A sketch is the ascending array of the K smallest distinct hashes of a text's five-word shingles (words as in
common.WORD, lower case; a text of fewer words is one shingle). Sketches of parts merge by union and cut. They estimate
resemblance, containment and the number of distinct shingles; with fewer than K hashes all three are exact.

The next document is found without a global sort in one task: quantiles of the ids cut the table into ranges, each range
is ordered by itself, and the first row of the following range visits it as a guest.

Defined results: null text is empty; texts without words have the empty sketch, alike (1) to each other and unlike (0)
to all others; a null id comes first; equal ids go by the text's hash; a single document is its own next; an empty table
gives no rows; other columns are not read. Ids are numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
K = 128
#: Bits of a hash: ten hexadecimal digits.
BITS = 40
RANGE_BYTES = 8 << 20
MOST_RANGES = 65_536


def let(value: Column, body) -> Column:
    """body of a value that is computed once: a lambda's free expressions are computed anew at each of its calls."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, k: int = K) -> Column:
    def hashes(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
        return F.transform(places, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(words, i, SHINGLE)), 64 - BITS))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(C.WORD), F.lit(0))
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes(w))), 1, k)))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have."""
    both = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    r, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (n + m) / n))


def shown(a: Column) -> Column:
    """A sketch as text: ten hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), "")


def _range_of(doc_id: Column, cuts: list) -> Column:
    """Cuts at or below the id, by halving."""
    if not cuts:
        return F.lit(0)
    all_ = F.array(*(F.lit(c) for c in cuts))
    start = F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("b"))

    def halve(state: Column, _: Column) -> Column:
        mid = F.shiftright(state["a"] + state["b"], 1)
        right = (state["a"] < state["b"]) & (F.get(all_, mid) <= doc_id)
        return F.struct(F.when(right, mid + 1).otherwise(state["a"]).alias("a"), F.when(right, state["b"]).otherwise(F.greatest(mid, state["a"])).alias("b"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.coalesce(F.aggregate(steps, start, halve)["a"], F.lit(0))


def with_next(docs: DataFrame, carry: list[str], doc_id: str = "doc_id") -> DataFrame:
    """docs and, as next_<column>, the carried columns of the next row by id, after the last row those of the first."""
    n = max(64, min(MOST_RANGES, -(-C.text_bytes(docs, "text") // RANGE_BYTES)))
    found = docs.agg(F.percentile_approx(doc_id, [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()["cuts"]
    placed = docs.withColumn("__range", _range_of(F.col(doc_id), sorted(set(found or []))))
    firsts = placed.groupBy("__range").agg(F.min(F.struct(doc_id)).alias("__first"))
    order = Window.orderBy("__range")  # over one row a range, MOST_RANGES at most
    hosts = firsts.select(F.col("__first").getField(doc_id).alias("__first"), F.coalesce(F.lag("__range").over(order), F.max("__range").over(Window.partitionBy())).alias("__host"))
    visited = placed.join(F.broadcast(hosts), F.col(doc_id).eqNullSafe(F.col("__first")), "left")
    rows = visited.withColumn("__at", F.explode(F.array_compact(F.array(F.struct(F.col("__range").alias("range"), F.lit(False).alias("guest")), F.when(F.col("__host").isNotNull(), F.struct(F.col("__host").alias("range"), F.lit(True).alias("guest")))))))
    w = Window.partitionBy("__at.range").orderBy("__at.guest", doc_id, F.xxhash64("text"))
    rows = rows.select(*docs.columns, "__at", *(F.lead(c).over(w).alias(f"next_{c}") for c in carry))
    return rows.where(~F.col("__at.guest")).drop("__at")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K) -> DataFrame:
    """(doc_id, text, sketch) and, of the next document, next_text and next_sketch."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_next(rows.withColumn("sketch", sketch(F.col("text"), k)), ["text", "sketch"])


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints(C.table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("sketch")).alias("fingerprint"),
        shown(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.round(distinct_shingles(F.col("sketch"))).cast("bigint").alias("n_shingles"),
    )
