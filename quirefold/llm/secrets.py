"""Secret scans in native expressions (operator 2).

Base kinds are regular expressions. The method adds the kind `entropy`: runs of a character class (hexadecimal, base-64)
whose Shannon entropy, in the best window of WINDOW characters, reaches the class's threshold. The fold over a run keeps
counts by character and the sum of c*log2(c), changed for the entering and the leaving character only. Base spans, words
of placeholders and fillers are blanked before runs are sought, so that what stands beside them is judged by itself; a
run that the allow-list explains as a whole (words, paths, numbers, UUIDs) is suppressed.

Defined results: null text counts as empty and has no spans; copies, ties and repeated rows give a row each; other
columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run fails whole and no part of it could pass, so these two can ask for the length at once.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

WINDOW = 20
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character, of at most log2(20) = 4.32.
BITS = {"hexadecimal": 3.0, "base64": 3.7}
ALLOWED = (
    r"^[A-Za-z]+([-_/+=]+[A-Za-z]*)*$",  # words, paths and identifiers without a digit
    r"^[0-9]+([-_/+=]+[0-9]*)*$",  # numbers, dates, telephone numbers
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # UUIDs
)
#: Words of placeholders, and fillers: what is left of a run on either side of one is a run of its own.
PLACEHOLDERS = "(?i:example|placeholder|changeme|dummy|sample)"
CUT = PLACEHOLDERS + r"|([A-Za-z0-9+/_=-])\1{7,}"
BLOCK = 256


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: a lambda's free expressions are computed anew at each of its calls."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _starts(lengths: Column) -> Column:
    """Sum of the lengths before each; by blocks, so that thousands of matches cost no square."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    return _let(blocks, lambda sums: F.transform(lengths, lambda _, i: _sum(F.slice(sums, F.lit(1), block(i))) + _sum(F.slice(lengths, block(i) * BLOCK + 1, i % BLOCK))))


def _most_before(values: Column) -> Column:
    """Largest of the values before each, and of all: one more than there are values, 0 where there is none; by blocks."""
    most = lambda a: F.coalesce(F.array_max(a), F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int")), lambda b: most(F.slice(values, b * BLOCK + 1, BLOCK)))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    before = lambda found, i: F.greatest(most(F.slice(found, F.lit(1), block(i))), most(F.slice(values, block(i) * BLOCK + 1, i % BLOCK)))
    return _let(blocks, lambda found: F.transform(F.sequence(F.lit(0), F.size(values)), lambda i: before(found, i)))


_EMPTY = "array<struct<start:int,end:int,hit:string,value:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, hit, value) of leftmost matches: the text before each match and the match itself give the offsets."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
    )

    def spans(m: Column) -> Column:
        lengths = F.transform(m["hits"], lambda h, i: F.get(m["gaps"], i) + F.length(h))
        place = lambda before, i: F.get(before, i) + F.get(m["gaps"], i)
        span = lambda before: F.transform(
            m["hits"],
            lambda h, i: F.struct(
                place(before, i).alias("start"),
                (place(before, i) + F.length(h)).alias("end"),
                h.alias("hit"),
                F.get(m["values"], i).alias("value"),
            ),
        )
        return _let(lengths, lambda n: _let(_starts(n), span))

    return F.when(text.rlike(pattern), _let(parts, spans)).otherwise(F.array().cast(_EMPTY))


def window_entropy(run: Column) -> Column:
    """Largest Shannon entropy, in bits a character, of a window of WINDOW characters of a run of ALPHABET."""
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def fold(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new = F.get(codes, i)
            old = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(0))
            n_new, n_old = F.get(acc["counts"], new), F.get(acc["counts"], old)
            entering = weight(n_new + 1) - weight(n_new)
            leaving = F.when(old > 0, weight(n_old - 1) - weight(n_old)).otherwise(F.lit(0.0))
            total = F.when(new == old, acc["total"]).otherwise(acc["total"] + entering + leaving)
            counts = F.transform(acc["counts"], lambda n, k: n + (k == new).cast("int") - ((k == old) & (old > 0)).cast("int"))
            best = F.when(i >= WINDOW - 1, F.greatest(acc["best"], F.lit(_LOG_WINDOW) - total / WINDOW)).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["best"])

    return _let(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c)), fold)


_LOG_WINDOW = 4.321928094887363  # log2(20)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _replaced(text: Column, spans: Column, fill) -> Column:
    """text with fill(first, length) for each span: whether it is the first of those that overlap, and the characters of
    it that no span before covers. The spans are sorted."""

    def cut(state: Column) -> Column:
        chars, ends = state["chars"], state["ends"]
        piece = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
        new = lambda s, i: F.greatest(s["end"] - F.greatest(F.get(ends, i), s["start"]), F.lit(0))
        parts = F.transform(spans, lambda s, i: F.concat(piece(F.get(ends, i), s["start"]), fill(s["start"] >= F.get(ends, i), new(s, i))))
        return F.concat(F.array_join(parts, ""), piece(F.get(ends, F.size(spans)), F.size(chars)))

    ends = _let(F.transform(spans, lambda s: s["end"]), _most_before)
    return F.when(F.size(spans) > 0, _let(F.struct(F.split(text, "").alias("chars"), ends.alias("ends")), cut)).otherwise(text)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, and base, spans: array<struct<start,rank,end,kind>> by start, then kind."""
    t = F.col("__text")
    blank = lambda _, n: F.repeat(F.lit(" "), n)
    found = (
        docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), *keep)
        .withColumn("__assign", F.filter(matches(t, ASSIGN, 1), lambda m: F.length(m["value"]) >= LEAST_VALUE))
        .withColumn("__access", matches(t, ACCESS))
        .withColumn("__hex", matches(t, HEX))
        .withColumn("base", F.array_sort(F.concat(*(_spans(F.col(f"__{k}"), k) for k in KINDS[:3]))))
        .withColumn("__open", F.when(t.rlike(RUN), _replaced(t, F.col("base"), blank)).otherwise(""))
        .withColumn("__cuts", F.when(F.col("__open").rlike(RUN), matches(F.col("__open"), CUT)).otherwise(F.array().cast(_EMPTY)))
        .withColumn("__runs", matches(_replaced(F.col("__open"), F.col("__cuts"), blank), RUN))
    )
    allowed = lambda s: _any([s.rlike(p) for p in ALLOWED])
    found = found.withColumn("__runs", F.when(F.size("__runs") > 0, F.filter(F.col("__runs"), lambda m: ~allowed(m["hit"]))).otherwise(F.col("__runs")))
    least = lambda s: F.when(s.rlike("^[0-9A-Fa-f]+$"), F.lit(BITS["hexadecimal"])).otherwise(F.lit(BITS["base64"]))
    high = F.when(F.size("__runs") > 0, F.filter(F.col("__runs"), lambda m: window_entropy(m["hit"]) >= least(m["hit"]) - 1e-9)).otherwise(F.col("__runs"))
    return found.withColumn("spans", F.array_sort(F.concat(F.col("base"), _spans(high, "entropy")))).select(*keep, "base", "spans")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced and n_chars set anew; null texts stay null."""
    columns = docs.columns
    scanned = scan(docs.select("text", F.struct(*columns).alias("__row")), keep=("__row",))
    spans = F.col("spans")
    # of spans that overlap, the first one's mask stands for all
    clean = _replaced(F.col("__row.text"), spans, lambda first, _: F.when(first, F.lit(mask)).otherwise(F.lit("")))
    out = scanned.withColumn("__clean", clean)
    new = {"text": F.col("__clean"), "n_chars": F.when(F.size(spans) > 0, F.length("__clean").cast("bigint")).otherwise(F.col("__row.n_chars")) if "n_chars" in columns else None}
    return out.select(*((new[c] if c in new else F.col(f"__row.{c}")).alias(c) for c in columns))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(C.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter(F.col("base"), lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return scanned.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _found(kind: str, pattern: str, group: int, source: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {KINDS.index(kind)} AS rank, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {group}) AS v,
  list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS g FROM {source} WHERE regexp_matches(t, '{p}')"""


_ALLOW = " OR ".join(f"regexp_matches(hit, '{p}')" for p in ALLOWED)
_FILLERS = "|".join(("\\" if c in "+-" else "") + c + "{8,}" for c in ALPHABET)


def _blanked(source: str, target: str, covers: str) -> str:
    """`target` (doc_id, t): texts of `source` with spaces for the characters that the spans of `covers` hold."""
    return f"""{target} AS (SELECT doc_id, CASE WHEN s IS NULL THEN t ELSE array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN len(list_filter(s, lambda x: x.a < i AND x.z >= i)) > 0 THEN ' ' ELSE t[i] END), '') END AS t
  FROM {source} LEFT JOIN (SELECT doc_id, list({{'a': a, 'z': z}}) AS s FROM {covers} GROUP BY doc_id) AS c USING (doc_id))"""


def _placed(source: str, matched: str, target: str) -> str:
    """`target` (doc_id, kind, rank, hit, val, a, z): the rows of `matched` with their offsets."""
    return f"""{matched} AS ({source}),
{target} AS (SELECT *, a + length(hit) AS z FROM (SELECT doc_id, kind, rank, h[i] AS hit, v[i] AS val, CAST(coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) + list_sum(g[1:i]) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM {matched})))"""


_BASE = ((k, p, g) for k, p, g in (("assign", ASSIGN, 1), ("access", ACCESS, 0), ("hex", HEX, 0)))
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_placed(" UNION ALL ".join(_found(*b, "d") for b in _BASE), "bm", "bp")},
b AS (SELECT * FROM bp WHERE kind <> 'assign' OR length(val) >= {LEAST_VALUE}),
d0 AS (SELECT * FROM d WHERE regexp_matches(t, '{RUN}')),
{_blanked("d0", "d1", "b")},
{_placed(_found("hex", PLACEHOLDERS + "|" + _FILLERS, 0, "d1"), "cm", "cp")},
{_blanked("d1", "d2", "cp")},
{_placed(_found("entropy", RUN, 0, "d2"), "rm", "rp")},
r AS (SELECT *, regexp_matches(hit, '^[0-9A-Fa-f]+$') AS hexed FROM rp WHERE NOT ({_ALLOW})),
e AS (SELECT * FROM r WHERE list_max(list_transform(range(1, length(hit) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(hit, i, {WINDOW}), ''), 'entropy'))) >= CASE WHEN hexed THEN {BITS["hexadecimal"]} ELSE {BITS["base64"]} END - 1e-9),
u AS (SELECT doc_id, kind, rank, a, z FROM b UNION ALL SELECT doc_id, kind, rank, a, z FROM e),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM u GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON d.doc_id IS NOT DISTINCT FROM j.doc_id
"""
