"""Queries of redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import redact as R
from .views import duck, table, view


def _words(spark: SparkSession, sf_dir: str) -> list[str]:
    """Keywords to mask: the first two words of the ten first benchmark items (a parameter list, bounded)."""
    rows = table(spark, sf_dir, "benchmark").orderBy("item_id").select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("k")).limit(10).collect()
    return sorted({r["k"] for r in rows if r["k"]})


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "f_doc_pages")


def pii_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.locate_report(R.preset_hits(_pages(spark, sf_dir)))


def keyword_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.keyword_hits(_pages(spark, sf_dir), _words(spark, sf_dir))
    return hits.groupBy("doc_id", "page_no", "literal").agg(F.count(F.lit(1)).alias("hits"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords: each two adjacent words of every benchmark item, and six of its characters from the fourth on."""
    b = table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " "))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    inner = F.array(F.substring("text", 4, 6))
    return b.select(F.explode(F.when(F.size("w") > 1, F.concat(pairs, inner)).otherwise(inner)).alias("keyword"))


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.keyword_table_hits(_pages(spark, sf_dir), _phrases(spark, sf_dir))
    return hits.groupBy("doc_id", "page_no", "literal").agg(F.count(F.lit(1)).alias("hits"))


def keyword_table_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    masked = R.mask_hits(pages, R.keyword_table_hits(pages, _phrases(spark, sf_dir)), ["doc_id", "page_no"])
    return masked.select("doc_id", "page_no", F.md5(F.col("text").cast("binary")).alias("masked_md5"), F.length("text").cast("bigint").alias("n_chars"))


def pii_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return R.redaction_report(R.preset_hits(pages), pages)


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = R.mask(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(masked.cast("binary")).alias("masked_md5"), F.length(masked).cast("bigint").alias("n_chars"))


def pii_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    masked = pages.withColumn("text", R.mask(F.col("text"), ("email",)))
    return R.verify(masked, R.preset_hits(pages, ("email",)), ("email",))


def side_channel_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    titles = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.substring("text", 1, 12).alias("title"))
    targets = c.where("turn = 0").select(F.col("conv_id").alias("doc_id"), F.substring("text", 3, 5).alias("target"))
    return R.scrub(titles, targets, "doc_id", "title").select("doc_id", "pos", "title")


def residue_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as values, all sentences of first turns as targets, a role's as one document: crowded, and few."""
    c = table(spark, sf_dir, "conversations")
    values = c.select("role", "conv_id", "turn", F.col("text").alias("title"))
    targets = c.where("turn = 0").select("role", F.explode(F.split("text", "[.]")).alias("target"))
    kept = R.scrub(values, targets, "role", "title", presets=tuple(R.PRESETS))
    return kept.select("role", "conv_id", "turn", F.md5(F.col("title").cast("binary")).alias("title_md5"))


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("k"), (1 + F.col("l_partkey") % 4).cast("int").alias("level"))
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))
    return o.withColumn("pos", pos.cast("bigint")).select("doc_id", "pos", "level", F.concat(F.lit("t"), F.col("pos").cast("string")).alias("title"), F.col("pos").alias("page_no"))


def outline_relevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relevel(_outline(spark, sf_dir).where("pos % 3 <> 2"))


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (1 + F.col("o_custkey") % 3).cast("int").alias("page_no"), F.col("o_orderkey").alias("rect_id"), ((F.col("o_custkey") * 7) % 500).cast("double").alias("x0"), ((F.col("o_custkey") * 3) % 300).cast("double").alias("y0"))
    return o.withColumn("x1", F.col("x0") + 120).withColumn("y1", F.col("y0") + 90)


def rect_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rect_hits(view(spark, sf_dir, "f_spans"), _rects(spark, sf_dir)).select("doc_id", "page_no", "text", "rect_id")


def rect_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mask_by_rect(view(spark, sf_dir, "f_spans"), _rects(spark, sf_dir)).select("doc_id", "page_no", "x0", "y0", "text")


def spec_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    spec = F.when(k % 4 == 0, F.lit('{"presets":["id","phone"],"custom":[" a ",""]}')).when(k % 4 == 1, F.lit('{"presets":["nope"]}')).when(k % 4 == 2, F.concat(F.lit('{"custom":["'), F.repeat(F.lit("x"), 101), F.lit('"]}'))).otherwise(F.lit("{}"))
    rules = R.keyword_rules(o.select("o_orderkey", spec.alias("spec"))).select("o_orderkey", F.array_join("custom", ",").alias("custom"), F.col("reason").alias("keyword_reason"))
    rect = R.rect_rules(o.select(F.col("o_orderkey").alias("r"), (k % 3).alias("page"), F.when(k % 7 == 0, F.lit(float("nan"))).otherwise((k % 5).cast("double")).alias("x"), (k % 11 - 1).cast("double").alias("y"), (k % 2).cast("double").alias("w"), F.lit(2.0).alias("h"))).select("r", F.col("reason").alias("rect_reason"))
    return rules.join(rect, F.col("o_orderkey") == F.col("r")).drop("r")


QUERIES = {f.__name__: f for f in (pii_locate, keyword_locate, keyword_table, keyword_table_mask, pii_report, pii_mask, pii_verify, side_channel_scrub, residue_scrub, outline_relevel, rect_hits, rect_mask, spec_checks)}

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_ID = r"^[1-9][0-9]{5}(18|19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]$"
_RUNS = "list_transform(regexp_extract_all(text, '[0-9]+[Xx]?'), lambda r: CASE WHEN length(r) = 18 THEN r ELSE rtrim(r, 'Xx') END)"
_HITS = f"""
h AS (SELECT doc_id, page_no, text, len(list_filter({_RUNS}, lambda r: regexp_matches(r, '{_ID}'))) AS n_id,
  len(list_filter({_RUNS}, lambda r: regexp_matches(r, '^1[3-9][0-9]{{9}}$'))) AS n_phone, len(regexp_extract_all(text, '{_EMAIL}')) AS n_email FROM f_doc_pages)"""
_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"
_RECTS = """
r AS (SELECT o_orderkey AS doc_id, 1 + o_custkey % 3 AS page_no, o_orderkey AS rect_id, CAST((o_custkey * 7) % 500 AS DOUBLE) AS x, CAST((o_custkey * 3) % 300 AS DOUBLE) AS y FROM orders)"""
_OVER = "s.doc_id = r.doc_id AND s.page_no = r.page_no AND s.x0 < r.x + 121 AND s.x1 > r.x - 1 AND s.y0 < r.y + 91 AND s.y1 > r.y - 1"

_PHRASES = """
b AS (SELECT text AS item, string_split(text, ' ') AS w FROM benchmark),
k AS (SELECT DISTINCT k FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS k FROM b UNION ALL SELECT substr(item, 4, 6) FROM b) WHERE k <> '')"""

ORACLES = {
    "keyword_table": duck(
        f"WITH {_PHRASES} SELECT doc_id, page_no, k AS literal, CAST((length(text) - length(replace(text, k, ''))) // length(k) AS BIGINT) AS hits FROM f_doc_pages, k WHERE contains(text, k)",
        "f_doc_pages",
    ),
    "keyword_table_mask": duck(
        f"""
WITH {_PHRASES}, h AS (SELECT doc_id, page_no, list(k ORDER BY length(k) DESC, k) AS found FROM f_doc_pages, k WHERE contains(text, k) GROUP BY ALL),
m AS (SELECT doc_id, page_no, CASE WHEN found IS NULL THEN text ELSE list_reduce(list_prepend(text, found), lambda t, x: replace(t, x, '')) END AS t FROM f_doc_pages LEFT JOIN h USING (doc_id, page_no))
SELECT doc_id, page_no, md5(t) AS masked_md5, length(t) AS n_chars FROM m""",
        "f_doc_pages",
    ),
    "pii_locate": duck(f"WITH {_HITS} SELECT doc_id, page_no, CAST(sum(n_id + n_phone + n_email) AS BIGINT) AS hits FROM h WHERE n_id + n_phone + n_email > 0 GROUP BY ROLLUP (doc_id, page_no) HAVING doc_id IS NOT NULL", "f_doc_pages"),
    "keyword_locate": duck(
        """
WITH b AS (SELECT array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS k FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 10)),
k AS (SELECT DISTINCT k FROM b WHERE k <> '')
SELECT doc_id, page_no, k AS literal, CAST((length(text) - length(replace(text, k, ''))) // length(k) AS BIGINT) AS hits FROM f_doc_pages, k WHERE contains(text, k)""",
        "f_doc_pages",
    ),
    "pii_report": duck(
        f"""WITH {_HITS} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (length(trim(coalesce(text, ''))) < 5) AS image_pages, CAST(coalesce(sum(n_id), 0) AS BIGINT) AS n_id, CAST(coalesce(sum(n_phone), 0) AS BIGINT) AS n_phone,
  CAST(coalesce(sum(n_email), 0) AS BIGINT) AS n_email, CAST(0 AS BIGINT) AS n_keyword, CAST(0 AS BIGINT) AS n_rect FROM h GROUP BY doc_id""",
        "f_doc_pages",
    ),
    "pii_mask": rf"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(^|[^0-9])([1-9][0-9]{{5}}(18|19|20)[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{{3}}[0-9Xx])($|[^0-9])', '\1\6', 'g'),
  '(^|[^0-9])(1[3-9][0-9]{{9}})($|[^0-9])', '\1\3', 'g'), '{_EMAIL}', '', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS masked_md5, length(t) AS n_chars FROM m""",
    "pii_verify": duck(
        f"""
WITH m AS (SELECT doc_id, page_no, lower(regexp_replace(regexp_replace(text, '{_EMAIL}', '', 'g'), '{_WS}', '', 'g')) AS t, list_transform(regexp_extract_all(text, '{_EMAIL}'), lambda e: lower(e)) AS e FROM f_doc_pages),
d AS (SELECT doc_id, string_agg(t, '' ORDER BY page_no) AS a, list_distinct(flatten(list(e))) AS targets FROM m GROUP BY doc_id),
f AS (SELECT *, len(list_filter(targets, lambda e: contains(a, e))) > 0 OR regexp_matches(a, '{_EMAIL}') AS bad FROM d),
p AS (SELECT m.doc_id, string_agg(CAST(page_no AS STRING), ',' ORDER BY page_no) AS pages FROM m JOIN f ON m.doc_id = f.doc_id AND f.bad WHERE len(list_filter(targets, lambda x: contains(t, x))) > 0 OR regexp_matches(t, '{_EMAIL}') GROUP BY m.doc_id)
SELECT f.doc_id, CASE WHEN bad THEN 'residue' ELSE 'ok' END AS verdict, CASE WHEN bad THEN coalesce(pages, 'all') END AS residue_pages FROM f LEFT JOIN p ON f.doc_id = p.doc_id""",
        "f_doc_pages",
    ),
    "side_channel_scrub": f"""
WITH v AS (SELECT conv_id AS doc_id, turn AS pos, substr(text, 1, 12) AS title, lower(regexp_replace(substr(text, 1, 12), '{_WS}', '', 'g')) AS v FROM conversations),
t AS (SELECT DISTINCT conv_id AS doc_id, lower(regexp_replace(substr(text, 3, 5), '{_WS}', '', 'g')) AS t FROM conversations WHERE turn = 0)
SELECT doc_id, pos, title FROM v WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = v.doc_id AND length(t.t) >= 3 AND length(v.v) >= 3 AND (contains(v.v, t.t) OR contains(t.t, v.v)))""",
    "residue_scrub": f"""
WITH v AS (SELECT role, conv_id, turn, text, lower(regexp_replace(text, '{_WS}', '', 'g')) AS v FROM conversations),
t AS (SELECT DISTINCT role, lower(regexp_replace(s, '{_WS}', '', 'g')) AS t FROM (SELECT role, unnest(string_split(text, '.')) AS s FROM conversations WHERE turn = 0)),
p AS (SELECT *, {_RUNS} AS runs FROM v)
SELECT role, conv_id, turn, md5(text) AS title_md5 FROM p
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.role = p.role AND length(t.t) >= 3 AND length(p.v) >= 3 AND (contains(p.v, t.t) OR contains(t.t, p.v)))
  AND NOT coalesce(regexp_matches(text, '{_EMAIL}') OR len(list_filter(runs, lambda r: regexp_matches(r, '{_ID}') OR regexp_matches(r, '^1[3-9][0-9]{{9}}$'))) > 0, false)""",
    "outline_relevel": """
WITH RECURSIVE o AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CAST(1 + l_partkey % 4 AS INT) AS level FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM o WHERE pos % 3 <> 2),
f AS (SELECT doc_id, n, pos, [level] AS open FROM k WHERE n = 1 UNION ALL
  SELECT k.doc_id, k.n, k.pos, list_append(list_filter(f.open, lambda x: x < k.level), k.level) FROM f JOIN k ON k.doc_id = f.doc_id AND k.n = f.n + 1)
SELECT doc_id, pos, len(open) AS level, 't' || CAST(pos AS STRING) AS title, pos AS page_no FROM f""",
    "rect_hits": duck(f"WITH {_RECTS} SELECT s.doc_id, s.page_no, s.text, r.rect_id FROM f_spans s JOIN r ON {_OVER}", "f_spans"),
    "rect_mask": duck(f"WITH {_RECTS} SELECT s.doc_id, s.page_no, s.x0, s.y0, s.text FROM f_spans s WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_OVER})", "f_spans"),
    "spec_checks": """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 2 THEN repeat('x', 101) ELSE '' END AS custom, CASE o_orderkey % 4 WHEN 1 THEN 'unknown_preset' WHEN 2 THEN 'too_long' WHEN 3 THEN 'empty' END AS keyword_reason,
  CASE WHEN o_orderkey % 7 = 0 THEN 'not_finite' WHEN o_orderkey % 3 < 1 THEN 'page' WHEN o_orderkey % 2 = 0 THEN 'size' WHEN o_orderkey % 11 - 1 < 0 THEN 'origin' END AS rect_reason FROM orders""",
}
