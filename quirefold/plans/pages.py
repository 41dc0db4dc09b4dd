"""Queries of pages, zones and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import invoices as I
from ..functions import pages as G
from ..functions import text as X
from ..operators import forms, layout
from ..operators import pages as P
from .views import duck, table, view


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "f_doc_pages").select("doc_id", F.col("page_no").cast("bigint").alias("page_no"), F.length("text").cast("bigint").alias("n"))


def _spec():
    d = F.col("doc_id")
    return F.concat(F.lit("1,"), (d % 5).cast("string"), F.lit("-"), (d % 5 + 3).cast("string"), F.lit(", 900-x"))


def page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select_pages(_pages(spark, sf_dir), _spec())


def page_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.remove_pages(_pages(spark, sf_dir), _spec())


def page_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("2:90,1,2:-90,3:450").alias("spec"))
    return P.reorder(_pages(spark, sf_dir), docs)


def order_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    d = F.col("doc_id")
    specs = n.select("doc_id", F.sequence(F.lit(1), "n").alias("available"), F.when(d % 3 == 0, F.array(F.lit(2), F.lit(1))).when(d % 3 == 1, F.array(F.lit(1), F.lit(1))).otherwise(F.array().cast("array<int>")).alias("order"))
    return P.order_rules(specs, "available", "order").select("doc_id", "allowed")


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = P.split_every(_pages(spark, sf_dir), 4).withColumn("how", F.lit("every"))
    ranges = P.split_ranges(_pages(spark, sf_dir), F.lit("1-2,5,2-3")).withColumn("how", F.lit("ranges"))
    return every.unionByName(ranges)


def page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.number_pages(_pages(spark, sf_dir), 7, 3)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ordinals(_pages(spark, sf_dir).withColumn("batch", F.col("doc_id") % 50), "batch", "doc_id")


def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("batch", "doc_id", "page_no", "ordinal")


def imposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.impose(_placed(spark, sf_dir), 2, 2).select("batch", "doc_id", "page_no", "sheet", "slot", "col", "row")


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).withColumn("batch", F.col("doc_id") % 50)
    return P.page_totals(files, "batch", "k", 4)


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.with_total(_pages(spark, sf_dir))
    fmt = F.element_at(F.array(*map(F.lit, (*X.PAGE_FORMATS, "none"))), (F.col("page_no") % 5 + 1).cast("int"))
    text = X.render_vars(F.lit("{filename}-{page}/{pages} {year} {other}{date}"), {"filename": F.concat(F.lit("doc{page}"), F.col("doc_id").cast("string")), "date": F.lit("2026-11-01"), "year": F.lit("2026"), "page": F.col("page_no"), "pages": F.col("n_pages")})
    return p.select("doc_id", "page_no", X.format_page_number(fmt, F.col("page_no"), F.col("n_pages")).alias("label"), text.alias("header"), G.normalize_rotation(F.col("page_no") * 90 - 450).alias("angle"))


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_pages"), F.length("text").cast("bigint").alias("n_chars"), F.md5(X.preview(F.col("text")).cast("binary")).alias("preview_md5"), X.xml_text_ok(F.col("text")).alias("xml_ok"))


def image_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "f_spans").select((F.col("doc_id") % 500).alias("doc_id"), (F.col("x0") % 40).cast("bigint").alias("xref"), "page_no", F.when(F.col("y0") % 2 == 0, F.lit("png")).otherwise(F.lit("jpg")).alias("ext"))
    return P.image_objects(s, 30)


def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    w = F.when(F.col("o_orderkey") % 9 == 0, F.lit(float("nan"))).otherwise((F.col("o_custkey") * 3 % 6000).cast("double"))
    return o.select("o_orderkey", G.pixel_budget_ok(w, (F.col("o_orderkey") % 6000).cast("double"), 150).alias("fits"))


def zone_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "f_spans")
    s = s.withColumn("text", F.when(F.col("y0").between(80, 107), F.concat(F.lit("名称：公司"), F.col("text"))).when(F.col("y0").between(150, 200), F.concat(F.lit("*"), F.col("text"))).when(F.col("y0") > 320, F.concat(F.lit("备注 "), F.col("text"))).otherwise(F.col("text")))
    return layout.zone_fields(s)


_FIXED = """
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
  CAST((l_partkey * 37) % 210 AS DOUBLE) AS x, CAST((l_suppkey * 13 + l_partkey) % 116 AS DOUBLE) AS y, CAST(210 + 30 * (l_orderkey % 2) AS DOUBLE) AS page_width,
  l_linenumber AS k, l_partkey AS p, l_suppkey AS s, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) AS price, l_orderkey AS o FROM {lineitem}"""
_FIXED_TEXT = """CASE WHEN k = 1 AND p % 4 <> 0 THEN lpad(CAST(o AS STRING), 20, '2')
  WHEN k = 2 THEN '2026年' || CAST(1 + p % 14 AS STRING) || '月' || CAST(1 + s % 30 AS STRING) || '日'
  WHEN y < 26 THEN CASE p % 3 WHEN 0 THEN '电子发票（普通发票）' WHEN 1 THEN '专用发票' ELSE 'x' END
  WHEN y < 38 THEN CASE p % 3 WHEN 0 THEN '名称：公司' || CAST(p AS STRING) WHEN 1 THEN '发票公司' || CAST(s AS STRING) ELSE '张三' || CAST(s AS STRING) END
  WHEN y < 60 THEN '91' || lpad(CAST(p AS STRING), 14, '0') WHEN y < 90 THEN '*' || CAST(p AS STRING) WHEN p % 5 = 0 THEN 'n/a' ELSE '¥ ' || price END"""


def fixed_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = spark.sql(_FIXED, lineitem=table(spark, sf_dir, "lineitem")).withColumn("text", F.expr(_FIXED_TEXT))
    return layout.fixed_zone_fields(placed)


def ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("bigint")
    o = li.select(F.col("l_orderkey").alias("doc_id"), pos.alias("obj_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice").cast("decimal(14,2)").cast("string")).otherwise(F.concat(F.lit("t"), F.col("l_partkey").cast("string"))).alias("text"))
    tags = o.select("doc_id", F.when(F.col("obj_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("field"), (-F.col("obj_id")).alias("pos"), "obj_id")
    return layout.resolve_references(tags, o)


def single_page_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "f_spans").groupBy("doc_id", "page_no").agg(F.count_if(F.length("text") == 20).alias("n"))
    return layout.single_page(s.select("doc_id", "page_no", F.when(F.col("n") == 0, F.concat(F.lit("no number on "), F.col("page_no").cast("string"))).alias("error")))


def sibling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent"), F.col("p_type").alias("name"), F.col("p_partkey").alias("pos"))
    return forms.sibling_index(p)


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tree = F.broadcast(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows
    s = table(spark, sf_dir, "supplier").join(tree, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_nationkey").cast("bigint").alias("doc_id"), F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("s"), (F.col("s_suppkey") % 7).cast("string")), F.concat(F.lit("f"), (F.col("s_suppkey") % 3).cast("string"))).alias("path"), F.col("s_name").alias("value")).dropDuplicates(["doc_id", "path"])


def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir).select("doc_id", "path", F.posexplode(forms.suffixes(F.col("path"))).alias("cut", "suffix"))


def suffix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    ask = leaves.select("doc_id", F.concat(F.lit("root/"), F.element_at(F.split("path", "/"), -2), F.lit("/"), F.element_at(F.split("path", "/"), -1), F.lit("/Yes")).alias("key")).unionByName(leaves.select("doc_id", F.concat(F.lit("x/"), F.element_at(F.split("path", "/"), -1)).alias("key")))
    return forms.resolve(ask.distinct(), leaves)


def _forms(spark: SparkSession, sf_dir: str):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("path"), F.col("l_partkey").alias("k")).groupBy("doc_id", "path").agg(F.min("k").alias("k"))
    before = li.where("k % 29 <> 3").select("doc_id", "path", (F.col("k") % 10).cast("string").alias("value"))
    after = li.where("k % 31 <> 5").select("doc_id", "path", F.when(F.col("k") % 4 == 0, F.lit("new")).when(F.col("k") % 37 == 1, F.lit("odd")).otherwise((F.col("k") % 10).cast("string")).alias("value"))
    targets = li.where("k % 4 = 0 AND k % 41 <> 0").select("doc_id", "path", F.lit("new").alias("value"))
    return before, after, targets


def change_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.change_audit(*_forms(spark, sf_dir))


def leaf_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, _ = _forms(spark, sf_dir)
    return forms.leaf_diff(before, after)


QUERIES = {f.__name__: f for f in (page_select, page_remove, page_reorder, order_subset, page_split, page_number, merge_order, imposition, page_totals, page_labels, text_stats, image_objects, page_budget, zone_fields, fixed_zones, ref_resolve, single_page_rule, sibling_index, suffixes, suffix_resolve, change_audit, leaf_diff)}

_P = "p AS (SELECT doc_id, page_no, length(text) AS n, max(page_no) OVER (PARTITION BY doc_id) AS n_pages FROM f_doc_pages)"
_IN = "(page_no = 1 OR (page_no >= greatest(1, doc_id % 5) AND page_no <= doc_id % 5 + 3))"
_O = f"{_P}, o AS (SELECT *, doc_id % 50 AS batch, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id, page_no) AS ordinal FROM p)"
_LEAVES = "l AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS doc_id, r_name || '/' || n_name || '/s' || CAST(s_suppkey % 7 AS STRING) || '/f' || CAST(s_suppkey % 3 AS STRING) AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_FORMS = """
li AS (SELECT l_orderkey AS doc_id, 'p' || CAST(l_linenumber AS STRING) AS path, min(l_partkey) AS k FROM lineitem GROUP BY ALL),
b AS (SELECT doc_id, path, CAST(k % 10 AS STRING) AS v FROM li WHERE k % 29 <> 3),
a AS (SELECT doc_id, path, CASE WHEN k % 4 = 0 THEN 'new' WHEN k % 37 = 1 THEN 'odd' ELSE CAST(k % 10 AS STRING) END AS v FROM li WHERE k % 31 <> 5),
t AS (SELECT doc_id, path, 'new' AS v FROM li WHERE k % 4 = 0 AND k % 41 <> 0)"""
_AMOUNT = r"^[¥￥]?\s*([0-9][0-9,]*(\.[0-9]{1,2})?)$"

ORACLES = {
    "order_subset": "SELECT doc_id, doc_id % 3 = 0 AND len(string_split(text, chr(10))) >= 2 AS allowed FROM documents",
    "page_select": duck(f"WITH {_P} SELECT doc_id, page_no, n FROM p WHERE {_IN}", "f_doc_pages"),
    "page_remove": duck(f"WITH {_P}, q AS (SELECT *, count(*) FILTER (NOT {_IN}) OVER (PARTITION BY doc_id) = 0 AS rejected FROM p) SELECT doc_id, page_no, n, rejected FROM q WHERE NOT {_IN} OR rejected", "f_doc_pages"),
    "page_reorder": duck(f"WITH {_P}, s AS (SELECT * FROM (VALUES (1, 2, 90), (2, 1, 0), (3, 2, 270), (4, 3, 90)) v(pos, page_no, angle)) SELECT doc_id, pos, page_no, angle, n FROM p JOIN s USING (page_no)", "f_doc_pages"),
    "page_split": duck(
        f"WITH {_P}, s AS (SELECT * FROM (VALUES (1, 1, 2), (2, 5, 5), (3, 2, 3)) v(part_no, a, b)) SELECT doc_id, page_no, n, CAST(ceil(page_no / 4) AS BIGINT) AS part_no, 'every' AS how FROM p UNION ALL SELECT doc_id, page_no, n, part_no, 'ranges' AS how FROM p JOIN s ON page_no BETWEEN a AND b",
        "f_doc_pages",
    ),
    "page_number": duck(f"WITH {_P} SELECT doc_id, page_no, n, n_pages, CASE WHEN page_no >= 3 THEN page_no + 4 END AS number FROM p", "f_doc_pages"),
    "merge_order": duck(f"WITH {_O} SELECT batch, doc_id, page_no, ordinal FROM o", "f_doc_pages"),
    "imposition": duck(f"WITH {_O} SELECT batch, doc_id, page_no, (ordinal - 1) // 4 + 1 AS sheet, (ordinal - 1) % 4 AS slot, (ordinal - 1) % 2 AS col, ((ordinal - 1) % 4) // 2 AS row FROM o", "f_doc_pages"),
    "page_totals": duck("SELECT doc_id % 50 AS batch, count(*) AS n_pages, CAST(ceil(count(*) / 4) AS BIGINT) AS n_sheets, count(*) <= 100 AS allowed FROM f_doc_pages GROUP BY 1", "f_doc_pages"),
    "page_labels": duck(
        f"""WITH {_P} SELECT doc_id, page_no, CASE page_no % 5 WHEN 0 THEN CAST(page_no AS STRING) WHEN 1 THEN page_no || ' / ' || n_pages WHEN 2 THEN '第 ' || page_no || ' 页' WHEN 3 THEN '第 ' || page_no || ' 页 共 ' || n_pages || ' 页' END AS label,
  'doc{{page}}' || doc_id || '-' || page_no || '/' || n_pages || ' 2026 {{other}}2026-11-01' AS header, ((page_no * 90 - 450) % 360 + 360) % 360 AS angle FROM p""".replace("{{", "{").replace("}}", "}"),
        "f_doc_pages",
    ),
    "text_stats": r"SELECT doc_id, len(string_split(text, chr(10))) AS n_pages, length(text) AS n_chars, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS preview_md5, NOT regexp_matches(text, '[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]') AS xml_ok FROM documents",
    "image_objects": duck(
        """
WITH s AS (SELECT doc_id % 500 AS doc_id, CAST(x0 % 40 AS BIGINT) AS xref, page_no, CASE WHEN y0 % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext FROM f_spans),
f AS (SELECT doc_id, xref, min(struct_pack(p := page_no, e := ext)) AS m FROM s GROUP BY 1, 2),
q AS (SELECT doc_id, xref, m.p AS page_no, m.e AS ext, row_number() OVER (PARTITION BY doc_id ORDER BY m.p, xref) AS seq FROM f)
SELECT *, printf('p%03d_img%02d.%s', page_no, seq, ext) AS name FROM q WHERE seq <= 30""",
        "f_spans",
    ),
    "page_budget": "WITH s AS (SELECT o_orderkey, CAST(o_custkey * 3 % 6000 AS DOUBLE) AS w, CAST(o_orderkey % 6000 AS DOUBLE) AS h FROM orders) SELECT o_orderkey, o_orderkey % 9 <> 0 AND w > 0 AND h > 0 AND ceil(w * 150 / 72) <= 8192 AND ceil(h * 150 / 72) <= 8192 AND ceil(w * 150 / 72) * ceil(h * 150 / 72) <= 67108864 AS fits FROM s",
    "fixed_zones": f"""
WITH f AS ({_FIXED.format(lineitem="lineitem")}), t AS (SELECT *, {_FIXED_TEXT} AS text FROM f),
c AS (SELECT *, trim(regexp_replace(text, '^名称[：:]\\s*', '')) AS c, x < page_width / 2 AS buyer, replace(replace(text, '¥', ''), ' ', '') AS a FROM t),
m AS (SELECT *, CASE WHEN regexp_matches(a, '^-?[0-9]{{1,12}}([.][0-9]{{1,2}})?$') THEN a END AS amount, regexp_matches(text, '^[0-9A-HJ-NP-RT-UW-Y]{{15,20}}$') AS tax,
  length(c) >= 2 AND regexp_matches(c, '[一-鿿]') AND NOT regexp_matches(c, '{"|".join(I.NAME_EXCLUDE)}') AND y >= 26 AND y < 46 AS name FROM c),
n AS (SELECT doc_id, arg_min(text, pos) FILTER (regexp_matches(text, '^[0-9]{{20}}$')) AS invoice_number FROM m GROUP BY doc_id),
g AS (SELECT doc_id, any_value(invoice_number) AS invoice_number,
  try_cast(regexp_replace(arg_min(text, struct_pack(n := length(text), p := pos)) FILTER (k = 2), '^([0-9]+)年([0-9]+)月([0-9]+)日$', '\\1-\\2-\\3') AS DATE) AS issue_date,
  arg_max(c, struct_pack(n := length(text), x := -x, p := -pos)) FILTER (name AND buyer) AS buyer_name, arg_max(c, struct_pack(n := length(text), x := -x, p := -pos)) FILTER (name AND NOT buyer) AS seller_name,
  arg_min(text, struct_pack(x := x, p := pos)) FILTER (tax AND y >= 38 AND y < 60 AND buyer AND text IS DISTINCT FROM invoice_number) AS buyer_tax_id,
  arg_min(text, struct_pack(x := x, p := pos)) FILTER (tax AND y >= 38 AND y < 60 AND NOT buyer AND text IS DISTINCT FROM invoice_number) AS seller_tax_id,
  count(amount) FILTER (y >= 88 AND y < 98) AS k, arg_min(amount, struct_pack(x := x, p := pos)) FILTER (y >= 88 AND y < 98 AND amount IS NOT NULL) AS a1, arg_max(amount, struct_pack(x := x, p := pos)) FILTER (y >= 88 AND y < 98 AND amount IS NOT NULL) AS a2,
  arg_max(amount, struct_pack(x := x, p := -pos)) FILTER (y >= 96 AND y < 113 AND x >= page_width * 0.55 AND amount IS NOT NULL) AS total_with_tax,
  nullif(count(*) FILTER (y >= 55 AND y < 92 AND starts_with(text, '*')), 0) AS item_count, string_agg(text, '' ORDER BY pos) AS pool FROM m JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, invoice_number, CAST(issue_date AS STRING) AS issue_date, buyer_name, seller_name, buyer_tax_id, seller_tax_id, CASE WHEN k >= 2 THEN a1 END AS amount_without_tax, CASE WHEN k >= 2 THEN a2 END AS tax_amount, total_with_tax, item_count,
  CASE WHEN contains(pool, '电子发票（普通发票）') THEN '电子发票（普通发票）' WHEN contains(pool, '专用发票') THEN '电子发票（增值税专用发票）' END AS invoice_type, CASE WHEN invoice_number IS NULL AND total_with_tax IS NULL THEN 'unsupported' END AS reason FROM g""",
    "zone_fields": duck(
        f"""
WITH s AS (SELECT * REPLACE (CASE WHEN y0 BETWEEN 80 AND 107 THEN '名称：公司' || text WHEN y0 BETWEEN 150 AND 200 THEN '*' || text WHEN y0 > 320 THEN '备注 ' || text ELSE text END AS text) FROM f_spans),
z AS (SELECT *, (y0 + y1) / 2 AS m, CASE WHEN (x0 + x1) / 2 < 298 THEN 'buyer' ELSE 'seller' END AS side, regexp_replace(text, '^名称：', '') AS c, regexp_matches(text, '{_AMOUNT}') AS amt, regexp_extract(text, '[0-9]{{20}}') AS d FROM s),
i AS (SELECT *, starts_with(c, '公司') AS nm, regexp_matches(c, '^[0-9A-HJ-NP-RT-UW-Y]{{15,20}}$') AS tx FROM z)
SELECT * REPLACE (CASE WHEN length(split_part(amount_without_tax, '.', 1)) <= 12 THEN amount_without_tax END AS amount_without_tax, CASE WHEN length(split_part(tax_amount, '.', 1)) <= 12 THEN tax_amount END AS tax_amount, CASE WHEN length(split_part(total_with_tax, '.', 1)) <= 12 THEN total_with_tax END AS total_with_tax) FROM (
SELECT doc_id, page_no,
  arg_min(d, struct_pack(a := y0, b := x0, c := text)) FILTER (m >= 24 AND m < 64 AND x0 >= 400 AND d <> '') AS invoice_number,
  arg_max(c, struct_pack(w := x1 - x0, a := -y0, b := -x0, t := text)) FILTER (m >= 86 AND m < 114 AND nm AND side = 'buyer') AS buyer_name,
  arg_max(c, struct_pack(w := x1 - x0, a := -y0, b := -x0, t := text)) FILTER (m >= 86 AND m < 114 AND nm AND side = 'seller') AS seller_name,
  arg_min(c, struct_pack(a := y0, b := x0, c := text)) FILTER (m >= 114 AND m < 150 AND tx AND side = 'buyer') AS buyer_tax_id,
  arg_min(c, struct_pack(a := y0, b := x0, c := text)) FILTER (m >= 114 AND m < 150 AND tx AND side = 'seller') AS seller_tax_id,
  CASE WHEN count(*) FILTER (m >= 248 AND m < 272 AND amt) >= 2 THEN arg_min(text, struct_pack(b := x0, a := y0, t := text)) FILTER (m >= 248 AND m < 272 AND amt) END AS amount_without_tax,
  CASE WHEN count(*) FILTER (m >= 248 AND m < 272 AND amt) >= 2 THEN arg_max(text, struct_pack(b := x0, a := y0, t := text)) FILTER (m >= 248 AND m < 272 AND amt) END AS tax_amount,
  arg_max(text, struct_pack(b := x0, a := y0, t := text)) FILTER (m >= 272 AND m < 296 AND amt) AS total_with_tax,
  nullif(count(*) FILTER (m >= 150 AND m < 254 AND starts_with(text, '*')), 0) AS item_count,
  nullif(trim(string_agg(text, ' ' ORDER BY y0, x0, text) FILTER (m >= 296 AND m < 354 AND NOT amt)), '') AS remark
FROM i WHERE (m >= 24 AND m < 64 AND x0 >= 400) OR (m >= 86 AND m < 354) GROUP BY doc_id, page_no)""",
        "f_spans",
    ),
    "ref_resolve": f"""
WITH o AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS obj_id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) ELSE 't' || l_partkey END AS text FROM lineitem)
SELECT doc_id, CASE WHEN obj_id % 2 = 0 THEN 'even' ELSE 'odd' END AS field, string_agg(text, '' ORDER BY obj_id DESC) AS text, arg_min(text, obj_id) FILTER (regexp_matches(text, '{_AMOUNT}')) AS last_amount FROM o GROUP BY 1, 2""",
    "single_page_rule": duck(
        """
WITH c AS (SELECT doc_id, page_no, count(*) FILTER (length(text) = 20) AS n FROM f_spans GROUP BY 1, 2)
SELECT doc_id, CASE WHEN count(*) FILTER (n > 0) = 1 THEN min(page_no) FILTER (n > 0) END AS page_no,
  CASE WHEN count(*) FILTER (n > 0) > 1 THEN 'several:' || string_agg(page_no, ',' ORDER BY page_no) FILTER (n > 0) WHEN count(*) FILTER (n > 0) = 0 THEN 'no number on ' || min(page_no) END AS reason FROM c GROUP BY doc_id""",
        "f_spans",
    ),
    "sibling_index": "SELECT p_brand AS parent, p_type AS name, p_partkey AS pos, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) > 1 THEN p_type || '[' || (row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1) || ']' ELSE p_type END AS label FROM part",
    "suffixes": f"WITH {_LEAVES} SELECT doc_id, path, unnest(range(0, 4)) AS cut, unnest([path, array_to_string(string_split(path, '/')[2:], '/'), array_to_string(string_split(path, '/')[3:], '/'), string_split(path, '/')[4]]) AS suffix FROM l",
    "suffix_resolve": f"""
WITH {_LEAVES},
q AS (SELECT DISTINCT doc_id, 'root/' || array_to_string(string_split(path, '/')[3:], '/') || '/Yes' AS key FROM l UNION SELECT DISTINCT doc_id, 'x/' || string_split(path, '/')[4] FROM l),
v AS (SELECT doc_id, key, regexp_replace(key, '/(Yes|No)$', '') AS k FROM q),
s AS (SELECT doc_id, key, unnest(range(0, len(string_split(k, '/')))) AS cut, k FROM v),
x AS (SELECT s.doc_id, s.key, s.cut, count(l.path) AS n, min(l.path) AS path FROM s LEFT JOIN l ON l.doc_id = s.doc_id AND (l.path = array_to_string(string_split(s.k, '/')[s.cut + 1:], '/') OR ends_with(l.path, '/' || array_to_string(string_split(s.k, '/')[s.cut + 1:], '/'))) GROUP BY s.doc_id, s.key, s.cut),
g AS (SELECT doc_id, key, arg_min(path, cut) FILTER (n = 1) AS path, max(n) AS most FROM x GROUP BY 1, 2),
t AS (SELECT *, count(path) OVER (PARTITION BY doc_id, path) AS shared FROM g)
SELECT doc_id, key, CASE WHEN shared = 1 THEN path END AS path, CASE WHEN path IS NULL THEN CASE WHEN most > 1 THEN 'ambiguous' ELSE 'none' END WHEN shared > 1 THEN 'taken' END AS reason FROM t""",
    "change_audit": f"""
WITH {_FORMS}
SELECT doc_id, bool_and((b.v IS NOT NULL) = (a.v IS NOT NULL)) AS same_leaves, bool_and(coalesce(a.v, '') = coalesce(b.v, '') OR t.v IS NOT NULL) AS only_targets, bool_and(t.v IS NULL OR (a.v IS NOT NULL AND a.v = t.v)) AS all_set
FROM b FULL JOIN a USING (doc_id, path) FULL JOIN t USING (doc_id, path) GROUP BY doc_id""",
    "leaf_diff": f"WITH {_FORMS} SELECT doc_id, path, 'before' AS side FROM (SELECT doc_id, path FROM b EXCEPT ALL SELECT doc_id, path FROM a) UNION ALL SELECT doc_id, path, 'after' FROM (SELECT doc_id, path FROM a EXCEPT ALL SELECT doc_id, path FROM b)",
}
