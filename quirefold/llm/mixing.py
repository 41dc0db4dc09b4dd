"""Mixing sources to target weights by pivotal dependent rounding (operator 9), in native expressions.

A source's target divided by its size is the expected number of copies of each of its documents. The whole part is
taken as it is. Fractions are rounded by the pivotal method: two fractions meet, mass moves from one to the other at
random until one is integral, the other goes on. Blocks of about BLOCK documents of one source are folded each in one
task, from the largest document to the smallest, so that documents of like size exchange mass; the one fraction that a
block has left goes to the next level of the tree, where blocks of blocks meet, up to one block a source.

Rows that repeat id, source and text are one unit of m rows: of m equal fractions p, m * p are taken, the whole part of
that at once and the rest as one fraction. So a row that holds a third of all is one row here, and neither its block nor
any array grows with it.

Defined results: null text has size 0, a null source is a source of its own and sorts last; documents of size 0 take 0
words; an empty table gives no rows; repeated rows are documents of their own; other columns are not read. Random
numbers are hashes of the row and a seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
CEILING = 3
BLOCK = 256
SEED = 20_25
_NEAR = 1e-9
#: Rows that one array stands for where a unit's rows are given out again.
_ROWS = 1 << 16


def sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, mark): words of each text, and a hash of the text that tells rows of one id apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(t, F.lit(C.WORD)).cast("bigint").alias("size"), F.xxhash64(F.col(text)).alias("mark"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, n_docs, target): one row a source, from rows of sizes() or from units with a column n_rows. The
    water level is found by aggregates over the sources: a source whose share is above its ceiling leaves, and the rest
    share what it could not take. The sources are ranked in one task, a row each."""
    times = F.col("n_rows") if "n_rows" in sized.columns else F.lit(1)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = sized.groupBy("source").agg(F.sum(F.col("size") * times).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1))
    weighed = C.written(by_source.select("*", weight.alias("weight"), (F.col("source_size") * float(ceiling)).alias("most")), "sources")
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * level >= F.col("most")
        r = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("taken"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(over).alias("full")).first()
        if not r["all"] or r["full"] == full:
            break
        full, level = r["full"], ((r["all"] - r["taken"]) / r["weight"] if r["weight"] else level)
    return weighed.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, F.col("most")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _pivot(units: Column) -> Column:
    """Folds units (p, r, ...) in order: (done: array<struct<at, take>>, at, p); at is the place of the unit that is left."""
    start = F.struct(F.array().cast("array<struct<at:int,take:int>>").alias("done"), F.lit(0).alias("at"), F.get(units, 0)["p"].alias("p"))

    def step(acc: Column, i: Column) -> Column:
        p, q, r = acc["p"], F.get(units, i)["p"], F.get(units, i)["r"]
        s = p + q
        low = s < 1
        # below 1 one of the two drops to 0 and the other goes on with s; else one is taken and the other goes on with s - 1
        first_done = F.when(low, r < q / s).otherwise(r < (1 - q) / (2 - s))
        done = F.struct(F.when(first_done, acc["at"]).otherwise(i).alias("at"), F.when(low, 0).otherwise(1).alias("take"))
        return F.struct(F.concat(acc["done"], F.array(done)).alias("done"), F.when(first_done, i).otherwise(acc["at"]).alias("at"), F.when(low, s).otherwise(s - 1).alias("p"))

    rest = F.when(F.size(units) > 1, F.sequence(F.lit(1), F.size(units) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, start, step)


def round_copies(units: DataFrame, seed: int = SEED) -> DataFrame:
    """units (doc_id, source, mark, size, n, p), n: units of the source; p strictly between 0 and 1. Adds take: 0 or 1."""
    columns = ["doc_id", "source", "mark", "size", "n"]
    results, level = [], 0
    blocks = F.ceil(F.col("n") / BLOCK)
    while True:
        blocked = units.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed + level)), F.col("blocks")))
        unit = F.struct((-F.col("size")).alias("k"), F.col("doc_id").alias("doc_id"), "mark", "size", "n", "p", _uniform(F.col("doc_id"), F.col("mark"), F.lit(seed - 1 - level)).alias("r"))
        folded = (
            blocked.groupBy("source", "blocks", "block")
            .agg(F.array_sort(F.collect_list(unit)).alias("units"))
            .withColumn("left", _pivot(F.col("units")))
            .withColumn("sure", F.map_from_entries("left.done"))
            .select("source", "blocks", "left.at", "left.p", "sure", F.posexplode("units").alias("i", "u"))
            .select(
                "source", "blocks", "u.doc_id", "u.mark", "u.size", "u.n", "u.r",
                F.when(F.col("i") == F.col("at"), F.col("p")).otherwise(F.element_at("sure", F.col("i")).cast("double")).alias("p"),
                (F.col("i") == F.col("at")).alias("is_left"),
            )
        )
        folded = C.written(folded, f"rounded-{level}")
        whole = (F.col("p") <= _NEAR) | (F.col("p") >= 1 - _NEAR)
        last = F.col("blocks") == 1
        settled = ~F.col("is_left") | whole | last
        results.append(folded.where(settled).select(*columns, F.when(~F.col("is_left") | whole, F.round("p")).otherwise((F.col("r") < F.col("p")).cast("int")).cast("int").alias("take")))
        units = folded.where(~settled).select(*columns, "p", "blocks")
        most = units.agg(F.max("blocks").alias("m")).first()["m"]
        if not most:
            break
        level += 1
        units, blocks = units.drop("n").withColumnRenamed("blocks", "n"), F.ceil(F.col("n") / BLOCK)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """(doc_id, source, mark, size, source_size, target, copies) for each row of sizes()."""
    units = C.written(sized.groupBy("doc_id", "source", "mark", "size").agg(F.count(F.lit(1)).alias("n_rows")), "sizes")
    goal = C.written(targets(units, weights, ceiling), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))).otherwise(F.lit(0.0))
    whole = F.floor(rate + _NEAR).cast("int")
    g = goal.select(F.col("source").alias("g"), "n_docs", "source_size", "target", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("share"))
    mass = F.when(F.col("size") > 0, F.col("n_rows") * F.col("share")).otherwise(F.lit(0.0))
    joined = units.join(g, F.col("source").eqNullSafe(F.col("g"))).withColumn("sure", F.floor(mass + _NEAR)).withColumn("p", F.greatest(mass - F.col("sure"), F.lit(0.0))).drop("g")
    rounded = round_copies(joined.where(F.col("p") > _NEAR).select("doc_id", "source", "mark", "size", F.col("n_docs").alias("n"), "p"), seed)
    taken = rounded.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("mark").alias("m"), "take")
    same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & F.col("mark").eqNullSafe(F.col("m"))
    more = F.col("sure") + F.coalesce("take", F.lit(0))  # rows of the unit that are taken once more
    kinds = F.array(F.struct((F.col("whole") + 1).alias("copies"), more.alias("k")), F.struct(F.col("whole").alias("copies"), (F.col("n_rows") - more).alias("k")))
    out = joined.join(taken, same, "left").select("doc_id", "source", "mark", "size", "source_size", "target", F.explode(F.filter(kinds, lambda x: x["k"] > 0)).alias("x"))
    many = F.sequence(F.lit(0), F.floor((F.col("x.k") - 1) / _ROWS))
    out = out.withColumn("part", F.explode(many)).withColumn("one", F.explode(F.sequence(F.lit(1), F.least(F.lit(_ROWS), F.col("x.k") - F.col("part") * _ROWS))))
    return out.select("doc_id", "source", "mark", "size", "source_size", "target", "x.copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The documents' rows, each as often as it has copies. Rows that repeat both id and text are one document here, whose
    size is that of all of them, and share their number of copies."""
    columns = docs.columns
    sized = sizes(docs).groupBy("doc_id", "mark").agg(F.min("source").alias("source"), F.sum("size").alias("size"))
    copies = mix(sized, weights).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("copies").alias("__copies")).where("__copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark"))
    return docs.join(copies, same).select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select(*columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(sizes(C.table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
