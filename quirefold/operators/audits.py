"""Audits of archives, batches, uploads, files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_BYTES, MOST_RATIO, RATIO_FROM = 5_000, 200 << 20, 100, 4_096
MOST_FILES, MOST_FILE, MOST_BATCH, MOST_TICKETS, MOST_LEDGER = 50, 10 << 20, 100 << 20, 200, 50_000
# fixed values: extensions by operation
EXTENSIONS = {"merge": (".pdf", ".ofd"), "extract": (".xml", ".ofd", ".pdf"), "rename": (".xml", ".ofd", ".pdf")}


def zip_audit(entries: DataFrame, archive: str = "archive_id") -> DataFrame:
    """(archive, n_entries, n_bytes, reason): the first rule that an archive breaks. An archive without entries is a row
    whose entry is null. actual_size, where there is such a column, must not exceed what is declared."""
    path = F.replace(F.col("entry"), F.lit("\\"), F.lit("/"))
    unsafe = F.startswith(path, F.lit("/")) | (F.substring(path, 2, 1) == ":")
    up = F.array_contains(F.split(path, "/"), "..")
    ratio = (F.col("file_size") >= RATIO_FROM) & (F.col("compress_size") > 0) & (F.col("file_size") > F.col("compress_size") * MOST_RATIO)
    forged = F.col("actual_size") > F.col("file_size") if "actual_size" in entries.columns else F.lit(False)
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = entries.groupBy(archive).agg(
        F.count("entry").alias("n_entries"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"), yes(F.col("flag_bits") % 2 == 1).alias("locked"), yes(ratio).alias("bomb"), yes(unsafe).alias("absolute"), yes(up).alias("up"), yes(forged).alias("forged")
    )
    reason = F.when(F.col("n_entries") == 0, "empty").when(F.col("locked"), "encrypted").when(F.col("n_entries") > MOST_ENTRIES, "entries").when(F.col("n_bytes") > MOST_BYTES, "bytes").when(F.col("bomb"), "ratio").when(F.col("absolute"), "absolute").when(F.col("up"), "traversal").when(F.col("forged"), "forged")
    return g.select(archive, "n_entries", "n_bytes", reason.alias("reason"))


def batch_quota(files: DataFrame, batch: str, size: str = "size") -> DataFrame:
    """(batch, n_files, n_bytes, largest, reason)"""
    g = files.groupBy(batch).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("n_bytes"), F.max(size).alias("largest"))
    return g.withColumn("reason", F.when(F.col("n_files") > MOST_FILES, "files").when(F.col("largest") > MOST_FILE, "file_size").when(F.col("n_bytes") > MOST_BATCH, "batch_size"))


def count_quota(rows: DataFrame, batch: str, most: int, name: str) -> DataFrame:
    """Batches with more rows than allowed: tickets and ledgers."""
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.when(F.col("n") > most, F.lit(name)))


def op_allowed(files: DataFrame, op: str = "op", ext: str = "ext") -> DataFrame:
    """Adds reason: null if the operation takes files of this extension; XML has a reason of its own for merging."""
    table = F.create_map(*(x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    ok = F.coalesce(F.array_contains(F.element_at(table, F.col(op)), F.col(ext)), F.lit(False))
    return files.withColumn("reason", F.when(~ok, F.when(F.col(ext) == ".xml", F.lit("xml_not_merged")).otherwise(F.lit("extension"))))


def upload_state(parts: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, n_parts, repeated, missing, complete) of piecewise uploads: indexes 0 to total - 1, each once."""
    g = parts.groupBy(task).agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n_parts"), F.collect_set(F.col("idx").cast("int")).alias("got"))
    missing = F.array_except(F.sequence(F.lit(0), F.col("total").cast("int") - 1), F.col("got"))
    return g.select(task, "n_parts", (F.col("n_parts") > F.size("got")).alias("repeated"), F.array_join(F.transform(F.sort_array(missing), lambda x: x.cast("string")), ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


def pick_artifact(files: DataFrame, task: str, name: str, priority: list[str], suffixes: tuple[str, ...] = (".pdf", ".zip"), inputs: str = "input") -> DataFrame:
    """(task, name): the first of the names in order of priority, else the first other pdf or zip that isn't an input."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(name))
    other = F.lower(F.col(name)).rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$") & ~F.startswith(F.col(name), F.lit(inputs))
    order = F.when(rank > 0, rank).when(other, F.lit(len(priority) + 1))
    return files.where(order.isNotNull()).groupBy(task).agg(F.min_by(name, F.struct(order, F.col(name))).alias(name))


def restore(manifests: DataFrame, files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """manifests (batch, manifest JSON {files:[{name,stored}], include_seller}); files (batch, stored). A batch is restored
    only if all its files are still there: (batch, n_files, n_found, include_seller, restorable)."""
    m = manifests.select(batch, F.from_json("manifest", "files array<struct<name:string,stored:string>>, include_seller boolean").alias("m"))
    e = m.select(batch, F.coalesce("m.include_seller", F.lit(False)).alias("include_seller"), F.explode_outer("m.files").alias("f"))
    have = files.select(F.col(batch).alias("__b"), F.col("stored").alias("__s")).distinct()
    j = e.join(have, (F.col(batch) == F.col("__b")) & (F.col("f.stored") == F.col("__s")), "left")
    g = j.groupBy(batch).agg(F.count("f").alias("n_files"), F.count("__s").alias("n_found"), F.bool_or("include_seller").alias("include_seller"))
    return g.withColumn("restorable", (F.col("n_files") > 0) & (F.col("n_files") == F.col("n_found")))


def missing_files(wanted: DataFrame, files: DataFrame, on: list[str]) -> DataFrame:
    """What is referred to and not there; empty if all is."""
    return wanted.join(files.select(*on).distinct(), on, "left_anti")


def text_layers(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_pages, n_chars, image_pages, has_text, too_short): pages of less than 5 characters are images, one of more
    than 50 makes a text layer, and less than 50 in all are too few to read."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    g = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(n).alias("n_chars"), F.count_if(n < 5).alias("image_pages"), F.bool_or(n > 50).alias("has_text"))
    return g.withColumn("too_short", F.col("n_chars") < 50)


def ocr_admission(docs: DataFrame, most_bytes: int = 20 << 20, most_pages: int = 10, least_side: int = 200, least_sharpness: float = 100.0) -> DataFrame:
    """docs (size, is_image, width, height, sharpness, encrypted, n_pages, has_text): adds admitted and note."""
    image = F.coalesce("is_image", F.lit(False))
    refused = F.when(F.col("size") > most_bytes, "size").when(image & ((F.col("width") < least_side) | (F.col("height") < least_side)), "resolution").when(~image & F.col("encrypted"), "encrypted").when(~image & (F.col("n_pages") > most_pages), "pages")
    note = F.coalesce(refused, F.when(image & (F.col("sharpness") < least_sharpness), "blurry").when(~image & F.col("has_text"), "has_text_layer"), F.lit(""))
    return docs.withColumn("admitted", refused.isNull()).withColumn("note", note)


def latest(df: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """The row of each group with the largest order."""
    return df.groupBy(group).agg(F.max_by(F.struct(order, *columns), F.col(order)).alias("r")).select(group, "r.*")


def first_rows(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group: n is what is asked for."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("nth") <= n)
