"""Scans of files by content and of logs, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

# fixed values: first bytes by extension
_ZIP = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
_OLE = (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",)
MAGIC = {
    ".pdf": (b"%PDF-",), ".ofd": _ZIP, ".zip": _ZIP, ".docx": _ZIP, ".pptx": _ZIP, ".xlsx": _ZIP, ".doc": _OLE, ".ppt": _OLE,
    ".xls": _OLE, ".png": (b"\x89PNG\r\n\x1a\n",), ".jpg": (b"\xff\xd8\xff",), ".jpeg": (b"\xff\xd8\xff",), ".webp": (b"RIFF",), ".xml": (b"<",),
}
LOOSE = (".caj", ".kdh", ".hn")
# fixed values: kinds by first bytes, in order of test
KINDS = (
    ("pdf", b"%PDF"), ("c8", b"\xc8"), ("c8", b"C8"), ("kdh", b"KDH"), ("hn", b"HN"), ("caj", b"CAJ"), ("zip", b"PK\x03\x04"),
    ("png", b"\x89PNG"), ("jpeg", b"\xff\xd8\xff"),
)


def _starts(content: Column, head: bytes, at: int = 1) -> Column:
    return F.substring(content, at, len(head)) == F.lit(head)


def sniff(content: Column) -> Column:
    """The kind that the first bytes tell; `unknown` if none."""
    out = None
    for kind, head in KINDS:
        out = F.when(_starts(content, head), kind) if out is None else out.when(_starts(content, head), kind)
    return out.otherwise("unknown")


def head_agrees(ext: Column, content: Column) -> Column:
    """Whether the first bytes are those of the extension. An XML text may begin with a byte order mark and white space;
    a WEBP has its name at byte 9."""
    agrees = F.lit(False)
    for e, heads in MAGIC.items():
        body = F.encode(F.regexp_replace(F.decode(F.substring(content, 1, 64), "iso-8859-1"), "^[\\u00ef\\u00bb\\u00bf \\t\\r\\n]+", ""), "iso-8859-1") if e == ".xml" else content
        one = F.lit(False)
        for head in heads:
            one = one | _starts(body, head)
        agrees = agrees | ((ext == e) & (one & _starts(content, b"WEBP", 9) if e == ".webp" else one))
    # this family has several kinds, some of which tell themselves within the first 20 bytes
    near = F.decode(F.substring(content, 1, 20), "iso-8859-1")
    loose = _starts(content, b"%PDF") | _starts(content, b"\xc8") | _starts(content, b"KDH") | F.contains(near, F.lit("CAJ")) | F.contains(near, F.lit("HN"))
    return agrees | (ext.isin(*LOOSE) & loose)


def admitted(files: DataFrame, extensions: tuple[str, ...], max_size: int) -> DataFrame:
    """files (path, length, content): (path, length, ext, kind, reason, content) with the reason why one isn't admitted,
    null if it is; content is given on for admitted files only."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    reason = F.when(~ext.isin(*extensions), "extension").when(F.col("length") > max_size, "size").when(ext.isin(*MAGIC, *LOOSE) & ~head_agrees(ext, F.col("content")), "content")
    rows = files.select("path", "length", ext.alias("ext"), sniff(F.col("content")).alias("kind"), reason.alias("reason"), "content")
    return rows.withColumn("content", F.when(F.col("reason").isNull(), F.col("content")))


def scan_files(spark: SparkSession, path: str, extensions: tuple[str, ...], max_size: int) -> DataFrame:
    """As admitted, of the files below a folder. The size is tested on the listing. Spark lists no empty files."""
    return admitted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), extensions, max_size)


# -- heads of files, contents of admitted ones only --------------------------------------------------------------------

#: Bytes that are read of a file before it is admitted, and files to a task.
HEAD, TAIL, FILES = 64, 4096, 500


def _file_system(path: str):
    """The file system of a path and the path there: local files and the stores that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Heads(DataSource):
    """Batch source of (path, length, head, tail), in parts of FILES files; a file's middle is not read."""

    @classmethod
    def name(cls) -> str:
        return "quirefold_heads"

    def schema(self) -> str:
        return "path string, length bigint, head binary, tail binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadsReader(self.options["path"])


class _HeadsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        system, root = _file_system(self.path)
        found = sorted((f.path, f.size) for f in system.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File)
        return [InputPartition(found[k : k + FILES]) for k in range(0, len(found), FILES)] or [InputPartition([])]

    def read(self, partition: InputPartition):
        import pyarrow as pa

        system, _ = _file_system(self.path)
        rows = []
        for path, size in partition.value:
            with system.open_input_file(path) as f:
                head = f.read(HEAD)
                f.seek(max(0, size - TAIL))
                rows.append((path, size, head, f.read(TAIL)))
        kinds = pa.string(), pa.int64(), pa.binary(), pa.binary()
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "length", "head", "tail"])


def scan_heads(spark: SparkSession, path: str, extensions: tuple[str, ...], max_size: int) -> DataFrame:
    """As scan_files, empty files too, but for content: (path, length, ext, kind, reason), judged by listing and head. A file
    of any size costs HEAD + TAIL bytes; an XML text with an entity in either is refused (dtd)."""
    spark.dataSource.register(_Heads)
    rows = spark.read.format("quirefold_heads").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    odd = F.coalesce((ext == ".xml") & (has_dtd(F.col("head")) | has_dtd(F.col("tail"))), F.lit(False))
    reason = F.when(~ext.isin(*extensions), "extension").when(F.col("length") > max_size, "size").when(ext.isin(*MAGIC, *LOOSE) & ~head_agrees(ext, F.col("head")), "content").when(odd, "dtd")
    return rows.select("path", "length", ext.alias("ext"), sniff(F.col("head")).alias("kind"), reason.alias("reason"))


def with_contents(scanned: DataFrame, root: str) -> DataFrame:
    """Adds content, which is read for admitted files only; those of a task are read one after another."""

    def run(batches):
        import pyarrow as pa

        system, _ = _file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                content = None
                if row["reason"] is None:
                    with system.open_input_stream(row["path"]) as f:
                        content = f.read()
                columns = [pa.array([row[c]], t) for c, t in zip(batch.schema.names, batch.schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([content], pa.binary())], [*batch.schema.names, "content"])

    return scanned.mapInArrow(run, StructType([*scanned.schema.fields, StructField("content", BinaryType())]))


def write_files(files: DataFrame, root: str) -> None:
    """files (path, content) below a folder, each task its own."""

    def run(batches):
        import pyarrow as pa

        system, base = _file_system(root)
        for batch in batches:
            for row in batch.to_pylist():
                place = f"{base}/{row['path']}"
                system.create_dir(place.rsplit("/", 1)[0])
                with system.open_output_stream(place) as f:
                    f.write(row["content"] or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    files.select("path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def has_dtd(content: Column) -> Column:
    """A document type or entity near the start, or an entity near the end: tested before any parser sees the text."""
    head = F.substring(content, 1, 4096).cast("string")
    tail = F.substring(content, -4096, 4096).cast("string")
    return F.contains(head, F.lit("<!DOCTYPE")) | F.contains(head, F.lit("<!ENTITY")) | F.contains(tail, F.lit("<!ENTITY"))


# fixed values: fields of an invoice and the tags that hold them, in order of preference
TAGS = {
    "invoice_number": ("InvoiceNumber", "EIid"),
    "issue_date": ("IssueTime",),
    "invoice_type": ("LabelName",),
    "buyer_name": ("BuyerName",),
    "seller_name": ("SellerName",),
    "buyer_tax_id": ("BuyerIdNum",),
    "seller_tax_id": ("SellerIdNum",),
    "amount_without_tax": ("TotalAmWithoutTax",),
    "tax_amount": ("TotalTaxAm",),
    "total_with_tax": ("TotalTax-includedAmount",),
    "drawer": ("Drawer",),
    "remark": ("Remark",),
}


def scan_invoice_xml(files: DataFrame, content: str = "content", name: str = "path") -> DataFrame:
    """One record a file: the first text of each tag anywhere in the tree, the number of items, and the reason why there is
    no record (dtd, malformed, root). Texts are looked at only after the tests, as the parsers expand entities and raise."""
    from ..functions.invoices import clean_amount_keep, normalize_date

    text = F.col(content).cast("string")
    safe = F.when(~has_dtd(F.col(content)), text)
    parsed = F.from_xml(safe, "Header STRING, EInvoiceData STRING, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = files.select(F.col(name).alias("source_file"), safe.alias("x"), parsed["_corrupt"].isNull().alias("sound"), (safe.isNotNull() & safe.rlike(r"(?s)^(﻿)?\s*(<\?.*?\?>)?\s*(<!--.*?-->\s*)*<EInvoice[\s>]")).alias("rooted"))
    reason = F.when(F.col("x").isNull(), "dtd").when(~F.col("sound"), "malformed").when(~F.col("rooted"), "root")
    rows = rows.withColumn("reason", reason).withColumn("x", F.when(F.col("reason").isNull(), F.col("x")))

    # one expression a file, as each call parses the text anew; no XML text can hold the separator
    tags = sorted({t for group in TAGS.values() for t in group})
    texts = ", '\x01', ".join([*(f"(//{t}[normalize-space()])[1]" for t in tags), "count(//IssuItemInformation)"])
    rows = rows.withColumn("found", F.split(F.call_function("xpath_string", F.col("x"), F.lit(f"concat({texts})")), "\x01"))

    def first(group: tuple[str, ...]) -> Column:
        found = [F.trim(F.get("found", F.lit(tags.index(t)))) for t in group]
        return F.coalesce(*(F.when(v != "", v) for v in found))

    fields = {k: first(t) for k, t in TAGS.items()}
    fields["issue_date"] = normalize_date(fields["issue_date"])
    for k in ("amount_without_tax", "tax_amount", "total_with_tax"):
        fields[k] = clean_amount_keep(fields[k])
    items = F.get("found", F.lit(len(tags))).cast("int")
    return rows.select("source_file", *(v.alias(k) for k, v in fields.items()), F.when(items > 0, items).alias("item_count"), "reason")


# fixed values: log lines of failed tasks and failed requests
TASK_LINE = r"\btask\s+([0-9a-f]{8}-[0-9a-f-]{27})\s+(?:rejected/)?failed:\s*(.*)"
REQUEST_LINE = r"Request failed request_id=([0-9a-f]+) method=(\S+) path=(\S+) status=([0-9]+)"


def failures(lines: DataFrame, day: str | None = None) -> DataFrame:
    """lines (value): (time, task_id, message, request_id, method, path, status) of the lines of a day, or of all days, that
    tell of a failure; the time is null where it cannot be read."""
    lines = lines.where(F.startswith("value", F.lit(day))) if day else lines
    part = lambda p, k: F.nullif(F.regexp_extract("value", p, k), F.lit(""))
    time = F.call_function("try_to_timestamp", F.replace(F.substring("value", 1, 23), F.lit(","), F.lit(".")), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    requests = (part(REQUEST_LINE, k + 1).alias(c) for k, c in enumerate(("request_id", "method", "path", "status")))
    rows = lines.select(time.alias("time"), part(TASK_LINE, 1).alias("task_id"), part(TASK_LINE, 2).alias("message"), *requests)
    return rows.withColumn("status", F.col("status").cast("int")).where("task_id IS NOT NULL OR request_id IS NOT NULL")


def scan_logs(spark: SparkSession, paths: list[str], day: str | None = None) -> DataFrame:
    """The failures that text files tell of."""
    return failures(spark.read.text(paths), day)


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """How listings are given out: requests by time, tasks by id. Sorted by ranges."""
    return rows.orderBy(*order)


# fixed values: columns of the exported ledger
HEADERS = {
    "source_file": "来源文件", "invoice_type": "票种", "invoice_number": "发票号码", "issue_date": "开票日期", "buyer_name": "购买方名称", "buyer_tax_id": "购买方税号", "seller_name": "销售方名称",
    "seller_tax_id": "销售方税号", "amount_without_tax": "不含税金额", "tax_amount": "税额", "total_with_tax": "价税合计", "drawer": "开票人", "remark": "备注", "warnings": "提示",
}


def write_ledger_csv(records: DataFrame, path: str) -> None:
    """Fourteen columns in order, cells that no spreadsheet takes for formulas, warnings joined; a byte order mark first."""
    from ..functions.text import sanitize_cell

    def cell(c: str) -> Column:
        if c not in records.columns:
            return F.lit(None).cast("string")
        value = F.array_join(c, "；") if records.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
        return F.coalesce(sanitize_cell(value), F.lit(""))

    out = records.select(*(cell(c).alias(("﻿" if k == 0 else "") + h) for k, (c, h) in enumerate(HEADERS.items())))
    out.write.option("header", True).option("quoteAll", True).option("emptyValue", "").mode("overwrite").csv(path)


def write_survey_csv(responses: DataFrame, path: str, order: str = "submitted_at", lists: tuple[str, ...] = ("features",)) -> None:
    """All columns, JSON lists as text joined by 、, by time: ordered by ranges, so files follow one another."""
    out = responses.select(*(F.array_join(F.from_json(c, "array<string>"), "、").alias(c) if c in lists else F.col(c) for c in responses.columns))
    out.orderBy(order).write.option("header", True).mode("overwrite").csv(path)


def write_daily(summary: DataFrame, path: str, day: str = "day") -> None:
    """A folder of JSON for each day; days that are written again are replaced, others stay."""
    summary.write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)
