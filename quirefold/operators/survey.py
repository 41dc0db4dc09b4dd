"""Survey responses: rules, bots, one response a client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a choice may be
FEATURES = ("发票合并打印", "OFD 转 PDF / OFD 在线查看", "发票提取 Excel", "发票重命名 / 查重", "PDF 合并 / 分割 / 压缩", "PDF 转 Word", "文档转 Markdown", "其他")
SOURCES = ("百度搜索", "Bing 或其他搜索引擎", "小红书", "朋友或同事推荐", "AI 工具推荐", "微信群 / 社群", "其他")
FREQUENCIES = ("这是第一次使用", "偶尔使用，几个月一次", "每月几次", "每周几次", "几乎每天使用")
PRICING = ("希望一直完全免费", "按次购买大额任务包", "19.9 元终身买断基础 Pro", "按月或按年订阅", "要看具体功能再决定")
PRICES = ("不考虑付费", "9.9 元以内", "19.9 元", "29.9～39.9 元", "50 元及以上", "不确定")
OUTCOMES = ("一次就成功，结果符合预期", "成功了，但操作过程有些复杂", "部分成功，结果有需要改进的地方", "没有成功")
SCENARIOS = ("个人报销或日常办公", "企业财务 / 会计人员", "行政、人事或综合管理", "开发者 / AI 文档处理", "学生或科研学习", "自由职业 / 个体经营", "其他")
PATHS = ("/invoice-merge/result", "/ofd-to-pdf/result", "/merge-pdf/result")
VERSIONS = ("v1",)
DOMAINS = {
    "frequency": FREQUENCIES, "source": SOURCES, "pricing_model": PRICING, "price_range": PRICES, "task_outcome": OUTCOMES,
    "usage_scenario": SCENARIOS, "page_path": PATHS, "schema_version": VERSIONS,
}
#: Choices that may be left out, and what stands for them then.
DEFAULTS = {"schema_version": "v1"}
LENGTHS = {"feature_request": 500, "issue_description": 500, "contact": 100, "feature_other": 100, "source_other": 100, "scenario_other": 100, "website": 200}
CLIENT = "^[A-Za-z0-9-]{32,64}$"
LEAST_MS, MOST_MS = 3_000, 86_400_000


def stripped(df: DataFrame) -> DataFrame:
    """Texts that people write, and the features, without white space at their ends: before any rule looks at them."""
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    texts = {c: strip(F.col(c)) for c in (*LENGTHS, "client_id") if c in df.columns}
    if "features" in df.columns:
        texts["features"] = F.transform("features", strip)
    return df.withColumns(texts) if texts else df


def violations(df: DataFrame, domains: dict[str, tuple[str, ...]] | None = None, features: tuple[str, ...] = FEATURES, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds rules: the names of the rules that a response breaks, of those whose columns it has. extra: columns that are
    not part of a response; a value there breaks the rule that nothing else is sent."""
    rules = []
    if "client_id" in df.columns:
        rules.append(F.when(~F.coalesce("client_id", F.lit("")).rlike(CLIENT), F.lit("client_id")))
    for c, values in (DOMAINS if domains is None else domains).items():
        if c in df.columns:
            given = F.coalesce(F.col(c), F.lit(DEFAULTS[c])) if c in DEFAULTS else F.col(c)
            rules.append(F.when(~F.coalesce(given.isin(*values), F.lit(False)), F.lit(c)))
    for c, n in LENGTHS.items():
        if c in df.columns:
            rules.append(F.when(F.length(c) > n, F.lit(c)))
    if "elapsed_ms" in df.columns:
        rules.append(F.when(~F.coalesce(F.col("elapsed_ms").between(0, MOST_MS), F.lit(False)), F.lit("elapsed_ms")))
    if "features" in df.columns:
        f = F.coalesce("features", F.array().cast("array<string>"))
        rules.append(F.when((F.size(f) == 0) | (F.size(F.array_distinct(f)) != F.size(f)) | (F.size(F.array_except(f, F.array(*map(F.lit, features)))) > 0), F.lit("features")))
    rules += [F.when(F.col(c).isNotNull(), F.lit(f"extra:{c}")) for c in extra]
    return df.withColumn("rules", F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>"))


def is_bot() -> Column:
    return (F.coalesce("website", F.lit("")) != "") | (F.col("elapsed_ms") < LEAST_MS)


def judged(df: DataFrame, domains: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Adds rules and verdict: rejected, bot (dropped without a word to the sender) or valid."""
    v = violations(df, domains)
    return v.withColumn("verdict", F.when(F.size("rules") > 0, "rejected").when(is_bot(), "bot").otherwise("valid"))


def new_clients(batch: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """The first response of each client that the table doesn't have."""
    first = batch.withColumn("__n", F.row_number().over(Window.partitionBy("client_id").orderBy(order))).where("__n = 1").drop("__n")
    return first.join(known.select("client_id"), "client_id", "left_anti")
