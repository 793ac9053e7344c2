"""Table contracts: columns and types, key, and row rules; typed scans built from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text
from tidemark.operators import checks
from tidemark.operators.checks import RowRule


@dataclass(frozen=True)
class Contract:
    ddl: str
    key: tuple[str, ...]
    rules: tuple[RowRule, ...] = ()
    codes: tuple[str, ...] = ()
    optional: tuple[str, ...] = field(default=())

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


def _contracts() -> dict[str, Contract]:
    """Built on use, since rules are column expressions and need a running session."""
    code = checks.pattern("symbol", r"\d{6,}")
    published = checks.ordered_dates("period_end", "publication_date")
    sha = RowRule("content_sha256_pattern", F.coalesce("content_sha256", F.lit("")).rlike("^([0-9a-f]{64})?$"))
    units = {  # Fixed values: unit of each fund fact.
        "fund_shares": "shares", "distributable_amount_quarter": "RMB",
        "distributable_amount_per_unit_quarter": "RMB_per_unit", "nav_per_unit": "RMB_per_unit",
    }
    unit_of = F.coalesce(*[F.when(F.col("metric") == m, F.lit(u)) for m, u in units.items()])
    present = F.col("status") == "available"
    span = F.col("first_date").isNotNull() & F.col("last_date").isNotNull()
    difference = F.abs(F.col("annual_value") - F.col("quarterly_value"))
    return {
        "securities": Contract("symbol STRING, name STRING, exchange STRING, listing_date DATE, asset_type STRING", ("symbol",), (code,), ("symbol",)),
        "documents": Contract(
            "document_id STRING, symbol STRING, document_type STRING, period_end DATE, publication_date DATE, source_url STRING, "
            "verification_status STRING, supersedes_document_id STRING, content_sha256 STRING", ("document_id",), (published, sha), ("symbol",),
            ("supersedes_document_id", "content_sha256")),
        "metric_definitions": Contract("metric STRING, asset_scope STRING, canonical_unit STRING, expected_frequency STRING", ("metric",)),
        "metric_requirements": Contract("asset_type STRING, metric STRING, requirement_level STRING, expected_frequency STRING",
                                        ("asset_type", "metric"), (checks.vocabulary("requirement_level", ["core", "optional", "conditional"]),)),
        "assets": Contract("symbol STRING, asset_id STRING, asset_type STRING, asset_effective_from DATE, installed_capacity_mw DOUBLE",
                           ("symbol", "asset_id"), tuple(checks.positive("installed_capacity_mw")), ("symbol",), ("installed_capacity_mw",)),
        "observations": Contract(
            "symbol STRING, asset_id STRING, period_end DATE, metric STRING, value DOUBLE, unit STRING, publication_date DATE, source_url STRING",
            ("symbol", "asset_id", "period_end", "metric", "publication_date"),
            (published, *checks.not_null("symbol", "asset_id", "period_end", "metric", "value", "source_url")), ("symbol",)),
        "asset_events": Contract(
            "event_id STRING, symbol STRING, asset_id STRING, event_type STRING, event_start DATE, event_end DATE, date_precision STRING, "
            "publication_date DATE, source_url STRING", ("event_id",),
            (checks.ordered_dates("event_start", "event_end"), checks.ordered_dates("event_start", "publication_date"),
             checks.vocabulary("date_precision", ["day", "month", "quarter"])), ("symbol",), ("asset_id", "event_end")),
        "panel_reviews": Contract("symbol STRING, period_end DATE, panel_name STRING, source_url STRING, review_status STRING, reviewed_at DATE",
                                  ("panel_name", "source_url"), (checks.vocabulary("review_status", ["single_pass", "double_checked"]),), ("symbol",)),
        "annual_reconciliations": Contract(
            "symbol STRING, asset_id STRING, fiscal_year INT, metric STRING, aggregation_method STRING, quarterly_value DOUBLE, annual_value DOUBLE, "
            "absolute_difference DOUBLE, relative_difference_pct DOUBLE, status STRING, annual_publication_date DATE",
            ("symbol", "asset_id", "fiscal_year", "metric"),
            (checks.vocabulary("aggregation_method", ["sum", "settled_electricity_weighted_average", "fuel_consumption_weighted_average"]),
             checks.vocabulary("status", ["exact", "within_rounding", "annual_true_up", "basis_difference"]),
             checks.identity("absolute_difference_recomputed", F.col("absolute_difference"), difference, 1e-6),
             RowRule("relative_difference_recomputed", F.abs(F.col("relative_difference_pct") - F.when(
                 F.col("annual_value") == 0, 0.0).otherwise(difference / F.abs("annual_value") * 100)) <= 1e-7),
             RowRule("exact_is_exact", (F.col("status") != "exact") | (F.col("absolute_difference") <= 1e-8))), ("symbol",)),
        "prices_adjusted": Contract("symbol STRING, date DATE, close DOUBLE, turnover DOUBLE, adjustment STRING", ("symbol", "date"),
                                    (*checks.positive("close"), RowRule("turnover_not_negative", F.col("turnover") >= 0),
                                     checks.vocabulary("adjustment", ["hfq"])), ("symbol",)),
        "prices_unadjusted": Contract("symbol STRING, date DATE, close DOUBLE, adjustment STRING", ("symbol", "date"),
                                      (*checks.positive("close"), checks.vocabulary("adjustment", ["none"])), ("symbol",)),
        "benchmark": Contract("date DATE, close DOUBLE", ("date",), tuple(checks.positive("close"))),
        "price_coverage": Contract("symbol STRING, status STRING, rows BIGINT, first_date DATE, last_date DATE", ("symbol",),
                                   (checks.vocabulary("status", ["available", "no_history", "network_failed"]),
                                    RowRule("available_has_rows", ~present | ((F.col("rows") > 0) & span)),
                                    RowRule("others_have_none", present | (F.col("rows") == 0))), ("symbol",), ("first_date", "last_date")),
        "fund_facts": Contract(
            "symbol STRING, period_end DATE, publication_date DATE, document_type STRING, metric STRING, value DOUBLE, unit STRING, source_url STRING, "
            "verification_status STRING", ("symbol", "period_end", "publication_date", "metric"),
            (published, RowRule("unit_of_metric", F.col("unit") == unit_of), RowRule("metric_known", unit_of.isNotNull()),
             RowRule("positive_where_needed", ~F.col("metric").isin("fund_shares", "nav_per_unit") | (F.col("value") > 0))), ("symbol",)),
        "distributions": Contract(
            "symbol STRING, publication_date DATE, ex_date DATE, dpu_per_unit DOUBLE, disclosed_rmb_per_10_units DOUBLE, source_url STRING, "
            "verification_status STRING", ("symbol", "publication_date"),
            (checks.ordered_dates("publication_date", "ex_date"), *checks.positive("dpu_per_unit"),
             checks.identity("ten_units", F.col("dpu_per_unit") * 10, F.col("disclosed_rmb_per_10_units"), 1e-10)), ("symbol",)),
        "announcements": Contract(
            "announcement_id STRING, symbol STRING, publication_date DATE, title STRING, bulletin_type STRING, original_type STRING, source_url STRING, "
            "exchange STRING, catalog_status STRING", ("announcement_id",), (), ("symbol",)),
        "universe_history": Contract(
            "snapshot_date DATE, symbol STRING, name STRING, exchange STRING, source_name STRING, source_url STRING, record_status STRING",
            ("snapshot_date", "symbol"), (code,), ("symbol",)),
        "security_overrides": Contract("symbol STRING, official_name STRING, asset_type STRING, verification_status STRING, source_url STRING, notes STRING",
                                       ("symbol",), (code, checks.vocabulary("verification_status", ["human_verified"])), ("symbol",), ("notes",)),
        "daily_weather": Contract(
            "grid_point_id STRING, time DATE, precipitation_sum DOUBLE, rain_sum DOUBLE, snowfall_sum DOUBLE, temperature_2m_mean DOUBLE, "
            "et0_fao_evapotranspiration DOUBLE", ("grid_point_id", "time"), tuple(checks.not_null("precipitation_sum", "temperature_2m_mean"))),
        "annual_metrics": Contract(
            "symbol STRING, asset_id STRING, period_start DATE, period_end DATE, period_type STRING, metric STRING, value DOUBLE",
            ("symbol", "asset_id", "period_start", "period_end", "metric"), (checks.vocabulary("period_type", ["annual", "year_to_date"]),), ("symbol",)),
        "grid_weights": Contract("grid_point_id STRING, area_weight DOUBLE", ("grid_point_id",), tuple(checks.positive("area_weight"))),
        "feature_definitions": Contract(
            "symbol STRING, asset_type STRING, feature_id STRING, metric STRING, aggregation STRING, asset_ids STRING, comparison_lag_quarters INT",
            ("symbol",), (checks.vocabulary("aggregation", ["sum"]), *checks.positive("comparison_lag_quarters")), ("symbol",)),
        "samples": Contract("symbol STRING, asset_type STRING, metric STRING, value DOUBLE", ("symbol", "metric"), (), ("symbol",)),
    }


def contract(name: str) -> Contract:
    return _contracts()[name]


def typed(raw: DataFrame, name: str) -> DataFrame:
    """Contract columns of a raw table in their types; a missing column or an unreadable value stops the job."""
    c = contract(name)
    missing = sorted(set(c.schema.names) - set(c.optional) - set(raw.columns))
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    columns = []
    for f in c.schema.fields:
        col = F.col(f.name) if f.name in raw.columns else F.lit(None)
        if isinstance(f.dataType, T.StringType):
            col = F.nullif(col.cast("string"), F.lit(""))
            col = text.security_code(col) if f.name in c.codes else col
        else:
            col = F.nullif(col.cast("string"), F.lit("")).cast(f.dataType)
        columns.append(col.alias(f.name))
    return raw.select(*columns)


def violations(df: DataFrame, name: str) -> DataFrame:
    """Broken rules and repeated keys of a typed table."""
    c = contract(name)
    parts = [checks.duplicate_keys(df, list(c.key))]
    if c.rules:
        parts.append(checks.row_violations(df, list(c.key), list(c.rules)))
    return checks.union(*parts)


def read_csv(spark: SparkSession, path: str, name: str, strict: bool = True) -> DataFrame:
    """CSV by header into the contract; all values are read as text first, so codes keep their zeros."""
    df = typed(spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST"), name)
    if strict:
        checks.require(violations(df, name), name)
    return df


def read_parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Columnar scan of the contract columns only."""
    return typed(spark.read.parquet(path), name)


def union_files(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """Many files, or folders, of one table as one scan; a malformed line stops the job."""
    return typed(spark.read.csv(paths, header=True, inferSchema=False, mode="FAILFAST"), name)


def tolerant_csv(spark: SparkSession, paths: str | list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, refused lines) of CSV files by header. A line with too many or too few fields, or with a value that its type cannot hold,
    is refused: a row (rule, file, line), one for each rule it breaks, and no row of the table. Files with other headers stop the job.

    One scan each; nothing is cached, so rows and refusals may be read apart. Broken rules of readable rows are `violations`.
    """
    header = spark.read.csv(paths, header=True, inferSchema=False).schema
    raw = spark.read.schema(T.StructType([*header.fields, T.StructField("__line", T.StringType())])).csv(
        paths, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="__line").withColumn("__file", F.col("_metadata.file_path"))
    fields = [f for f in contract(name).schema.fields if f.name in header.names and not isinstance(f.dataType, T.StringType)]
    unreadable = [
        F.when(F.col("__line").isNull() & F.nullif(F.col(f.name), F.lit("")).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f"unreadable_{f.name}"))
        for f in fields]
    rules = F.array_compact(F.array(F.when(F.col("__line").isNotNull(), F.lit("malformed_line")), *unreadable))
    marked = raw.withColumn("__rules", rules)
    line = F.coalesce("__line", F.to_csv(F.struct(*[F.col(c) for c in header.names])))
    refused = marked.where(F.size("__rules") > 0).select(F.explode("__rules").alias("rule"), F.col("__file").alias("file"), line.alias("line"))
    return typed(marked.where(F.size("__rules") == 0).drop("__line", "__file", "__rules"), name), refused


def union_conflicts(df: DataFrame, source: str) -> DataFrame:
    """Sources that several files give with different content."""
    content = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    found = df.groupBy(source).agg(F.count_distinct(content).alias("_n"))
    return checks.row_violations(found, [source], [RowRule("same_source_same_content", F.col("_n") == 1)])


# Column names of quote lists and histories in their own language.
QUOTE_COLUMNS = {
    "序号": "rank", "代码": "symbol", "名称": "name", "最新价": "last", "涨跌额": "change", "涨跌幅": "change_pct", "成交量": "volume",
    "成交额": "turnover", "振幅": "amplitude_pct", "最高": "high", "最高价": "high", "最低": "low", "最低价": "low", "今开": "open",
    "开盘价": "open", "昨收": "previous_close", "量比": "volume_ratio", "换手率": "turnover_rate_pct",
}
HISTORY_COLUMNS = {
    "日期": "date", "开盘": "open", "今开": "open", "收盘": "close", "最新价": "close", "最高": "high", "最低": "low", "成交量": "volume",
    "成交额": "turnover", "振幅": "amplitude_pct", "涨跌幅": "change_pct", "涨跌额": "change", "换手率": "turnover_rate_pct",
    "换手": "turnover_rate_pct", "amount": "turnover",
}


def canonical_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Known names to canonical ones; several spellings of one column are merged, unknown columns stay."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(names.get(c, c), []).append(c)
    out = df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(target) for target, cs in groups.items()])
    if "symbol" in out.columns:
        out = out.withColumn("symbol", text.security_code(F.col("symbol")))
    return out.withColumn("date", F.col("date").cast("date")) if "date" in out.columns else out
