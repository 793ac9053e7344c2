"""Driver tables seen as the domain tables the operators expect.

Sums run over whole cents and whole percents, so they are exact in any order and on
any number of tasks. Big tables are aggregated to (key, day) before they are joined.
Security codes have six digits or more: one code for each supplier, customer or nation, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import periods, text
from tidemark.session import shared, stage

# Words put into made-up fund names and titles.
TITLE_WORDS = ["数据中心", "租赁住房", "高速公路", "仓储物流", "产业园", "消费", "水务", "供热", "生物质", "清洁能源",
               "商业不动产", "基础设施"]
EXPANSION_TITLES = ["拟扩募并新购入项目的公告", "提交扩募申请的公告", "扩募申请获得受理的公告", "扩募反馈意见的公告",
                    "扩募获得批复的公告", "扩募发售公告", "扩募份额上市交易的公告", "扩募完成交割审计的公告", "扩募其他公告"]
METRICS = ["quantity", "revenue", "discount_value"]
UNITS = {"quantity": "units", "revenue": "RMB", "discount_value": "RMB"}
ASSET_TYPES = ["hydro", "wind", "toll_road", "water"]


def whole(amount: Column, scale: int = 100) -> Column:
    return F.floor(amount * scale + 0.5)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day(column: str) -> Column:
    return F.col(column).cast("date")


def code(key: Column) -> Column:
    return text.security_code(key)


def _lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("bigint").alias("qty"),
        whole(F.col("l_extendedprice")).alias("cents"), whole(F.col("l_discount")).alias("pct"), day("l_shipdate").alias("date"),
    )


def _bars(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("qty").alias("qty"), F.sum("cents").alias("cents"))


def _as_prices(bars: DataFrame) -> DataFrame:
    return bars.withColumn("close", F.col("cents") / 100.0 / F.col("qty")).withColumn(
        "turnover", F.col("cents") / 100.0
    ).drop("qty", "cents")


def prices(spark, sf) -> DataFrame:
    """Daily bars per supplier: symbol, date, close, turnover."""
    rows = _lines(spark, sf).select(code(F.col("l_suppkey")).alias("symbol"), "date", "qty", "cents")
    return _as_prices(_bars(rows, ["symbol", "date"]))


@shared
def benchmark(spark, sf) -> DataFrame:
    return _as_prices(_bars(_lines(spark, sf), ["date"])).select("date", "close")


@shared
def nation_prices(spark, sf) -> DataFrame:
    """Weekly bars per nation, dated by their Friday."""
    weekly = _bars(
        _lines(spark, sf).withColumn("date", periods.friday_week(F.col("date"))), ["l_suppkey", "date"]
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = weekly.join(suppliers, "l_suppkey").withColumn("symbol", code(F.col("s_nationkey")))
    return _as_prices(_bars(rows, ["symbol", "date"]))


@shared
def nation_benchmark(spark, sf) -> DataFrame:
    rows = _lines(spark, sf).withColumn("date", periods.friday_week(F.col("date")))
    return _as_prices(_bars(rows, ["date"])).select("date", "close")


def _asset(key: Column) -> Column:
    return F.concat(F.lit("A"), F.lpad((key % 16).cast("string"), 2, "0"))


def _document_id(symbol: Column, period: Column, published: Column) -> Column:
    return F.concat(F.lit("D"), symbol, F.date_format(period, "yyyyMMdd"), F.date_format(published, "yyyyMMdd"))


def _url(document_id: Column) -> Column:
    return F.concat(F.lit("https://disclosure.example/"), document_id)


@shared
def observations(spark, sf) -> DataFrame:
    """Quarterly metrics per asset in two versions: kept lines soon after quarter end, all lines 180 days after."""
    kept = F.col("l_returnflag") != "R"
    per_supplier = (
        _lines(spark, sf)
        .withColumn("period_end", periods.quarter_end(F.col("date")))
        .groupBy("l_suppkey", "period_end")
        .agg(
            *[F.sum(F.when(kept, e)).alias(f"{n}_first") for n, e in _measures()],
            *[F.sum(e).alias(f"{n}_all") for n, e in _measures()],
        )
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    per_asset = (
        per_supplier.join(suppliers, "l_suppkey")
        .withColumn("symbol", code(F.col("s_nationkey")))
        .withColumn("asset_id", _asset(F.col("l_suppkey")))
        .withColumn("_delay", (20 + (F.col("l_suppkey") % 16 + F.col("s_nationkey")) % 21).cast("int"))
        .groupBy("symbol", "asset_id", "period_end", "_delay")
        .agg(*[F.sum(f"{n}_{v}").alias(f"{n}_{v}") for n in METRICS for v in ("first", "all")])
    )
    entry = lambda n, v, delay: F.struct(
        F.lit(n).alias("metric"), (F.col(f"{n}_{v}") / (1.0 if n == "quantity" else 100.0 if n == "revenue" else 10000.0)).alias("value"),
        F.lit(UNITS[n]).alias("unit"), F.date_add("period_end", delay).alias("publication_date"),
    )
    rows = per_asset.withColumn("_o", F.explode(F.array(
        *[entry(n, "first", F.col("_delay")) for n in METRICS], *[entry(n, "all", F.lit(180)) for n in METRICS]
    ))).select("symbol", "asset_id", "period_end", "_o.*").where("value is not null")
    return rows.withColumn(
        "source_url", _url(_document_id(F.col("symbol"), F.col("period_end"), F.col("publication_date")))
    )


def _measures():
    return [("quantity", F.col("qty")), ("revenue", F.col("cents")), ("discount_value", F.col("cents") * F.col("pct"))]


def kept_observations(spark, sf) -> DataFrame:
    """Observations written once, so that several readers do not scan the lines again."""
    return stage(observations(spark, sf), "observations")


def registry(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    """Document registry behind the observations; a revision names the first report it replaces."""
    seen = (rows or observations(spark, sf)).select("symbol", "period_end", "publication_date").distinct()
    first = F.min("publication_date").over(_by("symbol", "period_end"))
    odd = F.quarter("period_end") % 2 == 1
    revision = F.col("publication_date") == F.date_add("period_end", 180)
    return seen.withColumn("_first", first).select(
        _document_id(F.col("symbol"), F.col("period_end"), F.col("publication_date")).alias("document_id"),
        "symbol",
        F.when(F.quarter("period_end") == 4, "annual_report").otherwise("quarterly_report").alias("document_type"),
        "period_end", "publication_date",
        _url(_document_id(F.col("symbol"), F.col("period_end"), F.col("publication_date"))).alias("source_url"),
        F.when(odd, "human_verified").otherwise("metadata_verified").alias("verification_status"),
        F.when(revision & (F.col("_first") < F.col("publication_date")),
               _document_id(F.col("symbol"), F.col("period_end"), F.col("_first"))).alias("supersedes_document_id"),
        F.when(odd, F.sha2(_document_id(F.col("symbol"), F.col("period_end"), F.col("publication_date")), 256)).alias("content_sha256"),
    )


def _by(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


@shared
def assets(spark, sf) -> DataFrame:
    rows = table(spark, sf, "supplier").select(
        code(F.col("s_nationkey")).alias("symbol"), _asset(F.col("s_suppkey")).alias("asset_id"), "s_nationkey"
    ).distinct()
    kind = F.element_at(F.array(*[F.lit(t) for t in ASSET_TYPES]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    return rows.select("symbol", "asset_id", kind.alias("asset_type"), F.lit("1995-01-01").cast("date").alias("asset_effective_from"))


def definitions(spark, sf) -> DataFrame:
    """One feature per nation over all its assets; a nation has sixteen assets at most."""
    metric = F.element_at(F.array(*[F.lit(m) for m in METRICS]), (F.col("symbol").cast("int") % 3 + 1))
    return (
        assets(spark, sf).groupBy("symbol", "asset_type")
        .agg(F.array_join(F.array_sort(F.collect_set("asset_id")), "|").alias("asset_ids"))
        .select("symbol", "asset_type", F.concat_ws("_", "symbol", metric).alias("feature_id"), metric.alias("metric"),
                F.lit("sum").alias("aggregation"), "asset_ids", F.lit(4).alias("comparison_lag_quarters"))
    )


def _orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", whole(F.col("o_totalprice")).alias("cents"), day("o_orderdate").alias("date"), "o_orderstatus"
    )


@shared
def distributions(spark, sf) -> DataFrame:
    slot = F.col("o_custkey") % 25
    per_day = _orders(spark, sf).groupBy(slot.alias("_slot"), F.col("date").alias("publication_date")).agg(F.sum("cents").alias("cents"))
    return per_day.select(
        code(F.col("_slot")).alias("symbol"), "publication_date",
        F.date_add("publication_date", (1 + F.col("_slot") % 5).cast("int")).alias("ex_date"),
        (F.col("cents") / 1000000.0).alias("dpu_per_unit"),
        (F.col("cents") / 1000000.0 * 10).alias("disclosed_rmb_per_10_units"),
        F.concat(F.lit("https://disclosure.example/P"), code(F.col("_slot")), F.date_format("publication_date", "yyyyMMdd")).alias("source_url"),
        F.when(F.month("publication_date") % 2 == 0, "machine_extracted_official_pdf").otherwise("visual_verified_official_pdf").alias("verification_status"),
    )


@shared
def fund_facts(spark, sf) -> DataFrame:
    slot = F.col("o_custkey") % 25
    per_quarter = (
        _orders(spark, sf)
        .groupBy(slot.alias("_slot"), periods.quarter_end(F.col("date")).alias("period_end"))
        .agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
    )
    shares = F.col("n") * 1000000.0
    amount = F.col("cents") / 100.0
    rounded = lambda x: F.floor(x * 10000 + 0.5) / 10000.0
    fact = lambda m, v, u, d: F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(u).alias("unit"), F.lit(d).alias("document_type"))
    return (
        per_quarter.withColumn("_f", F.explode(F.array(
            fact("fund_shares", shares, "shares", "quarterly_report"),
            fact("distributable_amount_quarter", amount, "RMB", "quarterly_report"),
            fact("distributable_amount_per_unit_quarter", rounded(amount / shares), "RMB_per_unit", "quarterly_report"),
            fact("nav_per_unit", rounded(F.col("cents") / F.col("n") / 25000.0), "RMB_per_unit", "annual_report"),
        )))
        .withColumn("publication_date", F.date_add("period_end", (30 + F.col("_slot") % 15).cast("int")))
        .withColumn("source_url", F.concat(F.lit("https://disclosure.example/F"), code(F.col("_slot")), F.date_format("period_end", "yyyyMMdd")))
        .select(code(F.col("_slot")).alias("symbol"), "period_end", "publication_date", "_f.document_type", "_f.metric", "_f.value", "_f.unit",
                "source_url", F.sha2("source_url", 256).alias("source_sha256"),
                F.when(F.quarter("period_end") % 2 == 0, "machine_extracted_official_pdf").otherwise("visual_verified_official_pdf").alias("verification_status"))
    )


# --- announcements and their texts ------------------------------------------------------------


def fund_code(key: Column) -> Column:
    """One fund code for each customer: an exchange prefix by the remainder of three, then the quotient."""
    prefix = F.element_at(F.array(F.lit("508"), F.lit("180"), F.lit("181")), (key % 3 + 1).cast("int"))
    return F.concat(prefix, text.zero_padded(F.floor(key / 3), 3))


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def _chinese(year: Column) -> Column:
    return F.translate(year.cast("string"), "0123456789", "〇一二三四五六七八九")


# Title bodies by kind; marks in braces are filled per row.
TITLE_BODIES = [
    "{year}年第{quarter}季度报告", "{year}年年度报告", "{year}年中期报告", "关于收益分配的公告", "{year}年第{quarter}季度报告（更正）",
    "{year}年年度报告摘要", "{expansion}", "关于变更名称的公告", "关于终止上市的公告", "{year}年半年度报告更正稿", "{written}年年度报告",
    "基金经理变更公告", "{other}审计报告", "{year}年3季度报告", "持有人大会公告", "{year}年年度报告更正公告",
]


def _title(kind: Column, word: Column, symbol: Column, key: Column, lot: Column) -> Column:
    fill = {
        "year": F.col("_year").cast("string"),
        "written": _chinese(F.col("_year")),
        "quarter": _pick(["一", "二", "三", "四"], key % 4),
        "expansion": _pick(EXPANSION_TITLES, F.floor(key / 16) % 9),
        "other": F.when(lot % 7 == 0, _pick(TITLE_WORDS, (lot + 1) % 12)).otherwise(F.lit("")),
    }
    body = _pick(TITLE_BODIES, kind)
    for mark, value in fill.items():
        body = F.replace(body, F.lit("{" + mark + "}"), value)
    return F.concat(symbol, word, F.lit("REIT"), body)


def announcements(spark, sf) -> DataFrame:
    """One notice per order with a title of one of sixteen kinds, and one listing notice per fund."""
    key, lot = F.col("o_orderkey"), F.col("o_custkey") % 1000
    symbol = fund_code(F.col("o_custkey"))
    from_orders = (
        _orders(spark, sf)
        .withColumn("publication_date", F.add_months("date", 240))
        .withColumn("_year", F.year("publication_date") - 1)
        .select(
            F.concat(F.lit("N"), F.lpad(key.cast("string"), 12, "0")).alias("announcement_id"), symbol.alias("symbol"), "publication_date",
            # a generator of one row: filters on the title below then test it as a value instead of holding its expression many times
            F.explode(F.array(_title(key % 16, _pick(TITLE_WORDS, lot % 12), symbol, key, lot))).alias("title"),
            F.when(key % 16 == 3, "权益分派").otherwise("定期公告").alias("original_type"),
        )
    )
    listed = (
        table(spark, sf, "customer")
        .groupBy(fund_code(F.col("c_custkey")).alias("symbol"))
        .agg(F.min("c_custkey").alias("_key"))
        .select(
            F.concat(F.lit("L"), "symbol").alias("announcement_id"), "symbol",
            F.date_add(F.lit("2015-01-31").cast("date"), (F.col("_key") * 37 % 1500).cast("int")).alias("publication_date"),
            F.concat("symbol", _pick(TITLE_WORDS, F.col("_key") % 1000 % 12), F.lit("REIT上市交易提示性公告")).alias("title"),
            F.lit("上市公告").alias("original_type"),
        )
    )
    return from_orders.unionByName(listed).withColumns({
        "bulletin_type": F.lit("公告"),
        "source_url": F.concat(F.lit("https://exchange.example/"), F.col("announcement_id")),
        "exchange": text.exchange_of(F.col("symbol")),
        "catalog_status": F.lit("official"),
    })


def catalogue(spark, sf) -> DataFrame:
    """Announcements with document type and period read from the title, as one projection over the orders; nothing is written."""
    from tidemark.operators import catalogue as c

    return c.reclassify(announcements(spark, sf))


def _four_decimals(units: Column) -> Column:
    return F.concat(F.floor(units / 10000).cast("string"), F.lit("."), F.lpad((units % 10000).cast("string"), 4, "0"))


# Report layouts; marks in braces are filled per row.
SHARE_LAYOUTS = [
    "报告期末基金份额总额 {shares} 份", "报告期末基金份额总额（单位：份） {shares}", "报告期期末基金份额总额 {shares}",
    "报告截止日 {year} 年 12 月 31 日 ，基金份额总额为 {shares} 份", "份额未披露",
]
_HEADER = " 3.3.1 本报告期的可供分配金额 项目 金额 "
_PLAIN = _HEADER + "本期 {amount} {unit} 3.3.2 其他"
AMOUNT_LAYOUTS = [
    _PLAIN, _HEADER + "本期 {amount} - {unit} 3.3.2 其他", _HEADER + "无" * 1600 + _HEADER + "本期 -{amount} -{unit} 3.3.2 其他",
    _PLAIN, _PLAIN, " 可供分配金额未披露",
]
NAV_LAYOUTS = [
    " 期末不动产基金份额净 值 {nav}", " 期末基金份额净值 {nav}", " 期末基金份额净 {nav} 1.2 3.4 值",
    " 报告截止日：{year} 年 12 月 31 日，基金份额净值为人民币 {nav} 元",
]
_SCHEME = " 本次公募REITs分红方案（单位：元/10 份） {dpu} 注：数值四舍五入 除息日 "
_PAY = " 现金红利发放日 {pay} 分红对象"
DIVIDEND_LAYOUTS = [
    _SCHEME + "场内：{ex} 场外：{off}" + _PAY, _SCHEME + "{exdash}（场内） {offdash}（场外）" + _PAY,
    _SCHEME + "日期（场 日期（场 {off} {ex} 内）外）" + _PAY, _SCHEME + "日期 {ex}" + _PAY,
    _SCHEME + "场内{ex}" + _PAY, _SCHEME + "场内{ex}" + _PAY, " 本次分红方案见附件 除息日",
]
OPERATIONS_LAYOUT = (
    " 出租率为 {occupied}.5%；日均自然车流量 {traffic} 辆次，客车车流量 {cars} 辆。货车日均自然车流量约 {lorries} 辆/日；通行费收入 {amount} 元；"
    "Revenue was {amount} RMB; 结算电价 0.{tariff} 元/千瓦时\n"
)


def document_texts(spark, sf) -> DataFrame:
    """Report text per order: whole prose of the matching document, then shares, amounts, net value and a dividend."""
    key = F.col("o_orderkey")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("o_orderkey"), F.col("text").alias("prose"))
    shares = 100000000 + key * 1000
    published = F.add_months("date", 240)
    ex = F.date_add(published, (1 + key % 9).cast("int"))
    written = lambda day: F.concat(F.year(day), F.lit("年"), F.month(day), F.lit("月"), F.dayofmonth(day), F.lit("日"))
    fill = {
        "shares": F.format_number(shares, 0),
        "amount": F.concat(F.format_number(F.floor(F.col("cents") / 100), 0), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")),
        "unit": _four_decimals(F.floor(F.col("cents") * 100 / shares)), "nav": _four_decimals(10000 + key % 90000),
        "dpu": _four_decimals(F.col("cents") % 90000 + 1), "year": (F.year(published) - 1).cast("string"),
        "exdash": F.date_format(ex, "yyyy-MM-dd"), "offdash": F.date_format(F.date_sub(ex, 1), "yyyy-MM-dd"),
        "ex": written(ex), "off": written(F.date_sub(ex, 1)), "pay": written(F.date_add(ex, 3)),
        "occupied": (key % 100).cast("string"), "traffic": (key % 9000 + 10).cast("string"), "cars": (key % 700 + 1).cast("string"),
        "lorries": (key % 300 + 1).cast("string"), "tariff": (key % 9 + 1).cast("string"),
    }

    def filled(layouts: list[str], index: Column | None = None) -> Column:
        """The layout with its marks filled, which are looked for from the first one on, and only those that stand in one of the layouts."""
        heads = [x.partition("{")[0] for x in layouts]
        head, text = [F.lit(x[0]) if index is None else _pick(x, index) for x in (heads, [x[len(h):] for x, h in zip(layouts, heads, strict=True)])]
        for mark, value in fill.items():
            if any("{" + mark + "}" in x for x in layouts):
                text = F.replace(text, F.lit("{" + mark + "}"), value)
        return F.concat(head, text)

    body = F.concat(
        F.lit("\n"), filled(SHARE_LAYOUTS, key % 5), F.lit("\n"), filled(AMOUNT_LAYOUTS, key % 6), filled(NAV_LAYOUTS, key % 4),
        filled(DIVIDEND_LAYOUTS, key % 7), filled([OPERATIONS_LAYOUT]),
    )
    number = F.concat(F.lit("N"), F.lpad(key.cast("string"), 12, "0"))
    # narrow rows are dealt out by their key before texts are made: text work then spreads over all cores, however few splits the scan has
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _orders(spark, sf).repartition(parts, "o_orderkey").join(docs, "o_orderkey", "left")
    return rows.select(
        number.alias("announcement_id"), fund_code(F.col("o_custkey")).alias("symbol"), published.alias("publication_date"),
        F.concat(F.lit("https://exchange.example/"), number).alias("source_url"), F.concat(F.coalesce("prose", F.lit("")), body).alias("text"),
    )


@shared
def universe_history(spark, sf) -> DataFrame:
    """Month-end snapshots of the funds with an order in the month."""
    seen = _orders(spark, sf).select(
        F.last_day(F.add_months("date", 240)).alias("snapshot_date"), fund_code(F.col("o_custkey")).alias("symbol"),
        (F.col("o_custkey") % 1000).alias("_lot"),
    ).distinct()
    name = F.concat("symbol", _pick(TITLE_WORDS, F.col("_lot") % 12), F.when(F.col("_lot") % 5 == 0, "...").otherwise("REIT"))
    return seen.select(
        "snapshot_date", "symbol", name.alias("name"), text.exchange_of(F.col("symbol")).alias("exchange"),
        F.lit("quote list").alias("source_name"), F.lit("https://quote.example/list").alias("source_url"),
        F.when(F.col("_lot") % 5 == 0, "needs_name_review").otherwise("source_observed").alias("record_status"),
    )


# --- weather, annual metrics and areas -----------------------------------------------------------


@shared
def _grid_days(spark, sf) -> DataFrame:
    """Lines summed per grid point and day: seven rows for each day."""
    return _lines(spark, sf).groupBy(F.col("l_linenumber").alias("_grid"), F.col("date").alias("time")).agg(
        F.sum("qty").alias("qty"), F.sum("pct").alias("pct"), F.count(F.lit(1)).alias("n"))


def daily_weather(spark, sf) -> DataFrame:
    """Every grid point on every day of the whole quarters covered; days without lines are dry."""
    seen = _grid_days(spark, sf)
    span = _grid_days(spark, sf).agg(F.trunc(F.min("time"), "quarter").alias("a"), periods.quarter_end(F.max("time")).alias("b"))
    grid = span.select(
        F.explode(F.sequence("a", "b")).alias("time"), F.array(*[F.lit(i) for i in range(1, 8)]).alias("_g")
    ).select("time", F.explode("_g").alias("_grid"))
    qty, pct = F.coalesce("qty", F.lit(0)), F.coalesce("pct", F.lit(0))
    return grid.join(seen, ["time", "_grid"], "left").select(
        F.concat(F.lit("grid_"), F.lpad(F.col("_grid").cast("string"), 2, "0")).alias("grid_point_id"), "time",
        (qty / 10.0).alias("precipitation_sum"), (qty / 20.0).alias("rain_sum"), (pct / 8.0).alias("snowfall_sum"),
        ((F.dayofyear("time") % 40) - 5 + pct / 16.0).alias("temperature_2m_mean"), (qty / 40.0 + 1.0).alias("et0_fao_evapotranspiration"),
    )


def grid_weights(spark, sf) -> DataFrame:
    """Share of all lines per grid point; seven points."""
    counts = _grid_days(spark, sf).groupBy("_grid").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        F.concat(F.lit("grid_"), F.lpad(F.col("_grid").cast("string"), 2, "0")).alias("grid_point_id"),
        (F.col("n") / total).alias("area_weight"),
    )


def hourly_forecasts(spark, sf) -> DataFrame:
    """24 hours per day of every grid point."""
    return daily_weather(spark, sf).withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(23)))).select(
        "grid_point_id", F.timestamp_seconds(F.unix_date("time").cast("bigint") * 86400 + F.col("_h") * 3600).alias("time"),
        (F.floor(F.col("precipitation_sum") * 10 + 0.5) / 250.0).alias("precipitation_previous_day1"),
    )


@shared
def annual_metrics(spark, sf) -> DataFrame:
    """Output, curtailed output and their sum per nation and whole year, in long form."""
    lines = _lines(spark, sf)
    returned = F.col("l_returnflag") == "R"
    per_supplier = lines.groupBy("l_suppkey", F.year("date").alias("_year")).agg(
        F.sum("qty").alias("potential"), F.sum(F.when(returned, F.col("qty")).otherwise(0)).alias("curtailed")
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    per_nation = (
        per_supplier.join(suppliers, "l_suppkey").groupBy("s_nationkey", "_year")
        .agg(F.sum("potential").alias("potential"), F.sum("curtailed").alias("curtailed"))
    )
    m = lambda n, v: F.struct(F.lit(n).alias("metric"), v.alias("value"))
    return per_nation.withColumn("_m", F.explode(F.array(
        m("hydrological_generation_potential", F.col("potential").cast("double")),
        m("curtailed_generation", F.col("curtailed").cast("double")),
        m("power_generation", (F.col("potential") - F.col("curtailed")).cast("double")),
        m("utilization_hours", (F.col("potential") - F.col("curtailed")) / 8.0),
    ))).select(
        code(F.col("s_nationkey")).alias("symbol"), F.lit("A00").alias("asset_id"),
        F.make_date(F.col("_year"), F.lit(1), F.lit(1)).alias("period_start"),
        F.make_date(F.col("_year"), F.lit(12), F.lit(31)).alias("period_end"),
        F.lit("annual").alias("period_type"), "_m.metric", "_m.value",
    )


@shared
def polygons(spark, sf) -> DataFrame:
    """One twelve-cornered area per nation; the month's share of trade sets the distance of its corner."""
    monthly = _lines(spark, sf).groupBy("l_suppkey", F.month("date").alias("seq")).agg(F.sum("cents").alias("cents"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    area = monthly.join(suppliers, "l_suppkey").groupBy("s_nationkey", "seq").agg(F.sum("cents").alias("cents"))
    share = F.col("cents") / F.sum("cents").over(_by("s_nationkey"))
    # Unit directions at thirty-degree steps, to three decimals.
    cos = [0.866, 0.5, 0.0, -0.5, -0.866, -1.0, -0.866, -0.5, 0.0, 0.5, 0.866, 1.0]
    sin = [0.5, 0.866, 1.0, 0.866, 0.5, 0.0, -0.5, -0.866, -1.0, -0.866, -0.5, 0.0]
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("seq"))
    r = 0.2 + F.col("_share") * 3.0
    snap = lambda x: F.floor(x * 10000 + 0.5) / 10000.0
    return area.withColumn("_share", share).select(
        code(F.col("s_nationkey")).alias("area_id"), "seq",
        snap(100.0 + F.col("s_nationkey") + r * at(cos)).alias("lon"), snap(25.0 + r * at(sin)).alias("lat"),
    )
