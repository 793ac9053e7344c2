"""Facts from report text as a Spark job: patterns are data, a text without the facts becomes a failure row.

All patterns are regular expressions run inside the scan stage; nothing is parsed in Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions.keyword_rules import contains_any

# Number, share, net value and distributable amount layouts; the first that matches counts.
NUMBER = r"([\d,]+(?:\.\d+)?)"
SHARE_PATTERNS = [
    r"报告期末基金份额总额\s*" + NUMBER + r"\s*份",
    r"报告期末基金份额总额\s*[（(]单位[：:]份[）)]\s*" + NUMBER,
    r"报告期期末基金份额总额\s*" + NUMBER,
    r"本报告期期末基金份额总额\s*" + NUMBER + r"\s*份",
    r"报告截止日.{0,140}?基金份额总额(?:为)?\s*" + NUMBER + r"\s*份",
]
NAV_PATTERNS = [
    r"期末不动产基金份额净\s*值\s*([\d.]+)",
    r"期末基金份额净\s*值\s*([\d.]+)",
    r"期末(?:不动产)?基金份额净\s+([\d.]+)(?:\s+[\d.]+){0,4}\s+值",
]
NAV_AT_DATE = (r"报告截止日[\s：:]*", r"\s*年\s*0?", r"\s*月\s*0?", r"\s*日.{0,80}?基金份额净\s*值(?:为)?(?:人民币)?\s*([\d.]+)\s*元")
AMOUNT_SECTION = r"3\s*\.\s*[23]\s*\.\s*1(?:\s*\.\s*1)?\s*本报告期(?:及近三年)?(?:的)?可供分配金额(.{0,1500})"
AMOUNT_LAYOUTS = [r"本期\s+(-?[\d,]+(?:\.\d+)?)\s+(-?[\d.]+)\b", r"本期\s+(-?[\d,]+(?:\.\d+)?)\s+-\s+(-?[\d.]+)\b"]
SHARE_RANGE = (1e6, 1e11)
NAV_LIMIT = 100
AMOUNT_LIMIT = 1e12

# Dividend scheme and ex-date layouts.
SCHEME_WORD = "分红方案"
SCHEME_WINDOW = 320
SCHEME_END = r"有关年度|注[：:]|二[、.]|2[、.]\s"
DECIMAL = r"(?<!\d)(\d+\.\d+)(?!\d)"
PER_TEN_UNITS = "元/10份"
EX_DATE_WORD = "除息日"
EX_WINDOW_BEFORE, EX_WINDOW_AFTER, TABLE_BEFORE = 120, 360, 180
EX_DATE_END = "现金红利发放日|分红对象"
DATE = r"(20\d{2})\s*[年/\-.]\s*(\d{1,2})\s*[月/\-.]\s*(\d{1,2})\s*日?"
ON_EXCHANGE_AFTER = r"场内[：:]?\s*" + DATE
ON_EXCHANGE_BEFORE = DATE + r"\s*[（(]?\s*场内"
TABLE_DATE_SPAN = 7

# Operating metrics, their words and units.
METRIC_WORDS = [
    ("occupancy", r"出租率|occupancy", r"%|％"),
    ("rentable_area", r"可供出租(?:建筑)?面积|可出租面积|rentable area", r"平方米|㎡|sq\.?\s*m"),
    ("leased_area", r"实际出租(?:建筑)?面积|已出租面积|leased area", r"平方米|㎡|sq\.?\s*m"),
    ("average_rent", r"平均租金|租金单价(?:水平)?|average rent", r"元/平方米/(?:天|月)|元/㎡/(?:天|月)"),
    ("rent_collection_rate", r"租金收缴率|rent collection rate", r"%|％"),
    ("tenant_concentration", r"租户集中度|前五大租户[^。；;\n]{0,12}(?:占比|比例)|tenant concentration", r"%|％"),
    ("traffic_volume", r"(?<!客车)(?<!货车)日均自然车流量|总收费车流量|(?<!客车)(?<!货车)车流量|traffic volume", r"万辆|辆次|辆/日|辆"),
    ("passenger_vehicle_traffic", r"客车(?:日均自然)?车流量|客车流量|passenger vehicle traffic", r"万辆|辆次|辆/日|辆"),
    ("freight_vehicle_traffic", r"货车(?:日均自然)?车流量|货车流量|freight vehicle traffic", r"万辆|辆次|辆/日|辆"),
    ("toll_revenue", r"通行费收入|toll revenue", r"亿元|万元|元|RMB"),
    ("power_generation", r"发电量|power generation", r"亿千瓦时|万千瓦时|千瓦时|GWh|MWh"),
    ("utilization_hours", r"有效发电小时|等效利用小时(?:数)?|利用小时(?:数)?|utili[sz]ation hours", r"小时|hours?"),
    ("settled_electricity", r"结算电量|settled electricity", r"亿千瓦时|万千瓦时|千瓦时|GWh|MWh"),
    ("settlement_tariff", r"结算(?:均价|电价)|settlement tariff", r"元/千瓦时|RMB/kWh"),
    ("revenue", r"营业收入|revenue", r"亿元|万元|元|RMB"),
    ("noi", r"运营净收益|\bNOI\b", r"亿元|万元|元|RMB"),
    ("distributable_amount", r"可供分配金额|distributable amount", r"亿元|万元|元|RMB"),
    ("distribution_per_unit", r"每份分派|每基金份额分派|distribution per unit|\bDPU\b", r"元/份|元|RMB"),
]
# Plain text without which a metric's pattern cannot match, in small letters; a quick test before the pattern is run.
METRIC_LITERALS = {
    "occupancy": ["出租率", "occupancy"], "rentable_area": ["面积", "rentable area"], "leased_area": ["面积", "leased area"],
    "average_rent": ["租金", "average rent"], "rent_collection_rate": ["租金收缴率", "rent collection rate"],
    "tenant_concentration": ["租户", "tenant concentration"], "traffic_volume": ["车流量", "traffic volume"],
    "passenger_vehicle_traffic": ["客车", "passenger vehicle traffic"], "freight_vehicle_traffic": ["货车", "freight vehicle traffic"],
    "toll_revenue": ["通行费收入", "toll revenue"], "power_generation": ["发电量", "power generation"],
    "utilization_hours": ["小时", "ation hours"], "settled_electricity": ["结算电量", "settled electricity"],
    "settlement_tariff": ["结算", "settlement tariff"], "revenue": ["营业收入", "revenue"], "noi": ["运营净收益", "noi"],
    "distributable_amount": ["可供分配金额", "distributable amount"],
    "distribution_per_unit": ["分派", "distribution per unit", "dpu"],
}
METRIC_GAP = r"[^。；;\n]{0,28}?"
# No unit begins with a figure, a comma, a point or white space, so a shorter number never fits where the longest does not.
METRIC_NUMBER = r"(-?\d[\d,]*+(?:\.\d++)?+)"
# Number and unit of a match, which are its end: units hold no figures.
MATCH_END = METRIC_NUMBER + r"\s*+([^\d\s,.]\D*+)$"
# Where no match goes on: words and gaps hold none of these marks, and white space with a line end follows a number or a part of "sq. m" only.
METRIC_CUT = r"[。；;\n](?<![\s\d,.qQ]\n)"
# Two letters that have no other form than small and capital; each literal in Latin letters has such a pair, so a piece without has none.
LATIN_PAIR = "[A-Za-z]{2}"
# A literal lies this many characters behind the start of its word at most, what is looked at before the word included.
LITERAL_REACH = 24
WHOLE = 2**31 - 1


def _cased(word: str) -> bool:
    return word.upper() != word.lower()


def _first_letters(words: str) -> str:
    """Lookahead for the letters with which one of these patterns can begin; empty where that cannot be told."""
    starts = [re.sub(r"^(?:\(\?<![^()]*\)|\\b)+", "", w)[:1] for w in re.split(r"\|(?![^()]*\))", words)]
    if not all(c.isalpha() for c in starts):
        return ""
    other = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}  # match these letters too without regard to case
    return f"(?=[{''.join(sorted({x for c in starts for x in c.lower() + c.upper() + other.get(c.lower(), '')}))}])"


def _held(piece: str, folded: str) -> Column:
    """For each literal the numbers of its metrics, or null where the piece does not hold it.

    They are looked for in the bytes of both; those without small and capital letters from their second byte on, as most such letters share a few first bytes, at
    each of which a comparison would begin. What is taken for one so and is none has no place later.
    """
    words = sorted({w for named in METRIC_LITERALS.values() for w in named})
    of = lambda w: F.array(*[F.lit(n) for n, (m, _, _) in enumerate(METRIC_WORDS) if w in METRIC_LITERALS[m]])
    holds = lambda w: F.contains(folded, F.lit(w.encode())) if _cased(w) else F.contains(piece, F.lit(w.encode()[1:]))
    return F.array(*[F.when(holds(w), of(w)) for w in words])


def _first_place(text: Column, words: list[list[str]], number: Column) -> Column:
    """Where the first literal of the metric of this number lies; null where none does."""
    own = F.get(F.array(*[F.array(*map(F.lit, named)).cast("array<string>") for named in words]), number)
    return F.array_min(F.transform(own, lambda w: F.nullif(F.call_function("instr", text, w), F.lit(0))))


def metric_candidates(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Every match of every metric pattern in the whole text: metric, value, unit and the words around.

    Texts are cut where no match goes on, and a pattern reads only pieces with a figure and one of its literals, from a little before the first one on.
    """
    piece, folded, number = F.col("_piece"), F.col("_folded"), F.col("_n")
    regexes = [f"{_first_letters(words)}(?iu)((?:{words}){METRIC_GAP}{METRIC_NUMBER}\\s*+({units}))" for _, words, units in METRIC_WORDS]

    pieces = texts.select(*keys, F.explode(F.split("text", METRIC_CUT)).alias("_piece")).where(piece.rlike("[0-9]"))
    # Upper then lower case brings letters together that match each other without regard to case.
    pieces = pieces.withColumns({"_folded": F.when(piece.rlike(LATIN_PAIR), F.lower(F.upper(piece))), "_bytes": piece.cast("binary")})
    possible = pieces.withColumn("_small", folded.cast("binary")).withColumn("_held", _held("_bytes", "_small")).select(
        *keys, "_piece", "_folded", F.explode(F.array_distinct(F.flatten(F.array_compact("_held")))).alias("_n"))
    kinds = [[[w for w in METRIC_LITERALS[m] if _cased(w) == cased] for m, _, _ in METRIC_WORDS] for cased in (False, True)]
    # Places in the folded piece are those of the piece unless a letter became two.
    folded_place = F.when(F.length(folded) == F.length(piece), _first_place(folded, kinds[1], number)).when(folded.isNotNull(), 1)
    start = F.greatest(F.least(_first_place(piece, kinds[0], number), folded_place) - LITERAL_REACH, F.lit(1))
    read = possible.select(*keys, "_n", F.substring(piece, start, F.lit(WHOLE)).alias("_read"))
    matches = reduce(lambda c, m: c.when(number == m[0], F.regexp_extract_all("_read", F.lit(m[1]), 1)), enumerate(regexes[1:], 1),
                     F.when(number == 0, F.regexp_extract_all("_read", F.lit(regexes[0]), 1)))
    # The matched piece alone is read again for its groups. As a lambda these patterns are no compiled code of the query, which would be one method,
    # too long for the JVM to compile in its turn.
    every = F.transform(matches, lambda raw: F.struct(
        t.number(F.regexp_extract(raw, MATCH_END, 1)).alias("value"), F.regexp_extract(raw, MATCH_END, 2).alias("unit"), F.trim(raw).alias("raw_text")))
    metric = F.get(F.array(*[F.lit(m) for m, _, _ in METRIC_WORDS]), number)
    return read.select(*keys, "_n", F.explode(every).alias("_m")).select(*keys, metric.alias("metric"), "_m.*")


def _book_nav(compact: Column, period_end: Column) -> Column:
    """Net value per unit stated for the period's own last day, else from the first table layout."""
    head, year, month, tail = NAV_AT_DATE
    own = F.concat(
        F.lit(head), F.year(period_end).cast("string"), F.lit(year), F.month(period_end).cast("string"), F.lit(month),
        F.dayofmonth(period_end).cast("string"), F.lit(tail),
    )
    stated = F.call_function("regexp_extract", compact, own, F.lit(1))
    return F.coalesce(F.when(stated != "", stated), t.first_group(compact, NAV_PATTERNS))


def _amounts(compact: Column) -> Column:
    """The first section that holds values, read in the first layout that fits."""
    sections = F.regexp_extract_all(compact, F.lit(AMOUNT_SECTION), 1)
    plain, dashed = AMOUNT_LAYOUTS

    def read(section: Column) -> Column:
        layout = F.when(section.rlike(plain), F.lit(0)).when(section.rlike(dashed), F.lit(1))
        take = lambda g: F.when(layout == 0, F.regexp_extract(section, plain, g)).when(
            layout == 1, F.regexp_extract(section, dashed, g))
        return F.when(layout.isNotNull(), F.struct(take(1).alias("amount"), take(2).alias("per_unit")))

    return F.get(F.array_compact(F.transform(sections, read)), F.lit(0))


def _failure(*checks: tuple[Column, str]) -> Column:
    """The first reason that applies, in order; null when all is well."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in checks])


def report_facts(texts: DataFrame) -> DataFrame:
    """Shares, distributable amounts and net value per report; ``failure_reason`` says what was not found.

    Annual reports need shares and net value, half-year reports all four facts,
    quarterly reports shares and amounts.
    """
    base = F.col("document_type")
    wants_amount = base.isin("quarterly_report", "semiannual_report")
    wants_nav = base.isin("annual_report", "semiannual_report")
    read = (
        texts.withColumn("_c", t.compact(F.col("text")))
        .withColumn("_s", t.first_group(F.col("_c"), SHARE_PATTERNS))
        .withColumn("_a", F.when(wants_amount, _amounts(F.col("_c"))))
        .withColumn("_n", F.when(wants_nav, _book_nav(F.col("_c"), F.col("period_end_candidate"))))
        .withColumns({
            "fund_shares": t.number(F.col("_s")),
            "distributable_amount_period": t.number(F.col("_a.amount")),
            "distributable_amount_per_unit_period": t.number(F.col("_a.per_unit")),
            "nav_per_unit": t.number(F.col("_n")),
        })
    )
    reason = _failure(
        (F.col("_c") != "", "no_text"),
        (F.col("fund_shares").isNotNull(), "shares_not_found"),
        (~wants_amount | (F.col("distributable_amount_period").isNotNull()
                          & F.col("distributable_amount_per_unit_period").isNotNull()), "amount_not_found"),
        (~wants_nav | F.col("nav_per_unit").isNotNull(), "nav_not_found"),
        (F.col("fund_shares").between(*SHARE_RANGE), "shares_out_of_range"),
        (~wants_amount | ((F.abs("distributable_amount_period") < AMOUNT_LIMIT)
                          & (F.abs("distributable_amount_per_unit_period") < NAV_LIMIT)), "amount_out_of_range"),
        (~wants_nav | ((F.col("nav_per_unit") > 0) & (F.col("nav_per_unit") < NAV_LIMIT)), "nav_out_of_range"),
    )
    kept = [c for c in texts.columns if c != "text"]
    facts = ["fund_shares", "distributable_amount_period", "distributable_amount_per_unit_period", "nav_per_unit"]
    judged = read.withColumn("failure_reason", reason)
    ok = F.col("failure_reason").isNull()
    return judged.select(
        *kept, *[F.when(ok, F.col(f)).alias(f) for f in facts], "failure_reason",
        F.when(ok, "success").otherwise("failed").alias("retrieval_status"),
    )


def _date(parts: Column) -> Column:
    """A day from the first date written in the text; impossible dates are null."""
    piece = lambda g: F.regexp_extract(parts, DATE, g)
    return F.when(parts.rlike(DATE), F.try_to_date(
        F.concat_ws("-", piece(1), F.lpad(piece(2), 2, "0"), F.lpad(piece(3), 2, "0")), "yyyy-MM-dd"
    ))


def _dates(window: Column) -> Column:
    """Distinct days in the text, in order."""
    raw = F.regexp_extract_all(window, F.lit(f"({DATE})"), 1)
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(raw, _date))))


def _scheme(compact: Column) -> Column:
    """The first scheme window that states an amount per ten units."""
    windows = F.regexp_extract_all(compact, F.lit(f"{SCHEME_WORD}(?=(.{{0,{SCHEME_WINDOW}}}))"), 1)
    cut = F.transform(windows, lambda w: F.get(F.split(w, SCHEME_END, 2), F.lit(0)))
    states = lambda w: F.regexp_replace(F.regexp_replace(w, r"(?<!\d)\d+\.\d+(?!\d)", ""), r"\s+", "").contains(
        PER_TEN_UNITS) & w.rlike(DECIMAL)
    return F.get(F.filter(cut, states), F.lit(0))


def distribution_facts(texts: DataFrame) -> DataFrame:
    """Amount per ten units and the on-exchange ex-date of each dividend notice, or why they are unknown."""
    compact = t.compact(F.col("text"))
    label = F.instr(F.col("_c"), EX_DATE_WORD)
    start = F.greatest(label - EX_WINDOW_BEFORE, F.lit(1))
    whole = F.substring(F.col("_c"), start, label + len(EX_DATE_WORD) + EX_WINDOW_AFTER - start)
    before_from = F.greatest(label - TABLE_BEFORE, F.lit(1))
    read = (
        texts.withColumn("_c", compact)
        .withColumn("_scheme", _scheme(F.col("_c")))
        .withColumn("_ten", t.number(t.group_or_null(F.col("_scheme"), DECIMAL)))
        .withColumn("_label", label)
        .withColumn("_window", F.when(label > 0, F.get(F.split(whole, EX_DATE_END, 2), F.lit(0))))
        .withColumn("_before", F.when(label > 0, F.substring(F.col("_c"), before_from, label - before_from)))
        .withColumn("_after_label", _date(t.group_or_null(F.col("_window"), f"({ON_EXCHANGE_AFTER})")))
        .withColumn("_before_label", _date(t.group_or_null(F.col("_window"), f"({ON_EXCHANGE_BEFORE})")))
        .withColumn("_table", F.when(F.size(_dates(F.col("_before"))) >= 2, _dates(F.col("_before"))).otherwise(_dates(F.col("_window"))))
    )
    fits = F.size("_table").between(2, 3) & (F.datediff(F.array_max("_table"), F.array_min("_table")) <= TABLE_DATE_SPAN)
    ex_date = F.coalesce("_after_label", "_before_label", F.when(fits, F.array_max("_table")))
    judged = read.withColumn("ex_date", ex_date).withColumn("failure_reason", _failure(
        (F.col("_c") != "", "no_text"),
        (F.col("_ten").isNotNull(), "scheme_not_found"),
        ((F.col("_ten") > 0) & (F.col("_ten") < 100), "amount_out_of_range"),
        (F.col("_label") > 0, "ex_date_table_not_found"),
        (F.col("ex_date").isNotNull(), "ex_date_not_confirmed"),
    ))
    ok = F.col("failure_reason").isNull()
    kept = [c for c in texts.columns if c != "text"]
    return judged.select(
        *kept, F.when(ok, F.col("ex_date")).alias("ex_date"), F.when(ok, F.col("_ten") / 10).alias("dpu_per_unit"),
        F.when(ok, F.col("_ten")).alias("disclosed_rmb_per_10_units"), "failure_reason",
        F.when(ok, "success").otherwise("failed").alias("retrieval_status"),
    )


# The strict one-pass layouts of the sample build.
STRICT_SHARES = r"报告期末基金份额总额\s+" + NUMBER + r"\s*份"
STRICT_SECTION = r"3\.3\.1\s*本报告期(?:及近三年)?的?可供分配金额(.+?)3\.3\.2"
STRICT_AMOUNTS = r"本期\s+(-?[\d,]+(?:\.\d+)?)\s+(-?[\d.]+|-)"


def strict_quarterly_facts(texts: DataFrame) -> DataFrame:
    """One pass with a single layout per fact; what does not match goes to the exclusions by its reason."""
    section = t.group_or_null(t.compact(F.col("text")), STRICT_SECTION)
    read = texts.withColumn("_c", t.compact(F.col("text"))).withColumn("_sec", section).select(
        *[c for c in texts.columns if c != "text"],
        t.number(t.group_or_null(F.col("_c"), STRICT_SHARES)).alias("fund_shares"),
        t.number(t.group_or_null(F.col("_sec"), STRICT_AMOUNTS, 1)).alias("distributable_amount_quarter"),
        t.number(t.group_or_null(F.col("_sec"), STRICT_AMOUNTS, 2)).alias("distributable_amount_per_unit_quarter"),
    )
    complete = (F.col("fund_shares").isNotNull() & F.col("distributable_amount_quarter").isNotNull()
                & F.col("distributable_amount_per_unit_quarter").isNotNull())
    return read.withColumn("status", F.when(complete, "extracted").otherwise("excluded"))


# Strict layouts of the yearly net value and of dividend notices.
STRICT_NAV = [
    r"报告截止日\s*\d{4}\s*年.*?基金份额净值(?:人民币)?\s*([\d.]+)\s*元",
    r"期末(?:不动产)?基金份额净\s*值\s*([\d.]+)",
    r"期末基金份额净\s+([\d.]+)\s+[\d.]+\s+[\d.]+\s+值",
]
STRICT_SCHEME = r"(?i)本次(?:公募\s*REITs\s*)?分红方案.{0,100}?([0-9]+\.\d+)"
STRICT_EX_SECTION = r"除息日(.{0,180}?)(?:现金红利发放日|分红对象)"
STRICT_DATE = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"


def strict_annual_nav(texts: DataFrame) -> DataFrame:
    """Net value per unit as the yearly report states it; none is worked out from other figures."""
    value = t.number(t.first_group(F.col("_c"), STRICT_NAV))
    return texts.withColumn("_c", t.compact(F.col("text"))).select(
        *[c for c in texts.columns if c != "text"], value.alias("nav_per_unit")
    ).withColumn("status", F.when(F.col("nav_per_unit").isNotNull(), "extracted").otherwise("excluded"))


def strict_distributions(texts: DataFrame) -> DataFrame:
    """Amount and ex-date in one pass: the on-exchange date, else the first date of the table. Unread notices are excluded rows."""
    section = F.col("_x")
    day = lambda e: F.try_to_date(F.regexp_replace(e, f"^.*?{STRICT_DATE}.*$", "$1-$2-$3"), "yyyy-M-d")
    marked = F.coalesce(
        t.group_or_null(section, f"(场内[：:]?\\s*{STRICT_DATE})"), t.group_or_null(section, f"({STRICT_DATE}\\s*[（(]场\\s*内)"),
        t.group_or_null(section, f"({STRICT_DATE})"))
    read = (
        texts.withColumn("_c", t.compact(F.col("text")))
        .withColumn("disclosed_rmb_per_10_units", t.number(t.group_or_null(F.col("_c"), STRICT_SCHEME)))
        .withColumn("_x", t.group_or_null(F.col("_c"), STRICT_EX_SECTION))
        .withColumn("ex_date", day(marked))
    )
    found = F.col("disclosed_rmb_per_10_units").isNotNull() & section.isNotNull()
    return read.select(
        *[c for c in texts.columns if c != "text"], "ex_date", (F.col("disclosed_rmb_per_10_units") / 10).alias("dpu_per_unit"),
        "disclosed_rmb_per_10_units", F.when(found, "extracted").otherwise("excluded").alias("status"))
