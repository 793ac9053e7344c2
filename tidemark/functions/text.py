"""Text helpers: whitespace, numbers, dates and the reading of announcement titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report words, excluded title words and correction marks.
DISTRIBUTION_WORD = "收益分配"
EXCLUDED_TITLE_WORDS = ["摘要", "评估报告", "审计报告", "提示性公告", "更正公告"]
REPORT_WORDS = [
    ("annual_report", ["年度报告"]),
    ("quarterly_report", ["季度报告"]),
    ("semiannual_report", ["中期报告", "半年度报告"]),
]
CORRECTION_WORD = "更正稿"
CORRECTION_SUFFIX = "（更正）"
YEAR_PATTERN = "(20[0-9]{2})年"
CHINESE_YEAR_PATTERN = "([二〇零0一二三四五六七八九]{4})年"
CHINESE_DIGITS = ("〇零0一二三四五六七八九", "000123456789")
QUARTER_PATTERN = "第?([一二三四1234])季度"
QUARTER_DIGITS = ("一二三四", "1234")
EXCHANGE_PREFIXES = [("SSE", ["508"]), ("SZSE", ["180", "181"])]


def compact(text: Column) -> Column:
    """Runs of any white space, full-width forms included, become one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def number(text: Column) -> Column:
    """Digits with thousands commas to a double; anything else is null."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def group_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def first_group(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The captured group of the first pattern that matches at all."""
    return F.coalesce(*[group_or_null(text, p, group) for p in patterns])


def zero_padded(number: Column, digits: int) -> Column:
    """At least so many digits; longer numbers keep all of theirs."""
    written = number.cast("string")
    return F.when(F.length(written) < digits, F.lpad(written, digits, "0")).otherwise(written)


def security_code(raw: Column) -> Column:
    """Codes have six digits or more, so that keys beyond a million stay apart."""
    return zero_padded(raw, 6)


def exchange_of(symbol: Column) -> Column:
    expr = F.lit("UNKNOWN")
    for name, prefixes in EXCHANGE_PREFIXES:
        expr = F.when(F.substring(symbol, 1, 3).isin(prefixes), F.lit(name)).otherwise(expr)
    return expr


def base_document_type(document_type: Column) -> Column:
    return F.regexp_replace(document_type, "_corrected$", "")


def is_corrected(document_type: Column) -> Column:
    return document_type.endswith("_corrected")


def document_type_of(title: Column, original_type: Column) -> Column:
    """Ordered rules over title and exchange category; the first that holds decides."""
    from tidemark.functions.keyword_rules import contains_any

    both = F.concat_ws(" ", title, original_type)
    suffix = F.when(
        title.contains(CORRECTION_WORD) | title.endswith(CORRECTION_SUFFIX), F.lit("_corrected")
    ).otherwise(F.lit(""))
    expr = F.when(both.contains(DISTRIBUTION_WORD), F.lit("distribution_announcement")).when(
        contains_any(title, EXCLUDED_TITLE_WORDS), F.lit("other")
    )
    for label, words in REPORT_WORDS:
        expr = expr.when(contains_any(both, words), F.concat(F.lit(label), suffix))
    return expr.otherwise(F.lit("other"))


def title_year(title: Column) -> Column:
    """Year in Arabic digits, else in Chinese digits when those give 20xx."""
    written = F.translate(group_or_null(title, CHINESE_YEAR_PATTERN), *CHINESE_DIGITS)
    written = F.when(written.rlike("^20[0-9]{2}$"), written)
    return F.coalesce(group_or_null(title, YEAR_PATTERN), written).cast("int")


def period_end_of(title: Column, document_type: Column) -> Column:
    year = title_year(title)
    base = base_document_type(document_type)
    quarter = F.translate(group_or_null(title, QUARTER_PATTERN), *QUARTER_DIGITS).cast("int")
    month = (
        F.when(base == "annual_report", F.lit(12))
        .when(base == "semiannual_report", F.lit(6))
        .when(base == "quarterly_report", quarter * 3)
    )
    return F.last_day(F.make_date(year, month, F.lit(1)))
