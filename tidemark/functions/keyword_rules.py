"""Keyword rules: tables of (label, words) turned into one CASE expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of security names -> asset type, first match wins.
ASSET_TYPE_NAME_WORDS = [
    ("data_center", ["数据中心"]),
    ("rental_housing", ["租赁住房", "保障房", "安居", "有巢", "宽庭"]),
    ("toll_road", ["高速", "交控", "交投", "隧道"]),
    ("logistics", ["仓储", "物流", "普洛斯", "安博"]),
    ("industrial_park", ["产业园", "产园", "高科", "科创", "软件园", "光谷", "智造"]),
    ("retail", ["消费", "商业", "奥莱", "市场", "百联", "印力", "凯德", "物美"]),
    ("renewable", ["清洁能源", "新能源", "光伏", "风电"]),
    ("heating", ["供热"]),
    ("water", ["水务", "水利"]),
]

# Words of official titles -> asset type, first match wins.
ASSET_TYPE_TITLE_WORDS = [
    ("data_center", ["数据中心"]),
    ("rental_housing", ["租赁住房", "保障性住房", "保障房", "保租房"]),
    ("toll_road", ["高速公路", "高速封闭式基础设施", "收费公路", "跨海大桥"]),
    ("logistics", ["仓储物流", "物流仓储", "物流基础设施", "医药仓储"]),
    ("industrial_park", ["产业园", "软件园", "科创孵化器"]),
    ("retail", ["消费", "购物中心", "奥特莱斯", "农贸市场"]),
    ("water", ["水务", "原水水利"]),
    ("heating", ["供热"]),
    ("waste_to_energy", ["生物质"]),
    ("renewable", ["清洁能源", "新能源"]),
    ("commercial_property", ["商业不动产"]),
]

# Title patterns -> event type, last match wins.
EVENT_TYPE_PATTERNS = [
    ("expansion", "扩募"),
    ("fund_rename", "变更名称|更名"),
    ("termination", "终止上市|终止基金合同|退市|摘牌"),
]

# Title patterns -> stage of an expansion, last match wins.
EXPANSION_STAGE_PATTERNS = [
    ("proposal", "拟扩募|决定.*扩募"),
    ("application_submitted", "提交.*申请"),
    ("application_accepted", "获得受理|申请受理"),
    ("exchange_feedback", "反馈意见"),
    ("approval_or_registration", "准予注册|审核通过|获得.*批复"),
    ("offering", "询价|发售|认购|定价"),
    ("expansion_units_listing_notice", "扩募份额上市交易"),
    ("asset_closing_disclosure", "交割审计|完成交割"),
]


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_label(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the first rule with a word in ``text``, null when none has."""
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(label)) for label, words in rules])


def first_word(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The word that made ``first_label`` match."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for _, words in rules for w in words])


def last_label(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the last rule whose pattern is found in ``text``, null when none is."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in reversed(rules)])
