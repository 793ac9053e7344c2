"""Metric patterns read only the pieces of a text that can hold a match: same matches as the patterns over whole texts, one by one."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import extraction as x


def whole(texts, keys):
    """The plain form: each pattern over each whole text, its matches read again for their groups."""
    parts = []
    for metric, words, units in x.METRIC_WORDS:
        regex = f"(?iu)((?:{words}){x.METRIC_GAP}(-?\\d[\\d,]*(?:\\.\\d+)?)\\s*({units}))"
        raw = texts.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(regex), 1)).alias("raw"))
        parts.append(raw.select(*keys, F.lit(metric).alias("metric"), F.replace(F.regexp_extract("raw", regex, 2), F.lit(","), F.lit("")).try_cast("double").alias("value"),
                                F.regexp_extract("raw", regex, 3).alias("unit"), F.trim("raw").alias("raw_text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


WORDS = ["出租率", "OCCUPANCY", "可供出租建筑面积", "rentable Area", "已出租面积", "平均租金", "租金收缴率", "前五大租户2023年占比", "租户集中度", "日均自然车流量", "客车车流量", "货车日均自然车流量", "车流量",
         "traffic volume", "通行费收入", "发电量", "utiliSation hours", "等效利用小时数", "结算电量", "结算电价", "settlement tariff", "营业收入", "Revenue", "运营净收益", "NOI", "xNOI", "可供分配金额",
         "每份分派", "dpu", "DPUs", "İ", "ß", "ŉ", "K", "leased area", "toll Revenue"]
UNITS = ["%", "％", "平方米", "sq. m", "sq.\n m", "SQ M", "元/平方米/天", "辆次", "辆/日", "亿元", "元", "RMB", "rmb", "GWh", "小时", "hours", "元/千瓦时", "RMB/kWh", "元/份", "m", ""]
NUMBERS = ["5", "-5", "1,234.50", "1.2.3", "12,", "1.5,", "2023年12", "0.1234", "7 ", "8\n", "9 \n ", "--3", "1,234,567.89 0.12"]
BETWEEN = ["", "", "为", " ", "：", "。", "；", ";", "\n", " \n", "约", "无" * 30, "无" * 200, ", ", "q\n", "a", "本期 1 ", "́", "客车", "货车", "."]


def test_pieces_give_the_matches_of_whole_texts(spark):
    rng = random.Random(23)
    pick = rng.choice
    texts = [(i, "".join(pick(BETWEEN) + pick(pick([WORDS, WORDS, NUMBERS, UNITS, [pick(WORDS) + pick(BETWEEN) + pick(NUMBERS) + pick(UNITS)]])) for _ in range(rng.randrange(1, 40))))
             for i in range(5000)] + [(-1, None), (-2, "")]
    rows = spark.createDataFrame(texts, "id int, text string").repartition(4).cache()
    want, got = [sorted(map(tuple, f(rows, ["id"]).collect()), key=repr) for f in (whole, x.metric_candidates)]
    assert got == want and len(want) > 2000 and len({r[1] for r in want}) > 14
    rows.unpersist()


def test_the_tables_of_words_fit_what_the_reading_of_pieces_takes_for_granted():
    for metric, words, units in x.METRIC_WORDS:
        assert x._first_letters(words), metric
        assert not re.search(r"[。；;]", words.replace("[^。；;\\n]", "")) and not re.search(r"[。；;\d]", units), metric
        assert all(not re.match(r"[\s\d,.]", u) for u in units.split("|")), metric
        for literal in x.METRIC_LITERALS[metric]:
            assert not x._cased(literal) or re.search("[a-hj-jl-rt-z]{2}", literal), literal


def test_a_pattern_reads_no_text_before_its_literal_nor_other_sentences(spark):
    """Before, each pattern with a literal anywhere went through the whole text: here that is far more than the pieces that hold it."""
    long = "无" * 50 + "。"
    rows = spark.createDataFrame([(1, long * 2000 + "出租率为 95.5%；" + "营业收入" + long * 2000)], "id int, text string")
    found = x.metric_candidates(rows, ["id"])
    assert [tuple(r) for r in found.collect()] == [(1, "occupancy", 95.5, "%", "出租率为 95.5%")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(_read" in plan and "regexp_extract_all(text" not in plan
