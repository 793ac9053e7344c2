"""Null and repeated ids: each row has a result of its own."""

import hashlib

import corpus_pipeline
from tests.llm import samples
from tests.llm.test_text_scans import benchmark, phrases_by_hand
from tidemark.llm import fm_index


def test_many_blocks_give_each_row_its_own_spans(spark, monkeypatch):
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", 3000)
    items = benchmark(spark)
    hit = next(r["text"] for r in items.collect() if len((r["text"] or "").split()) >= 13)
    own = spark.createDataFrame([(None, hit), (None, "clean words only"), (7, hit), (7, "other clean words")], "doc_id long, text string")
    docs = samples.documents(spark).select("doc_id", "text").union(own).cache()
    got = fm_index.judged(fm_index.find_phrases(docs, items, "doc_id", "text")).collect()
    mine = [(r["row"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in got]
    want = phrases_by_hand(samples.pairs(docs), [(r[0], r[1]) for r in items.collect()])
    assert samples.multiset(mine) == samples.multiset(want)


def test_pipeline_verdicts_go_by_row(spark):
    long = lambda k, end="": " ".join(f"q{k}z{j}" for j in range(100)) + end
    rows = [(1, long(1)), (2, long(1, " tail")), (2, long(2)), (3, long(3)), (3, long(4)), (4, long(5)), (4, long(5)), (5, long(6)), (5, long(6, " tail")),
            (None, long(1)), (6, None), (6, ""), (6, long(7)), (7, long(7, " tail"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, samples.SF).collect()]
    fifth = [r for r in got if r[0] == 5]
    assert len(fifth) == 1 and fifth[0] in rows
    want = [(1, long(1)), (2, long(2)), (3, long(3)), (3, long(4)), (4, long(5)), (None, long(1)), (6, None), (6, ""), (6, long(7))]
    assert samples.multiset(r for r in got if r[0] != 5) == samples.multiset(want)

    hit = next(r["text"] for r in spark.read.parquet(f"{samples.SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) >= 13)
    rows = [(None, hit), (None, long(1)), (None, None), (7, hit), (7, long(2)), (8, long(3))]
    got = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), samples.SF).collect()
    assert samples.multiset(map(tuple, got)) == samples.multiset(r for r in rows if r[1] != hit)
