"""Registered queries of the corpus operators over the driver tables, with oracle SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, columns, exact, fm_index, hilbert, mixing, odd_sketch, quality, rans, runs, secrets, urls, warc
from tidemark.llm.common import words_of
from tidemark.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SHARDS = 40


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


OP3_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
    lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
tags AS (
  SELECT url, host, path, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM parts WHERE url IS NOT NULL),
hrefs AS (
  SELECT url, host, path, CASE
    WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS href
  FROM tags),
targets AS (
  SELECT url, CASE WHEN contains(href, '://') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || host || href
    ELSE regexp_replace(regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || host || regexp_extract(path, '(?s)^(.*/)?'), '/*$', '') || '/' || href END AS target
  FROM hrefs WHERE href <> ''),
spelled AS (SELECT url AS u FROM pages UNION SELECT target FROM targets UNION SELECT url FROM targets),
addressed AS (
  SELECT u, h, p, CASE WHEN h <> '' THEN h || regexp_replace(p, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS address
  FROM (SELECT u, lower(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1)) AS h, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p,
    substr(regexp_replace('&' || regexp_extract(u, '(?s)^[^?#]*\?([^#]*)', 1), '&(?:utm_[a-z]+|ref)=[^&]*', '', 'g'), 2) AS q FROM spelled WHERE u IS NOT NULL)),
judged AS (
  SELECT u, address, h, p,
    CASE WHEN (h = 'example.net' OR ends_with(h, '.example.net')) AND starts_with(p, '/en/') THEN 'example.net/en/'
      WHEN (h = 'example.com' OR ends_with(h, '.example.com')) AND starts_with(p, '/de/') THEN 'example.com/de/'
      WHEN (h = 'org' OR ends_with(h, '.org')) AND starts_with(p, '/fr/') THEN 'org/fr/'
      WHEN (h = 'net' OR ends_with(h, '.net')) AND starts_with(p, '/') THEN 'net/' END AS rule
  FROM addressed),
edges AS (
  SELECT DISTINCT a.address AS a, b.address AS b FROM targets t JOIN addressed a ON a.u = t.url JOIN addressed b ON b.u = t.target
  WHERE a.address IS NOT NULL AND b.address IS NOT NULL AND a.address <> b.address),
reach(node, other) AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
  UNION SELECT r.node, e.b FROM reach r JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON e.a = r.other),
said AS (
  SELECT address, max(rule IN ('net/', 'example.com/de/')) AS block, max(rule IN ('example.net/en/', 'org/fr/')) AS allow
  FROM judged WHERE address IS NOT NULL AND rule IS NOT NULL GROUP BY address),
around AS (
  SELECT n.address, coalesce(bool_or(s.block), false) AS block, coalesce(bool_or(s.allow), false) AS allow
  FROM (SELECT DISTINCT address AS address, address AS other FROM addressed UNION SELECT node, other FROM reach) n LEFT JOIN said s ON s.address = n.other
  GROUP BY n.address)
SELECT p.page_id, p.host, p.path, j.rule,
  CASE WHEN j.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN j.rule IS NOT NULL THEN 'allow'
    WHEN a.block AND NOT a.allow THEN 'block' ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN judged j ON j.u = p.url LEFT JOIN around a ON a.address = j.address
"""


@query("op3_url_redirects", OP3_SQL)
def op3(spark, sf):
    judged = urls.judge(table(spark, sf, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _shard_columns(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))


def shard_cells() -> list:
    return [hilbert.by_hash("lang"), hilbert.by_hash("source"), hilbert.by_log(F.col("size"))]


@query("op4_hilbert_shards")
def op4(spark, sf):
    placed = hilbert.shard_runs(_shard_columns(table(spark, sf, "documents")), shard_cells(), "doc_id", SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        F.col("curve_index"))


OP7_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
sums AS (SELECT sum(source_size)::HUGEINT AS total, sum(weight)::HUGEINT AS weights FROM per),
rounds AS (
  SELECT 0 AS turn, total AS rest, weights AS weight FROM sums
  UNION ALL
  SELECT turn + 1, s.total - coalesce((SELECT sum(3 * source_size) FROM per WHERE 3 * source_size * r.weight < r.rest * per.weight), 0),
    s.weights - coalesce((SELECT sum(weight) FROM per WHERE 3 * source_size * r.weight < r.rest * per.weight), 0)
  FROM rounds r, sums s WHERE turn < 40 AND r.weight > 0),
last AS (SELECT arg_max(rest, turn)::DOUBLE AS rest, arg_max(weight, turn)::DOUBLE AS weight FROM rounds),
aimed AS (SELECT source, source_size, least(rest * per.weight / (CASE WHEN last.weight = 0 THEN 1 ELSE last.weight END), (3 * source_size)::DOUBLE) AS target FROM per, last),
rated AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 1.0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, coalesce(s.source || '/', '') || s.size)), 1, 8))::BIGINT / 4294967296.0 AS coin
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""


@query("op7_mix_sources", OP7_SQL)
def op7(spark, sf):
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@query("op9_quality_outliers")
def op9(spark, sf):
    judged = quality.judge(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query("op1_secret_spans")
def op1(spark, sf):
    docs = table(spark, sf, "documents")
    found = secrets.find_secrets(docs, secrets.fit(secrets.counts_from_rules(docs)))
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = secrets.KINDS[:3]
    return found.select(
        F.col("id").alias("doc_id"), *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed(of(base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size(of(["markov"])).cast("long").alias("n_markov"))


@query("op5_fm_index_phrases")
def op5(spark, sf):
    found = fm_index.judged(fm_index.find_phrases(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text"))
    return found.select(
        F.col("row").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_rans_tokens")
def op6(spark, sf):
    path = new_folder(spark, "tokens")
    rans.write_tokens(table(spark, sf, "documents"), path, tokenizer_path())
    ids = rans.read_tokens(spark, path)
    return ids.select(
        F.col("key").alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))


# SHA-1 in SQL is a hex text; twenty bits (five digits) give four base32 letters.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (k // 4) + 1)::BIGINT, 5))::BIGINT) >> (5 * (3 - k % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""


@query("op8_warc_archives", OP8_SQL)
def op8(spark, sf):
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_archives(spark.read.parquet(path), payloads=False).drop("url", "payload", "record_id", "refers_to_id")


@query("op2_odd_sketch_components")
def op2(spark, sf):
    return odd_sketch.similar_texts(table(spark, sf, "documents"), width=2, percent=80).withColumnRenamed("id", "doc_id")


@query("op10_column_construction")
def op10(spark, sf):
    out = columns.remove_repeats(table(spark, sf, "documents"), texts=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


def rewritten(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words from place a on replaced by repeats of p words, where the hash of the doc_id says so."""
    docs = docs.select("doc_id", "text")
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = words_of(F.col("text"))
    n, g = F.col("__n"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    new = F.expr("array_join(transform(__words, (w, i) -> if(i < __a, w, __words[cast(__a + (i - __a) % __p as int)])), ' ')")
    chosen = docs.where(F.pmod(h, F.lit(10)) == 0).withColumn("__words", words).withColumn("__n", F.size("__words")).where("__n > 0")
    changed = chosen.withColumn("__a", a.cast("long")).withColumn("__p", p.cast("long")).select("doc_id", new.alias("text"))
    same = docs.where((F.pmod(h, F.lit(10)) != 0) | h.isNull() | (F.size(words) == 0))
    return changed.union(same)


@query("op11_periodic_runs")
def op11(spark, sf):
    found = runs.find_runs(rewritten(table(spark, sf, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", first)
    length = -F.col("best.l")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


@query("op12_token_alignment")
def op12(spark, sf):
    import public_tokenizers

    sha = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    found = alignment.align(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), summaries={"groups_sha256": sha})
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP13_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM documents),
g AS (SELECT doc_id, normal, max(doc_id) OVER (PARTITION BY normal) AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM g
"""


@query("op13_exact_duplicates", OP13_SQL)
def op13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", exact.digest(F.col("text")).alias("text_sha256"))
    return exact.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
