"""The domain tables of ``domain.py`` again, as plain SQL for the checking engine.

``sql(body, ...)`` puts the views a query needs, and those they need, in front of it.
"""

from __future__ import annotations

import re

from tidemark.plans.domain import EXPANSION_TITLES, TITLE_WORDS

QEND = "last_day(date_trunc('quarter', {d}) + INTERVAL 2 MONTH)"


def qend(d: str) -> str:
    return f"CAST(last_day(CAST(date_trunc('quarter', {d}) + INTERVAL 2 MONTH AS DATE)) AS DATE)"


def shift_q(d: str, n: str) -> str:
    return f"CAST(last_day(CAST(date_trunc('quarter', {d}) + to_months(CAST(2 - 3 * ({n}) AS INTEGER)) AS DATE)) AS DATE)"


def friday(d: str) -> str:
    return f"CAST(CAST(date_trunc('week', {d} + 2) AS DATE) + 4 AS DATE)"


def code(k: str) -> str:
    return padded(k, 6)


def padded(k: str, digits: int) -> str:
    return f"(CASE WHEN length(CAST({k} AS VARCHAR)) < {digits} THEN lpad(CAST({k} AS VARCHAR), {digits}, '0') ELSE CAST({k} AS VARCHAR) END)"


def fund_code(k: str) -> str:
    return f"(CASE ({k}) % 3 WHEN 0 THEN '508' WHEN 1 THEN '180' ELSE '181' END || {padded(f'(({k}) // 3)', 3)})"


def pick(words: list[str], index: str) -> str:
    items = ", ".join("'" + w + "'" for w in words)
    return f"([{items}])[CAST(({index}) AS INTEGER) + 1]"


def add20(d: str) -> str:
    return f"CAST({d} + INTERVAL 240 MONTH AS DATE)"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def four(n: str) -> str:
    return f"(CAST(({n}) // 10000 AS VARCHAR) || '.' || lpad(CAST(({n}) % 10000 AS VARCHAR), 4, '0'))"


def cn(d: str) -> str:
    return f"(CAST(year({d}) AS VARCHAR) || '年' || CAST(month({d}) AS VARCHAR) || '月' || CAST(day({d}) AS VARCHAR) || '日')"


def money(c: str) -> str:
    return f"(format('{{:,}}', CAST({c} // 100 AS BIGINT)) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def corr(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0))"


def avg_rank(value: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) "
            f"+ (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0)")


def pct_rank(value: str, part: str) -> str:
    return f"({avg_rank(value, part)} / count(*) OVER (PARTITION BY {part}))"


VIEWS: dict[str, str] = {}

VIEWS["lines"] = """
SELECT l_suppkey, l_linenumber, l_returnflag, CAST(l_quantity AS BIGINT) AS qty,
       CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS pct,
       CAST(l_shipdate AS DATE) AS date
FROM lineitem"""

VIEWS["prices"] = f"""
SELECT {code('l_suppkey')} AS symbol, date, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE / CAST(sum(qty) AS BIGINT) AS close,
       CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS turnover
FROM lines GROUP BY ALL"""

VIEWS["bench"] = """
SELECT date, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE / CAST(sum(qty) AS BIGINT) AS close FROM lines GROUP BY date"""

VIEWS["nprices"] = f"""
SELECT {code('s_nationkey')} AS symbol, {friday('date')} AS date,
       CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE / CAST(sum(qty) AS BIGINT) AS close, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS turnover
FROM lines JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"""

VIEWS["nbench"] = f"""
SELECT {friday('date')} AS date, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE / CAST(sum(qty) AS BIGINT) AS close FROM lines GROUP BY 1"""

VIEWS["obs_base"] = f"""
SELECT {code('s_nationkey')} AS symbol, 'A' || lpad(CAST(l_suppkey % 16 AS VARCHAR), 2, '0') AS asset_id, {qend('date')} AS period_end,
       CAST(20 + (l_suppkey % 16 + s_nationkey) % 21 AS INTEGER) AS delay,
       CAST(sum(qty) FILTER (l_returnflag <> 'R') AS BIGINT) AS q1, CAST(sum(cents) FILTER (l_returnflag <> 'R') AS BIGINT) AS r1,
       CAST(sum(cents * pct) FILTER (l_returnflag <> 'R') AS BIGINT) AS d1,
       CAST(sum(qty) AS BIGINT) AS q2, CAST(sum(cents) AS BIGINT) AS r2, CAST(sum(cents * pct) AS BIGINT) AS d2
FROM lines JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL"""

VIEWS["obs_long"] = """
SELECT symbol, asset_id, period_end, 'quantity' AS metric, q1 / 1.0::DOUBLE AS value, 'units' AS unit, CAST(period_end + delay AS DATE) AS publication_date FROM obs_base
UNION ALL SELECT symbol, asset_id, period_end, 'revenue', r1 / 100.0::DOUBLE, 'RMB', CAST(period_end + delay AS DATE) FROM obs_base
UNION ALL SELECT symbol, asset_id, period_end, 'discount_value', d1 / 10000.0::DOUBLE, 'RMB', CAST(period_end + delay AS DATE) FROM obs_base
UNION ALL SELECT symbol, asset_id, period_end, 'quantity', q2 / 1.0::DOUBLE, 'units', CAST(period_end + 180 AS DATE) FROM obs_base
UNION ALL SELECT symbol, asset_id, period_end, 'revenue', r2 / 100.0::DOUBLE, 'RMB', CAST(period_end + 180 AS DATE) FROM obs_base
UNION ALL SELECT symbol, asset_id, period_end, 'discount_value', d2 / 10000.0::DOUBLE, 'RMB', CAST(period_end + 180 AS DATE) FROM obs_base"""

VIEWS["obs"] = """
SELECT *, 'https://disclosure.example/D' || symbol || strftime(period_end, '%Y%m%d') || strftime(publication_date, '%Y%m%d') AS source_url
FROM obs_long WHERE value IS NOT NULL"""

VIEWS["registry"] = """
SELECT 'D' || symbol || strftime(period_end, '%Y%m%d') || strftime(publication_date, '%Y%m%d') AS document_id, symbol,
       CASE WHEN quarter(period_end) = 4 THEN 'annual_report' ELSE 'quarterly_report' END AS document_type, period_end, publication_date, source_url,
       CASE WHEN quarter(period_end) % 2 = 1 THEN 'human_verified' ELSE 'metadata_verified' END AS verification_status,
       CASE WHEN publication_date = period_end + 180 AND min(publication_date) OVER (PARTITION BY symbol, period_end) < publication_date
            THEN 'D' || symbol || strftime(period_end, '%Y%m%d') || strftime(min(publication_date) OVER (PARTITION BY symbol, period_end), '%Y%m%d') END AS supersedes_document_id,
       CASE WHEN quarter(period_end) % 2 = 1 THEN sha256('D' || symbol || strftime(period_end, '%Y%m%d') || strftime(publication_date, '%Y%m%d')) END AS content_sha256
FROM (SELECT DISTINCT symbol, period_end, publication_date, source_url FROM obs)"""

VIEWS["assets"] = f"""
SELECT DISTINCT {code('s_nationkey')} AS symbol, 'A' || lpad(CAST(s_suppkey % 16 AS VARCHAR), 2, '0') AS asset_id,
       {pick(['hydro', 'wind', 'toll_road', 'water'], 's_nationkey % 4')} AS asset_type, DATE '1995-01-01' AS asset_effective_from
FROM supplier"""

VIEWS["definitions"] = """
SELECT symbol, asset_type, symbol || '_' || metric AS feature_id, metric, 'sum' AS aggregation, asset_ids, 4 AS comparison_lag_quarters, asset_list
FROM (SELECT symbol, asset_type, (['quantity', 'revenue', 'discount_value'])[CAST(symbol AS INTEGER) % 3 + 1] AS metric,
             string_agg(asset_id, '|' ORDER BY asset_id) AS asset_ids, list(asset_id ORDER BY asset_id) AS asset_list
      FROM assets GROUP BY symbol, asset_type)"""

VIEWS["versions"] = """
SELECT symbol || ':' || asset_id || ':' || strftime(o.period_end, '%Y%m%d') || ':' || metric || ':' || document_id AS observation_id,
       symbol, asset_id, period_end, metric, value, unit, value AS raw_value, unit AS raw_unit, document_id, publication_date AS valid_from,
       lead(publication_date) OVER k AS valid_to,
       lag(symbol || ':' || asset_id || ':' || strftime(o.period_end, '%Y%m%d') || ':' || metric || ':' || document_id) OVER k AS supersedes_observation_id,
       CASE WHEN verification_status = 'human_verified' THEN 'verified' ELSE 'unverified' END AS quality_status, source_url
FROM (SELECT obs.*, registry.document_id, registry.verification_status FROM obs JOIN registry USING (source_url)) o
WINDOW k AS (PARTITION BY symbol, asset_id, period_end, metric ORDER BY publication_date)"""

VIEWS["ord"] = """
SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS date, o_orderstatus FROM orders"""

VIEWS["distr"] = f"""
SELECT {code('slot')} AS symbol, publication_date, CAST(publication_date + CAST(1 + slot % 5 AS INTEGER) AS DATE) AS ex_date, c / 1000000.0::DOUBLE AS dpu_per_unit,
       c / 1000000.0::DOUBLE * 10 AS disclosed_rmb_per_10_units,
       'https://disclosure.example/P' || {code('slot')} || strftime(publication_date, '%Y%m%d') AS source_url,
       CASE WHEN month(publication_date) % 2 = 0 THEN 'machine_extracted_official_pdf' ELSE 'visual_verified_official_pdf' END AS verification_status
FROM (SELECT o_custkey % 25 AS slot, date AS publication_date, CAST(sum(cents) AS BIGINT) AS c FROM ord GROUP BY 1, 2)"""

VIEWS["facts_base"] = f"""
SELECT o_custkey % 25 AS slot, {qend('date')} AS period_end, CAST(sum(cents) AS BIGINT) AS c, count(*) AS n FROM ord GROUP BY 1, 2"""

VIEWS["facts"] = f"""
SELECT {code('slot')} AS symbol, period_end, CAST(period_end + CAST(30 + slot % 15 AS INTEGER) AS DATE) AS publication_date, document_type, metric, value, unit,
       'https://disclosure.example/F' || {code('slot')} || strftime(period_end, '%Y%m%d') AS source_url,
       sha256('https://disclosure.example/F' || {code('slot')} || strftime(period_end, '%Y%m%d')) AS source_sha256,
       CASE WHEN quarter(period_end) % 2 = 0 THEN 'machine_extracted_official_pdf' ELSE 'visual_verified_official_pdf' END AS verification_status
FROM (
  SELECT *, 'fund_shares' AS metric, n * 1000000.0::DOUBLE AS value, 'shares' AS unit, 'quarterly_report' AS document_type FROM facts_base
  UNION ALL SELECT *, 'distributable_amount_quarter', c / 100.0::DOUBLE, 'RMB', 'quarterly_report' FROM facts_base
  UNION ALL SELECT *, 'distributable_amount_per_unit_quarter', floor(c / 100.0::DOUBLE / (n * 1000000.0::DOUBLE) * 10000 + 0.5) / 10000.0::DOUBLE, 'RMB_per_unit', 'quarterly_report' FROM facts_base
  UNION ALL SELECT *, 'nav_per_unit', floor(c / n::DOUBLE / 25000.0::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE, 'RMB_per_unit', 'annual_report' FROM facts_base)"""

_TITLES = {
    0: f"y || '年第' || {pick(['一', '二', '三', '四'], 'k % 4')} || '季度报告'",
    1: "y || '年年度报告'",
    2: "y || '年中期报告'",
    3: "'关于收益分配的公告'",
    4: f"y || '年第' || {pick(['一', '二', '三', '四'], 'k % 4')} || '季度报告（更正）'",
    5: "y || '年年度报告摘要'",
    6: pick(EXPANSION_TITLES, "(k // 16) % 9"),
    7: "'关于变更名称的公告'",
    8: "'关于终止上市的公告'",
    9: "y || '年半年度报告更正稿'",
    10: "translate(y, '0123456789', '〇一二三四五六七八九') || '年年度报告'",
    11: "'基金经理变更公告'",
    12: f"CASE WHEN lot % 7 = 0 THEN {pick(TITLE_WORDS, '(lot + 1) % 12')} ELSE '' END || '审计报告'",
    13: "y || '年3季度报告'",
    14: "'持有人大会公告'",
    15: "y || '年年度报告更正公告'",
}

VIEWS["ann_orders"] = f"""
SELECT 'N' || lpad(CAST(k AS VARCHAR), 12, '0') AS announcement_id, symbol, publication_date,
       symbol || {pick(TITLE_WORDS, 'lot % 12')} || 'REIT' || CASE k % 16 {" ".join(f"WHEN {k} THEN {e}" for k, e in _TITLES.items())} END AS title,
       CASE WHEN k % 16 = 3 THEN '权益分派' ELSE '定期公告' END AS original_type
FROM (SELECT o_orderkey AS k, o_custkey % 1000 AS lot, {fund_code('o_custkey')} AS symbol, {add20('date')} AS publication_date,
             CAST(year({add20('date')}) - 1 AS VARCHAR) AS y FROM ord)"""

VIEWS["ann"] = f"""
SELECT *, '公告' AS bulletin_type, 'https://exchange.example/' || announcement_id AS source_url,
       CASE WHEN left(symbol, 3) = '508' THEN 'SSE' WHEN left(symbol, 3) IN ('180', '181') THEN 'SZSE' ELSE 'UNKNOWN' END AS exchange, 'official' AS catalog_status
FROM (SELECT * FROM ann_orders
      UNION ALL
      SELECT 'L' || symbol, symbol, CAST(DATE '2015-01-31' + CAST(key * 37 % 1500 AS INTEGER) AS DATE),
             symbol || {pick(TITLE_WORDS, 'key % 1000 % 12')} || 'REIT上市交易提示性公告', '上市公告'
      FROM (SELECT {fund_code('c_custkey')} AS symbol, min(c_custkey) AS key FROM customer GROUP BY 1))"""

VIEWS["cat_typed"] = """
SELECT *, CASE
  WHEN contains(title || ' ' || original_type, '收益分配') THEN 'distribution_announcement'
  WHEN regexp_matches(title, '摘要|评估报告|审计报告|提示性公告|更正公告') THEN 'other'
  WHEN contains(title || ' ' || original_type, '年度报告') THEN 'annual_report' || c
  WHEN contains(title || ' ' || original_type, '季度报告') THEN 'quarterly_report' || c
  WHEN regexp_matches(title || ' ' || original_type, '中期报告|半年度报告') THEN 'semiannual_report' || c
  ELSE 'other' END AS document_type_candidate
FROM (SELECT *, CASE WHEN contains(title, '更正稿') OR suffix(title, '（更正）') THEN '_corrected' ELSE '' END AS c FROM ann)"""

VIEWS["cat"] = """
SELECT * EXCLUDE (c, base, y, m), CASE WHEN y IS NOT NULL AND m IS NOT NULL THEN CAST(last_day(make_date(y, m, 1)) AS DATE) END AS period_end_candidate
FROM (
  SELECT *, CASE base WHEN 'annual_report' THEN 12 WHEN 'semiannual_report' THEN 6 WHEN 'quarterly_report' THEN
      3 * TRY_CAST(translate(nullif(regexp_extract(title, '第?([一二三四1234])季度', 1), ''), '一二三四', '1234') AS INTEGER) END AS m
  FROM (
    SELECT *, replace(document_type_candidate, '_corrected', '') AS base,
      coalesce(TRY_CAST(nullif(regexp_extract(title, '(20[0-9]{2})年', 1), '') AS INTEGER),
               TRY_CAST(nullif(regexp_extract(translate(regexp_extract(title, '([二〇零0一二三四五六七八九]{4})年', 1), '〇零0一二三四五六七八九', '000123456789'), '^20[0-9]{2}$'), '') AS INTEGER)) AS y
    FROM cat_typed))"""

VIEWS["texts"] = f"""
SELECT 'N' || lpad(CAST(k AS VARCHAR), 12, '0') AS announcement_id, symbol, publication_date, 'https://exchange.example/N' || lpad(CAST(k AS VARCHAR), 12, '0') AS source_url,
  coalesce(prose, '') || chr(10) ||
  CASE k % 5 WHEN 0 THEN '报告期末基金份额总额 ' || s || ' 份' WHEN 1 THEN '报告期末基金份额总额（单位：份） ' || s WHEN 2 THEN '报告期期末基金份额总额 ' || s
    WHEN 3 THEN '报告截止日 ' || y || ' 年 12 月 31 日 ，基金份额总额为 ' || s || ' 份' ELSE '份额未披露' END || chr(10) ||
  CASE k % 6 WHEN 1 THEN h || '本期 ' || a || ' - ' || p || ' 3.3.2 其他' WHEN 2 THEN h || repeat('无', 1600) || h || '本期 -' || a || ' -' || p || ' 3.3.2 其他'
    WHEN 5 THEN ' 可供分配金额未披露' ELSE h || '本期 ' || a || ' ' || p || ' 3.3.2 其他' END ||
  CASE k % 4 WHEN 0 THEN ' 期末不动产基金份额净 值 ' || nav WHEN 1 THEN ' 期末基金份额净值 ' || nav WHEN 2 THEN ' 期末基金份额净 ' || nav || ' 1.2 3.4 值'
    ELSE ' 报告截止日：' || y || ' 年 12 月 31 日，基金份额净值为人民币 ' || nav || ' 元' END ||
  CASE WHEN k % 7 = 6 THEN ' 本次分红方案见附件 除息日' ELSE ' 本次公募REITs分红方案（单位：元/10 份） ' || dpu || ' 注：数值四舍五入 除息日 ' ||
    CASE k % 7 WHEN 0 THEN '场内：' || {cn('ex')} || ' 场外：' || {cn('(ex - 1)')}
      WHEN 1 THEN strftime(ex, '%Y-%m-%d') || '（场内） ' || strftime(ex - 1, '%Y-%m-%d') || '（场外）'
      WHEN 2 THEN '日期（场 日期（场 ' || {cn('(ex - 1)')} || ' ' || {cn('ex')} || ' 内）外）'
      WHEN 3 THEN '日期 ' || {cn('ex')} ELSE '场内' || {cn('ex')} END ||
    ' 现金红利发放日 ' || {cn('(ex + 3)')} || ' 分红对象' END ||
  ' 出租率为 ' || (k % 100) || '.5%；日均自然车流量 ' || (k % 9000 + 10) || ' 辆次，客车车流量 ' || (k % 700 + 1) || ' 辆。货车日均自然车流量约 ' || (k % 300 + 1) ||
  ' 辆/日；通行费收入 ' || a || ' 元；Revenue was ' || a || ' RMB; 结算电价 0.' || (k % 9 + 1) || ' 元/千瓦时' || chr(10) AS text,
  k
FROM (SELECT o_orderkey AS k, {fund_code('o_custkey')} AS symbol, {add20('date')} AS publication_date, documents.text AS prose,
        format('{{:,}}', CAST(100000000 + o_orderkey * 1000 AS BIGINT)) AS s, {money('cents')} AS a, ' 3.3.1 本报告期的可供分配金额 项目 金额 ' AS h,
        {four('cents * 100 // (100000000 + o_orderkey * 1000)')} AS p, {four('10000 + o_orderkey % 90000')} AS nav, {four('cents % 90000 + 1')} AS dpu,
        CAST(year({add20('date')}) - 1 AS VARCHAR) AS y, CAST({add20('date')} + CAST(1 + o_orderkey % 9 AS INTEGER) AS DATE) AS ex
      FROM ord LEFT JOIN documents ON doc_id = o_orderkey)"""

VIEWS["universe"] = f"""
SELECT snapshot_date, symbol, symbol || {pick(TITLE_WORDS, 'lot % 12')} || CASE WHEN lot % 5 = 0 THEN '...' ELSE 'REIT' END AS name,
  CASE WHEN left(symbol, 3) = '508' THEN 'SSE' WHEN left(symbol, 3) IN ('180', '181') THEN 'SZSE' ELSE 'UNKNOWN' END AS exchange,
  'quote list' AS source_name, 'https://quote.example/list' AS source_url, CASE WHEN lot % 5 = 0 THEN 'needs_name_review' ELSE 'source_observed' END AS record_status
FROM (SELECT DISTINCT CAST(last_day({add20('date')}) AS DATE) AS snapshot_date, {fund_code('o_custkey')} AS symbol, o_custkey % 1000 AS lot FROM ord)"""

VIEWS["weather"] = f"""
SELECT 'grid_' || lpad(CAST(g AS VARCHAR), 2, '0') AS grid_point_id, time, coalesce(qty, 0) / 10.0::DOUBLE AS precipitation_sum, coalesce(qty, 0) / 20.0::DOUBLE AS rain_sum,
  coalesce(pct, 0) / 8.0::DOUBLE AS snowfall_sum, (dayofyear(time) % 40) - 5 + coalesce(pct, 0) / 16.0::DOUBLE AS temperature_2m_mean,
  coalesce(qty, 0) / 40.0::DOUBLE + 1.0 AS et0_fao_evapotranspiration
FROM (SELECT CAST(unnest(generate_series(CAST(date_trunc('quarter', min(date)) AS TIMESTAMP), CAST({qend('max(date)')} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS time FROM lines)
JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS g) ON true
LEFT JOIN (SELECT l_linenumber, date, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(pct) AS BIGINT) AS pct FROM lines GROUP BY 1, 2) ON l_linenumber = g AND date = time"""

VIEWS["weights"] = """
SELECT 'grid_' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS grid_point_id, n / (sum(n) OVER ())::DOUBLE AS area_weight
FROM (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1)"""

VIEWS["annual_base"] = f"""
SELECT {code('s_nationkey')} AS symbol, year(date) AS y, CAST(sum(qty) AS BIGINT) AS p, CAST(coalesce(sum(qty) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS c
FROM lines JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"""

VIEWS["polygon"] = f"""
SELECT {code('s_nationkey')} AS area_id, seq,
  floor((100.0 + s_nationkey + (0.2 + share * 3.0) * ([0.866, 0.5, 0.0, -0.5, -0.866, -1.0, -0.866, -0.5, 0.0, 0.5, 0.866, 1.0]::DOUBLE[])[seq]) * 10000 + 0.5) / 10000.0::DOUBLE AS lon,
  floor((25.0 + (0.2 + share * 3.0) * ([0.5, 0.866, 1.0, 0.866, 0.5, 0.0, -0.5, -0.866, -1.0, -0.866, -0.5, 0.0]::DOUBLE[])[seq]) * 10000 + 0.5) / 10000.0::DOUBLE AS lat
FROM (SELECT s_nationkey, seq, c / CAST(sum(c) OVER (PARTITION BY s_nationkey) AS DOUBLE) AS share
      FROM (SELECT s_nationkey, CAST(month(date) AS INTEGER) AS seq, CAST(sum(cents) AS BIGINT) AS c FROM lines JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2))"""


def needed(body: str, views: dict[str, str]) -> list[str]:
    """Views named in the text, and those they name, in an order that defines each before its use."""
    order: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text, re.I):
            if name in views and name not in order and name not in open_names:
                open_names.add(name)
                visit(views[name])
                order.append(name)

    visit(body)
    return order


def sql(body: str, recursive: bool = False, **extra: str) -> str:
    """The query with the views it reads in front; ``extra`` adds views of its own."""
    views = {**VIEWS, **extra}
    names = needed(body, views)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(f"{n} AS ({views[n]})" for n in names) + "\n" if names else "") + body
