"""URL filters: host and path rules, and their decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, components
from tidemark.session import stage

# The tags that name another address of the same page, and query keys that do not change it.
TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
TRACKING = r"&(?:utm_[a-z]+|ref)=[^&]*"


def host(url: Column) -> Column:
    """Lower-cased (A-Z) text after the first `://` up to `/`, `?`, `#` or the end; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host, path, verdict) that fits, as `host` + `path` text, and its verdict; NULL if none fits.

    The list is part of the plan, so it is for some hundred rules.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def with_address(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Adds host, path and address: one key for addresses of the same page, without scheme, fragment, tracking keys
    or closing slash; NULL without a host."""
    h, p, a, q = (prefix + c for c in ("host", "path", "address", "__query"))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    df = df.withColumn(h, host(F.col(url))).withColumn(p, path(F.col(url)))
    df = df.withColumn(q, F.substring(F.regexp_replace(F.concat(F.lit("&"), query), TRACKING, ""), 2, 1 << 30))
    base = F.concat(F.col(h), F.regexp_replace(F.col(p), "/+$", ""))
    whole = F.concat(base, F.when(F.col(q) == "", "").otherwise(F.concat(F.lit("?"), F.col(q))))
    return df.withColumn(a, F.when(F.col(h) != "", whole)).drop(q)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): the addresses that pages name as their canonical form or refresh to. Pages without any give no row.

    Links are written before they are resolved against their page's address: they are few, and the plan stays short.
    """
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TAGS), 0)
    found = pages.select(F.col(url).alias("url"), F.explode(tags).alias("tag"))
    href = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).when(
        F.col("tag").rlike(REFRESH), F.regexp_extract("tag", REFRESH_URL, 1))
    found = stage(found.select("url", href.alias("href")).where("href != '' and url is not null").distinct(), "links")
    scheme, link = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.col("href")
    found = found.withColumn("root", F.concat(scheme, F.lit("://"), host(F.col("url")))).withColumn("path", path(F.col("url")))
    folder = F.regexp_replace(F.concat("root", F.regexp_extract("path", r"(?s)^(.*/)?", 0)), "/*$", "")
    target = (
        F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat("root", link)).otherwise(F.concat(folder, F.lit("/"), link))
    )
    return stage(found.select("url", target.alias("target")).distinct(), "links")


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: (id, host, path, rule, verdict, aliases_blocked).

    A page with a rule of its own has that verdict. Others are blocked if an alias (a page or link target
    reached over canonical links, refreshes and spellings of one address, in any number of steps) is blocked by
    a rule and no alias is allowed by one: an explicit allow comes first. All else is allowed. NULL urls and urls
    without a host have no alias. Equal urls are one address. Components are found by rounds of
    joins; pages of one address are counted before they are joined.
    """
    base = with_address(pages.select(F.col(id).alias("id"), F.col(url).alias("url")), "url").drop("url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("own", verdict)

    linked = stage(with_address(with_address(links(pages, url, html), "url", "from_"), "target", "to_"), "links")
    roots = components(linked, "from_address", "to_address")
    _, aimed = rule_of(F.col("to_host"), F.col("to_path"), rules)
    said = base.select("address", "own").union(linked.select("to_address", aimed)).where("address is not null and own is not null")
    flags = [F.max((F.col("own") == v).cast("int")).alias(v) for v in ("block", "allow")]
    said = said.groupBy("address").agg(*flags)
    root = F.coalesce("root", "address")
    groups = said.join(roots.withColumnRenamed("node", "address"), "address", "left").groupBy(root.alias("of")).agg(
        F.max("block").alias("block"), F.max("allow").alias("allow")).where("block = 1 and allow = 0").select("of", F.lit(True).alias("blocked"))
    out = base.join(roots.withColumnRenamed("node", "address"), "address", "left").withColumn("of", root).join(groups, "of", "left")
    blocked = F.coalesce("blocked", F.lit(False))
    return out.select(
        "id", "host", "path", "rule",
        F.coalesce("own", F.when(blocked, "block").otherwise("allow")).alias("verdict"), blocked.alias("aliases_blocked"),
    )
