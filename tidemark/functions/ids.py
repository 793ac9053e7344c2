"""Stable row ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_number(value: Column) -> Column:
    """One text per number, whatever the engine prints for doubles."""
    return value.cast("decimal(38,10)").cast("string")


def digest_id(*parts: Column) -> Column:
    """SHA-256 over the parts; an unknown part counts as empty text and keeps its place."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\u001f", *texts), 256)


def readable_observation_id(symbol: Column, asset: Column, period_end: Column, metric: Column, document: Column) -> Column:
    return F.concat_ws(":", symbol, asset, F.date_format(period_end, "yyyyMMdd"), metric, document)
