"""Exact token cost: whole nano-dollars, priced by the longest dash-separated prefix of a model id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import dims


def price_key(model: Column) -> Column:
    """The priced id that equals the model or is its longest prefix before a dash, else null."""
    parts = F.split(model, "-")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    known = F.array(*map(F.lit, dims.PRICES))
    return F.try_element_at(F.filter(prefixes, lambda p: F.array_contains(known, p)), F.lit(1))


def _rate(key: Column, rate: int) -> Column:
    entries = [x for row in dims.milli_prices() for x in (F.lit(row[0]), F.lit(row[1 + rate]).cast("long"))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(0).cast("long"))


def nano_cost(model: Column) -> Column:
    """Cost of a usage row in nano-dollars (long); reasoning is billed as output, unknown models cost nothing."""
    key = F.coalesce(price_key(model), F.lit(""))
    return (
        F.col("input_tokens") * _rate(key, 0) + (F.col("output_tokens") + F.col("reasoning_output_tokens")) * _rate(key, 1)
        + F.col("cache_creation_input_tokens") * _rate(key, 2) + F.col("cache_read_input_tokens") * _rate(key, 3)
    )


def usd(nano: Column) -> Column:
    return nano.cast("double") / F.lit(1e9)
