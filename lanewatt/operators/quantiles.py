"""Exact quantiles from ranks over ranges of the values: no buffer holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_share


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each of ``shares``): exact percentiles, linear between neighbours, of the values that are not
    null; keys without any have no row, null keys are a group like any other.

    Equal values are counted first, so that a value that many rows share is one row, then ranked by ranges of (keys,
    value); only the few rows that hold a wanted rank reach the last step.
    """
    if not shares or any(not 0 <= q <= 1 for q in shares.values()):
        raise ValueError("shares must lie between 0 and 1")
    # a null key would meet nothing in a join, so keys travel as a struct
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.struct(F.lit(0).alias("_all"), *keys).alias("_key"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_share(counted, ["_key"], ["_v"], "_n")
    first, last = F.col("upto") - F.col("_n"), F.col("upto") - 1  # the ranks that a value has, from 0

    def at(q: float):
        return (F.col("total") - 1) * F.lit(q)

    def holds(rank):
        return (first <= rank) & (rank <= last)

    wanted = F.lit(False)
    sides = []
    for k, q in enumerate(shares.values()):
        low, high = F.floor(at(q)), F.ceil(at(q))
        wanted = wanted | holds(low) | holds(high)
        sides += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_low{k}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_high{k}")]
    found = ranked.where(wanted).groupBy("_key").agg(F.max("total").alias("total"), *sides)
    out = []
    for k, (name, q) in enumerate(shares.items()):
        part = at(q) - F.floor(at(q))
        out.append((F.col(f"_low{k}") * (1 - part) + F.col(f"_high{k}") * part).alias(name))
    return found.select(*[F.col("_key")[c].alias(c) for c in keys], *out)
