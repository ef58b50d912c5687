"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove_folder, scratch_folder

__all__ = ["remove_folder"]

#: A key with more rows than this (or than the total by ``MOST_HOT``, if that is more) is joined apart by ``spread_join``.
HOT_ROWS = 512
MOST_HOT = 20_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder of ``spark.checkpoint.dir``, deleted at the end of the ``scratch_job`` that it is made in."""
    return scratch_folder(spark, name)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once a row however often ``use`` names it, in its lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def quoted(columns: list[str]) -> list:
    """Columns by their whole names, which may hold dots or back quotes."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as make it no column's, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread_join(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, whose keys are unique and whose ``_n`` is the number of a key's rows in ``many``.

    Keys with a great share of the ``total`` rows don't meet in one task: they are sent to all tasks instead. As their
    counts add up to ``total`` at most, there are never more than ``MOST_HOT`` of them.
    """
    most = max(HOT_ROWS, total // MOST_HOT)
    if total <= most:
        return many.join(one.drop("_n"), key)
    hot = F.broadcast(one.where(F.col("_n") > most).drop("_n"))
    cold = one.where(F.col("_n") <= most).drop("_n")
    return many.join(hot, key).unionByName(many.join(hot.select(key), key, "left_anti").join(cold, key))


def spread_left(many: DataFrame, one: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Left join of ``many`` with ``one``, whose keys are unique; ``counts`` has every key's rows in ``many`` as ``_n``.

    Keys with a great share of all rows are sent to all tasks, as ``spread_join`` does, whether ``one`` has them or not.
    """
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("_n") > max(HOT_ROWS, total // MOST_HOT)).select(key)
    if hot.isEmpty():
        return many.join(one, key, "left")
    hot = F.broadcast(hot.join(one, key, "left"))
    return many.join(hot, key).unionByName(many.join(hot.select(key), key, "left_anti").join(one, key, "left"))
