"""Contiguous shards of near-equal byte size, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, stored, text_or_empty

ROW_OVERHEAD = 8


def assign_shards(rows: DataFrame, order_by: list[str], size: str, shards: int, partitions: int | None = None) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, gapless in a shard) to ``rows``.

    Rows are sorted by ``order_by``; the row whose middle byte lies in the k-th of ``shards`` equal parts of all bytes
    goes to shard k, so shards are contiguous runs and differ by less than one row's size from the target.

    1. A range partitioning deals the narrow rows out; each partition makes its own running sums.
    2. One row of totals a partition gives the partitions' offsets (a window over that small table).
    3. Offset + running sum is the global prefix sum, and an integer division the shard.

    Sizes must be positive integers; null keys sort first; wholly equal rows are interchangeable, and a spread key
    keeps even millions of them from one partition. An empty table gives no rows. Columns named like the two results
    are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    # the rows' own columns travel in one struct, so that no name of theirs can clash
    keyed = rows.select(F.struct(*quoted(keep)).alias("own"), *[c.alias(f"key{k}") for k, c in enumerate(quoted(order_by))], quoted([size])[0].alias("size"), (F.monotonically_increasing_id() % 4096).alias("spread"))
    order = [*[f"key{k}" for k in range(len(order_by))], "spread"]
    dealt = keyed.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id())
    local = Window.partitionBy("part").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = stored(dealt.select("own", "size", "part", F.row_number().over(local).cast("long").alias("row"), F.sum("size").over(running).alias("upto")), "shard-sums")
    totals = summed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")
    ).crossJoin(F.broadcast(totals.agg(F.sum("bytes").alias("all_bytes"))))
    # one row a range partition, whose number is set above, not by the data
    middle = F.expr(f"((2 * (bytes_before + upto) - size) * {shards}) div (2 * all_bytes)")
    placed = summed.join(F.broadcast(offsets), "part").select(
        "own", (F.col("rows_before") + F.col("row") - 1).alias("at"), F.least(middle, F.lit(shards - 1)).cast("int").alias("shard")
    )
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(*[F.col("own").getField(c).alias(c) for c in keep], "shard", (F.col("at") - F.col("first")).alias("slot"))


def document_shards(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Shards of ``documents`` in the order of doc_id: size is the text's UTF-8 bytes plus 8 (null text: none), law ``bytes``.

    A shard is a contiguous run of ids; repeated ids and null ids are placed like any row, and equal texts with unlike
    ids may lie in different shards: the law is that of bytes, which no group can keep to where one holds a third of all
    rows. Texts never enter a shuffle: size and checksum are taken in the scan.
    """
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    return assign_shards(narrow, ["doc_id", "text_crc32", "size"], "size", shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
