"""Incremental ingest of detector files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ingest import parse_detector_lines, with_lanes


def five_minute_flow(rows: DataFrame, lateness: str = "15 minutes", batch: bool = False) -> DataFrame:
    """(station_id, window start, flow, density, n) of a stream of (station_id, ts, flow_count, speed), copies dropped;
    rows later than ``lateness`` behind the newest don't count. ``batch``: the same over a table, where none is late."""
    x = rows.withColumn("event_time", F.col("ts").cast("timestamp"))
    key = ["station_id", "event_time"]
    x = x.dropDuplicates(key) if batch else x.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(key)
    w = x.groupBy("station_id", F.window("event_time", "5 minutes")).agg(
        (F.sum("flow_count") * 12).alias("flow"), F.avg("speed").alias("speed"), F.count("*").alias("n")
    )
    return w.select("station_id", F.col("window.start").alias("start"), "flow", F.try_divide("flow", "speed").alias("density"), "n")


def stream_detector_files(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.readStream.option("pathGlobFilter", "*.gz").text(path)
    return with_lanes(parse_detector_lines(lines)).select("station_id", "ts", F.col("total_flow_5min").alias("flow_count"), F.col("avg_speed_mph").alias("speed"))


def run_available(df: DataFrame, sink: str, checkpoint: str) -> dict[str, int]:
    """Process what is there and end. Returns what the run did not count: ``late`` rows, behind the watermark, and
    ``repeated`` ones, as the stream's own state operators report them batch by batch."""
    run = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    told: dict[int, tuple[int, int]] = {}

    def note() -> None:
        for p in run.recentProgress:
            states = p.stateOperators
            told[p.batchId] = (sum(s.numRowsDroppedByWatermark for s in states), sum(int(s.customMetrics.get("numDroppedDuplicateRows", 0)) for s in states))

    while not run.awaitTermination(5):  # progress is kept for the last batches only, so it is read while the run goes on
        note()
    note()
    return {"late": sum(x for x, _ in told.values()), "repeated": sum(x for _, x in told.values())}
