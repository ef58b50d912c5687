"""Deliveries landed by station and month: only what a delivery touches is rewritten, and a manifest swaps it in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StationMonths:
    """A table of detector rows under ``folder``, cut into parts by month and by ``buckets`` of stations.

    ``data/<delivery>/month=…/bucket=…`` holds the files, which are never changed once written; ``manifest/<number>`` lists
    for every part the delivery that has its rows now. A delivery reads and writes the parts that it touches and nothing
    else, then a manifest of the next number is put in place by one rename; until then readers see the table as it was. A
    delivery that dies leaves files that no manifest names.

    There are as many parts as months times buckets, so manifests are small whatever the number of rows.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last manifest; 0 before the first delivery."""
        path, fs = self._path("manifest")
        if not fs.exists(path):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[tuple[str, int], str]:
        """{(month, bucket): delivery} as of a version, the last one by default."""
        version = self.version() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.schema("month string, bucket int, delivery string").parquet(f"{self.folder}/manifest/{version}").collect()
        return {(r["month"], r["bucket"]): r["delivery"] for r in rows}

    def _read(self, parts: dict[tuple[str, int], str]) -> DataFrame:
        """The rows of some parts; each delivery's folder is the base of its paths."""
        deliveries: dict[str, list[str]] = {}
        for (month, bucket), delivery in parts.items():
            deliveries.setdefault(delivery, []).append(f"{self.folder}/data/{delivery}/month={month}/bucket={bucket}")
        out = None
        for delivery, paths in sorted(deliveries.items()):
            rows = self.spark.read.option("mergeSchema", True).parquet(*sorted(paths))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows as of a version (columns that a delivery lacks are null), or None before the first delivery."""
        return self._read(self.manifest(version))

    def land(self, rows: DataFrame) -> dict[tuple[str, int], str]:
        """Add ``rows`` (station_id, ts, any others); whole-row duplicates, of earlier deliveries too, are dropped.

        Returns the parts that were rewritten. Rows without a station or a time are an error, as they have no part. An
        empty delivery changes nothing. Two writers at once: the second finds the number taken and raises; its files are
        then no part of the table, and it may land again.
        """
        if not rows.where("station_id IS NULL OR ts IS NULL").isEmpty():
            raise ValueError("rows without station_id or ts")
        version = self.version()
        known = self.manifest(version)
        part = [F.date_format("ts", "yyyy-MM").alias("month"), F.pmod(F.xxhash64(F.col("station_id").cast("long")), F.lit(self.buckets)).cast("int").alias("bucket")]
        touched = {(r["month"], r["bucket"]) for r in rows.select(*part).distinct().collect()}  # months times buckets at most
        if not touched:
            return {}
        old = self._read({k: known[k] for k in touched & known.keys()})
        every = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
        every = every.dropDuplicates().select("*", *part)
        delivery = uuid.uuid4().hex
        # parts of a common size, each in few files, in order of station and time
        dealt = every.repartition(F.col("month"), F.col("bucket")).sortWithinPartitions("month", "bucket", "station_id", "ts")
        dealt.write.partitionBy("month", "bucket").parquet(f"{self.folder}/data/{delivery}")
        listed = known | {k: delivery for k in touched}
        self._swap_in(listed, version + 1)
        return {k: delivery for k in touched}

    def _swap_in(self, listed: dict[tuple[str, int], str], version: int) -> None:
        made = f"manifest/.new-{uuid.uuid4().hex}"
        rows = [(month, bucket, delivery) for (month, bucket), delivery in sorted(listed.items())]
        self.spark.createDataFrame(rows, "month string, bucket int, delivery string").coalesce(1).write.parquet(f"{self.folder}/{made}")
        new, fs = self._path(made)
        place, _ = self._path(f"manifest/{version}")
        if fs.exists(place) or not fs.rename(new, place):
            fs.delete(new, True)
            raise RuntimeError(f"another delivery took version {version}")
