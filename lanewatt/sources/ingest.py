"""Detector files, station metadata, markers, corridors, parameter tables and runs: readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import RANGE_BYTES, read_marker_features
from .scratch import written

# The columns of the detector feed and of station metadata, with the other names they go by.
STATION_FIELDS = (
    "timestamp string, station_id long, district int, freeway int, direction string, lane_type string, station_length double, "
    "samples int, pct_observed double, total_flow_5min double, avg_occupancy double, avg_speed_mph double"
)
LANE_FIELDS = (("good_samples", "int"), ("flow", "double"), ("occupancy", "double"), ("speed", "double"), ("observed", "double"))
TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"
METADATA_ALIASES = {
    "station_id": ("ID", "id", "station_id"), "route": ("Fwy", "fwy", "route"), "direction": ("Dir", "dir", "direction"), "type": ("Type", "type"),
    "name": ("Name", "name"), "abs_pm": ("Abs_PM", "abs_pm"), "latitude": ("Latitude", "latitude"), "longitude": ("Longitude", "longitude"),
    "lanes": ("Lanes", "lanes"), "length": ("Length", "length"), "district": ("District", "district"),
}
NAMED = [f.split() for f in STATION_FIELDS.split(", ")]


def parse_detector_lines(lines: DataFrame) -> DataFrame:
    """Rows of the headerless feed in ``value``: station fields, ts (wall clock), and an array of lanes.

    Lanes are told by the number of fields of each row; a row whose width fits no number of lanes has ``bad_width`` true
    and no lanes. Blank fields are null; NaN is null.
    """
    # exploded from an array of one, so that the split is done once and not anew in every expression over it
    parts = lines.select("value", F.explode(F.array(F.split("value", ",", -1))).alias("_f"))

    def number(x: Column, kind: str) -> Column:
        """Blanks are told before the cast, to which they are an error that costs more than all the rest of a row."""
        cast = F.nullif(F.trim(x), F.lit("")).try_cast(kind)
        return F.nanvl(cast, F.lit(None).cast(kind)) if kind == "double" else cast

    fields = [(number(F.col("_f")[k], kind) if kind != "string" else F.trim(F.col("_f")[k])).alias(n) for k, (n, kind) in enumerate(NAMED)]
    width = F.size("_f") - len(NAMED)
    bad = (width < 0) | (width % len(LANE_FIELDS) != 0)

    def lane(i: Column) -> Column:
        at = lambda k: F.element_at("_f", (len(NAMED) + len(LANE_FIELDS) * i + k + 1).cast("int"))
        return F.struct((i + 1).cast("int").alias("lane"), *[number(at(k), kind).alias(n) for k, (n, kind) in enumerate(LANE_FIELDS)])

    lanes = F.when(bad | (width == 0), F.array().cast("array<struct<lane:int,good_samples:int,flow:double,occupancy:double,speed:double,observed:double>>")).otherwise(
        F.transform(F.sequence(F.lit(0), (width / len(LANE_FIELDS)).cast("int") - 1), lane)
    )
    out = parts.select(*fields, F.coalesce(bad, F.lit(True)).alias("bad_width"), lanes.alias("lanes"))
    return out.withColumn("ts", F.try_to_timestamp("timestamp", F.lit(TIME_FORMAT)).cast("timestamp_ntz")).drop("timestamp")


def read_detector_files(spark: SparkSession, path: str, stations: list[int] | DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The ``.gz`` files of a folder, both ends of the period included; an end without a time means its midnight.

    Gzip files can't be split, so each is one task; land them once by ``write_by_station`` and read those.
    """
    rows = with_lanes(parse_detector_lines(spark.read.option("pathGlobFilter", "*.gz").text(path)))
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if isinstance(stations, DataFrame):
        return rows.join(stations.select("station_id").distinct(), "station_id", "left_semi")
    return rows if stations is None else rows.where(F.col("station_id").isin(stations))


def with_lanes(rows: DataFrame) -> DataFrame:
    """Rows whose width fits; the others are what ``quarantine`` gives."""
    return rows.where(~F.col("bad_width")).drop("bad_width")


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where("bad_width")


def explode_lanes(rows: DataFrame) -> DataFrame:
    """One row a lane. Rows without lanes go after the explosion: a filter before it would parse all lanes once more."""
    return rows.select("station_id", "ts", F.explode_outer("lanes").alias("l")).where("l IS NOT NULL").select("station_id", "ts", "l.*")


def write_by_station(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Whole-row duplicates dropped, then one folder a station, rows in order of time. Stations in ``rows`` replace what
    is there of them; the folders of others stay."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.dropDuplicates().repartition(n, "station_id").sortWithinPartitions("station_id", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("station_id").parquet(path)


def merge_by_station(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both, whole-row duplicates dropped; columns that one lacks are null."""
    return existing.unionByName(new, allowMissingColumns=True).dropDuplicates()


def split_by_station(rows: DataFrame, station: int) -> DataFrame:
    """One station's rows: a partition of what ``write_by_station`` wrote."""
    return rows.where(F.col("station_id") == station)


def new_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    return listing.join(ledger.select("file_name"), "file_name", "left_anti")


def expand_file_requests(districts: DataFrame, types: list[str], years: list[int], months: list[int]) -> DataFrame:
    """(type, district, year, month) of every combination; ``districts`` has the column district."""
    out = districts.select("district").distinct()
    for name, values in (("type", types), ("year", years), ("month", months)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in values])))
    return out


def normalise_metadata_key(df: DataFrame) -> DataFrame:
    """Known spellings of metadata columns become one."""
    return df.withColumnsRenamed({a: name for name, aliases in METADATA_ALIASES.items() for a in aliases if a in df.columns})


def clean_station_metadata(raw: DataFrame, route: int | None = None, direction: str | None = None, mainline_only: bool = True) -> DataFrame:
    """Metadata with canonical names and types; rows without a place go. An error lists columns that are missing."""
    df = normalise_metadata_key(raw)
    missing = [n for n in ("station_id", "route", "direction", "type", "abs_pm", "latitude", "longitude") if n not in df.columns]
    if missing:
        raise ValueError(f"station metadata lacks {', '.join(missing)}")
    kinds = {"station_id": "long", "route": "int", "abs_pm": "double", "latitude": "double", "longitude": "double", "lanes": "int", "length": "double"}
    df = df.withColumns({n: F.col(n).try_cast(k) for n, k in kinds.items() if n in df.columns}).withColumn("direction", F.upper("direction"))
    df = df.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    if route is not None:
        df = df.where(F.col("route") == route)
    if direction is not None:
        df = df.where(F.col("direction") == direction.upper())
    return df.where("type = 'ML'") if mainline_only else df


def read_station_metadata(spark: SparkSession, path: str, sep: str = "\t", **filters) -> DataFrame:
    return clean_station_metadata(spark.read.option("sep", sep).option("header", True).csv(path), **filters)


MARKERS = "features array<struct<properties:struct<Route:string,PM:double>,geometry:struct<coordinates:array<double>>>>"


def parse_markers(text: DataFrame, routes: list[int]) -> DataFrame:
    """(route, pm, longitude, latitude) of GeoJSON texts in ``value``: points with Route and PM, lon/lat."""
    f = text.select(F.explode(F.from_json("value", MARKERS)["features"]).alias("f"))
    at = F.col("f.geometry.coordinates")
    out = f.select(F.regexp_extract("f.properties.Route", r"\d+", 0).try_cast("int").alias("route"), F.col("f.properties.PM").alias("pm"), at[0].alias("longitude"), at[1].alias("latitude"))
    return out.where(F.col("route").isin(routes) & F.col("pm").isNotNull())


def read_postmile_markers(spark: SparkSession, path: str, routes: list[int]) -> DataFrame:
    """Markers of whole GeoJSON files, each one a task, from any store that Spark reads; ``read_marker_ranges`` reads large
    ones by many tasks."""
    return parse_markers(spark.read.text(path, wholetext=True), routes)


def read_marker_ranges(spark: SparkSession, uri: str, routes: list[int], range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(markers, problems): markers as ``parse_markers`` gives them, of files read by byte ranges, and the features that are
    none, each with its file, offset and what is wrong with it."""
    rows = read_marker_features(spark, uri, range_bytes)
    number = F.regexp_extract("route", r"\d+", 0).try_cast("int")
    good = rows.where("problem IS NULL").select(number.alias("route"), "pm", "longitude", "latitude").where(F.col("route").isin(routes))
    return good, rows.where("problem IS NOT NULL").select("file", "offset", "problem")


def write_corridor(segments: DataFrame, junctions: DataFrame, nodes: DataFrame, path: str) -> None:
    """Segments, junctions and the node-to-postmile table as JSON lines."""
    for name, df in (("segments", segments), ("junctions", junctions), ("nodes", nodes)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_corridor(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    seg = "corridor_id string, seq int, geometry array<struct<lon:double,lat:double>>, lanes int, pm_start double, pm_end double"
    jun = "corridor_id string, junction_id long, kind string, postmile double, lat double, lon double, lanes int, name string"
    return (
        spark.read.schema(seg).json(f"{path}/segments"), spark.read.schema(jun).json(f"{path}/junctions"),
        spark.read.schema("node_id long, pm double").json(f"{path}/nodes"),
    )


def clean_freeway_table(raw: DataFrame) -> DataFrame:
    """Cell parameters with defaults where a column or a value is absent: rho_crit q_max / v_f, no ramps, no bound on
    capacity, gamma and xi 1."""
    missing = [n for n in ("cell", "length", "q_max", "v_f", "w", "rho_jam") if n not in raw.columns]
    if missing:
        raise ValueError(f"the parameter table lacks {', '.join(missing)}")
    has = lambda n, kind: F.col(n).cast("string").try_cast(kind) if n in raw.columns else F.lit(None).cast(kind)
    flag = lambda n: F.coalesce(F.lower(F.trim(F.col(n).cast("string"))).isin("true", "1", "yes", "t"), F.lit(False)) if n in raw.columns else F.lit(False)
    q, v = has("q_max", "double"), has("v_f", "double")
    return raw.select(
        has("cell", "long").alias("cell"), has("length", "double").alias("length"), q.alias("q_max"), v.alias("v_f"), has("w", "double").alias("w"), has("rho_jam", "double").alias("rho_jam"),
        F.coalesce(has("rho_crit", "double"), F.try_divide(q, v)).alias("rho_crit"), flag("on_ramp").alias("on_ramp"), flag("off_ramp").alias("off_ramp"),
        has("on_ramp_capacity", "double").alias("on_ramp_capacity"), has("off_ramp_capacity", "double").alias("off_ramp_capacity"),
        F.coalesce(has("gamma", "double"), F.lit(1.0)).alias("gamma"), F.coalesce(has("xi", "double"), F.lit(1.0)).alias("xi"),
    )


def read_freeway_table(spark: SparkSession, path: str) -> DataFrame:
    return clean_freeway_table(spark.read.option("header", True).csv(path))


def wide_to_long(df: DataFrame, key: str, value: str, cells: DataFrame | None = None) -> DataFrame:
    """(key, cell, value) of a table whose other columns are numbered by cell; with ``cells``, missing ones are 0."""
    cols = [c for c in df.columns if c != key]
    bad = [c for c in cols if not c.isdigit()]
    if bad:
        raise ValueError(f"not cell numbers: {', '.join(bad)}")
    long = df.unpivot(key, cols, "cell", value).withColumn("cell", F.col("cell").cast("long"))
    if cells is None:
        return long
    dense = df.select(key).crossJoin(cells.select("cell"))  # the table is that product
    return dense.join(long, [key, "cell"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def long_to_wide(df: DataFrame, key: str, value: str, cells: list[int]) -> DataFrame:
    """A column a cell of ``cells``; a wide table is no wider than its reader can hold, so many cells go by blocks."""
    return df.groupBy(key).pivot("cell", cells).agg(F.first(value))


def long_to_blocks(df: DataFrame, key: str, value: str, width: int = 64) -> DataFrame:
    """(key, block, values): all cells of a long table in blocks of ``width`` columns: the array's k-th entry (from 0) is cell
    block * width + k, null where there is none. What cells there are need not be known, and no row grows with them."""
    dealt = df.select(key, "cell", value, F.floor(F.col("cell") / width).alias("block")).repartition(key, "block")  # once, for both sums
    once = dealt.groupBy(key, "block", "cell").agg(F.first(value).alias(value))
    placed = once.groupBy(key, "block").agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("cell", F.lit(width)).cast("int").alias("k"), value))).alias("m"))
    return placed.select(key, "block", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.try_element_at("m", k)).alias("values"))


def blocks_to_long(blocks: DataFrame, key: str, value: str, width: int = 64, cells: DataFrame | None = None) -> DataFrame:
    """(key, cell, value) of what ``long_to_blocks`` gives, without the nulls; with ``cells`` every key has each of them, missing ones 0."""
    if cells is None:
        return blocks.select(key, "block", F.posexplode("values").alias("k", value)).where(F.col(value).isNotNull()).select(key, (F.col("block") * width + F.col("k")).alias("cell"), value)
    blocks = written(blocks.select(key, "block", "values"), "blocks")
    asked = cells.select("cell").groupBy(F.floor(F.col("cell") / width).alias("block")).agg(F.collect_list("cell").alias("_cells"))
    dense = blocks.select(key).distinct().crossJoin(asked)  # the table is that product; a row is a block of cells until the join is done
    rows = dense.join(blocks, [key, "block"], "left").select(key, "values", F.explode("_cells").alias("cell"))
    return rows.select(key, "cell", F.coalesce(F.get("values", F.pmod("cell", F.lit(width)).cast("int")), F.lit(0.0)).alias(value))


def write_run(path: str, run_id: str, **tables: DataFrame) -> None:
    """The tables of one run, each partitioned by run; a run written again takes the place of itself, others stay."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def read_run(spark: SparkSession, path: str, run_id: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where(F.col("run_id") == run_id)


def write_demand_long(demand: DataFrame, path: str, steps_per_part: int = 288) -> None:
    """One folder a ``steps_per_part`` steps; parts in ``demand`` replace what is there of them, others stay."""
    demand.withColumn("part", F.floor(F.col("step") / steps_per_part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a headerless matrix file, or of a folder's files one after the other, rows in their order.

    Files are split like any text. Rows are counted by block; what lies before a block is the sum over the blocks before it,
    so a row knows its number without a task that reads the whole file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    local = Window.partitionBy("file", "block").orderBy("at")  # a block's lines, as many as a task has read
    lines = written(lines.withColumn("row", F.row_number().over(local) - 1), "lines")
    full = lines.where(F.trim("value") != "").groupBy("file").agg(F.max(F.struct("block", "row")).alias("end"))  # blank lines at a file's end are no rows
    kept = lines.join(full, "file").where(F.struct("block", "row") <= F.col("end"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    totals = kept.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = kept.join(totals, ["file", "block"])
    return rows.select((F.col("first") + F.col("row")).alias("row"), F.posexplode(F.split("value", ",")).alias("col", "v")).select("row", "col", F.trim("v").try_cast("double").alias("value"))


def matrix_cells(text: DataFrame, *keys: str) -> DataFrame:
    """(keys, row, col, value) of matrices written as text in ``value``; null where an entry is no number."""
    rows = text.select(*keys, F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("row", "line"))
    return rows.select(*keys, "row", F.posexplode(F.split("line", ",")).alias("col", "v")).select(*keys, "row", "col", F.trim("v").try_cast("double").alias("value"))


def fit_bundle_meta(cells: DataFrame, dt_s: float, horizon: int) -> DataFrame:
    """One JSON row: step, horizon, ramp cells, capacities (null: unbounded)."""
    ids = lambda flag: F.sort_array(F.collect_list(F.when(F.col(flag), F.col("cell"))))
    caps = F.sort_array(F.collect_list(F.struct("cell", "on_ramp_capacity", "off_ramp_capacity")))
    return cells.agg(F.to_json(F.struct(
        F.lit(dt_s).alias("dt_s"), F.lit(horizon).alias("horizon"), F.count("*").alias("n_cells"), ids("on_ramp").alias("on_ramp_cells"), ids("off_ramp").alias("off_ramp_cells"), caps.alias("capacities")
    ), {"ignoreNullFields": "false"}).alias("meta"))


def write_fit_bundle(path: str, cells: DataFrame, initial: DataFrame, inflow: DataFrame, observed: DataFrame, dt_s: float, horizon: int) -> None:
    """What a fit reads: cell parameters, initial state, inflow and observed grid as tables, and one row of meta."""
    for name, df in (("params", cells), ("initial", initial), ("inflow", inflow), ("observed", observed)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    fit_bundle_meta(cells, dt_s, horizon).write.mode("overwrite").text(f"{path}/meta")


def read_fit_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle by name, and ``meta`` with its fields as columns."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in ("params", "initial", "inflow", "observed")}
    meta = "dt_s double, horizon long, n_cells long, on_ramp_cells array<long>, off_ramp_cells array<long>, capacities array<struct<cell:long,on_ramp_capacity:double,off_ramp_capacity:double>>"
    out["meta"] = spark.read.text(f"{path}/meta").select(F.from_json("value", meta).alias("m")).select("m.*")
    return out


def write_imputed_grid(grid: DataFrame, path: str) -> None:
    """A filled grid (cell, m_5min, value, source), one folder a source of its values."""
    grid.write.mode("overwrite").partitionBy("source").parquet(path)


def imputed_counts(grid: DataFrame, n_cells: int, horizon: int) -> DataFrame:
    """(source, n) of a filled grid, and how many entries stay unfilled."""
    by = grid.groupBy("source").agg(F.count("*").alias("n"))
    rest = grid.agg((F.lit(n_cells * horizon) - F.count("*")).alias("n")).select(F.lit("unfilled").alias("source"), "n")
    return by.unionByName(rest)


def parse_study_reports(texts: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Metrics out of report texts by their labels: a line ``label: number``. ``missing`` lists labels that a text lacks."""
    found = {n: F.regexp_extract("value", rf"(?m)^\s*{label}\s*:\s*(-?[0-9.]+)", 1).try_cast("double") for n, label in metrics.items()}
    out = texts.withColumns(found)
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in metrics]))).drop("value")


def cross_study(summaries: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, strategy, distance_mi, rank, value): studies side by side, by distance within a metric and strategy."""
    tidy = summaries.unpivot(["strategy", "distance_mi"], metrics, "metric", "value")
    w = Window.partitionBy("metric", "strategy").orderBy("distance_mi")
    return tidy.select("metric", "strategy", "distance_mi", F.row_number().over(w).alias("rank"), "value")


def missing_stations(asked: DataFrame, ts: DataFrame) -> DataFrame:
    return asked.select("station_id").distinct().join(ts.select("station_id").distinct(), "station_id", "left_anti")


def latest_snapshot(files: DataFrame) -> DataFrame:
    return files.agg(F.max("file_name").alias("file_name"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).dropDuplicates()
