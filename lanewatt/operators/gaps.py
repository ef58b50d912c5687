"""Regular grids, gap filling and outlier fences of detector series: keys station_id and ts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SAMPLE_MINUTES, slot_of_week
from ..sources.scratch import written
from .quantiles import exact_percentiles

#: Whitened values this near to a fence lie on it.
TIE = 1e-9
#: Rows that one task sorts where stations are dealt out by hand.
DEALT_ROWS = 250_000


def contiguous_grid(ts: DataFrame) -> DataFrame:
    """Every station on 5-minute samples from January 1 of its first year to December 31 of its last; gaps are null rows."""
    span = ts.groupBy("station_id").agg(F.min(F.year("ts")).alias("y0"), F.max(F.year("ts")).alias("y1"))
    grid = F.expr("sequence(CAST(make_date(y0, 1, 1) AS TIMESTAMP_NTZ), CAST(make_date(y1, 12, 31) AS TIMESTAMP_NTZ) + INTERVAL '23:55' HOUR TO MINUTE, INTERVAL '5' MINUTE)")
    return span.select("station_id", F.explode(grid).alias("ts")).join(ts, ["station_id", "ts"], "left")


def reindex_window(ts: DataFrame, start: str, end: str) -> DataFrame:
    """Every station on each 5-minute sample of [start, end); absent rows are null."""
    grid = F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - INTERVAL '5' MINUTE, INTERVAL '5' MINUTE)")
    return ts.select("station_id").distinct().select("station_id", F.explode(grid).alias("ts")).join(ts, ["station_id", "ts"], "left")


def cell_grid(cells: DataFrame, obs: DataFrame, value: str, horizon: int, span: int = 24) -> DataFrame:
    """(cell, m_5min, value, direct): every cell of ``cells`` (cell, station_id) on every sample below the horizon, null where
    its station has no row; direct cells have a station. A station has one row a sample.

    A station's ``span`` of samples is one row with an array, so cells meet spans, and samples are made after the join: no
    join or shuffle holds a row a cell and sample. Cells without a station meet nothing and are dealt out by themselves.
    """
    at = F.map_from_entries(F.collect_list(F.struct((F.col("m_5min") % span).cast("int").alias("k"), F.col(value).alias("v"))))
    held = obs.where((F.col("m_5min") >= 0) & (F.col("m_5min") < horizon)).groupBy("station_id", F.floor(F.col("m_5min") / span).alias("_span")).agg(at.alias("_at"))
    held = held.select("station_id", "_span", F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.try_element_at("_at", k)).alias("_values"))
    every = cells.select("cell", "station_id").withColumn("_span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((horizon - 1) // span).cast("long"))))
    none = F.array_repeat(F.lit(None).cast(dict(obs.dtypes)[value]), span)
    direct = every.where("station_id IS NOT NULL").join(held, ["station_id", "_span"], "left").select("cell", "_span", F.coalesce("_values", none).alias("_values"), F.lit(True).alias("direct"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    other = every.where("station_id IS NULL").repartition(parts, "cell", "_span").select("cell", "_span", none.alias("_values"), F.lit(False).alias("direct"))
    rows = direct.unionByName(other).select("cell", "_span", "direct", F.posexplode("_values").alias("_k", "value"))
    return rows.select("cell", (F.col("_span") * span + F.col("_k")).alias("m_5min"), "value", "direct").where(F.col("m_5min") < horizon)


def slot_stats(ts: DataFrame, value: str) -> DataFrame:
    """Mean, sample deviation and count by station and block of the week."""
    return ts.groupBy("station_id", slot_of_week("ts").alias("slot_of_week")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )


def whiten(df: DataFrame, value: str, out: str = "whitened") -> DataFrame:
    """(x - mean) / sample deviation within the station's block of the week; null if there is but one value, or no spread."""
    w = Window.partitionBy("station_id", slot_of_week("ts"))
    spread = F.stddev_samp(value).over(w)
    return df.withColumn(out, F.try_divide(F.col(value) - F.avg(value).over(w), F.when(spread > 0, spread)))


def iqr_fence(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """Rows within k interquartile ranges of the station's quartiles (exact, linear), ties with a bound included; null
    values and rows without a station go. Quartiles come of ranks, so no window or buffer holds a station's life."""
    x = df.join(exact_percentiles(df, ["station_id"], value, {"_q1": 0.25, "_q3": 0.75}), "station_id")
    spread = k * (F.col("_q3") - F.col("_q1"))
    return x.where(F.col(value).between(F.col("_q1") - spread - TIE, F.col("_q3") + spread + TIE)).select(*df.columns)


def _carried(chunks: DataFrame) -> DataFrame:
    """(_st, _ends): per station a map from each chunk to what its neighbours leave open: the last value before it, and the
    lengths of the runs of nulls that end at its start and begin at its end. Windows here hold a row a chunk.

    A chunk without a value passes on what it got, its own length added: such chunks share the number of chunks with a
    value up to them (or from them on), and lengths add up within that number.
    """
    on, back = Window.partitionBy("_st").orderBy("_chunk"), Window.partitionBy("_st").orderBy(F.desc("_chunk"))
    upto = Window.unboundedPreceding, Window.currentRow
    x = chunks.withColumn("_fore", F.sum(F.when(F.col("_k") > 0, 1).otherwise(0)).over(on.rowsBetween(*upto)))
    x = x.withColumn("_aft", F.sum(F.when(F.col("_k") > 0, 1).otherwise(0)).over(back.rowsBetween(*upto)))
    x = x.withColumn("_open", F.sum("_trail").over(Window.partitionBy("_st", "_fore").orderBy("_chunk").rowsBetween(*upto)))
    x = x.withColumn("_shut", F.sum("_lead").over(Window.partitionBy("_st", "_aft").orderBy(F.desc("_chunk")).rowsBetween(*upto)))
    ends = F.struct(
        F.last("_last", ignorenulls=True).over(on.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.coalesce(F.lag("_open").over(on), F.lit(0)).alias("ahead"), F.coalesce(F.lag("_shut").over(back), F.lit(0)).alias("behind"),
    )
    # a null chunk is a key like any other, so it travels in a struct
    return x.select("_st", F.struct(F.struct("_chunk"), ends).alias("_e")).groupBy("_st").agg(F.map_from_entries(F.collect_list("_e")).alias("_ends"))


def deal_by_station(df: DataFrame) -> DataFrame:
    """Rows shuffled once by station, in parts of about ``DEALT_ROWS``: the fillers' windows and joins on top shuffle no row
    again. A station is a struct, as a null one would meet nothing in a join."""
    return df.repartition(df.count() // DEALT_ROWS + 1, F.struct("station_id"))


def _persisted(df: DataFrame, value: str, max_gap_minutes: int | None, out: str, chunk: str) -> DataFrame:
    """``persistence_fill`` of rows with their station as a struct in ``_st``, which stays. Chunks meet what is carried into
    them by station alone, so rows that lie together by station stay where they are."""
    own = Window.partitionBy("_st", "_chunk")
    w = own.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = df.withColumn("_chunk", F.date_trunc(chunk, F.col("ts").cast("timestamp_ntz")))
    x = x.withColumns({"_local": F.last(value, ignorenulls=True).over(w), "_g": F.count(value).over(w), "_k": F.count(value).over(own)})
    null = F.col(value).isNull()
    chunks = x.groupBy("_st", "_chunk").agg(
        F.max("_k").alias("_k"), F.count_if(F.col("_g") == 0).alias("_lead"), F.count_if(null & (F.col("_g") == F.col("_k"))).alias("_trail"),
        F.max_by(value, F.when(~null, F.col("ts"))).alias("_last"),
    )
    x = x.join(_carried(chunks), "_st", "left").withColumn("_end", F.try_element_at("_ends", F.struct("_chunk"))).drop("_ends")
    last = F.coalesce("_local", "_end.before")
    if max_gap_minutes is None:
        filled = F.coalesce(F.col(value), last)
    else:
        local = F.count_if(null).over(Window.partitionBy("_st", "_chunk", "_g"))
        rows = local + F.when(F.col("_g") == 0, F.col("_end.ahead")).otherwise(0) + F.when(F.col("_g") == F.col("_k"), F.col("_end.behind")).otherwise(0)
        filled = F.when(~null, F.col(value)).when(rows * SAMPLE_MINUTES <= max_gap_minutes, last)
    return x.withColumn(out, filled).drop("_chunk", "_local", "_g", "_k", "_end")


def persistence_fill(df: DataFrame, value: str, max_gap_minutes: int | None = None, out: str | None = None, chunk: str = "month") -> DataFrame:
    """The last value carried forward; with a limit, only into gaps no longer than it, whole or not at all; rows must be on
    a grid.

    Runs are counted within a station's ``chunk`` of time, and what is open at a chunk's ends comes of a scan over one row a
    chunk, so no window holds more than a chunk of a station's life. A station that starts with nulls keeps them.
    """
    return _persisted(df.withColumn("_st", F.struct("station_id")), value, max_gap_minutes, out or value, chunk).drop("_st")


def _slot_mean(df: DataFrame, value: str, history: DataFrame | None) -> tuple[DataFrame, Column]:
    slot = slot_of_week("ts")
    if history is None:
        return df, F.avg(value).over(Window.partitionBy("_st", slot))
    stats = history.groupBy("station_id", slot.alias("_slot")).agg(F.avg(value).alias("_mean"))
    return df.withColumn("_slot", slot).join(stats, ["station_id", "_slot"], "left").drop("_slot"), F.col("_mean")


def slot_mean_fill(df: DataFrame, value: str, history: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Nulls take the mean of their own block of the week; a block never seen stays null. ``filled`` marks what was filled."""
    df, mean = _slot_mean(df.withColumn("_st", F.struct("station_id")), value, history)
    done = df.withColumn("_new", F.coalesce(F.col(value), mean)).withColumn("filled", F.col(value).isNull() & F.col("_new").isNotNull())
    return done.withColumn(out or value, F.col("_new")).drop("_new", "_mean", "_st")


def unseen_slots(df: DataFrame, value: str) -> DataFrame:
    """Blocks of the week with gaps but no value to fill them from."""
    return df.groupBy("station_id", slot_of_week("ts").alias("slot_of_week")).agg(F.count("*").alias("n_rows"), F.count(value).alias("n")).where("n = 0").drop("n")


def hash_normal(seed: int, *keys: str) -> Column:
    """A standard normal number that the keys decide, wherever and whenever it is drawn."""
    unit = lambda s: (F.pmod(F.xxhash64(*keys, F.lit(s)), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)
    return F.sqrt(-2 * F.log(unit(2 * seed))) * F.cos(F.lit(6.283185307179586) * unit(2 * seed + 1))


def stochastic_slot_fill(df: DataFrame, value: str, seed: int) -> DataFrame:
    """Nulls take a draw from their block's normal law, not below zero; the mean where the block has no spread."""
    w = Window.partitionBy("station_id", slot_of_week("ts"))
    mean, std, n = F.avg(value).over(w), F.stddev_samp(value).over(w), F.count(value).over(w)
    drawn = F.when((n < 2) | (std == 0), mean).otherwise(F.greatest(mean + std * hash_normal(seed, "station_id", "ts"), F.lit(0.0)))
    return df.withColumn(value, F.coalesce(F.col(value), drawn))


def gap_aware_fill(df: DataFrame, value: str, short_gap_max: int = 2, history: DataFrame | None = None) -> DataFrame:
    """Gaps of at most ``short_gap_max`` samples by persistence, longer ones by the means of the values as they were."""
    df = df.withColumns({"_orig": F.col(value), "_st": F.struct("station_id")})
    df = _persisted(df, "_orig", short_gap_max * SAMPLE_MINUTES, "_short", "month")
    df, mean = _slot_mean(df, value, history)
    return df.withColumn(value, F.coalesce("_short", mean)).drop("_orig", "_short", "_mean", "_st")


def _stencil(rows: pa.Table, k: int, decay: float) -> pa.Table:
    """One tile: its own targets from the dense sums of its own and its halo's values."""
    cell, m, value, asked = (rows.column(c).to_numpy() for c in ("cell", "m_5min", "value", "asked"))
    c0, m0 = cell.min() - k, m.min() - k
    shape = (int(cell.max() - c0 + k + 1), int(m.max() - m0 + k + 1))
    place = (cell - c0) * shape[1] + (m - m0)
    known = ~np.isnan(value)
    total = np.bincount(place[known], value[known], shape[0] * shape[1]).reshape(shape)
    count = np.bincount(place[known], minlength=shape[0] * shape[1]).reshape(shape)
    row, col = np.divmod(np.unique(place[asked]), shape[1])
    at = row + c0, col + m0
    upper = lower = np.zeros(len(row))
    for dc in range(-k, k + 1):
        for dt in range(-(k - abs(dc)), k - abs(dc) + 1):
            if dc:
                weight = np.exp(-decay * (abs(dc) + abs(dt) - 1))
                beside = (row + dc, col + dt)
                upper, lower = upper + weight * total[beside], lower + weight * count[beside]
    found = np.divide(upper, lower, out=np.zeros(len(upper)), where=lower > 0)
    return pa.table({"cell": at[0], "m_5min": at[1], "value": pa.array(found, mask=lower == 0)})


def knn_impute(grid: DataFrame, usable: DataFrame, targets: DataFrame, k: int = 3, decay: float = 1.0, tile: tuple[int, int] = (64, 288)) -> DataFrame:
    """(cell, m_5min, value) of ``targets`` from the ``usable`` entries at most k steps away in space and time together.

    Weights fall by exp(-decay) a step; the target's own cell is no neighbour; imputed entries never are. Where there is
    no neighbour the value is null. Targets count once; without a cell or a time they have a null value.

    Entries are dealt into tiles of ``tile`` cells and samples. An entry is its own tile's and, within k of an edge, also
    the tile's beyond it, so about one copy in ten is added and a tile is bounded whatever the table.
    """
    halo = lambda c, n, wide: F.sequence(F.floor((c - wide) / n), F.floor((c + wide) / n))
    own = targets.select("cell", "m_5min").where("cell IS NOT NULL AND m_5min IS NOT NULL")
    asked = own.select(F.floor(F.col("cell") / tile[0]).alias("a"), F.floor(F.col("m_5min") / tile[1]).alias("b"), F.col("cell").cast("long").alias("cell"), F.col("m_5min").cast("long").alias("m_5min"), F.lit(float("nan")).alias("value"), F.lit(True).alias("asked"))
    near = usable.where("value IS NOT NULL AND NOT isnan(value)").select(F.col("cell").cast("long").alias("cell"), F.col("m_5min").cast("long").alias("m_5min"), F.col("value").cast("double").alias("value"), F.lit(False).alias("asked"))
    near = near.withColumn("a", F.explode(halo(F.col("cell"), tile[0], k))).withColumn("b", F.explode(halo(F.col("m_5min"), tile[1], k)))
    tiles = asked.unionByName(near).groupBy("a", "b").applyInArrow(lambda rows: _tile(rows, k, decay), "cell long, m_5min long, value double")
    kinds = dict(targets.dtypes)
    lost = targets.select("cell", "m_5min").where("cell IS NULL OR m_5min IS NULL").distinct().withColumn("value", F.lit(None).cast("double"))
    return tiles.select(F.col("cell").cast(kinds["cell"]), F.col("m_5min").cast(kinds["m_5min"]), "value").unionByName(lost)


def _tile(rows: pa.Table, k: int, decay: float) -> pa.Table:
    if not pc.any(rows.column("asked")).as_py():
        return pa.table({"cell": pa.array([], pa.int64()), "m_5min": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
    return _stencil(rows, k, decay)


def augment_grid(grid: DataFrame, history: DataFrame, k: int = 3, decay: float = 1.0) -> DataFrame:
    """Fill a (cell, m_5min, value, direct) grid: direct cells from ``history`` (cell, m_5min, value) means, the others
    from their neighbours. ``source`` is observed, hist or knn; unfilled entries are left out.

    The grid is made once and written; only a direct cell's gaps meet the means, all other entries are shuffled for nothing
    but the tiles.
    """
    grid = written(grid, "grid")
    means = history.groupBy("cell", "m_5min").agg(F.avg("value").alias("_mean")).where("_mean IS NOT NULL")
    told = lambda rows, value, source: rows.select("cell", "m_5min", F.col(value).alias("value"), F.lit(source).alias("source"))
    observed = told(grid.where("value IS NOT NULL"), "value", "observed")
    done = observed.unionByName(told(grid.where("value IS NULL AND direct").join(means, ["cell", "m_5min"]), "_mean", "hist"))
    rest = grid.where("value IS NULL AND NOT direct")
    return done.unionByName(told(knn_impute(grid, done, rest, k, decay).where("value IS NOT NULL"), "value", "knn"))
