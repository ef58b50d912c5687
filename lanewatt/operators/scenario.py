"""Ramp demand, split ratios and other scenario series from detector series: keys station_id and m_5min or step."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SAMPLES_PER_HOUR, classify_ramp_flow, clip_split_ratio, exact_divisor
from .gaps import deal_by_station


def build_stretches(meta: DataFrame) -> DataFrame:
    """Stretches between consecutive main-line stations of a (route, direction), and the ramps between them.

    One row per stretch: pm_up, pm_down, up_ml_id, down_ml_id, on_ids, off_ids, review_ids, n_on, n_off, config_type,
    notes. North and east run up the postmiles. A ramp at a main-line station's postmile lies in the gap below it. Before
    the first and after the last station the far end is null.
    """
    side = F.when(F.col("type") == "ML", "ml").otherwise(classify_ramp_flow("type", "name"))
    x = meta.where(F.col("type").isin("ML", "OR", "FR") | F.col("type").isNull()).select("route", "direction", "station_id", "abs_pm", side.alias("side"))
    ml = F.col("side") == "ml"
    road = Window.partitionBy("route", "direction").orderBy("abs_pm", F.when(ml, 1).otherwise(0), "station_id")
    here = F.struct(F.col("station_id").alias("id"), F.col("abs_pm").alias("pm"))
    before = F.last(F.when(ml, here), ignorenulls=True).over(road.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(ml, here), ignorenulls=True).over(road.rowsBetween(0, Window.unboundedFollowing))
    gap = F.count_if(ml).over(road.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumns({"lo": before, "hi": after, "gap": gap})
    # a main-line station closes its own gap; the rows after the last one have none to close theirs
    ids = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("station_id"))))
    g = x.groupBy("route", "direction", "gap").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), ids("on").alias("on_ids"), ids("off").alias("off_ids"), ids("review").alias("review_ids"))
    up = F.col("direction").isin("N", "E")
    a, b = F.when(up, F.col("lo")).otherwise(F.col("hi")), F.when(up, F.col("hi")).otherwise(F.col("lo"))
    n_on, n_off = F.size("on_ids"), F.size("off_ids")
    config = F.when((n_on > 0) & (n_off > 0), "c").when(n_on > 0, "a").when(n_off > 0, "b").otherwise("mainline")
    notes = F.array_join(F.array_compact(F.array(F.when(F.size("review_ids") > 0, "review"), F.when(F.col("lo").isNull() | F.col("hi").isNull(), "open_end"), F.when((n_on > 1) | (n_off > 1), "several"))), ";")
    number = F.row_number().over(Window.partitionBy("route", "direction").orderBy("gap"))
    return g.select(
        "route", "direction", number.alias("stretch_id"), a["pm"].alias("pm_up"), b["pm"].alias("pm_down"), a["id"].alias("up_ml_id"), b["id"].alias("down_ml_id"),
        "on_ids", "off_ids", "review_ids", n_on.alias("n_on"), n_off.alias("n_off"), config.alias("config_type"), notes.alias("notes"),
    )


def stretch_summary(stretches: DataFrame) -> DataFrame:
    return stretches.groupBy("config_type").agg(F.count("*").alias("n"), F.sum("n_on").alias("n_on"), F.sum("n_off").alias("n_off"), F.count_if(F.col("notes") != "").alias("n_notes"))


def downstream_mainline(cells: DataFrame, side: str, stretches: DataFrame) -> DataFrame:
    """(cell, down_ml_id): of the stretches that list any of the cell's ids, the furthest downstream one's end station."""
    ids = cells.select("cell", F.explode(f"{side}_ramp_vds_ids").alias("_id")).select("cell", F.col("_id").try_cast("long").alias("id"))
    own = stretches.where("down_ml_id IS NOT NULL").select("direction", "pm_down", "down_ml_id", F.explode(F.array_union("on_ids", "off_ids")).alias("id"))
    ahead = F.when(F.col("direction").isin("N", "E"), F.col("pm_down")).otherwise(-F.col("pm_down"))
    return ids.join(own, "id").groupBy("cell").agg(F.max_by("down_ml_id", F.struct(ahead.alias("a"), "down_ml_id")).alias("down_ml_id"))


def absent_ramp_flow(ramps: DataFrame, stretches: DataFrame, flow: DataFrame, fraction: float = 0.1) -> DataFrame:
    """(station_id, kind, m_5min, flow): an estimate for ramp stations without any measured flow.

    ``ramps`` has station_id, kind (on, off); ``flow`` station_id, m_5min, flow (gaps filled). By conservation over the
    ramp's stretch: an on-ramp gets what the road gains, an off-ramp what it loses, in a stretch of ramps of one side
    only; in one of both sides ``fraction`` of the flow upstream. Measured ramps of the same side are taken off, and
    nothing falls below zero. Ramps in no stretch have zero.
    """
    present = flow.where("flow IS NOT NULL").select("station_id").distinct()
    absent = ramps.join(present, "station_id", "left_anti")
    own = stretches.select("stretch_id", "up_ml_id", "down_ml_id", "config_type", F.explode(F.concat(
        F.transform("on_ids", lambda i: F.struct(F.lit("on").alias("kind"), i.alias("station_id"))), F.transform("off_ids", lambda i: F.struct(F.lit("off").alias("kind"), i.alias("station_id")))
    )).alias("r")).select("stretch_id", "up_ml_id", "down_ml_id", "config_type", "r.kind", "r.station_id")
    placed = absent.join(own, ["station_id", "kind"], "left")
    up = flow.select(F.col("station_id").alias("up_ml_id"), "m_5min", F.col("flow").alias("q_up"))
    down = flow.select(F.col("station_id").alias("down_ml_id"), "m_5min", F.col("flow").alias("q_down"))
    measured = own.join(flow, "station_id").groupBy("stretch_id", "kind", "m_5min").agg(F.sum(F.coalesce("flow", F.lit(0.0))).alias("siblings"))
    # the stretch names both stations before the samples meet, so only its own two series are paired
    x = placed.join(up, "up_ml_id").join(down, ["down_ml_id", "m_5min"]).join(measured, ["stretch_id", "kind", "m_5min"], "left")
    change = F.when(F.col("kind") == "on", F.col("q_down") - F.col("q_up")).otherwise(F.col("q_up") - F.col("q_down"))
    raw = F.when(F.col("config_type") == "c", fraction * F.col("q_up")).otherwise(F.greatest(change, F.lit(0.0)))
    est = x.select("station_id", "kind", "m_5min", F.greatest(raw - F.coalesce("siblings", F.lit(0.0)), F.lit(0.0)).alias("flow"))
    steps = flow.select("m_5min").distinct()  # zeros at every sample: the result is that product
    nowhere = placed.where("stretch_id IS NULL").select("station_id", "kind").crossJoin(steps).select("station_id", "kind", "m_5min", F.lit(0.0).alias("flow"))
    return est.unionByName(nowhere)


def hold_to_step(series: DataFrame, dt_s: float, value: str = "flow") -> DataFrame:
    """5-minute counts as rates, each held for its 300 / dt steps: (…, step)."""
    r = exact_divisor(300, dt_s)
    held = series.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    return held.withColumn("step", F.col("m_5min") * r + F.col("_i")).withColumn(value, F.col(value) * SAMPLES_PER_HOUR).drop("_i", "m_5min")


def hourly_to_step(series: DataFrame, dt_s: float, value: str = "flow") -> DataFrame:
    """Sums of twelve 5-minute counts, held for 3600 / dt steps: (station_id, step, value)."""
    r = exact_divisor(3600, dt_s)
    hours = series.groupBy("station_id", F.floor(F.col("m_5min") / 12).alias("hour")).agg(F.sum(value).alias(value))
    return hours.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(r - 1)))).select("station_id", (F.col("hour") * r + F.col("_i")).alias("step"), value)


def inflow_series(series: DataFrame, station: int, dt_s: float, lo: int, hi: int) -> DataFrame:
    """(step, inflow): one station's rate over [lo, hi) of 5-minute samples, steps counted from the window's start."""
    own = series.where((F.col("station_id") == station) & (F.col("m_5min") >= lo) & (F.col("m_5min") < hi)).withColumn("m_5min", F.col("m_5min") - lo)
    made = hold_to_step(own, dt_s) if dt_s <= 300 else hourly_to_step(own, dt_s)
    return made.select("step", F.col("flow").alias("inflow"))


def ramp_demand(cells: DataFrame, flow: DataFrame, lo: int, hi: int, dt_s: float = 300, fill: Callable[[DataFrame], DataFrame] | None = None, gaps: str = "error") -> DataFrame:
    """(cell, step, demand): the rates of an on-ramp cell's stations, summed, over samples [lo, hi) at steps of ``dt_s``.

    ``flow`` (station_id, m_5min, flow: counts) is filled by ``fill`` first, with all its history, and cut to the window
    after. Virtual ids count for nothing. A sample that is missing or null after that is an error, which names the
    station and the sample (``gaps`` "null": no demand there), so no sum is silently too small. Stations without any
    row in ``flow`` are skipped.
    """
    ids = cells.where("on_ramp").select("cell", F.explode("on_ramp_vds_ids").alias("_id")).select("cell", F.col("_id").try_cast("long").alias("station_id")).where("station_id IS NOT NULL")
    own = fill(flow) if fill else flow
    seen = ids.join(own.select("station_id").distinct(), "station_id", "left_semi")
    dense = seen.withColumn("m_5min", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))))
    x = dense.join(own.select("station_id", "m_5min", "flow"), ["station_id", "m_5min"], "left")
    if gaps == "error":
        lost = F.raise_error(F.concat(F.lit("no flow at station "), F.col("station_id"), F.lit(", sample "), F.col("m_5min"))).cast("double")
        x = x.withColumn("flow", F.when(F.col("flow").isNull(), lost).otherwise(F.col("flow")))
    whole = F.when(F.count("flow") == F.count("*"), F.sum("flow")).alias("flow")
    summed = x.groupBy("cell", (F.col("m_5min") - lo).alias("m_5min")).agg(whole)
    stepped = hold_to_step(summed, dt_s) if dt_s <= 300 else hourly_to_step(summed.withColumnRenamed("cell", "station_id"), dt_s).withColumnRenamed("station_id", "cell")
    return stepped.select("cell", "step", F.col("flow").alias("demand"))


def split_ratio(cells: DataFrame, flow: DataFrame, stretches: DataFrame) -> DataFrame:
    """(cell, m_5min, beta, raw): off-ramp flow over itself and the main line's downstream; 0 where that is not positive
    or no station lies downstream; clipped below 1."""
    off = cells.where("off_ramp")
    ids = off.select("cell", F.explode("off_ramp_vds_ids").alias("_id")).select("cell", F.col("_id").try_cast("long").alias("station_id")).where("station_id IS NOT NULL")
    s = ids.join(flow, "station_id").groupBy("cell", "m_5min").agg(F.sum("flow").alias("s"))
    f = downstream_mainline(off, "off", stretches).join(flow.select(F.col("station_id").alias("down_ml_id"), "m_5min", F.col("flow").alias("f")), "down_ml_id").select("cell", "m_5min", "f")
    x = s.join(f, ["cell", "m_5min"], "left")
    total = F.col("f") + F.col("s")
    raw = F.coalesce(F.when(total > 0, F.try_divide(F.col("s"), total)), F.lit(0.0))
    return x.select("cell", "m_5min", clip_split_ratio(raw).alias("beta"), raw.alias("raw"))


def initial_density(cells: DataFrame, obs5: DataFrame, at: int) -> DataFrame:
    """(cell, rho0, problem): density of the cell's station at one sample; what is missing is told, not guessed."""
    now = obs5.where(F.col("m_5min") == at).select(F.col("station_id").alias("vds_id"), "density", F.lit(True).alias("_row"))
    x = cells.select("cell", "vds_id").join(now, "vds_id", "left")
    problem = F.when(F.col("vds_id").isNull(), "no_station").when(F.col("_row").isNull(), "no_row").when(F.col("density").isNull(), "no_value")
    return x.select("cell", F.col("density").alias("rho0"), problem.alias("problem"))


def scenario_table(cells: DataFrame, inflow: DataFrame, demand: DataFrame | float = 0.0, beta: DataFrame | float = 0.0) -> DataFrame:
    """(step, cell, demand, beta) for every cell and every step of ``inflow`` (step, inflow); scalars hold for all."""
    if inflow.columns != ["step", "inflow"]:
        raise ValueError("inflow needs the columns step and inflow")
    out = inflow.select("step").crossJoin(cells.select("cell"))  # the table is that product
    for name, given in (("demand", demand), ("beta", beta)):
        if isinstance(given, DataFrame):
            out = out.join(given.select("step", "cell", name), ["step", "cell"], "left").fillna(0.0, [name])
        else:
            out = out.withColumn(name, F.lit(float(given)))
    return out


def weight_mask(grid: DataFrame, dense: DataFrame | None, imputed_weight: float) -> DataFrame:
    """Dense (cell, m_5min, value, weight, genuine): 1 for observed entries, ``imputed_weight`` for filled ones, else 0. Without
    ``dense`` the grid is dense itself, its unfilled entries without a source, and nothing is joined."""
    genuine = F.col("source") == "observed"
    w = F.when(genuine, 1.0).when(F.col("source").isNotNull(), imputed_weight).otherwise(0.0)
    every = grid if dense is None else dense.join(grid, ["cell", "m_5min"], "left")
    return every.select("cell", "m_5min", "value", w.alias("weight"), F.coalesce(genuine, F.lit(False)).alias("genuine"))


def holdout_blocks(series: DataFrame, value: str, gap: int, every: int) -> DataFrame:
    """Mask blocks of ``gap`` samples, one in ``every``: (…, truth, gap_id), the value null inside a block."""
    at = F.floor(F.col("m_5min") / every)
    inside = F.col("m_5min") % every < gap
    out = series.withColumn("truth", F.when(inside, F.col(value))).withColumn("gap_id", F.when(inside, at))
    return out.withColumn(value, F.when(~inside, F.col(value)))


def holdout_report(series: DataFrame, value: str, lengths: tuple[int, ...], every: int, fillers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(strategy, gap, n, rmse, mape, bias): every filler's error on masked blocks of every length of gap. Rows are dealt once,
    by station; all fillers and lengths read that one shuffle."""
    series = deal_by_station(series)
    rows = [
        fill_accuracy(fill(holdout_blocks(series, value, gap, every)), value).select(F.lit(name).alias("strategy"), F.lit(gap).alias("gap"), "*")
        for gap in lengths for name, fill in fillers.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def fill_accuracy(filled: DataFrame, value: str) -> DataFrame:
    """(n, rmse, mape, bias) of filled values against the truth that was masked."""
    d: Column = F.col(value) - F.col("truth")
    return filled.where("truth IS NOT NULL").agg(
        F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), (100 * F.avg(F.when(F.col("truth") != 0, F.abs(d) / F.abs("truth")))).alias("mape"), F.avg(d).alias("bias")
    )
