"""Flow/density curves for every station at once, ramp capacities, and cell parameters from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import min_observed, standardize
from ..sources.scratch import written
from .gaps import TIE, iqr_fence, whiten
from .quality import fd_gate
from .quantiles import exact_percentiles

#: The outcome of a calibration.
STATUS = {0: "ok", 1: "no_data", 2: "no_metadata", 3: "too_few_congested", 4: "gate_failed"}


def attach_lanes(ts: DataFrame, meta: DataFrame) -> DataFrame:
    """Lanes of each row's station; rows of stations without metadata go. The smaller side is left to the planner."""
    return ts.join(meta.select("station_id", "lanes"), "station_id")


def available_stations(meta: DataFrame, ts: DataFrame, kind: str | None = None) -> DataFrame:
    own = meta if kind is None else meta.where(F.col("type") == kind)
    return own.select("station_id").distinct().join(ts.select("station_id").distinct(), "station_id", "left_semi")


def fd_seed(df: DataFrame) -> DataFrame:
    """(station_id, seed): the density of the largest flow, the earliest of equals."""
    return df.groupBy("station_id").agg(F.min_by("density", F.struct((-F.col("flow")).alias("f"), F.col("ts").alias("t"))).alias("seed"))


def _free_flow_speed() -> Column:
    x, y, free = F.col("density"), F.col("flow"), F.col("density") <= F.col("seed")
    return F.try_divide(F.sum(F.when(free, x * y)), F.sum(F.when(free, x * x))).alias("free_flow_speed")


def fit_free_flow(df: DataFrame) -> DataFrame:
    """(station_id, free_flow_speed): least squares through the origin up to the seed."""
    return df.groupBy("station_id").agg(_free_flow_speed())


def congestion_bins(df: DataFrame, size: int = 10, k: float = 1.0) -> DataFrame:
    """(station_id, bin, density, flow): congested rows by density in full bins of ``size``; in each the whitened flows
    over the upper fence go, then mean density and largest flow stand for it."""
    w = Window.partitionBy("station_id").orderBy("density", "ts")
    over = Window.partitionBy("station_id")
    rows = df.where("density > seed").withColumn("_n", F.row_number().over(w) - 1).withColumn("_all", F.count("*").over(over))
    rows = rows.withColumn("bin", F.floor(F.col("_n") / size)).where((F.col("bin") + 1) * size <= F.col("_all"))
    fence = F.col("_q")[1] + k * (F.col("_q")[1] - F.col("_q")[0])
    rows = rows.withColumn("_q", F.percentile("whitened", F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy("station_id", "bin")))
    return rows.where(F.col("whitened") <= fence + TIE).groupBy("station_id", "bin").agg(F.avg("density").alias("density"), F.max("flow").alias("flow"))


def fit_congestion(bins: DataFrame) -> DataFrame:
    """(station_id, slope, intercept, jam_density) of the congested branch, by least squares."""
    fit = bins.groupBy("station_id").agg(F.regr_slope("flow", "density").alias("slope"), F.regr_intercept("flow", "density").alias("intercept"))
    return fit.withColumn("jam_density", F.try_divide(-F.col("intercept"), F.col("slope")))


def fd_peak(fit: DataFrame) -> DataFrame:
    """Where the two branches meet: critical density, capacity, and the wave speed."""
    crit = F.try_divide(F.col("intercept"), F.col("free_flow_speed") - F.col("slope"))
    return fit.withColumn("critical_density", crit).withColumn("capacity", F.col("free_flow_speed") * F.col("critical_density")).withColumn("congestion_wave_speed", -F.col("slope"))


def usable_rows(ts: DataFrame, meta: DataFrame, threshold: float = 100.0, k: float = 1.0) -> DataFrame:
    """Per-lane flow and density, observed well enough, whitened by block of the week and inside the station's fence."""
    rows = min_observed(standardize(attach_lanes(ts, meta)), threshold).where("flow IS NOT NULL AND density IS NOT NULL")
    return iqr_fence(whiten(rows, "flow"), "whitened", k)


def calibrate_fd(ts: DataFrame, meta: DataFrame, stations: DataFrame | None = None, bin_size: int = 10) -> DataFrame:
    """The triangle of every station in ``stations`` (all of ``meta`` by default), with code and status.

    ``ts`` has station_id, ts, pct_observed, total_flow_5min, avg_speed_mph. The usable rows are made and written once,
    dealt by station with their station's seed; free flow and the count of congested rows are one aggregate of them.
    """
    asked = (stations if stations is not None else meta.select("station_id")).select("station_id").distinct()
    rows = usable_rows(ts.join(asked, "station_id", "left_semi"), meta)
    first = F.min_by("density", F.struct((-F.col("flow")).alias("f"), F.col("ts").alias("t"))).over(Window.partitionBy("station_id"))
    seeded = written(rows.withColumn("seed", first).select("station_id", "ts", "density", "flow", "whitened", "seed"), "usable")
    enough = (F.floor(F.count_if(F.col("density") > F.col("seed")) / bin_size) >= 2).alias("enough")
    fit = fd_peak(seeded.groupBy("station_id").agg(_free_flow_speed(), enough).join(fit_congestion(congestion_bins(seeded, bin_size)), "station_id", "left"))
    known = meta.select("station_id", F.lit(True).alias("has_meta")).distinct()
    seen = ts.select("station_id", F.lit(True).alias("has_data")).distinct()
    out = asked.join(seen, "station_id", "left").join(known, "station_id", "left").join(fit, "station_id", "left")
    code = (
        F.when(F.col("has_data").isNull(), 1).when(F.col("has_meta").isNull(), 2).when(F.col("enough").isNull(), 1).when(~F.col("enough"), 3).otherwise(0)
    )
    names = ["capacity", "free_flow_speed", "congestion_wave_speed", "jam_density", "critical_density"]
    gated = fd_gate(out.withColumn("calibration_code", code).select("station_id", *names, "calibration_code"))
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return gated.withColumn("calibration_status", status[F.col("calibration_code")])


def calibrate_ramp_capacity(ts: DataFrame, stations: DataFrame, q: float = 0.99, threshold: float = 100.0, k: float = 1.5) -> DataFrame:
    """(station_id, ramp_capacity, n_observations, calibration_code): the q-quantile of the fenced hourly flow."""
    seen = ts.groupBy("station_id").agg(F.lit(True).alias("has_data"))
    rows = min_observed(ts, threshold).withColumn("flow", F.col("total_flow_5min") * 12).where("flow IS NOT NULL")
    fenced = written(iqr_fence(whiten(rows, "flow"), "whitened", k).select("station_id", "flow"), "fenced")
    kept = fenced.groupBy("station_id").agg(F.count("*").alias("n_observations")).join(exact_percentiles(fenced, ["station_id"], "flow", {"ramp_capacity": q}), "station_id")
    out = stations.select("station_id").distinct().join(seen, "station_id", "left").join(kept, "station_id", "left")
    code = F.when(F.col("has_data").isNull(), 1).when(F.col("n_observations").isNull(), 2).when(F.col("ramp_capacity") > 0, 0).otherwise(4)
    return out.select("station_id", "ramp_capacity", F.coalesce("n_observations", F.lit(0)).cast("long").alias("n_observations"), code.alias("calibration_code"))


def merge_calibration(new: DataFrame, previous: DataFrame) -> DataFrame:
    """New results where a station was processed, the previous ones elsewhere."""
    kept = previous.join(new.select("station_id"), "station_id", "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def assemble_freeway(cells: DataFrame, fd: DataFrame, ramps: DataFrame) -> DataFrame:
    """Cell parameters: the station's per-lane capacity, jam and critical density times the cell's lanes; speeds as they are.

    A cell goes by ``fd_vds_id`` where it has one; ``unresolved`` marks cells without calibrated parameters.
    """
    own = cells.withColumn("effective_id", F.coalesce("fd_vds_id", "vds_id"))
    p = fd.where("calibration_code = 0").select(F.col("station_id").alias("effective_id"), "capacity", "free_flow_speed", "congestion_wave_speed", "jam_density", "critical_density")
    out = own.join(p, "effective_id", "left")
    lanes = F.col("lanes")
    out = out.select(
        "corridor_id", "cell", "length", "lanes", "on_ramp", "off_ramp", "on_ramp_vds_ids", "off_ramp_vds_ids", "effective_id",
        (F.col("capacity") * lanes).alias("q_max"), F.col("free_flow_speed").alias("v_f"), F.col("congestion_wave_speed").alias("w"),
        (F.col("jam_density") * lanes).alias("rho_jam"), (F.col("critical_density") * lanes).alias("rho_crit"), F.col("capacity").isNull().alias("unresolved"),
    )
    for side in ("on", "off"):
        out = out.join(ramp_capacity(cells, ramps, side).select("corridor_id", "cell", F.col("capacity").alias(f"{side}_ramp_capacity")), ["corridor_id", "cell"], "left")
    return out.drop("on_ramp_vds_ids", "off_ramp_vds_ids")


def redirect_failed_fd(cells: DataFrame, fd: DataFrame) -> DataFrame:
    """``fd_vds_id`` for cells whose station failed: the nearest upstream station with code 0; ``redirected`` tells.

    Cells with an override, and stations without a result, are left alone; null with redirected true: none upstream.
    """
    codes = fd.select(F.col("station_id").alias("vds_id"), F.col("calibration_code").alias("_code"))
    w = Window.partitionBy("corridor_id").orderBy("cell")
    joined = cells.join(codes, "vds_id", "left").withColumn("_good", F.last(F.when(F.col("_code") == 0, F.col("vds_id")), ignorenulls=True).over(w))
    failed = F.col("fd_vds_id").isNull() & F.coalesce(F.col("_code") != 0, F.lit(False))
    return joined.withColumn("redirected", failed).withColumn("fd_vds_id", F.when(failed, F.col("_good")).otherwise(F.col("fd_vds_id"))).drop("_code", "_good")


def ramp_capacity(cells: DataFrame, capacities: DataFrame, side: str) -> DataFrame:
    """(corridor_id, cell, capacity, n_ids, n_missing): the sum of what the side's stations have; null if none has."""
    ids = cells.where(F.col(f"{side}_ramp")).select("corridor_id", "cell", F.explode(f"{side}_ramp_vds_ids").alias("_id")).withColumn("station_id", F.col("_id").try_cast("long"))
    found = ids.join(capacities.select("station_id", "ramp_capacity"), "station_id", "left")
    return found.groupBy("corridor_id", "cell").agg(F.sum("ramp_capacity").alias("capacity"), F.count("*").alias("n_ids"), F.count_if(F.col("ramp_capacity").isNull()).alias("n_missing"))


def cfl_advisory(freeway: DataFrame) -> DataFrame:
    """The largest stable step: bound, the first cell that sets it, the largest 5 s multiple strictly below; min, mean, max."""
    dt = F.col("length") / F.col("v_f") * 3600
    one = freeway.withColumn("_dt", dt).agg(
        F.min("_dt").alias("bound_s"), F.min_by("cell", F.struct("_dt", "cell")).alias("binding_cell"), F.avg("_dt").alias("mean_s"), F.max("_dt").alias("max_s")
    )
    step = F.floor((F.col("bound_s") - 1e-9) / 5) * 5
    return one.withColumn("suggested_s", F.when(step > 0, step.cast("double")).otherwise(F.col("bound_s")))
