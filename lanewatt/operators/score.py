"""Simulated against observed traffic: paired errors, aggregates, GEH, quantile pairs, performance metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import geh, pct_diff
from ..sources.scratch import written
from .quantiles import exact_percentiles


def run_key(rows: DataFrame) -> list[str]:
    """The key that keeps runs apart, where a table has several; each run is scored by itself."""
    return ["run_id"] if "run_id" in rows.columns else []


def block_mean(traj: DataFrame, steps: int) -> DataFrame:
    """(run_id, cell, m_5min, flow, density): means of flow and of post-step density over blocks of ``steps`` steps."""
    return traj.groupBy("run_id", "cell", F.floor(F.col("step") / steps).alias("m_5min")).agg(F.avg("flow").alias("flow"), F.avg("rho_post").alias("density"))


def downsample(traj: DataFrame, period: int) -> DataFrame:
    return traj.where(F.col("step") % period == 0)


def first_cell_per_station(cells: DataFrame) -> DataFrame:
    """Cells with ``vds_id`` kept for the first direct cell of a station only."""
    direct = F.col("vds_source").isin("direct", "direct_tiebreak")
    w = Window.partitionBy("corridor_id", F.when(direct, F.col("vds_id"))).orderBy("cell")
    first = direct & (F.row_number().over(w) == 1)
    return cells.withColumn("_first", first).withColumn("vds_id", F.when(F.col("_first"), F.col("vds_id"))).drop("_first")


def pair_sim_observed(sim5: DataFrame, obs5: DataFrame, cells: DataFrame) -> DataFrame:
    """(run_id, cell, station_id, m_5min, sim_flow, obs_flow, sim_density, obs_density) of directly assigned cells; a side's
    nulls stay null.

    ``obs5`` has station_id, m_5min, flow, density. Every run meets the same observations; without a ``run_id`` there is one
    run. Built once; the error metrics read it.
    """
    run = run_key(sim5)
    direct = cells.where(F.col("vds_source").isin("direct", "direct_tiebreak")).select("cell", F.col("vds_id").alias("station_id"))
    obs = obs5.select("station_id", "m_5min", F.col("flow").alias("obs_flow"), F.col("density").alias("obs_density"))
    sim = sim5.select(*run, "cell", "m_5min", F.col("flow").alias("sim_flow"), F.col("density").alias("sim_density"))
    return sim.join(direct, "cell").join(obs, ["station_id", "m_5min"], "left").select(*run, "cell", "station_id", "m_5min", "sim_flow", "obs_flow", "sim_density", "obs_density")


def pair_runs(traj: DataFrame, obs5: DataFrame, cells: DataFrame, steps: int) -> DataFrame:
    """What ``pair_sim_observed`` gives of ``block_mean``, with the ``hour``, by one shuffle of the trajectories.

    Rows are dealt by station and hour; block means are made where they lie, and meet one row of the hour's observations.
    What is summed by station and hour afterwards is not shuffled again.
    """
    direct = cells.where(F.col("vds_source").isin("direct", "direct_tiebreak")).select("cell", F.col("vds_id").alias("station_id"))
    keys = ["run_id", "cell", "station_id", "hour", "m_5min"]
    rows = traj.join(direct, "cell").select("run_id", "cell", "station_id", F.floor(F.col("step") / (12 * steps)).alias("hour"), F.floor(F.col("step") / steps).alias("m_5min"), "flow", "rho_post")
    sim = rows.repartition("station_id", "hour").groupBy(*keys).agg(F.avg("flow").alias("sim_flow"), F.avg("rho_post").alias("sim_density"))
    seen = F.collect_list(F.struct("m_5min", F.col("flow").alias("obs_flow"), F.col("density").alias("obs_density")))
    obs = obs5.groupBy("station_id", F.floor(F.col("m_5min") / 12).alias("hour")).agg(seen.alias("_seen"))
    own = F.explode_outer(F.filter("_seen", lambda o: o["m_5min"] == F.col("m_5min"))).alias("_o")
    x = sim.join(obs, ["station_id", "hour"], "left").select(*keys, "sim_flow", "sim_density", own)
    return x.select(*keys, "sim_flow", F.col("_o.obs_flow").alias("obs_flow"), "sim_density", F.col("_o.obs_density").alias("obs_density"))


def _all_errors(rows: DataFrame) -> list[Column]:
    one = _summed_errors if "flow_sq" in rows.columns else _errors
    return [*one("flow"), *one("density")]


def _errors(kind: str) -> list[Column]:
    o, d = F.col(f"obs_{kind}"), F.col(f"sim_{kind}") - F.col(f"obs_{kind}")
    return [
        F.sqrt(F.avg(d * d)).alias(f"{kind}_rmse"),
        (100 * F.avg(F.when(o != 0, F.abs(d) / F.abs(o)))).alias(f"{kind}_mape"),
        F.count(d).alias(f"{kind}_n"),
    ]


def rmse_mape(pairs: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Errors by run and cell; cells of ``cells`` without a pair get a row of zero counts in every run."""
    keys = [*run_key(pairs), "cell"]
    out = pairs.groupBy(*keys).agg(*_all_errors(pairs))
    if cells is None:
        return out
    every = cells.select("cell")
    if len(keys) > 1:
        out = written(out, "errors")  # a row a run and cell, so that pairs are made once
        every = every.crossJoin(out.select("run_id").distinct())  # the result's own rows
    return every.join(out, keys, "left").fillna(0, ["flow_n", "density_n"]).select(*keys, *out.columns[len(keys):])


def rmse_mape_all(pairs: DataFrame) -> DataFrame:
    """By run and cell, and pooled by run (cell null), in one pass by grouping sets; pooling is over residuals, not over
    cells' errors."""
    run = run_key(pairs)
    return pairs.groupingSets([[*run, "cell"], run], *run, "cell").agg(*_all_errors(pairs))


def corridor_rmse_mape(pairs: DataFrame) -> DataFrame:
    """Pooled errors, a row a run."""
    return pairs.groupBy(*run_key(pairs)).agg(*_all_errors(pairs))


def run_differences(stats: DataFrame, baseline: str, measures: list[str]) -> DataFrame:
    """(run_id, other keys, a difference for each of ``measures``): every run's row less the baseline's with the same keys,
    named ``measure_diff``; null where either is missing. ``stats`` has a row a run and keys, as the scores here do.

    The baseline's rows are joined by their keys, pooled rows (null cell) with pooled ones; a baseline that is no run
    gives nulls.
    """
    keys = [c for c in ("cell", "period", "m_5min", "hour") if c in stats.columns]
    base = stats.where(F.col("run_id") == baseline).select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(m).alias(f"_{m}") for m in measures])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
    return stats.where(F.col("run_id") != baseline).join(base, same, "left").select("run_id", *keys, *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_diff") for m in measures])


def corridor_aggregates(sim5: DataFrame, obs5: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Vehicle miles and hours by run, simulated over the cells' lengths and observed over the stations', where both are known."""
    own = first_cell_per_station(cells).where("vds_id IS NOT NULL").select("cell", F.col("length").alias("cell_length"), F.col("vds_id").alias("station_id"))
    obs = obs5.select("station_id", "m_5min", F.col("flow").alias("o"), F.col("density").alias("od"))
    rows = sim5.select(*run_key(sim5), "cell", "m_5min", "flow", "density").join(own, "cell").join(meta.select("station_id", F.col("length").alias("station_length")), "station_id").join(obs, ["station_id", "m_5min"])
    kept = rows.where("o IS NOT NULL AND od IS NOT NULL")
    out = kept.groupBy(*run_key(sim5)).agg(
        (F.sum(F.col("flow") * F.col("cell_length")) / 12).alias("sim_vmt"), (F.sum(F.col("density") * F.col("cell_length")) / 12).alias("sim_vht"),
        (F.sum(F.col("o") * F.col("station_length")) / 12).alias("obs_vmt"), (F.sum(F.col("od") * F.col("station_length")) / 12).alias("obs_vht"),
        F.countDistinct("station_id").alias("n_vds"),
    )
    return out.withColumn("vmt_pct", pct_diff("sim_vmt", "obs_vmt")).withColumn("vht_pct", pct_diff("sim_vht", "obs_vht"))


def hourly_geh(pairs: DataFrame) -> DataFrame:
    """(run_id, cell, hour, geh): hours from the window's start whose twelve samples are all there on both sides."""
    keys = [*run_key(pairs), "cell"]
    if "flow_sq" in pairs.columns:  # ``hour_sums``
        return pairs.where("n = 12").select(*keys, "hour", geh("s", "o").alias("geh"))
    dealt = "hour" in pairs.columns  # by ``pair_runs``, by station and hour
    at = ["station_id", "hour"] if dealt else [F.floor(F.col("m_5min") / 12).alias("hour")]
    hours = pairs.groupBy(*keys, *at).agg(
        F.avg("sim_flow").alias("s"), F.avg("obs_flow").alias("o"), F.count(F.col("sim_flow") + F.col("obs_flow")).alias("n")
    )
    return hours.where("n = 12").select(*keys, "hour", geh("s", "o").alias("geh"))


def flow_geh(pairs: DataFrame) -> DataFrame:
    """By run and cell, and pooled by run (cell null): hours, median GEH, and the share below 5 in per cent.

    Medians come of ranks over ranges, so the pooled one, over all hours of a state, is held by no single task.
    """
    hours = written(hourly_geh(pairs), "hours")
    keys = [c for c in ("run_id", "cell") if c in hours.columns]
    pooled = hours.unionByName(hours.withColumn("cell", F.lit(None).cast(dict(hours.dtypes)["cell"])))
    out = pooled.groupBy(*keys).agg(F.count("*").alias("n_hours"), (100 * F.avg((F.col("geh") < 5).cast("double"))).alias("geh_pct_under_5"))
    medians = exact_percentiles(pooled, keys, "geh", {"geh_median": 0.5})
    same = reduce(lambda a, b: a & b, [out[c].eqNullSafe(medians[c]) for c in keys])
    return out.join(medians, same, "left").select(*[out[c] for c in keys], "n_hours", "geh_median", "geh_pct_under_5")


def qq_rank_pairs(pairs: DataFrame, kind: str = "flow", least: int = 2) -> DataFrame:
    """(run_id, cell, rank, sim, obs): either side sorted by itself, paired by rank; cells with ``least`` pairs or more.
    Pairs are dealt once by run and cell; ranks of both sides and their rows come of that."""
    keys = [*run_key(pairs), "cell"]
    ok = pairs.where(F.col(f"obs_{kind}").isNotNull()).select(*keys, F.col(f"sim_{kind}").alias("sim"), F.col(f"obs_{kind}").alias("obs")).repartition(*keys)
    sides = ok.select(*keys, F.posexplode(F.array("sim", "obs")).alias("_side", "_v"))
    ranked = sides.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_side").orderBy("_v")))
    at = lambda k: F.max(F.when(F.col("_side") == k, F.col("_v")))
    out = ranked.groupBy(*keys, "rank").agg(at(0).alias("sim"), at(1).alias("obs"))
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


_SUMS = ("vht", "vmt", "delay", "productivity_loss")


def _cell_metrics(traj: DataFrame, cells: DataFrame, dt_hours: float) -> DataFrame:
    x = traj.join(cells.select("cell", "length", "v_f", "q_max", "rho_crit"), "cell")
    vht = (F.col("rho_post") * F.col("length") + F.col("queue_post")) * dt_hours
    vmt = F.col("rho_post") * F.col("speed") * dt_hours * F.col("length")
    congested = F.col("rho_post") > F.col("rho_crit")
    return x.withColumns({
        "vht": vht, "vmt": vmt, "delay": F.when(congested, vht - vmt / F.col("v_f")).otherwise(0.0),
        "productivity_loss": F.when(congested, (1 - F.col("flow") / F.col("q_max")) * dt_hours * F.col("length")).otherwise(0.0),
        "still": F.col("speed") == 0, "travel_time": F.try_divide(F.col("length"), F.col("speed")),
    })


def performance_metrics(traj: DataFrame, cells: DataFrame, dt_hours: float) -> DataFrame:
    """(run_id, step, vht, vmt, delay, productivity_loss, travel_time): delay and loss count only above critical density.

    Travel time is null (without bound) if a cell stands still.
    """
    total = [F.sum(n).alias(n) for n in _SUMS]
    return _cell_metrics(traj, cells, dt_hours).groupBy("run_id", "step").agg(*total, F.when(F.max("still"), None).otherwise(F.sum("travel_time")).alias("travel_time"))


def cell_totals(traj: DataFrame, cells: DataFrame, dt_hours: float) -> DataFrame:
    """(run_id, cell, vht, vmt, delay, productivity_loss): each cell's sums over all steps."""
    return _cell_metrics(traj, cells, dt_hours).groupBy("run_id", "cell").agg(*[F.sum(n).alias(n) for n in _SUMS])


def metric_totals(metrics: DataFrame, period: int, horizon: int) -> DataFrame:
    """Sums over whole periods of ``period`` steps, and over the horizon (period null), in one pass."""
    rows = metrics.where(F.col("step") < horizon - horizon % period).withColumn("period", F.floor(F.col("step") / period))
    sums = [F.sum(n).alias(n) for n in _SUMS]
    return rows.groupingSets([["run_id", "period"], ["run_id"]], "run_id", "period").agg(*sums, F.avg("travel_time").alias("mean_travel_time"), F.max("travel_time").alias("max_travel_time"))


def compare_grids(ours: DataFrame, reference: DataFrame, period: int) -> DataFrame:
    """By run and cell: errors of state and flow sampled every ``period`` steps against a reference (cell, step, rho, flow)."""
    a = downsample(ours, period).select(*run_key(ours), "cell", "step", F.col("rho_post").alias("sim_density"), F.col("flow").alias("sim_flow"))
    b = reference.select("cell", "step", F.col("rho").alias("obs_density"), F.col("flow").alias("obs_flow"))
    return rmse_mape(a.join(b, ["cell", "step"]))


def weighted_grid_error(sim5: DataFrame, grid: DataFrame, imputed_weight: float) -> DataFrame:
    """Weighted mean squared error over a (cell, m_5min, value, source) grid, RMSE and MAPE over observed entries only."""
    d = F.col("density") - F.col("value")
    genuine = F.col("source") == "observed"
    w = F.when(genuine, 1.0).otherwise(imputed_weight)
    return sim5.join(grid, ["cell", "m_5min"]).groupBy(*run_key(sim5)).agg(
        F.try_divide(F.sum(w * d * d), F.sum(w)).alias("weighted_mse"), F.sqrt(F.avg(F.when(genuine, d * d))).alias("rmse"),
        (100 * F.avg(F.when(genuine & (F.col("value") != 0), F.abs(d) / F.abs("value")))).alias("mape"), F.count_if(genuine).alias("n"),
    )


def observed_grid(obs5: DataFrame, cells: DataFrame, horizon: int) -> DataFrame:
    """(cell, m_5min, flow, density): every direct cell by every 5 minutes, null where not observed."""
    direct = cells.where(F.col("vds_source").isin("direct", "direct_tiebreak")).select("cell", F.col("vds_id").alias("station_id"))
    dense = direct.withColumn("m_5min", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn("m_5min", F.col("m_5min").cast("long"))
    return dense.join(obs5.select("station_id", "m_5min", "flow", "density"), ["station_id", "m_5min"], "left").select("cell", "m_5min", "flow", "density")


def hour_sums(pairs: DataFrame) -> DataFrame:
    """Sums of ``pair_runs`` by run, cell and hour, which errors, hourly GEH and aggregates come of: a row for up to twelve pairs."""
    aggs = [F.avg("sim_flow").alias("s"), F.avg("obs_flow").alias("o"), F.count(F.col("sim_flow") + F.col("obs_flow")).alias("n")]
    for k in ("flow", "density"):
        o, d = F.col(f"obs_{k}"), F.col(f"sim_{k}") - F.col(f"obs_{k}")
        part = F.when(o != 0, F.abs(d) / F.abs(o))
        aggs += [F.sum(d * d).alias(f"{k}_sq"), F.count(d).alias(f"{k}_n"), F.sum(part).alias(f"{k}_part"), F.count(part).alias(f"{k}_parts")]
    both = F.col("obs_flow").isNotNull() & F.col("obs_density").isNotNull()
    aggs += [F.sum(F.when(both, F.col(c))).alias(f"sum_{c}") for c in ("sim_flow", "sim_density", "obs_flow", "obs_density")] + [F.count_if(both).alias("both")]
    return pairs.groupBy(*run_key(pairs), "cell", "station_id", "hour").agg(*aggs)


def _summed_errors(kind: str) -> list[Column]:
    n = F.sum(f"{kind}_n")
    return [
        F.sqrt(F.try_divide(F.sum(f"{kind}_sq"), n)).alias(f"{kind}_rmse"), (100 * F.try_divide(F.sum(f"{kind}_part"), F.sum(f"{kind}_parts"))).alias(f"{kind}_mape"), n.alias(f"{kind}_n"),
    ]


def hours_aggregates(hours: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """``corridor_aggregates`` out of ``hour_sums``."""
    own = first_cell_per_station(cells).where("vds_id IS NOT NULL").select("cell", F.col("length").alias("cell_length"))
    kept = hours.where("both > 0").join(own, "cell").join(meta.select("station_id", F.col("length").alias("station_length")), "station_id")
    total = lambda side, kind, length: (F.sum(F.col(f"sum_{side}_{kind}") * F.col(f"{length}_length")) / 12)
    out = kept.groupBy(*run_key(hours)).agg(
        total("sim", "flow", "cell").alias("sim_vmt"), total("sim", "density", "cell").alias("sim_vht"),
        total("obs", "flow", "station").alias("obs_vmt"), total("obs", "density", "station").alias("obs_vht"), F.countDistinct("station_id").alias("n_vds"),
    )
    return out.withColumn("vmt_pct", pct_diff("sim_vmt", "obs_vmt")).withColumn("vht_pct", pct_diff("sim_vht", "obs_vht"))


def merge_geh(stats: DataFrame, hours: DataFrame) -> DataFrame:
    return stats.join(hours, [*run_key(stats), "cell"], "left")


def top_cells(stats: DataFrame, k: int = 5) -> DataFrame:
    """The k worst cells of every run by density error; equal errors by cell."""
    order = Window.partitionBy(*run_key(stats)).orderBy(F.desc_nulls_last("density_rmse"), "cell")
    if not run_key(stats):
        return stats.orderBy(F.desc_nulls_last("density_rmse"), "cell").limit(k)
    return stats.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def validation_report(pairs: DataFrame, aggregates: DataFrame, k: int = 5) -> DataFrame:
    """(run_id, item, cell, value): scored cells, pooled errors, aggregates, share of good hours, and the k worst cells, all
    by run.

    Pairs of ``pair_runs`` come as their ``hour_sums``, others are written once; errors by cell and pooled come of one pass
    over them, and are written too, as three parts of the report read them.
    """
    if "flow_sq" not in pairs.columns:
        pairs = written(pairs, "pairs")
    run = run_key(pairs)
    every = written(rmse_mape_all(pairs), "errors")
    stats = every.where("cell IS NOT NULL")
    good = hourly_geh(pairs).groupBy(*run).agg((100 * F.avg((F.col("geh") < 5).cast("double"))).alias("geh_pct_under_5"))
    wide = every.where("cell IS NULL").select(*run, "flow_rmse", "flow_mape", "density_rmse", "density_mape")
    for part in (aggregates, good):
        wide = wide.join(part, run, "left") if run else wide.crossJoin(part)  # one row each, or one a run
    item = lambda name, value: F.struct(F.lit(name).alias("item"), F.lit(None).cast("long").alias("cell"), value.cast("double").alias("value"))
    flat = wide.select(*run, F.explode(F.array(*[item(n, F.col(n)) for n in wide.columns if n not in run])).alias("r")).select(*run, "r.*")
    scored = stats.where("density_n > 0")
    count = scored.groupBy(*run).agg(F.count("*").alias("n")).select(*run, item("n_scored", F.col("n")).alias("r")).select(*run, "r.*")
    worst = top_cells(scored, k).select(*run, F.lit("worst_density_rmse").alias("item"), F.col("cell").cast("long").alias("cell"), F.col("density_rmse").alias("value"))
    return flat.unionByName(count).unionByName(worst)
