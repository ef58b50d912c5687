"""Queries over detector series, calibration, scoring and charging load."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calibrate, gaps, load, quality, scenario, score
from ..sources import ingest
from ..sources.scratch import scratch_folder, written
from .registry import query
from .views import HORIZON, sample, with_ts

SPEC = load.PadSpec()
#: Positions of the views' corridor (25 cells) on a grid of half a metre, and the bins used here.
BIN_M = 804.672
DT_H = 1 / 12
PER_LANE = "SELECT d.station_id, m_5min, pct_observed, total_flow_5min * 12e0 / 3e0 AS flow, total_flow_5min * 12e0 / 3e0 / nullif(avg_speed_mph, 0e0) AS density FROM det d"


def meta(t):
    """Stations of the detector view, of three lanes each: one for sixteen suppliers."""
    s = t.supplier.select(F.floor(F.col("s_suppkey") / 16).alias("station_id")).distinct()
    return s.select("station_id", F.lit(3).alias("lanes"), F.lit("ML").alias("type"), (0.4 + F.col("station_id") % 6 * 0.07).alias("length"))


META_SQL = "meta AS (SELECT station_id, 3 AS lanes, 4e-1 + (station_id % 6) * 7e-2 AS length FROM (SELECT DISTINCT CAST(floor(s_suppkey / 16e0) AS BIGINT) AS station_id FROM supplier))"


@query("b1_standardize", f"SELECT station_id, m_5min, pct_observed, 3 AS lanes, round(flow, 4) AS flow, round(density, 4) AS density FROM ({PER_LANE})")
def _(t):
    return S.standardize(t.det.withColumn("lanes", F.lit(3)))


@query("b2_total_flow_density", "SELECT d.station_id, d.m_5min, round(o.flow, 4) AS flow, round(o.density, 4) AS density FROM det d JOIN obs5 o USING (station_id, m_5min)")
def _(t):
    return S.total_flow_density(t.det).select("station_id", "m_5min", "flow", "density")


@query("b3_min_observed", "SELECT station_id, count(*) AS n FROM det WHERE pct_observed >= 100 GROUP BY 1")
def _(t):
    return S.min_observed(t.det).groupBy("station_id").agg(F.count("*").alias("n"))


@query("b4_time_window", "SELECT station_id, m_5min, round(avg_speed_mph, 4) AS avg_speed_mph FROM det WHERE m_5min >= 288 AND m_5min < 576")
def _(t):
    return S.time_window(t.det, 288, 576, "m_5min").select("station_id", "m_5min", "avg_speed_mph")


@query("b5_require_contiguous", "SELECT station_id, count(*) AS n_rows, CAST(8640 AS BIGINT) AS expected FROM det GROUP BY 1 HAVING count(*) <> 8640")
def _(t):
    return quality.require_contiguous(t.det, HORIZON)


@query("b6_require_no_null", "SELECT station_id, count(*) AS n_null FROM det WHERE total_flow_5min IS NULL GROUP BY 1")
def _(t):
    return quality.require_no_null(t.det, "total_flow_5min")


@query("b8_slot_key", "SELECT station_id, m_5min % 2016 AS slot_of_week, count(*) AS n FROM det GROUP BY 1, 2")
def _(t):
    return with_ts(t.det).groupBy("station_id", S.slot_of_week("ts").alias("slot_of_week")).agg(F.count("*").alias("n"))


@query("b20_fd_gate", """
WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) * 60 AS capacity, 60e0 AS free_flow_speed, CASE WHEN p_size % 7 = 0 THEN 61e0 ELSE 15e0 END AS congestion_wave_speed,
  CAST(p_size AS DOUBLE) * 5 + CASE WHEN p_size % 5 = 0 THEN 9 ELSE 0 END * 1e0 AS jam_density, CAST(p_size AS DOUBLE) - CASE WHEN p_size % 4 = 0 THEN 3 ELSE 0 END AS critical_density FROM part),
g AS (SELECT *, CASE WHEN capacity <= 0 THEN 'capacity_not_positive' WHEN jam_density <= 0 THEN 'jam_density_not_positive' WHEN critical_density <= 0 THEN 'critical_density_not_positive'
  WHEN congestion_wave_speed >= free_flow_speed THEN 'wave_not_slower' WHEN critical_density >= jam_density THEN 'critical_not_below_jam'
  WHEN abs(capacity - free_flow_speed * critical_density) > 0.05 * capacity THEN 'free_flow_identity'
  WHEN abs(capacity - congestion_wave_speed * (jam_density - critical_density)) > 0.05 * capacity THEN 'congestion_identity' END AS reason FROM p)
SELECT id, CASE WHEN reason IS NULL THEN 0 ELSE 4 END AS calibration_code, reason, CASE WHEN reason IS NULL THEN capacity END AS capacity FROM g""")
def _(t):
    p = F.col("p_size").cast("double")
    df = t.part.select(
        F.col("p_partkey").cast("long").alias("id"), (p * 60).alias("capacity"), F.lit(60.0).alias("free_flow_speed"), F.when(F.col("p_size") % 7 == 0, 61.0).otherwise(15.0).alias("congestion_wave_speed"),
        (p * 5 + F.when(F.col("p_size") % 5 == 0, 9).otherwise(0)).alias("jam_density"), (p - F.when(F.col("p_size") % 4 == 0, 3).otherwise(0)).alias("critical_density"),
    )
    return quality.fd_gate(df).select("id", "calibration_code", "reason", "capacity")


@query("b21_geh", "SELECT p_partkey AS id, round(CASE WHEN p_size + p_retailprice = 0 THEN 0 ELSE sqrt(2 * (p_size - p_retailprice) ** 2 / (p_size + p_retailprice)) END, 4) AS geh FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), S.geh(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("geh"))


@query("b22_pct_diff", """SELECT c_custkey AS id, round(100 * (c_acctbal - c_nationkey) / nullif(CAST(c_nationkey AS DOUBLE), 0), 4) AS diff,
round(CASE WHEN c_nationkey = 0 THEN 0 ELSE 100 * (c_nationkey - c_acctbal) / c_nationkey END, 4) AS attenuation FROM customer""")
def _(t):
    base = F.col("c_nationkey").cast("double")
    return t.customer.select(F.col("c_custkey").alias("id"), S.pct_diff("c_acctbal", base).alias("diff"), S.pct_attenuation(base, "c_acctbal").alias("attenuation"))


@query("b23_clip_split_ratio", """SELECT count(*) FILTER (b < 0) AS n_below, round(avg(-b) FILTER (b < 0), 4) AS mean_below, count(*) FILTER (b > 0.9999999999999999) AS n_above,
round(avg(b - 1) FILTER (b > 0.9999999999999999), 4) AS mean_above FROM (SELECT c_acctbal / 5000e0 AS b FROM customer)""")
def _(t):
    return S.split_ratio_report(t.customer.select((F.col("c_acctbal") / 5000).alias("beta")))


@query("b24_snap_to_grid", "SELECT cell, round(round_even(length * 1609.344 / 0.5, 0) * 0.5, 4) AS metres FROM cells")
def _(t):
    return t.cells.select("cell", S.snap_to_grid("length", 0.5).alias("metres"))


@query("b26_window_label", "SELECT DISTINCT p_size * 15 AS s, CASE WHEN p_size < 4 THEN p_size * 15 || 's' ELSE p_size // 4 || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END || 'min' END AS label FROM part")
def _(t):
    return t.part.select((F.col("p_size") * 15).alias("s")).distinct().select("s", S.window_label("s").alias("label"))


# Gaps.


@query("h1_contiguous_grid", "SELECT d.station_id, CAST(105408 AS BIGINT) AS n_rows, 105408 - count(*) AS n_gaps, CAST(0 AS BIGINT) AS first_sample, CAST(105407 AS BIGINT) AS last_sample FROM det d GROUP BY 1")
def _(t):
    g = gaps.contiguous_grid(with_ts(t.det)).withColumn("k", sample())
    return g.groupBy("station_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("pct_observed").isNull()).alias("n_gaps"), F.min("k").alias("first_sample"), F.max("k").alias("last_sample"))


GRID_SQL = "grid AS (SELECT s.station_id, g.m_5min, d.total_flow_5min AS v FROM (SELECT DISTINCT station_id FROM det) s CROSS JOIN (SELECT unnest(range(0, 8640)) AS m_5min) g LEFT JOIN det d ON d.station_id = s.station_id AND d.m_5min = g.m_5min)"


def grid(t):
    return gaps.reindex_window(with_ts(t.det).select("station_id", "ts", F.col("total_flow_5min").alias("v")), "2024-01-01 00:00:00", "2024-01-31 00:00:00").withColumn("m_5min", sample())


@query("h2_reindex_window", f"WITH {GRID_SQL} SELECT station_id, count(*) AS n_rows, count(v) AS n, round(sum(v), 2) AS total FROM grid GROUP BY 1", 2)
def _(t):
    return grid(t).groupBy("station_id").agg(F.count("*").alias("n_rows"), F.count("v").alias("n"), F.sum("v").alias("total"))


@query("d1_slot_stats", "SELECT station_id, m_5min % 2016 AS slot_of_week, round(avg(total_flow_5min), 4) AS mean, round(stddev_samp(total_flow_5min), 4) AS std, count(total_flow_5min) AS n FROM det GROUP BY 1, 2")
def _(t):
    return gaps.slot_stats(with_ts(t.det), "total_flow_5min")


WHITE = """white AS (SELECT *, (flow - avg(flow) OVER w) / nullif(stddev_samp(flow) OVER w, 0) AS whitened
FROM (SELECT * FROM ({per_lane}) WHERE pct_observed >= 100 AND flow IS NOT NULL AND density IS NOT NULL) WINDOW w AS (PARTITION BY station_id, m_5min % 2016))""".format(per_lane=PER_LANE)


@query("e1_whiten", f"WITH {WHITE} SELECT station_id, m_5min, round(whitened, 4) AS whitened FROM white")
def _(t):
    rows = S.min_observed(S.standardize(with_ts(t.det).withColumn("lanes", F.lit(3)))).where("flow IS NOT NULL AND density IS NOT NULL")
    return gaps.whiten(rows, "flow").select("station_id", "m_5min", "whitened")


KEPT = """kept AS (SELECT w.* FROM white w JOIN (SELECT station_id, quantile_cont(whitened, 0.25) AS q1, quantile_cont(whitened, 0.75) AS q3 FROM white GROUP BY 1) q USING (station_id)
WHERE whitened BETWEEN q1 - (q3 - q1) - 1e-9 AND q3 + (q3 - q1) + 1e-9)"""


@query("d2_iqr_fence", f"WITH {WHITE}, {KEPT} SELECT station_id, count(*) AS n, round(avg(flow), 3) AS mean_flow FROM kept GROUP BY 1", 3)
def _(t):
    return calibrate.usable_rows(with_ts(t.det), meta(t)).groupBy("station_id").agg(F.count("*").alias("n"), F.avg("flow").alias("mean_flow"))


RUNS = """runs AS (SELECT *, sum(change) OVER (PARTITION BY station_id ORDER BY m_5min) AS run FROM (
SELECT *, CASE WHEN (v IS NULL) <> lag(v IS NULL) OVER (PARTITION BY station_id ORDER BY m_5min) THEN 1 ELSE 0 END AS change FROM grid)),
short AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN count(*) OVER (PARTITION BY station_id, run) * 5 <= 10 THEN last_value(v IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY m_5min) END AS p FROM runs)"""


@query("e2_persistence_fill", f"WITH {GRID_SQL}, {RUNS} SELECT station_id, m_5min, round(p, 4) AS v FROM short")
def _(t):
    return gaps.persistence_fill(grid(t), "v", 10).select("station_id", "m_5min", "v")


@query("e3_slot_mean_fill", f"WITH {GRID_SQL} SELECT station_id, m_5min, round(coalesce(v, a), 4) AS v, v IS NULL AND a IS NOT NULL AS filled FROM (SELECT *, avg(v) OVER (PARTITION BY station_id, m_5min % 2016) AS a FROM grid)")
def _(t):
    return gaps.slot_mean_fill(grid(t), "v").select("station_id", "m_5min", "v", "filled")


@query("e4_stochastic_slot_fill", f"""WITH {GRID_SQL} SELECT station_id, m_5min, round(v, 4) AS observed, v IS NULL AND count(v) OVER w > 0 AS filled, true AS in_range,
CASE WHEN v IS NULL AND (count(v) OVER w = 1 OR stddev_samp(v) OVER w = 0) THEN round(avg(v) OVER w, 4) END AS settled FROM grid WINDOW w AS (PARTITION BY station_id, m_5min % 2016)""")
def _(t):
    """A draw has no SQL: that observed values stay, which gaps are filled, and that draws keep to their slot's law, has."""
    g = grid(t).withColumn("observed", F.col("v"))
    stats = gaps.slot_stats(g, "v")
    x = gaps.stochastic_slot_fill(g, "v", 7).withColumn("slot_of_week", S.slot_of_week("ts")).join(stats, ["station_id", "slot_of_week"])
    gap = F.col("observed").isNull()
    std = F.coalesce("std", F.lit(0.0))
    low, high = F.greatest(F.col("mean") - 6.5 * std, F.lit(0.0)), F.greatest(F.col("mean") + 6.5 * std, F.lit(0.0))
    sure = (F.col("n") == 1) | (F.col("std") == 0)
    return x.select("station_id", "m_5min", "observed", (gap & F.col("v").isNotNull()).alias("filled"), F.coalesce(~gap | F.col("v").between(low - 1e-9, high + 1e-9), F.lit(True)).alias("in_range"), F.when(gap & sure, F.col("v")).alias("settled"))


@query("e5_gap_aware_fill", f"WITH {GRID_SQL}, {RUNS} SELECT station_id, m_5min, round(coalesce(p, avg(v) OVER (PARTITION BY station_id, m_5min % 2016)), 4) AS v FROM short")
def _(t):
    return gaps.gap_aware_fill(grid(t), "v").select("station_id", "m_5min", "v")


FIELD_SQL = """field AS (SELECT c.cell, g.m_5min, o.density AS value FROM cells c CROSS JOIN (SELECT unnest(range(0, 8640)) AS m_5min) g LEFT JOIN obs5 o ON o.station_id = c.vds_id AND o.m_5min = g.m_5min)"""


def field(t, horizon=HORIZON):
    cells = t.cells.select("cell", F.col("vds_id").alias("station_id"))
    return gaps.cell_grid(cells, t.obs5, "density", horizon)


def field_known(t):
    """The entries of ``field`` that have a value, without the grid."""
    cells = t.cells.where("vds_id IS NOT NULL").select("cell", F.col("vds_id").alias("station_id"))
    return t.obs5.where("density IS NOT NULL").join(cells, "station_id").select("cell", "m_5min", F.col("density").alias("value"), F.lit(True).alias("direct"))


KNN = """SELECT t.cell, t.m_5min, round(sum(exp(-(d - 1)) * u.value) / sum(CASE WHEN u.value IS NOT NULL THEN exp(-(d - 1)) END), 4) AS value
FROM (SELECT * FROM field WHERE value IS NULL) t CROSS JOIN (SELECT dc, dm, abs(dc) + abs(dm) AS d FROM (SELECT unnest(range(-3, 4)) AS dc) CROSS JOIN (SELECT unnest(range(-3, 4)) AS dm) WHERE dc <> 0 AND abs(dc) + abs(dm) <= 3) o
LEFT JOIN field u ON u.cell = t.cell + dc AND u.m_5min = t.m_5min + dm GROUP BY 1, 2"""


@query("c16_knn_impute", f"WITH {FIELD_SQL} {KNN}")
def _(t):
    f = field(t)
    return gaps.knn_impute(f, f.where("value IS NOT NULL"), f.where("value IS NULL"))


@query("h11_augment_grid", f"""WITH {FIELD_SQL}, f2 AS (SELECT f.cell, f.m_5min, coalesce(f.value, CASE WHEN c.vds_id IS NOT NULL THEN h.a END) AS value,
CASE WHEN f.value IS NOT NULL THEN 'observed' WHEN c.vds_id IS NOT NULL AND h.a IS NOT NULL THEN 'hist' END AS source, c.vds_id IS NOT NULL AS direct
FROM field f JOIN cells c USING (cell) LEFT JOIN (SELECT station_id, m_5min % 288 AS m, avg(density) AS a FROM obs5 GROUP BY 1, 2) h ON h.station_id = c.vds_id AND h.m = f.m_5min),
k AS ({KNN.replace("(SELECT * FROM field WHERE value IS NULL) t", "(SELECT * FROM f2 WHERE value IS NULL AND NOT direct) t").replace("LEFT JOIN field u", "LEFT JOIN f2 u")})
SELECT cell, m_5min, round(value, 4) AS value, source FROM f2 WHERE value IS NOT NULL UNION ALL SELECT cell, m_5min, value, 'knn' FROM k WHERE value IS NOT NULL""")
def _(t):
    # means of stations, which several cells share
    means = t.obs5.groupBy("station_id", (F.col("m_5min") % 288).alias("m_5min")).agg(F.avg("density").alias("value"))
    history = t.cells.select("cell", F.col("vds_id").alias("station_id")).join(means, "station_id").select("cell", "m_5min", "value")
    return gaps.augment_grid(field(t), history)


@query("a20_imputed_grid_counts", f"""WITH {FIELD_SQL}, g AS (SELECT CASE WHEN direct THEN 'observed' ELSE 'knn' END AS source FROM (SELECT f.*, c.vds_id IS NOT NULL AS direct FROM field f JOIN cells c USING (cell)) WHERE value IS NOT NULL)
SELECT source, count(*) AS n FROM g GROUP BY 1 UNION ALL SELECT 'unfilled', (SELECT count(*) FROM cells) * 8640 - count(*) FROM g""")
def _(t):
    g = field_known(t).withColumn("source", F.when(F.col("direct"), "observed").otherwise("knn"))
    path = scratch_folder(t.spark, "imputed")
    ingest.write_imputed_grid(g.select("cell", "m_5min", "value", "source"), path)
    return ingest.imputed_counts(t.spark.read.parquet(path), t.cells.count(), HORIZON)


# Calibration.

FIT = f"""{WHITE}, {KEPT}, seed AS (SELECT station_id, arg_min(density, (-flow, m_5min)) AS seed FROM kept GROUP BY 1),
s AS (SELECT k.*, seed FROM kept k JOIN seed USING (station_id)),
free AS (SELECT station_id, sum(density * flow) / sum(density * density) AS v FROM s WHERE density <= seed GROUP BY 1),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY station_id ORDER BY density, m_5min) - 1) // 10 AS bin, count(*) OVER (PARTITION BY station_id) AS n FROM s WHERE density > seed),
full_bins AS (SELECT * FROM numbered WHERE (bin + 1) * 10 <= n),
fenced AS (SELECT f.* FROM full_bins f JOIN (SELECT station_id, bin, quantile_cont(whitened, 0.75) AS q3, quantile_cont(whitened, 0.25) AS q1 FROM full_bins GROUP BY 1, 2) q USING (station_id, bin) WHERE whitened <= q3 + (q3 - q1) + 1e-9),
bins AS (SELECT station_id, bin, avg(density) AS density, max(flow) AS flow FROM fenced GROUP BY 1, 2),
line AS (SELECT station_id, regr_slope(flow, density) AS m, regr_intercept(flow, density) AS b FROM bins GROUP BY 1),
fit AS (SELECT station_id, v AS free_flow_speed, -m AS congestion_wave_speed, -b / m AS jam_density, b / (v - m) AS critical_density, v * b / (v - m) AS capacity FROM free JOIN line USING (station_id))"""


@query("d3_fd_seed", f"WITH {FIT} SELECT station_id, round(seed, 3) AS seed FROM seed", 3)
def _(t):
    return calibrate.fd_seed(calibrate.usable_rows(with_ts(t.det), meta(t)))


def seeded(t):
    rows = calibrate.usable_rows(with_ts(t.det), meta(t))
    return rows.join(calibrate.fd_seed(rows), "station_id")


@query("d4_fit_free_flow", f"WITH {FIT} SELECT station_id, round(v, 3) AS free_flow_speed FROM free", 3)
def _(t):
    return calibrate.fit_free_flow(seeded(t))


@query("d5_congestion_bins", f"WITH {FIT} SELECT station_id, bin, round(density, 3) AS density, round(flow, 2) AS flow FROM bins", 3)
def _(t):
    return calibrate.congestion_bins(seeded(t)).withColumn("flow", F.round("flow", 2))


@query("d6_fit_congestion", f"WITH {FIT} SELECT station_id, round(m, 3) AS slope, round(b, 1) AS intercept, round(-b / m, 2) AS jam_density FROM line", 3)
def _(t):
    f = calibrate.fit_congestion(calibrate.congestion_bins(seeded(t)))
    return f.withColumn("intercept", F.round("intercept", 1)).withColumn("jam_density", F.round("jam_density", 2))


@query("d7_fd_peak", f"WITH {FIT} SELECT station_id, round(critical_density, 2) AS critical_density, round(capacity, 1) AS capacity, round(congestion_wave_speed, 3) AS congestion_wave_speed FROM fit", 3)
def _(t):
    s = seeded(t)
    p = calibrate.fd_peak(calibrate.fit_free_flow(s).join(calibrate.fit_congestion(calibrate.congestion_bins(s)), "station_id"))
    return p.select("station_id", F.round("critical_density", 2).alias("critical_density"), F.round("capacity", 1).alias("capacity"), "congestion_wave_speed")


@query("d8_calibrate_fd", f"""WITH {META_SQL}, {FIT} SELECT station_id, CASE WHEN fit.capacity IS NULL THEN 1 ELSE 0 END AS calibration_code, CASE WHEN fit.capacity IS NULL THEN 'no_data' ELSE 'ok' END AS calibration_status, round(capacity, 1) AS capacity, round(free_flow_speed, 3) AS free_flow_speed,
round(congestion_wave_speed, 3) AS congestion_wave_speed, round(jam_density, 2) AS jam_density, round(critical_density, 2) AS critical_density FROM meta LEFT JOIN fit USING (station_id)
UNION ALL SELECT -1, 1, 'no_data', NULL, NULL, NULL, NULL, NULL""", 3)
def _(t):
    asked = meta(t).select("station_id").union(t.spark.range(-1, 0))
    out = calibrate.calibrate_fd(with_ts(t.det), meta(t), asked)
    return out.select("station_id", "calibration_code", "calibration_status", F.round("capacity", 1).alias("capacity"), "free_flow_speed", "congestion_wave_speed", F.round("jam_density", 2).alias("jam_density"), F.round("critical_density", 2).alias("critical_density"))


@query("d9_calibrate_ramp_capacity", f"""WITH {META_SQL}, f AS (SELECT *, (flow - avg(flow) OVER w) / nullif(stddev_samp(flow) OVER w, 0) AS z FROM (SELECT station_id, m_5min, total_flow_5min * 12 AS flow FROM det WHERE pct_observed >= 100 AND total_flow_5min IS NOT NULL) WINDOW w AS (PARTITION BY station_id, m_5min % 2016)),
k AS (SELECT f.* FROM f JOIN (SELECT station_id, quantile_cont(z, 0.25) AS a, quantile_cont(z, 0.75) AS b FROM f GROUP BY 1) q USING (station_id) WHERE z BETWEEN a - 1.5 * (b - a) - 1e-9 AND b + 1.5 * (b - a) + 1e-9)
SELECT m.station_id, round(quantile_cont(flow, 0.99), 3) AS ramp_capacity, count(flow) AS n_observations, CASE WHEN count(flow) = 0 THEN 2 ELSE 0 END AS calibration_code FROM meta m LEFT JOIN k USING (station_id) GROUP BY 1 UNION ALL SELECT -1, NULL, 0, 1""", 3)
def _(t):
    return calibrate.calibrate_ramp_capacity(with_ts(t.det), meta(t).select("station_id").union(t.spark.range(-1, 0)))


@query("c1_attach_lanes", "SELECT d.station_id, s.lanes, count(*) AS n FROM det d JOIN stations s ON s.station_id = d.station_id GROUP BY 1, 2")
def _(t):
    return calibrate.attach_lanes(t.det, t.stations).groupBy("station_id", "lanes").agg(F.count("*").alias("n"))


@query("c2_available_stations", "SELECT DISTINCT station_id FROM stations WHERE type = 'ML' AND station_id IN (SELECT station_id FROM det)")
def _(t):
    return calibrate.available_stations(t.stations, t.det, "ML")


@query("c21_merge_calibration", "SELECT station_id, CASE WHEN station_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM stations")
def _(t):
    s = t.stations.select("station_id")
    return calibrate.merge_calibration(s.where("station_id % 3 = 0").withColumn("origin", F.lit("new")), s.withColumn("origin", F.lit("old")))


# Scoring.

SIM5 = "sim5 AS (SELECT run_id, cell, step // 2 AS m_5min, avg(flow) AS flow, avg(rho_post) AS density FROM two_runs GROUP BY 1, 2, 3)"
PAIRS = SIM5 + """, pairs AS (SELECT s.run_id, s.cell, c.vds_id AS station_id, s.m_5min, s.flow AS sim_flow, o.flow AS obs_flow, s.density AS sim_density, o.density AS obs_density
FROM sim5 s JOIN cells c ON c.cell = s.cell AND c.vds_source IN ('direct', 'direct_tiebreak') LEFT JOIN obs5 o ON o.station_id = c.vds_id AND o.m_5min = s.m_5min)"""


def sim5(t):
    return score.block_mean(t.two_runs, 2)


def pairs(t):
    return score.pair_runs(t.two_runs, t.obs5, t.cells, 2)


def errors_sql(n=3):
    return ", ".join(f"round(sqrt(avg((sim_{k} - obs_{k}) ** 2)), {n}) AS {k}_rmse, round(100 * avg(CASE WHEN obs_{k} <> 0 THEN abs(sim_{k} - obs_{k}) / abs(obs_{k}) END), {n}) AS {k}_mape, count(sim_{k} - obs_{k}) AS {k}_n" for k in ("flow", "density"))


@query("h5_block_mean", f"WITH {SIM5} SELECT run_id, cell, m_5min, round(flow, 3) AS flow, round(density, 3) AS density FROM sim5", 3)
def _(t):
    return sim5(t)


@query("h6_downsample", "SELECT cell, step, round(rho_post, 4) AS rho_post FROM traj WHERE step % 6 = 0")
def _(t):
    return score.downsample(t.traj, 6).select("cell", "step", "rho_post")


@query("c15_pair_sim_observed", f"WITH {PAIRS} SELECT run_id, cell, station_id, m_5min, round(sim_flow, 3) AS sim_flow, round(obs_flow, 3) AS obs_flow, round(sim_density, 3) AS sim_density, round(obs_density, 3) AS obs_density FROM pairs", 3)
def _(t):
    return pairs(t).drop("hour")


@query("d10_rmse_mape", f"WITH {PAIRS} SELECT r.run_id, c.cell, flow_rmse, flow_mape, coalesce(flow_n, 0) AS flow_n, density_rmse, density_mape, coalesce(density_n, 0) AS density_n FROM cells c CROSS JOIN (SELECT DISTINCT run_id FROM pairs) r LEFT JOIN (SELECT run_id, cell, {errors_sql()} FROM pairs GROUP BY 1, 2) e ON e.cell = c.cell AND e.run_id = r.run_id", 3)
def _(t):
    return score.rmse_mape(pairs(t), t.cells)


@query("d11_corridor_rmse_mape", f"WITH {PAIRS} SELECT run_id, {errors_sql()} FROM pairs GROUP BY 1", 3)
def _(t):
    return score.corridor_rmse_mape(pairs(t))


@query("d10_d11_grouping_sets", f"WITH {PAIRS} SELECT run_id, cell, {errors_sql()} FROM pairs GROUP BY GROUPING SETS ((run_id, cell), (run_id))", 3)
def _(t):
    return score.rmse_mape_all(pairs(t))


@query("d10_run_differences", f"""WITH {PAIRS}, e AS (SELECT run_id, cell, sqrt(avg((sim_flow - obs_flow) ** 2)) AS flow_rmse, sqrt(avg((sim_density - obs_density) ** 2)) AS density_rmse FROM pairs GROUP BY GROUPING SETS ((run_id, cell), (run_id)))
SELECT b.run_id, b.cell, round(b.flow_rmse - a.flow_rmse, 2) AS flow_rmse_diff, round(b.density_rmse - a.density_rmse, 2) AS density_rmse_diff FROM e b JOIN e a ON a.run_id = 'r1' AND b.run_id = 'r2' AND a.cell IS NOT DISTINCT FROM b.cell""", 2)
def _(t):
    """How much worse the second run is than the first, by cell and pooled."""
    return score.run_differences(score.rmse_mape_all(pairs(t)), "r1", ["flow_rmse", "density_rmse"])


@query("c20_first_cell_per_station", "SELECT cell, CASE WHEN vds_id IS NOT NULL AND row_number() OVER (PARTITION BY corridor_id, vds_id ORDER BY cell) = 1 THEN vds_id END AS vds_id FROM cells")
def _(t):
    return score.first_cell_per_station(t.cells).select("cell", "vds_id")


AGG = """first_cells AS (SELECT cell, length, CASE WHEN vds_id IS NOT NULL AND row_number() OVER (PARTITION BY corridor_id, vds_id ORDER BY cell) = 1 THEN vds_id END AS vds_id FROM cells),
agg AS (SELECT s.run_id, sum(s.flow * f.length) / 12 AS sim_vmt, sum(s.density * f.length) / 12 AS sim_vht, sum(o.flow * m.length) / 12 AS obs_vmt, sum(o.density * m.length) / 12 AS obs_vht, count(DISTINCT f.vds_id) AS n_vds
FROM sim5 s JOIN first_cells f ON f.cell = s.cell AND f.vds_id IS NOT NULL JOIN meta m ON m.station_id = f.vds_id JOIN obs5 o ON o.station_id = f.vds_id AND o.m_5min = s.m_5min WHERE o.flow IS NOT NULL AND o.density IS NOT NULL GROUP BY 1)"""


@query("d12_corridor_aggregates", f"WITH {META_SQL}, {SIM5}, {AGG} SELECT run_id, round(sim_vmt, 1) AS sim_vmt, round(sim_vht, 1) AS sim_vht, round(obs_vmt, 1) AS obs_vmt, round(obs_vht, 1) AS obs_vht, n_vds, round(100 * (sim_vmt - obs_vmt) / obs_vmt, 1) AS vmt_pct, round(100 * (sim_vht - obs_vht) / obs_vht, 1) AS vht_pct FROM agg", 1)
def _(t):
    return score.corridor_aggregates(sim5(t), t.obs5, t.cells, meta(t))


GEH = "hours AS (SELECT run_id, cell, m_5min // 12 AS hour, avg(sim_flow) AS s, avg(obs_flow) AS o FROM pairs GROUP BY 1, 2, 3 HAVING count(sim_flow + obs_flow) >= 5), gehs AS (SELECT run_id, cell, sqrt(2 * (s - o) ** 2 / nullif(s + o, 0)) AS geh FROM hours)"


@query("d13_flow_geh", f"WITH {PAIRS}, {GEH.replace('>= 5', '= 12')} SELECT run_id, cell, count(*) AS n_hours, round(median(geh), 3) AS geh_median, round(100 * avg(CASE WHEN geh < 5 THEN 1 ELSE 0 END), 3) AS geh_pct_under_5 FROM gehs GROUP BY GROUPING SETS ((run_id, cell), (run_id))", 3)
def _(t):
    return score.flow_geh(pairs(t))


@query("c22_merge_geh", f"WITH {PAIRS}, {GEH.replace('>= 5', '= 12')}, g AS (SELECT run_id, cell, count(*) AS n_hours FROM gehs GROUP BY 1, 2) SELECT run_id, cell, e.flow_n, g.n_hours FROM (SELECT run_id, cell, {errors_sql()} FROM pairs GROUP BY 1, 2) e LEFT JOIN g USING (run_id, cell)")
def _(t):
    p = written(score.hour_sums(pairs(t)), "hour-sums")
    return score.merge_geh(score.rmse_mape(p), score.flow_geh(p).where("cell IS NOT NULL")).select("run_id", "cell", "flow_n", "n_hours")


@query("d14_qq_rank_pairs", f"WITH {PAIRS}, ok AS (SELECT * FROM pairs WHERE obs_flow IS NOT NULL), a AS (SELECT run_id, cell, sim_flow AS sim, row_number() OVER (PARTITION BY run_id, cell ORDER BY sim_flow) AS rank FROM ok), b AS (SELECT run_id, cell, obs_flow AS obs, row_number() OVER (PARTITION BY run_id, cell ORDER BY obs_flow) AS rank FROM ok) SELECT run_id, cell, rank, round(sim, 3) AS sim, round(obs, 3) AS obs FROM a JOIN b USING (run_id, cell, rank)", 3)
def _(t):
    return score.qq_rank_pairs(pairs(t))


METRICS = """metrics AS (SELECT run_id, step, sum(vht) AS vht, sum(vmt) AS vmt, sum(CASE WHEN c THEN vht - vmt / v_f ELSE 0 END) AS delay, sum(CASE WHEN c THEN (1 - flow / q_max) / 24e0 * length ELSE 0 END) AS productivity_loss,
CASE WHEN bool_or(speed = 0) THEN NULL ELSE sum(length / nullif(speed, 0)) END AS travel_time FROM (SELECT t.*, length, v_f, q_max, (rho_post * length + queue_post) / 24e0 AS vht, rho_post * speed / 24e0 * length AS vmt, rho_post > rho_crit AS c FROM traj t JOIN cells USING (cell)) GROUP BY 1, 2)"""


@query("d15_performance_metrics", f"WITH {METRICS} SELECT run_id, step, round(vht, 3) AS vht, round(vmt, 3) AS vmt, round(delay, 3) AS delay, round(productivity_loss, 3) AS productivity_loss, round(travel_time, 3) AS travel_time FROM metrics", 3)
def _(t):
    return score.performance_metrics(t.traj, t.cells, 1 / 24)


@query("d16_metric_totals", f"WITH {METRICS} SELECT run_id, step // 288 AS period, round(sum(vht), 1) AS vht, round(sum(vmt), 1) AS vmt, round(sum(delay), 1) AS delay, round(sum(productivity_loss), 1) AS productivity_loss, round(avg(travel_time), 1) AS mean_travel_time, round(max(travel_time), 1) AS max_travel_time FROM metrics GROUP BY GROUPING SETS ((run_id, step // 288), (run_id))", 1)
def _(t):
    return score.metric_totals(score.performance_metrics(t.traj, t.cells, 1 / 24), 288, 2 * HORIZON)


@query("d16_cell_totals", f"""WITH x AS (SELECT t.*, length, v_f, q_max, (rho_post * length + queue_post) / 24e0 AS vht, rho_post * speed / 24e0 * length AS vmt, rho_post > rho_crit AS c FROM traj t JOIN cells USING (cell))
SELECT run_id, cell, round(sum(vht), 1) AS vht, round(sum(vmt), 1) AS vmt, round(sum(CASE WHEN c THEN vht - vmt / v_f ELSE 0 END), 1) AS delay, round(sum(CASE WHEN c THEN (1 - flow / q_max) / 24e0 * length ELSE 0 END), 1) AS productivity_loss FROM x GROUP BY 1, 2""", 1)
def _(t):
    return score.cell_totals(t.traj, t.cells, 1 / 24)


@query("d17_compare_grids", "WITH p AS (SELECT a.run_id, a.cell, a.rho_post AS sim_density, a.flow AS sim_flow, b.rho_post + 1.5 AS obs_density, b.flow * 0.98 AS obs_flow FROM two_runs a JOIN traj b ON a.cell = b.cell AND a.step = b.step WHERE a.step % 6 = 0) SELECT run_id, cell, " + errors_sql() + " FROM p GROUP BY 1, 2", 3)
def _(t):
    ref = t.traj.select("cell", "step", (F.col("rho_post") + 1.5).alias("rho"), (F.col("flow") * 0.98).alias("flow"))
    return score.compare_grids(t.two_runs, ref, 6)


def sourced(t):
    return t.cells.where("vds_id IS NOT NULL").select("cell", F.col("vds_id").alias("station_id")).join(t.obs5, "station_id").select("cell", "m_5min", F.col("density").alias("value"), F.when((F.col("m_5min") + F.col("cell")) % 3 == 0, "knn").otherwise("observed").alias("source"))


@query("d18_weighted_grid_error", f"""WITH {SIM5}, g AS (SELECT c.cell, m_5min, density AS value, CASE WHEN (m_5min + c.cell) % 3 = 0 THEN 0.25 ELSE 1 END AS w FROM cells c JOIN obs5 o ON o.station_id = c.vds_id),
x AS (SELECT run_id, density - value AS d, value, CASE WHEN value IS NULL THEN w ELSE w END AS w FROM sim5 JOIN g USING (cell, m_5min))
SELECT run_id, round(sum(w * d * d) / sum(w), 2) AS weighted_mse, round(sqrt(avg(CASE WHEN w = 1 THEN d * d END)), 2) AS rmse, round(100 * avg(CASE WHEN w = 1 AND value <> 0 THEN abs(d) / abs(value) END), 2) AS mape, count(*) FILTER (w = 1) AS n FROM x GROUP BY 1""", 2)
def _(t):
    return score.weighted_grid_error(sim5(t), sourced(t), 0.25)


@query("d21_observed_grid", "SELECT c.cell, g.m_5min, round(o.flow, 3) AS flow, round(o.density, 3) AS density FROM cells c CROSS JOIN (SELECT unnest(range(0, 8640)) AS m_5min) g LEFT JOIN obs5 o ON o.station_id = c.vds_id AND o.m_5min = g.m_5min WHERE c.vds_id IS NOT NULL", 3)
def _(t):
    return score.observed_grid(t.obs5, t.cells, HORIZON)


@query("f1_top_cells", f"WITH {PAIRS}, e AS (SELECT run_id, cell, sqrt(avg((sim_density - obs_density) ** 2)) AS r FROM pairs GROUP BY 1, 2) SELECT run_id, cell, round(r, 3) AS density_rmse FROM e QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY r DESC NULLS LAST, cell) <= 5", 3)
def _(t):
    return score.top_cells(score.rmse_mape(pairs(t))).select("run_id", "cell", "density_rmse")


@query("d31_validation_report", f"""WITH {META_SQL}, {PAIRS}, {AGG}, {GEH.replace('>= 5', '= 12')}, e AS (SELECT run_id, {errors_sql(6)} FROM pairs GROUP BY 1), per AS (SELECT run_id, cell, sqrt(avg((sim_density - obs_density) ** 2)) AS r FROM pairs GROUP BY 1, 2)
SELECT run_id, item, CAST(NULL AS BIGINT) AS cell, round(CAST(value AS DOUBLE), 1) AS value FROM (SELECT run_id, unnest(['flow_rmse', 'flow_mape', 'density_rmse', 'density_mape', 'sim_vmt', 'sim_vht', 'obs_vmt', 'obs_vht', 'n_vds', 'vmt_pct', 'vht_pct', 'geh_pct_under_5', 'n_scored']) AS item,
unnest([flow_rmse, flow_mape, density_rmse, density_mape, sim_vmt, sim_vht, obs_vmt, obs_vht, n_vds, 100 * (sim_vmt - obs_vmt) / obs_vmt, 100 * (sim_vht - obs_vht) / obs_vht, good, n_scored]) AS value FROM e JOIN agg USING (run_id) JOIN (SELECT run_id, 100 * avg(CASE WHEN geh < 5 THEN 1 ELSE 0 END) AS good FROM gehs GROUP BY 1) USING (run_id) JOIN (SELECT run_id, count(r) AS n_scored FROM per GROUP BY 1) USING (run_id))
UNION ALL (SELECT run_id, 'worst_density_rmse', cell, round(r, 1) FROM per QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY r DESC NULLS LAST, cell) <= 5)""", 1)
def _(t):
    hours = written(score.hour_sums(pairs(t)), "hour-sums")
    return score.validation_report(hours, score.hours_aggregates(hours, t.cells, meta(t)))


# Charging load.

N_POS = "(SELECT CAST(sum(round_even(length * 1609.344 / 0.5, 0)) AS BIGINT) AS n FROM cells)"


def positions(t) -> int:
    """Grid positions of the corridor: one number, from its cells."""
    return int(load.cell_positions(t.cells, SPEC.dx).agg(F.sum("n")).first()[0])


PROFILE = f"""sized AS (SELECT cell, length, CAST(round_even(length * 1609.344 / 0.5, 0) AS BIGINT) AS n FROM cells), total AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM sized),
pads AS (SELECT unnest(range(0, (SELECT n FROM total))) AS x), on_pads AS (SELECT x, CASE WHEN x % 8 < 7 THEN 1 ELSE 0 END AS p FROM pads),
laps AS (SELECT j, sum(p) AS o FROM (SELECT x + d AS j, p FROM on_pads CROSS JOIN (SELECT unnest(range(0, 3)) AS d)) GROUP BY 1), profile AS (SELECT j AS position, 150000e0 * o / (SELECT max(o) FROM laps) AS power FROM laps)"""


@query("e13_power_profile", f"WITH {PROFILE} SELECT position, round(power, 3) AS power FROM profile", 3)
def _(t):
    return load.power_profile(t.spark, positions(t), SPEC)


BINS = PROFILE + f""", placed AS (SELECT cell, n, CAST(sum(n) OVER (ORDER BY cell) - n AS BIGINT) AS start FROM sized),
spread AS (SELECT cell, n, start + k + 1 AS position FROM (SELECT cell, n, start, unnest(range(0, n)) AS k FROM placed)),
weights AS (SELECT cell, CAST(floor(position * 0.5 / {BIN_M}) AS BIGINT) AS bin, sum(power / n) AS wt FROM spread JOIN profile USING (position) GROUP BY 1, 2)"""


@query("c17_position_map", f"WITH {BINS} SELECT cell, position, round(1e0 / n, 8) AS weight FROM spread", 8)
def _(t):
    return load.position_map(t.cells, SPEC)


@query("h12_mainline_vht", "SELECT cell, step, round(rho_post * length / 24e0, 4) AS vht FROM traj JOIN cells USING (cell)")
def _(t):
    return load.mainline_vht(t.traj, t.cells, 1 / 24)


@query("h13_charging_demand", f"WITH {BINS} SELECT step, bin, round(sum(0.8 * rho_post * length / 24e0 * wt), 1) AS energy_wh FROM traj JOIN cells USING (cell) JOIN weights USING (cell) GROUP BY 1, 2", 1)
def _(t):
    return load.charging_demand(load.mainline_vht(t.traj, t.cells, 1 / 24), t.cells, SPEC, 0.8, BIN_M, positions(t))


DEMAND = BINS + ", demand AS (SELECT m_5min AS step, bin, sum(0.8 * density * length / 12e0 * wt) AS energy_wh FROM obs5 o JOIN cells c ON c.vds_id = o.station_id JOIN weights USING (cell) WHERE density IS NOT NULL GROUP BY 1, 2)"
STEPS = DEMAND + ", steps AS (SELECT step, sum(energy_wh) AS energy_wh FROM demand GROUP BY 1)"


def demand(t):
    return load.observed_demand(t.obs5, t.cells, SPEC, 0.8, BIN_M, positions(t))


def steps(t):
    return load.energy_per_step(demand(t))


@query("h14_observed_demand", f"WITH {DEMAND} SELECT step, bin, round(energy_wh, 1) AS energy_wh FROM demand", 1)
def _(t):
    return demand(t)


@query("d24_peak_power", f"WITH {STEPS} SELECT round(sum(energy_wh), 0) AS total_wh, round(max(energy_wh) * 12, 0) AS peak_w, arg_min(step, (-energy_wh, step)) AS peak_step FROM steps", 0)
def _(t):
    return load.peak_power(steps(t), DT_H)


@query("d25_bin_profiles", f"""WITH {STEPS}, x AS (SELECT bin, step, energy_wh * 12 / 1e6 / 0.5 AS mw FROM demand), pk AS (SELECT arg_min(step, (-energy_wh, step)) AS s FROM steps)
SELECT bin, round(coalesce(max(mw) FILTER (step = s), 0), 3) AS at_peak, round(max(mw), 3) AS absolute_peak, round(sum(mw) / 8640, 3) AS average, round(sum(mw) / 8640 / max(mw), 3) AS load_factor,
round(quantile_cont(mw, 0.1), 3) AS p10, round(quantile_cont(mw, 0.25), 3) AS p25, round(quantile_cont(mw, 0.5), 3) AS p50, round(quantile_cont(mw, 0.75), 3) AS p75, round(quantile_cont(mw, 0.9), 3) AS p90 FROM x, pk GROUP BY bin""", 3)
def _(t):
    return load.bin_profiles(demand(t), DT_H, 0.5, HORIZON)


@query("d26_bin_positions", "SELECT least(greatest(CAST(floor((c_acctbal - 200) / 500) AS BIGINT), 0), 9) AS bin, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy(load.clamped_bin(F.col("c_acctbal") - 200, 500.0, 10).alias("bin")).agg(F.count("*").alias("n"))


@query("d27_mile_segments", "SELECT CAST(floor(c_acctbal / 1609.344 / 0.7) AS BIGINT) AS segment, count(*) AS n FROM customer WHERE c_acctbal >= 0 AND c_acctbal / 1609.344 < 5 GROUP BY 1")
def _(t):
    x = t.customer.select(load.mile_segment("c_acctbal", 0.7, 5.0).alias("segment")).where("segment IS NOT NULL")
    return x.groupBy("segment").agg(F.count("*").alias("n"))


@query("h7_rebin_sum", f"WITH {STEPS} SELECT step // 7 AS block, round(sum(energy_wh), 0) AS energy_wh, count(*) AS n, round(sum(energy_wh) / (count(*) / 12e0), 0) AS power_w FROM steps GROUP BY 1", 0)
def _(t):
    return load.window_power(load.rebin_sum(steps(t), 7), DT_H)


@query("e11_load_duration_table", f"WITH {STEPS} SELECT row_number() OVER (ORDER BY energy_wh DESC, step) AS rank, round(row_number() OVER (ORDER BY energy_wh DESC, step) / 12e0, 4) AS hours, round(energy_wh * 12, 0) AS power_w FROM steps")
def _(t):
    p = steps(t).select("step", (F.col("energy_wh") * 12).alias("power_w"))
    return load.load_duration_table(p, DT_H).select("rank", "hours", F.round("power_w", 0).alias("power_w"))


LDC = "curve AS (SELECT i, min_by(energy_wh, -k) AS energy_wh FROM (SELECT unnest(range(0, 512)) AS i) g JOIN (SELECT energy_wh, row_number() OVER (ORDER BY energy_wh DESC) AS k, count(*) OVER () AS n FROM steps) s ON k = greatest(1, CAST(ceil((i + 0.5) / 512e0 * n - 1e-9) AS BIGINT)) GROUP BY 1)"


@query("e9_load_duration_curve", f"WITH {STEPS}, {LDC} SELECT i, round(energy_wh * 12, 0) AS power_w FROM curve", 0)
def _(t):
    return load.load_duration_curve(steps(t).select((F.col("energy_wh") * 12).alias("power_w"), F.lit(1).alias("weight")))


@query("e12_bin_centers", f"WITH {STEPS}, b AS (SELECT step // 7 AS block, count(*) AS n FROM steps GROUP BY 1) SELECT block, round((2 * sum(n) OVER (ORDER BY block) - n) / 2e0 / 12e0, 4) AS center_h FROM b")
def _(t):
    return load.bin_centers(load.rebin_sum(steps(t), 7), DT_H)


@query("e10_ldc_divergence", f"""WITH {STEPS}, {LDC}, h AS (SELECT step // 12 AS block, count(*) AS n, sum(energy_wh) / (count(*) / 12e0) AS p FROM steps GROUP BY 1),
hc AS (SELECT p, sum(n) OVER (ORDER BY p DESC, block) AS hi, sum(n) OVER (ORDER BY p DESC, block) - n AS lo, (SELECT count(*) FROM steps) AS total FROM h),
hourly AS (SELECT i, p FROM (SELECT unnest(range(0, 512)) AS i) g JOIN hc ON (i + 0.5) / 512e0 > lo / CAST(total AS DOUBLE) AND (i + 0.5) / 512e0 <= hi / CAST(total AS DOUBLE))
SELECT round(avg(abs(c.energy_wh * 12 - p)) / (SELECT avg(energy_wh * 12) FROM steps), 4) AS divergence FROM curve c JOIN hourly USING (i)""")
def _(t):
    s = written(steps(t), "steps")
    native = s.select((F.col("energy_wh") * 12).alias("power_w"), F.lit(1).alias("weight"))
    hourly = load.window_power(load.rebin_sum(s, 12), DT_H).select("power_w", F.col("n").alias("weight"))
    curve, other = load.load_duration_curve(native), load.load_duration_curve(hourly)
    return load.ldc_divergence(curve, other, native.agg(F.avg("power_w")).first()[0])


@query("d29_temporal_aggregation", f"""WITH {STEPS}, w AS (SELECT * FROM (VALUES (300e0, 1), (900e0, 3), (3600e0, 12), (21600e0, 72)) v(window_s, s)),
b AS (SELECT window_s, step // s AS block, sum(energy_wh) AS e, count(*) AS n, sum(energy_wh) / (count(*) / 12e0) AS p FROM steps CROSS JOIN w GROUP BY 1, 2),
c AS (SELECT *, (2 * sum(n) OVER (PARTITION BY window_s ORDER BY block) - n) / 2e0 / 12e0 AS t FROM b),
a AS (SELECT window_s, max(p) AS peak, arg_min(t, (-p, block)) AS best, sum(e) AS e, sum(n) AS n FROM c GROUP BY 1), z AS (SELECT peak AS p0, best AS t0, e AS e0, e / (n / 12e0) AS m0 FROM a WHERE window_s = 300),
lc AS (SELECT window_s, p, n, sum(n) OVER (PARTITION BY window_s ORDER BY p DESC, block) AS hi, CAST(sum(n) OVER (PARTITION BY window_s) AS DOUBLE) AS total FROM b),
lv AS (SELECT window_s, i, p FROM (SELECT unnest(range(0, 512)) AS i) g JOIN lc ON (i + 0.5) / 512e0 > (hi - n) / total AND (i + 0.5) / 512e0 <= hi / total),
dv AS (SELECT x.window_s, avg(abs(x.p - y.p)) AS gap FROM lv x JOIN lv y ON x.i = y.i AND y.window_s = 300 GROUP BY 1)
SELECT window_s, round(peak, 0) AS peak_w, round(100 * (p0 - peak) / p0, 3) AS attenuation_pct, round(best, 3) AS peak_time_h, round(best - t0, 3) AS peak_shift_h, round(e, 0) AS energy_wh, round(gap / m0, 4) AS divergence, abs(e - e0) / e0 < 1e-9 AS energy_kept FROM a JOIN dv USING (window_s), z""")
def _(t):
    x = load.temporal_aggregation_summary(written(steps(t), "steps"), 300.0, [900.0, 3600.0, 21600.0])
    r = lambda n, k: F.round(n, k).alias(n)
    return x.select("window_s", r("peak_w", 0), r("attenuation_pct", 3), r("peak_time_h", 3), r("peak_shift_h", 3), r("energy_wh", 0), "divergence", (F.abs("energy_error") < 1e-9).alias("energy_kept"))


@query("d28_segment_peak_attenuation", f"""WITH {STEPS}, w AS (SELECT * FROM (VALUES (300e0, 1), (3600e0, 12)) v(window_s, s)), l AS (SELECT * FROM (VALUES (1e0), (2.5e0)) v(length_mi)),
seg AS (SELECT length_mi, CAST(floor((bin + 0.5) * {BIN_M} / 1609.344 / length_mi) AS BIGINT) AS segment, step, sum(energy_wh) AS e FROM demand CROSS JOIN l WHERE (bin + 0.5) * {BIN_M} / 1609.344 < 12 GROUP BY 1, 2, 3),
b AS (SELECT length_mi, segment, window_s, step // s AS block, sum(e) / count(*) AS p FROM seg CROSS JOIN w GROUP BY 1, 2, 3, 4), pk AS (SELECT length_mi, segment, window_s, max(p) AS peak FROM b GROUP BY 1, 2, 3),
a AS (SELECT x.*, 100 * (y.peak - x.peak) / y.peak AS a FROM pk x JOIN pk y ON x.length_mi = y.length_mi AND x.segment = y.segment AND y.window_s = 300)
SELECT length_mi, window_s, arg_min(segment, (-a, segment)) AS segment, round(max(a), 3) AS attenuation_pct FROM a GROUP BY 1, 2""", 3)
def _(t):
    return load.segment_peak_attenuation(demand(t), 300.0, [3600.0], BIN_M, [1.0, 2.5], 12.0)


# Scenario series.


@query("h3_hold_to_step", "SELECT station_id, m_5min * 3 + i AS step, round(total_flow_5min * 12, 3) AS flow FROM det CROSS JOIN (SELECT unnest(range(0, 3)) AS i)", 3)
def _(t):
    return scenario.hold_to_step(t.det.select("station_id", "m_5min", F.col("total_flow_5min").alias("flow")), 100)


@query("h4_hourly_to_step", "SELECT station_id, h * 4 + i AS step, round(f, 3) AS flow FROM (SELECT station_id, m_5min // 12 AS h, sum(total_flow_5min) AS f FROM det GROUP BY 1, 2) CROSS JOIN (SELECT unnest(range(0, 4)) AS i)", 3)
def _(t):
    return scenario.hourly_to_step(t.det.select("station_id", "m_5min", F.col("total_flow_5min").alias("flow")), 900)


@query("h8_inflow_series", "SELECT (m_5min - 288) * 3 + i AS step, round(total_flow_5min * 12, 3) AS inflow FROM det CROSS JOIN (SELECT unnest(range(0, 3)) AS i) WHERE m_5min >= 288 AND m_5min < 576 AND station_id = 2", 3)
def _(t):
    return scenario.inflow_series(t.det.select("station_id", "m_5min", F.col("total_flow_5min").alias("flow")), 2, 100, 288, 576)


@query("d23_initial_density", """WITH now AS (SELECT * FROM obs5 WHERE m_5min = 100)
SELECT cell, round(density, 3) AS rho0, CASE WHEN vds_id IS NULL THEN 'no_station' WHEN m_5min IS NULL THEN 'no_row' WHEN density IS NULL THEN 'no_value' END AS problem FROM cells LEFT JOIN now ON vds_id = station_id""", 3)
def _(t):
    return scenario.initial_density(t.cells, t.obs5, 100)


@query("a23_scenario_table", "SELECT m_5min AS step, cell, CASE WHEN on_ramp THEN CAST((m_5min + cell) % 9 AS DOUBLE) ELSE 0e0 END AS demand, 5e-2 AS beta FROM (SELECT DISTINCT m_5min FROM det WHERE station_id = 1) CROSS JOIN cells")
def _(t):
    inflow = t.det.where("station_id = 1").select(F.col("m_5min").alias("step"), F.col("total_flow_5min").alias("inflow"))
    d = inflow.select("step").crossJoin(t.cells.where("on_ramp").select("cell")).withColumn("demand", ((F.col("step") + F.col("cell")) % 9).cast("double"))
    return scenario.scenario_table(t.cells, inflow, d, 0.05)


@query("b16_scenario_violations", """WITH s AS (SELECT m_5min AS step, station_id * 5 AS cell, CAST(m_5min % 7 AS DOUBLE) - 1 AS demand, CAST(m_5min % 13 AS DOUBLE) / 10 AS beta FROM det),
x AS (SELECT s.*, c.on_ramp, c.off_ramp, c.cell IS NOT NULL AS known FROM s LEFT JOIN cells c USING (cell))
SELECT cell, v AS violation, count(*) AS n FROM (SELECT cell, unnest(list_filter([CASE WHEN NOT known THEN 'cell_unknown' END, CASE WHEN beta < 0 OR beta > 1 THEN 'beta_out_of_range' END, CASE WHEN demand < 0 THEN 'demand_negative' END,
CASE WHEN known AND demand <> 0 AND NOT on_ramp THEN 'demand_without_ramp' END, CASE WHEN known AND beta <> 0 AND NOT off_ramp THEN 'beta_without_ramp' END], lambda y: y IS NOT NULL)) AS v FROM x
UNION ALL SELECT cell, 'rho0_above_jam' FROM cells WHERE cell * 40 > rho_jam UNION ALL SELECT cell, 'row_count' FROM s GROUP BY 1 HAVING count(*) <> 8640) GROUP BY 1, 2""")
def _(t):
    s = t.det.select(F.col("m_5min").alias("step"), (F.col("station_id") * 5).alias("cell"), ((F.col("m_5min") % 7).cast("double") - 1).alias("demand"), ((F.col("m_5min") % 13).cast("double") / 10).alias("beta"))
    c = t.cells.withColumn("rho0", F.col("cell") * 40.0).withColumn("q0", F.lit(0.0))
    return quality.scenario_violations(s, c, 8640)


@query("a22_weight_mask", f"""WITH {FIELD_SQL} SELECT cell, m_5min, round(value, 3) AS value, CASE WHEN value IS NULL THEN 0 WHEN (m_5min + cell) % 3 = 0 THEN 0.25 ELSE 1 END * 1e0 AS weight, value IS NOT NULL AND (m_5min + cell) % 3 <> 0 AS genuine FROM field""", 3)
def _(t):
    source = F.when(F.col("value").isNotNull(), F.when((F.col("m_5min") + F.col("cell")) % 3 == 0, "knn").otherwise("observed"))
    return scenario.weight_mask(field(t).withColumn("source", source), None, 0.25)


HOLDOUT_GAPS = (1, 3, 6, 12)
FILLERS = {"persistence": lambda df: gaps.persistence_fill(df, "v"), "slot_mean": lambda df: gaps.slot_mean_fill(df, "v"), "gap_aware": lambda df: gaps.gap_aware_fill(df, "v")}


@query("v1_holdout_accuracy", f"""WITH {GRID_SQL}, h AS (SELECT gap, station_id, m_5min, CASE WHEN m_5min % 97 < gap THEN v END AS truth, CASE WHEN m_5min % 97 >= gap THEN v END AS v FROM grid CROSS JOIN (SELECT unnest([1, 3, 6, 12]) AS gap)),
r0 AS (SELECT *, CASE WHEN (v IS NULL) <> lag(v IS NULL) OVER w THEN 1 ELSE 0 END AS change, last_value(v IGNORE NULLS) OVER w AS p, avg(v) OVER (PARTITION BY gap, station_id, m_5min % 2016) AS a FROM h WINDOW w AS (PARTITION BY gap, station_id ORDER BY m_5min)),
r1 AS (SELECT *, sum(change) OVER (PARTITION BY gap, station_id ORDER BY m_5min) AS run FROM r0), r2 AS (SELECT *, count(*) OVER (PARTITION BY gap, station_id, run) AS length FROM r1),
f AS (SELECT gap, s AS strategy, truth, CASE s WHEN 'persistence' THEN coalesce(v, p) WHEN 'slot_mean' THEN coalesce(v, a) ELSE coalesce(v, CASE WHEN length * 5 <= 10 THEN p END, a) END AS v FROM r2 CROSS JOIN (SELECT unnest(['persistence', 'slot_mean', 'gap_aware']) AS s) WHERE truth IS NOT NULL)
SELECT strategy, gap, count(v - truth) AS n, round(sqrt(avg((v - truth) ** 2)), 3) AS rmse, round(100 * avg(CASE WHEN truth <> 0 THEN abs(v - truth) / abs(truth) END), 3) AS mape, round(avg(v - truth), 3) AS bias FROM f GROUP BY 1, 2""", 3)
def _(t):
    g = written(grid(t), "grid")
    return scenario.holdout_report(g, "v", HOLDOUT_GAPS, 97, FILLERS)


@query("u1_pluggable_fill", f"WITH {GRID_SQL} SELECT station_id, count(*) AS n_rows, count(p) AS n FROM (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY m_5min) AS p FROM grid) GROUP BY 1")
def _(t):
    filled = grid(t).transform(lambda df: gaps.persistence_fill(df, "v"))
    return filled.groupBy("station_id").agg(F.count("*").alias("n_rows"), F.count("v").alias("n"))


# Tables written and read again.


@query("a17_write_demand_long", f"WITH {DEMAND} SELECT step // 288 AS part, count(*) AS n, count(DISTINCT bin) AS n_bins FROM demand GROUP BY 1")
def _(t):
    path = scratch_folder(t.spark, "demand")
    ingest.write_demand_long(demand(t), path)
    return t.spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("bin").alias("n_bins"))


@query("a16_write_read_run", "SELECT cell, count(*) AS n, round(max(queue_post), 4) AS queue FROM traj GROUP BY 1")
def _(t):
    path = scratch_folder(t.spark, "runs")
    ingest.write_run(path, "r1", traj=t.traj.drop("run_id"))
    return ingest.read_run(t.spark, path, "r1", "traj").groupBy("cell").agg(F.count("*").alias("n"), F.max("queue_post").alias("queue"))


@query("a4_write_by_station", "SELECT station_id, count(*) AS n, round(sum(avg_speed_mph), 2) AS speed FROM det GROUP BY 1", 2)
def _(t):
    path = scratch_folder(t.spark, "stations")
    ingest.write_by_station(with_ts(t.det.union(t.det)), path)
    return t.spark.read.parquet(path).groupBy(F.col("station_id").cast("long").alias("station_id")).agg(F.count("*").alias("n"), F.sum("avg_speed_mph").alias("speed"))


@query("b27_choose_dt", "SELECT 300e0 / n AS dt FROM (SELECT floor(300 / bound) + 1 AS n FROM (SELECT min(length / v_f) * 3600 AS bound FROM cells))", 6)
def _(t):
    return t.cells.agg(F.lit(S.choose_dt(t.cells)).alias("dt"))
