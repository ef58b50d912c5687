"""Operators on small tables with values worked out by hand, and readers and writers by round trips."""

import gzip
import math
import random
from datetime import datetime

import numpy as np
import pytest
from lanewatt.functions import scalars as S
from lanewatt.operators import calibrate, gaps, linref, load, quality, quantiles, running, scenario, score
from lanewatt.sources import ingest
from lanewatt.sources.scratch import written
from lanewatt.streaming import detectors
from pyspark.sql import functions as F


def ts_table(spark, rows, schema="station_id long, minute int, v double"):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, minute, 0)"))


def values(df, order, col):
    return [r[col] for r in df.orderBy(order).collect()]


def test_argument_checks(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    assert S.require_grid_aligned(at(0), at(1), 100) == 300 and S.require_grid_aligned(at(0), at(2), 900) == 3600
    for bad in ((at(0, 1), at(1), 100), (at(1), at(1), 100), (at(0), at(1), 7), (at(0, 30), at(2), 900), (at(0), at(1), 4000)):
        with pytest.raises(ValueError):
            S.require_grid_aligned(*bad)
    assert S.exact_divisor(300, 12.5) == 24
    cells = spark.createDataFrame([(0, 0.2, 60.0), (1, 0.5, 60.0)], "cell long, length double, v_f double")
    assert S.choose_dt(cells) == 300 / 26 and S.choose_dt(cells, 10) == 10  # the bound is 12 s, and 12 itself is not below it
    with pytest.raises(ValueError):
        S.choose_dt(cells, 12)
    assert S.resolve_start(None, at(1)) == at(1) == S.resolve_start(at(1), None)
    for bad in ((None, None), (at(1), at(2))):
        with pytest.raises(ValueError):
            S.resolve_start(*bad)
    with pytest.raises(ValueError):
        load.PadSpec(alpha=3.3).steps(3.3)


def test_gap_filling(spark):
    v = [None, 1.0, None, None, 4.0, None, None, None, 8.0]
    df = ts_table(spark, [(1, 5 * k, x) for k, x in enumerate(v)])
    assert values(gaps.persistence_fill(df, "v"), "ts", "v") == [None, 1, 1, 1, 4, 4, 4, 4, 8]
    assert values(gaps.persistence_fill(df, "v", 10), "ts", "v") == [None, 1, 1, 1, 4, None, None, None, 8]
    week = ts_table(spark, [(1, 480, 10.0), (1, 480 + 10080, 20.0), (1, 480 + 2 * 10080, None), (1, 485, None)])
    out = gaps.slot_mean_fill(week, "v").orderBy("ts").collect()
    assert [r.v for r in out] == [10, None, 20, 15] and [r.filled for r in out] == [False, False, False, True]
    assert values(gaps.gap_aware_fill(week, "v"), "ts", "v") == [10, 10, 20, 20]  # gaps of one row are short
    assert values(gaps.gap_aware_fill(week, "v", 0), "ts", "v") == [10, None, 20, 15]
    assert [r.slot_of_week for r in gaps.unseen_slots(week, "v").collect()] == [97]
    a, b = (values(gaps.stochastic_slot_fill(week.repartition(n), "v", 3), "ts", "v") for n in (1, 4))
    assert a == b and a[3] >= 0


def test_grids(spark):
    df = ts_table(spark, [(1, 0, 1.0), (1, 15, 2.0)])
    assert gaps.contiguous_grid(df).count() == 366 * 288
    assert values(gaps.reindex_window(df, "2024-01-01 00:00:00", "2024-01-01 00:20:00"), "ts", "v") == [1, None, None, 2]


def test_neighbour_imputation(spark):
    grid = spark.createDataFrame([(0, 0, 10.0), (1, 0, None), (2, 0, 30.0)], "cell long, m_5min long, value double")
    assert gaps.knn_impute(grid, grid, grid.where("value IS NULL")).first()["value"] == pytest.approx(20)
    rows = [(c, m, v) for c, col in enumerate(([100.0] * 3, [1e6, None, 1e6], [200.0] * 3)) for m, v in enumerate(col)]
    grid = spark.createDataFrame(rows, "cell long, m_5min long, value double")
    assert gaps.knn_impute(grid, grid, grid.where("value IS NULL")).first()["value"] == pytest.approx(150)  # its own cell is no neighbour
    alone = spark.createDataFrame([(0, 0, None)], "cell long, m_5min long, value double")
    assert gaps.knn_impute(alone, alone, alone).first()["value"] is None


def test_calibration_recovers_a_known_triangle(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(28 * 288):
        rho = float(rng.uniform(1, 149))
        q = 60 * rho if rho <= 30 else 15 * (150 - rho)
        rows.append((1, 5 * k, 100.0, q * 3 / 12, q / rho))
    ts = ts_table(spark, rows, "station_id long, minute int, pct_observed double, total_flow_5min double, avg_speed_mph double")
    meta = spark.createDataFrame([(1, 3), (2, 3)], "station_id long, lanes int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "station_id long")
    out = {r.station_id: r for r in calibrate.calibrate_fd(ts, meta, asked).collect()}
    assert out[1].calibration_code == 0 and out[2].calibration_code == 1 and out[3].calibration_code == 1
    for name, want in (("free_flow_speed", 60), ("congestion_wave_speed", 15), ("capacity", 1800), ("critical_density", 30), ("jam_density", 150)):
        assert out[1][name] == pytest.approx(want, rel=0.015)
    unknown = calibrate.calibrate_fd(ts.withColumn("station_id", F.lit(9).cast("long")), meta, spark.createDataFrame([(9,)], "station_id long")).first()
    assert unknown.calibration_code == 2


def test_scores(spark):
    cells = spark.createDataFrame([(0, 7, "direct"), (1, 7, "direct"), (2, None, "missing")], "cell long, vds_id long, vds_source string").withColumn("corridor_id", F.lit("c"))
    sim = spark.createDataFrame([(c, m, 110.0, 11.0) for c in range(3) for m in range(12)], "cell long, m_5min long, flow double, density double")
    obs = spark.createDataFrame([(7, m, None if m == 3 else 100.0, 0.0 if m == 4 else 10.0) for m in range(12)], "station_id long, m_5min long, flow double, density double")
    p = score.pair_sim_observed(sim, obs, cells)
    out = {r.cell: r for r in score.rmse_mape(p, cells).collect()}
    assert out[0].flow_rmse == pytest.approx(10) and out[0].flow_mape == pytest.approx(10) and out[0].flow_n == 11
    assert out[0].density_mape == pytest.approx(10) and out[0].density_n == 12 and out[2].flow_n == 0 and out[2].flow_rmse is None
    assert score.hourly_geh(p).count() == 0  # one sample is missing in the hour
    assert [r.vds_id for r in score.first_cell_per_station(cells).orderBy("cell").collect()] == [7, None, None]
    g = spark.createDataFrame([(0.0, 0.0), (110.0, 100.0), (None, 1.0)], "m double, c double").select(S.geh("m", "c").alias("g")).collect()
    assert g[0].g == 0 and g[1].g == pytest.approx((2 * 100 / 210) ** 0.5) and g[2].g is None


def test_pad_profile_matches_a_moving_sum(spark):
    spec = load.PadSpec(alpha=3.5, lambda_gap=1.0, delta=1.5, beta=1e5, beta_prime=2e5, dx=0.5)
    for n in (1, 3, 10, 200):
        on = np.array([1 if x % 9 < 7 else 0 for x in range(n)])
        want = np.convolve(on, np.ones(3))
        got = values(load.power_profile(spark, n, spec), "position", "power")
        assert np.allclose(got, 1e5 * want / want.max())


def test_factored_demand_equals_the_expanded_one(spark):
    spec = load.PadSpec()
    cells = spark.createDataFrame([(0, 0.23), (1, 0.31)], "cell long, length double")
    n = int(load.cell_positions(cells, spec.dx).agg(F.sum("n")).first()[0])
    vht = spark.createDataFrame([(c, k, 0.1 * (c + k + 1)) for c in range(2) for k in range(3)], "cell long, step long, vht double")
    a = {(r.step, r.bin): r.energy_wh for r in load.charging_demand(vht, cells, spec, 0.8, 100.0, n).collect()}
    long = load.demand_long(vht, cells, spec, 0.8, n).groupBy("step", F.floor(F.col("position") * 0.5 / 100).alias("bin")).agg(F.sum("energy_wh").alias("e"))
    b = {(r.step, r.bin): r.e for r in long.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    with pytest.raises(ValueError):
        load.charging_demand(vht, cells, spec, 1.5, 100.0, n)
    m = load.position_map(cells, spec).groupBy("cell").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1) for r in m)


def test_load_duration_curve_and_blocks(spark):
    p = spark.createDataFrame([(4.0, 1), (1.0, 1), (3.0, 1), (2.0, 1)], "power_w double, weight int")
    assert values(load.load_duration_curve(p, 4), "i", "power_w") == [4, 3, 2, 1]
    assert values(load.load_duration_curve(p, 8), "i", "power_w") == [4, 4, 3, 3, 2, 2, 1, 1]
    assert load.ldc_divergence(load.load_duration_curve(p, 8), load.load_duration_curve(p, 8), 2.5).first()[0] == 0
    steps = spark.createDataFrame([(k, float(k)) for k in range(7)], "step long, energy_wh double")
    out = load.window_power(load.rebin_sum(steps, 3), 1.0).orderBy("block").collect()
    assert [(r.energy_wh, r.n, r.power_w) for r in out] == [(3, 3, 1), (12, 3, 4), (6, 1, 6)]
    assert values(load.bin_centers(load.rebin_sum(steps, 3), 1.0), "block", "center_h") == [1.5, 4.5, 6.5]
    s = {r.window_s: r for r in load.temporal_aggregation_summary(steps, 3600.0, [7200.0, 60.0]).collect()}
    assert set(s) == {3600.0, 7200.0} and s[3600.0].attenuation_pct == 0 and s[7200.0].peak_w == 6 and s[7200.0].energy_error == pytest.approx(0)


def test_stations_on_cells_and_breaks(spark):
    cells = spark.createDataFrame([("c", 0, 0.0, 1.0, 3), ("c", 1, 1.0, 2.0, 4), ("c", 2, 2.0, 3.0, 4)], "corridor_id string, cell long, pm_start double, pm_end double, lanes int")
    stations = spark.createDataFrame([("c", 5, 0.0, 3), ("c", 6, 1.0, 3), ("c", 8, 1.3, 3), ("c", 7, 1.9, 4)], "corridor_id string, station_id long, pm double, lanes int")
    got = {r.cell: r for r in linref.assign_stations(cells, stations, "midpoint").collect()}
    assert (got[0].vds_id, got[0].vds_source, got[0].vds_n_candidates) == (5, "direct_tiebreak", 2)  # on a border: the upstream cell
    assert got[1].vds_id == 8 and got[2].vds_source == "missing"
    best = {r.cell: r for r in linref.assign_stations(cells, stations, "midpoint", prefer_lanes=True).collect()}
    assert (best[1].vds_id, best[1].vds_source, best[1].vds_n_candidates) == (7, "direct", 2)
    up = {r.cell: r for r in linref.inherit_upstream(linref.assign_stations(cells, stations)).collect()}
    assert up[2].vds_id == 8 and up[2].vds_source == "upstream" and up[2].vds_distance_mi == pytest.approx(1.3 - 2.5)


def test_stretches(spark):
    rows = [(1, 0.0, "ML", "a"), (2, 1.0, "ML", "b"), (3, 2.0, "ML", "c"), (4, 3.0, "ML", "d"), (5, 1.5, "OR", "on"), (6, 1.6, "FR", "off"), (7, 2.0, "OR", "edge"), (8, 2.5, None, "mystery")]
    meta = spark.createDataFrame([(880, d, *r) for d in "NS" for r in rows], "route int, direction string, station_id long, abs_pm double, type string, name string")
    out = {(r.direction, r.stretch_id): r for r in scenario.build_stretches(meta).collect()}
    n = out["N", 3]
    assert (n.up_ml_id, n.down_ml_id, n.on_ids, n.off_ids, n.config_type) == (2, 3, [5, 7], [6], "c") and "several" in n.notes
    assert (out["S", 3].up_ml_id, out["S", 3].down_ml_id) == (3, 2)
    assert out["N", 4].review_ids == [8] and "review" in out["N", 4].notes and out["N", 1].up_ml_id is None


def test_absent_ramps(spark):
    st = spark.createDataFrame([(1, 10, 20, "a", [5, 6], [])], "stretch_id int, up_ml_id long, down_ml_id long, config_type string, on_ids array<long>, off_ids array<long>")
    flow = spark.createDataFrame([(10, 0, 100.0), (20, 0, 160.0), (6, 0, 20.0), (10, 1, 100.0), (20, 1, 50.0), (6, 1, 20.0)], "station_id long, m_5min long, flow double")
    ramps = spark.createDataFrame([(5, "on"), (6, "on"), (9, "off")], "station_id long, kind string")
    got = {(r.station_id, r.m_5min): r.flow for r in scenario.absent_ramp_flow(ramps, st, flow).collect()}
    assert got == {(5, 0): 40.0, (5, 1): 0.0, (9, 0): 0.0, (9, 1): 0.0}


def feed(folder, name, lines):
    with gzip.open(folder / name, "wt") as f:
        f.write("\n".join(lines) + "\n")


def line(minute, lanes, station=7, flow="12"):
    head = f"01/01/2024 {minute // 60:02d}:{minute % 60:02d}:00,{station},4,880,N,ML,.5,10,100,{flow},.1,60"
    return ",".join([head, *["10,3,.1,55,100"] * lanes])


def test_detector_files(spark, tmp_path):
    feed(tmp_path, "a.gz", [line(0, 2), line(5, 2, flow=""), line(0, 4, station=8), line(10, 2) + ",1"])
    feed(tmp_path, "b.gz", [line(0, 2), line(60, 0, flow="NaN")])
    (tmp_path / "note.txt").write_text("x")
    rows = ingest.read_detector_files(spark, str(tmp_path))
    assert rows.count() == 5 and ingest.quarantine(ingest.parse_detector_lines(spark.read.text(str(tmp_path / "a.gz")))).count() == 1
    assert sorted(len(r.lanes) for r in rows.collect()) == [0, 2, 2, 2, 4]
    assert rows.where("total_flow_5min IS NULL").count() == 2
    assert ingest.read_detector_files(spark, str(tmp_path), [7], "2024-01-01 00:00:00", "2024-01-01 00:05:00").count() == 3
    assert ingest.read_detector_files(spark, str(tmp_path), end="2024-01-01").count() == 3  # a bare date is its midnight
    assert ingest.explode_lanes(rows).where("station_id = 8").count() == 4
    out = str(tmp_path / "by_station")
    ingest.write_by_station(rows, out)
    back = spark.read.parquet(out)
    assert back.count() == 4 and ingest.split_by_station(back, 8).count() == 1
    assert ingest.merge_by_station(back, back.withColumn("extra", F.lit(1))).count() == 8


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    feed(source, "a.gz", [line(0, 1), line(0, 1), line(5, 1), line(30, 1)])
    rows = detectors.stream_detector_files(spark, str(source))
    sink, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    detectors.run_available(detectors.five_minute_flow(rows), sink, mark)
    feed(source, "b.gz", [line(50, 1), line(1, 1)])
    detectors.run_available(detectors.five_minute_flow(detectors.stream_detector_files(spark, str(source))), sink, mark)
    got = spark.read.schema("station_id long, start timestamp, flow double, density double, n long").parquet(sink).orderBy("start").collect()
    assert [(r.start.minute, r.n, r.flow, r.density) for r in got[:2]] == [(0, 1, 144.0, 2.4), (5, 1, 144.0, 2.4)]


def test_corridor_run_and_matrix_round_trips(spark, tmp_path):
    seg = spark.createDataFrame([("c", 0, [(-118.0, 34.0), (-117.9, 34.0)], 3, 0.0, 1.0)], "corridor_id string, seq int, geometry array<struct<lon:double,lat:double>>, lanes int, pm_start double, pm_end double")
    jun = spark.createDataFrame([("c", 1, "on", 0.5, 34.0, -117.95, 1, None)], "corridor_id string, junction_id long, kind string, postmile double, lat double, lon double, lanes int, name string")
    nodes = spark.createDataFrame([(1, 0.0)], "node_id long, pm double")
    ingest.write_corridor(seg, jun, nodes, str(tmp_path / "cor"))
    for made, back in zip((seg, jun, nodes), ingest.read_corridor(spark, str(tmp_path / "cor")), strict=True):
        assert made.collect() == back.collect()
    ingest.write_run(str(tmp_path / "runs"), "r1", params=nodes)
    assert ingest.read_run(spark, str(tmp_path / "runs"), "r1", "params").count() == 1
    (tmp_path / "m.csv").write_text("1,2\n3,x\n")
    assert [(r.row, r.col, r.value) for r in ingest.read_matrix_csv(spark, str(tmp_path / "m.csv")).orderBy("row", "col").collect()] == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, None)]
    demand = spark.createDataFrame([(0, 1, 2.0), (300, 1, 2.0)], "step long, position long, energy_wh double")
    ingest.write_demand_long(demand, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("part = 1").count() == 1
    (tmp_path / "pm.json").write_text('{"features": [{"properties": {"Route": "I 880", "PM": 1.5}, "geometry": {"coordinates": [-122.0, 37.5]}}, {"properties": {"Route": "17", "PM": 2}, "geometry": {"coordinates": [-122.0, 37.5]}}]}')
    assert [(r.route, r.pm, r.latitude) for r in ingest.read_postmile_markers(spark, str(tmp_path / "pm.json"), [880]).collect()] == [(880, 1.5, 37.5)]


def test_metadata_and_tables_say_what_is_missing(spark, tmp_path):
    (tmp_path / "meta.txt").write_text("ID\tFwy\tDir\tAbs_PM\tLatitude\tLongitude\tLanes\tType\tName\n1\t5\tn\t1.0\t34\t-118\t3\tML\ta\n2\t5\tN\tx\t34\t-118\t3\tOR\tb\n3\t5\tN\t2\t\t-118\t3\tML\tc\n")
    assert [r.station_id for r in ingest.read_station_metadata(spark, str(tmp_path / "meta.txt"), route=5, direction="n").collect()] == [1]
    with pytest.raises(ValueError, match="latitude"):
        ingest.clean_station_metadata(spark.createDataFrame([(1, 5)], "ID long, Fwy int"))
    with pytest.raises(ValueError, match="q_max"):
        ingest.clean_freeway_table(spark.createDataFrame([(1, 5.0)], "cell long, length double"))
    with pytest.raises(ValueError, match="cell numbers"):
        ingest.wide_to_long(spark.createDataFrame([(1, 5.0)], "step long, x double"), "step", "v")
    assert quality.require_contiguous(spark.createDataFrame([(1,), (1,), (2,)], "station_id long"), 2).count() == 1


def test_a_pandas_filler_plugs_in(spark):
    def filler(pdf):
        pdf = pdf.sort_values("minute")
        pdf["v"] = pdf["v"].interpolate()
        return pdf

    df = spark.createDataFrame([(1, 0, 1.0), (1, 5, None), (1, 10, 3.0)], "station_id long, minute int, v double")
    done = df.transform(lambda d: d.groupBy("station_id").applyInPandas(filler, d.schema))
    assert values(done, "minute", "v") == [1, 2, 3]


def test_running_sums_equal_a_plain_loop(spark):
    rows = [(k, (k * 37) % 11, k % 3) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, n long, key int")
    got = {r["id"]: r["upto"] for r in running.running_sum(df, [F.desc("n"), "id"], "n", "upto").collect()}
    total, want = 0, {}
    for i, n, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += n
        want[i] = total
    assert got == want
    for r in running.running_share(df, ["key"], ["id"], "n").collect():
        own = [n for i, n, k in rows if k == r["key"]]
        assert r["total"] == sum(own) and r["upto"] == sum(n for i, n, k in rows if k == r["key"] and i <= r["id"])
    assert running.running_share(df.limit(0), [], ["id"], "n").count() == 0


def test_rewritten_stations_and_runs_leave_the_others(spark, tmp_path):
    rows = lambda s, v: spark.createDataFrame([(s, i, v) for i in range(3)], "station_id long, ts long, v int")
    path = str(tmp_path / "stations")
    ingest.write_by_station(rows(1, 1).union(rows(2, 1)), path)
    ingest.write_by_station(rows(2, 5), path)
    assert sorted((r["station_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1)] * 3 + [(2, 5)] * 3
    path = str(tmp_path / "runs")
    for run, v in (("r1", 1), ("r2", 2), ("r1", 3)):
        ingest.write_run(path, run, traj=rows(1, v))
    assert [r["v"] for r in ingest.read_run(spark, path, "r1", "traj").collect()] == [3] * 3
    assert [r["v"] for r in ingest.read_run(spark, path, "r2", "traj").collect()] == [2] * 3


def test_ramp_demand_fills_first_and_tells_gaps(spark):
    cells = spark.createDataFrame([(0, True, ["1", "2", "v9"])], "cell long, on_ramp boolean, on_ramp_vds_ids array<string>")
    flow = spark.createDataFrame([(1, 0, 5.0), (1, 1, None), (1, 2, 7.0), (2, 0, 1.0), (2, 1, 2.0), (2, 2, 3.0)], "station_id long, m_5min long, flow double")
    with pytest.raises(Exception, match="no flow at station 1, sample 1"):
        scenario.ramp_demand(cells, flow, 0, 3).collect()
    told = {r["step"]: r["demand"] for r in scenario.ramp_demand(cells, flow, 0, 3, gaps="null").collect()}
    assert told == {0: 72.0, 1: None, 2: 120.0}
    filled = scenario.ramp_demand(cells, flow, 1, 3, 150, lambda df: df.fillna(4.0, ["flow"])).collect()
    assert {r["step"]: r["demand"] for r in filled} == {0: 72.0, 1: 72.0, 2: 120.0, 3: 120.0}


def test_nearest_points_are_found_however_far(spark):
    rng = random.Random(5)
    marks = [(1, float(k), rng.uniform(-120, -110), rng.uniform(30, 40)) for k in range(60)]
    nodes = [(k, rng.uniform(-121, -109), rng.uniform(29, 41), 1) for k in range(40)] + [(99, 100.0, -40.0, 1)]
    got = {r["node_id"]: r["pm"] for r in linref.annotate_postmiles(spark.createDataFrame(nodes, "node_id long, x double, y double, route int"), spark.createDataFrame(marks, "route int, pm double, longitude double, latitude double")).collect()}
    assert set(got) == {n for n, *_ in nodes}
    for n, x, y, _ in nodes:
        _, pm, lon, lat = min(marks, key=lambda m: ((m[2] - x) ** 2 + (m[3] - y) ** 2, m[1]))
        a1, a2, d = math.radians(lat), math.radians(y), math.radians(x - lon)
        miles = 2 * 6371009 * math.asin(math.sqrt(math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin(d / 2) ** 2)) / 1609.344
        assert abs(abs(got[n] - pm) - miles) < 1e-6


def test_tags_labels_and_capacities(spark):
    one = spark.createDataFrame([("4;3", ["3", "4", "4"], 90.0), ("3;4;4", [], 45.0), (None, None, 900.0)], "tag string, tags array<string>, s double")
    got = [tuple(r) for r in one.select(S.parse_lanes("tag"), S.lanes_of_list("tags"), S.window_label("s")).collect()]
    assert got == [(4, 4, "1.5min"), (3, 0, "45s"), (0, 0, "15min")]


def test_fills_carry_over_chunks_of_time(spark):
    """Every layout of nulls over three chunks, against a loop over the whole series."""
    rng = random.Random(3)
    rows, want = [], {}
    for station in range(60):
        values = [None if rng.random() < 0.6 else float(k) for k in range(24)]
        if station % 5 == 0:
            values[6:18] = [None] * 12  # a chunk without any value, and its neighbours' ends
        at = [f"2024-01-{1 + k // 8:02} {16 + k % 8}:00" for k in range(24)]
        rows += [(station, t, v) for t, v in zip(at, values, strict=True)]
        for limit in (None, 3):
            k = 0
            while k < 24:
                run = k
                while run < 24 and values[run] is None:
                    run += 1
                for j in range(k, run):
                    fits = k > 0 and (limit is None or run - k <= limit)
                    want[station, at[j], limit] = values[k - 1] if fits else None
                if run < 24:
                    want[station, at[run], limit] = values[run]
                k = run + 1
    df = spark.createDataFrame(rows, "station_id long, ts string, v double").withColumn("at", F.col("ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for limit in (None, 3):
        got = gaps.persistence_fill(df, "v", limit and limit * 5, out="w", chunk="day")
        assert got.columns == [*df.columns, "w"]
        assert {(r["station_id"], r["at"], limit): r["w"] for r in got.collect()} == {k: v for k, v in want.items() if k[2] == limit}


def test_crowded_squares_are_cut_up(spark, monkeypatch):
    """Nine in ten of the edges lie in one place: stations find the same edge as among all of them."""
    rng = random.Random(5)
    place = lambda: (-118.0 + rng.random() * (0.008 if rng.random() < 0.9 else 3), 34.0 + rng.random() * (0.008 if rng.random() < 0.9 else 1))
    segments = [("k", n, [(x, y), (x + 0.0003, y + 0.0002)], float(n), n + 1.0) for n, (x, y) in enumerate(place() for _ in range(600))]
    stations = [("k", n, *place()) for n in range(300)]
    seg = spark.createDataFrame(segments, "corridor_id string, seq int, geometry array<struct<lon:double,lat:double>>, pm_start double, pm_end double")
    sta = spark.createDataFrame(stations, "corridor_id string, station_id long, longitude double, latitude double")
    found = {}
    for most in (40, 10**9):
        monkeypatch.setattr(linref, "SQUARE_ROWS", most)
        found[most] = {r["station_id"]: (r["seq"], round(r["distance_m"], 6)) for r in linref.project_to_corridor(sta, seg, 100.0).collect()}
    assert found[40] == found[10**9] and len(found[40]) > 200
    monkeypatch.setattr(linref, "SQUARE_ROWS", 40)
    box = [F.least("p.lon", "q.lon") - 1e-4, F.greatest("p.lon", "q.lon") + 1e-4, F.least("p.lat", "q.lat") - 1e-4, F.greatest("p.lat", "q.lat") + 1e-4]
    met = linref._meet(sta, "longitude", "latitude", linref.segment_edges(seg), box, ["corridor_id"], 0.01, 1e-4)
    assert met.groupBy("station_id", "seq").count().where("count > 1").isEmpty()
    assert met.groupBy("station_id").count().agg(F.max("count")).first()[0] <= 40  # no leaf over the bound


def test_weights_in_closed_form_equal_sums_over_positions(spark):
    cells = spark.createDataFrame([(0, 0.03), (1, 0.011), (2, 0.02), (3, 0.0001)], "cell long, length double")
    for spec in (load.PadSpec(), load.PadSpec(alpha=1.5, lambda_gap=2.0, delta=4.0), load.PadSpec(dx=0.1, beta=5.0), load.PadSpec(alpha=0.5, lambda_gap=0.5, delta=0.5)):
        n = int(load.cell_positions(cells, spec.dx).agg(F.sum("n")).first()[0])
        power = {r["position"]: r["power"] for r in load.power_profile(spark, n, spec).collect()}
        for bin_m in (7.0, 3.3, 40.0):
            want = {}
            for r in load.position_map(cells, spec).collect():
                if r["position"] in power:
                    key = r["cell"], int(r["position"] * spec.dx // bin_m)
                    want[key] = want.get(key, 0.0) + power[r["position"]] * r["weight"]
            got = {(r["cell"], r["bin"]): r["w"] for r in load.bin_weights(cells, spec, bin_m, n).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    fine = load.bin_weights(cells, load.PadSpec(dx=0.001), 7.0, 10**5)
    assert fine.count() < 100  # a grid of a hundred thousand positions


def test_percentiles_by_ranks_equal_numpys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 0.0, rng.random()])) for _ in range(2000)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"low": 0.0, "q": 0.37, "mid": 0.5, "high": 1.0}
    got = {r["k"]: [r[n] for n in shares] for r in quantiles.exact_percentiles(df, ["k"], "v", shares).collect()}
    for k in ("a", "b", None, "one"):
        assert got[k] == pytest.approx(np.quantile([v for x, v in rows if x == k], list(shares.values())).tolist())
    assert "none" not in got
    pooled = quantiles.exact_percentiles(df, [], "v", {"mid": 0.5}).first()["mid"]
    assert pooled == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_windows_come_from_their_largest_divisor(spark):
    assert load.window_lattice([1, 3, 12, 72, 5]) == {1: 0, 3: 1, 5: 1, 12: 3, 72: 12}
    per = spark.createDataFrame([(k, float(k)) for k in range(10)], "step long, energy_wh double")
    got = {(r["window_s"], r["block"]): (r["energy_wh"], r["n"]) for r in load.aggregation_windows(per, 300, [600, 1200]).collect()}
    assert got[600.0, 4] == (17.0, 2) and got[1200.0, 2] == (17.0, 2) and got[300.0, 9] == (9.0, 1) and len(got) == 18


def test_runs_are_scored_apart_and_compared(spark):
    pairs = spark.createDataFrame([(r, c, 1, m, 10.0 + d, 10.0, 5.0, 5.0) for r, d in (("a", 1.0), ("b", 3.0)) for c in (1, 2) for m in range(12)], "run_id string, cell long, station_id long, m_5min long, sim_flow double, obs_flow double, sim_density double, obs_density double")
    by_run = {r["run_id"]: r["flow_rmse"] for r in score.corridor_rmse_mape(pairs).collect()}
    assert by_run == {"a": 1.0, "b": 3.0}
    diff = {r["cell"]: r["flow_rmse_diff"] for r in score.run_differences(score.rmse_mape_all(pairs), "a", ["flow_rmse"]).collect()}
    assert diff == {1: 2.0, 2: 2.0, None: 2.0}
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell long")
    assert sorted((r["run_id"], r["cell"], r["flow_n"]) for r in score.rmse_mape(pairs, cells).collect()) == [(r, c, 12 * (c < 3)) for r in "ab" for c in (1, 2, 3)]
    geh = {(r["run_id"], r["cell"]): r["n_hours"] for r in score.flow_geh(pairs).collect()}
    assert geh == {(r, c): n for r in "ab" for c, n in ((1, 1), (2, 1), (None, 2))}
    assert score.flow_geh(pairs.drop("run_id").where("station_id = 0")).count() == 0


def test_tiles_with_halos_equal_the_offsets_by_hand(spark):
    rng = random.Random(2)
    known = {(c, m): rng.random() for c in range(-3, 40) for m in range(50) if rng.random() < 0.2}
    asked = [(c, m) for c in range(-3, 40) for m in range(0, 50, 3)] + [(99, 99), (0, 0), (0, 0)]
    usable = spark.createDataFrame([(c, m, v) for (c, m), v in known.items()], "cell long, m_5min long, value double")
    targets = spark.createDataFrame([*asked, (None, 1)], "cell long, m_5min long")
    got = {(r["cell"], r["m_5min"]): r["value"] for r in gaps.knn_impute(None, usable, targets, 3, 0.7, tile=(8, 16)).collect()}
    assert got.keys() == {*asked, (None, 1)} and got[None, 1] is None
    for c, m in set(asked):
        near = [(math.exp(-0.7 * (abs(a) + abs(b) - 1)), known[c + a, m + b]) for a in range(-3, 4) for b in range(-3, 4) if a and abs(a) + abs(b) <= 3 and (c + a, m + b) in known]
        assert got[c, m] == (pytest.approx(sum(w * v for w, v in near) / sum(w for w, _ in near)) if near else None)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_known_entries_of_the_field_come_without_a_grid(spark):
    from lanewatt.plans import registry, series

    t = registry.Source(spark, "/root/testdata/sf0.001")
    known = series.field_known(t)
    assert "Generate" not in plan_of(known)  # a grid of all samples was sent to all tasks before
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, series.field(t).where("value IS NOT NULL").collect()))


def test_a_dense_grid_gets_its_weights_without_a_join(spark):
    grid = spark.createDataFrame([(0, 0, 2.0, "observed"), (0, 1, 3.0, "knn"), (0, 2, None, None)], "cell long, m_5min long, value double, source string")
    out = scenario.weight_mask(grid, None, 0.25)
    assert "Join" not in plan_of(out)
    assert sorted((r["m_5min"], r["weight"], r["genuine"]) for r in out.collect()) == [(0, 1.0, True), (1, 0.25, False), (2, 0.0, False)]


def test_cells_meet_spans_of_their_stations_samples(spark):
    cells = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, 9)], "cell long, station_id long")
    obs = spark.createDataFrame([(7, 0, 1.0), (7, 30, None), (7, 49, 2.0), (7, 50, 9.0), (8, 3, 5.0)], "station_id long, m_5min long, density double")
    got = {(r["cell"], r["m_5min"]): (r["value"], r["direct"]) for r in gaps.cell_grid(cells, obs, "density", 50).collect()}
    assert got == {(c, m): ({0: 1.0, 49: 2.0}.get(m) if c < 3 else None, c != 3) for c in range(1, 5) for m in range(50)}


def test_postmiles_are_looked_up_once_a_place(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(linref, "written", lambda df, name: made.setdefault(name, []).append(df.count()) or df)
    nodes = spark.range(500).select(F.col("id").alias("node_id"), F.lit(-118.0).alias("x"), (34 + F.col("id") % 2 / 1e3).alias("y"), F.lit(5).alias("route"))
    markers = spark.range(300).select(F.lit(5).alias("route"), (9.0 - F.col("id") % 7).alias("pm"), F.lit(-118.0).alias("longitude"), F.lit(34.0).alias("latitude"))
    pm = dict(map(tuple, linref.annotate_postmiles(nodes, markers).collect()))
    assert len(pm) == 500 and pm[0] == 3.0 and pm[1] == pytest.approx(3.0 + 111.19 / 1609.344, abs=1e-4)
    assert made["markers"] == [1] and made["nearest"] == [2]


def test_demand_is_dealt_by_blocks_of_cells(spark):
    cells = spark.range(100).select(F.col("id").alias("cell"), F.lit(0.5).alias("length"))
    vht = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"), F.lit(1.0).alias("vht"))
    out = load.charging_demand(vht, cells, load.PadSpec(), 0.8, 800.0, int(load.cell_positions(cells, 0.5).agg(F.sum("n")).first()[0]))
    assert "RepartitionByExpression" in plan_of(out)  # a task held the sums of all cells that it met before
    dealt = vht.repartition(100 // load.BLOCK_CELLS + 1, F.floor(F.col("cell") / load.BLOCK_CELLS)).withColumn("p", F.spark_partition_id())
    assert dealt.select(F.floor(F.col("cell") / load.BLOCK_CELLS).alias("b"), "p").distinct().count() == 4


def test_pairs_are_dealt_once_and_ranked_where_they_lie(spark):
    traj = spark.createDataFrame([(r, s, c, 10.0 + s + c, 5.0) for r in ("a", "b") for s in range(48) for c in (1, 2)], "run_id string, step long, cell long, flow double, rho_post double")
    cells = spark.createDataFrame([(1, 0, "direct"), (2, 0, "direct")], "cell long, vds_id long, vds_source string")
    obs = spark.createDataFrame([(0, m, 20.0 - m, 4.0) for m in range(23)], "station_id long, m_5min long, flow double, density double")
    got = score.pair_runs(traj, obs, cells, 2)
    want = score.pair_sim_observed(score.block_mean(traj, 2), obs, cells)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert "Join" not in plan_of(score.qq_rank_pairs(want)).split("RepartitionByExpression")[0]  # both sides were joined by rank before
    errors = lambda df: sorted((str(r["run_id"]), str(r["cell"]), round(r["flow_rmse"], 9), round(r["density_mape"], 9), r["flow_n"]) for r in score.rmse_mape_all(df).collect())
    assert errors(score.hour_sums(got)) == errors(want)


def test_blocks_become_rows_after_the_join(spark):
    blocks = ingest.long_to_blocks(spark.createDataFrame([(0, 1, 2.0), (1, 70, 3.0)], "step long, cell long, v double"), "step", "v")
    out = ingest.blocks_to_long(blocks, "step", "v", cells=spark.createDataFrame([(1,), (70,), (200,)], "cell long"))
    plan = plan_of(out)
    assert plan.index("explode(_cells") < plan.index("Join")
    assert sorted(map(tuple, out.collect())) == [(0, 1, 2.0), (0, 70, 0.0), (0, 200, 0.0), (1, 1, 0.0), (1, 70, 3.0), (1, 200, 0.0)]


def shuffles(spark, df, of=""):
    """How many shuffles a plan runs, those that are read again counted once; nothing is broadcast."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    return len([x for x in plan.splitlines() if " Exchange hashpartitioning" in x and "ReusedExchange" not in x and of in x])


def test_holdout_deals_the_series_once(spark, monkeypatch):
    """Twelve fills read one shuffle, a null station between the others; the report is that of each fill alone."""
    monkeypatch.setattr(gaps, "DEALT_ROWS", 1000, raising=False)
    rows = [(s, 5 * i, None if i % 11 == 3 else float(i % 50)) for s in (1, 2, None) for i in range(0, 9000, 7)]
    df = written(ts_table(spark, rows).withColumn("m_5min", F.col("minute") / 5), "series")
    fillers = {"persistence": lambda d: gaps.persistence_fill(d, "v"), "slot_mean": lambda d: gaps.slot_mean_fill(d, "v"), "gap_aware": lambda d: gaps.gap_aware_fill(d, "v")}
    report = scenario.holdout_report(df, "v", (1, 3, 6, 12), 97, fillers)
    assert shuffles(spark, report, "station_id") == 1
    for r in report.where("gap IN (3, 12)").collect():
        alone = scenario.fill_accuracy(fillers[r["strategy"]](scenario.holdout_blocks(df, "v", r["gap"], 97)), "v").first()
        assert r["n"] == alone["n"] > 0 and math.isclose(r["rmse"], alone["rmse"]) and math.isclose(r["bias"], alone["bias"], abs_tol=1e-9)


def test_persistence_carries_into_chunks_of_a_null_station(spark):
    """A null station is one like any other, and so are rows without a time."""
    rows = [(s, 1440 * d, 1.5 if d == 3 else None) for s in (None, 7) for d in range(0, 100, 3)]
    out = gaps.persistence_fill(ts_table(spark, rows), "v")
    assert [tuple(r) for r in out.groupBy("station_id").agg(F.count("v").alias("n")).orderBy("station_id").collect()] == [(None, 33), (7, 33)]


def test_lanes_are_parsed_once(spark):
    lane = "10,4.5,0.1,,NaN"
    head = "01/01/2024 00:05:00,{},4,880,N,ML,0.5,30,100, ,0.05,61.5"
    lines = spark.createDataFrame([(head.format(1) + "," + lane + "," + lane,), (head.format(2),), (head.format(3) + ",1",)], "value string")
    lanes = ingest.explode_lanes(ingest.with_lanes(ingest.parse_detector_lines(lines)))
    assert [tuple(r)[2:] for r in lanes.where("station_id = 1").orderBy("lane").collect()] == [(k, 10, 4.5, 0.1, None, None) for k in (1, 2)]
    assert lanes.count() == 2 and ingest.parse_detector_lines(lines).where("total_flow_5min IS NULL").count() == 3
    assert lanes._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1


def test_augmented_grid_is_made_once(spark):
    """Only gaps of direct cells meet the means; what made the grid is not run again for each kind of entry."""
    rows = [(c, m, None if (c, m) in ((0, 2), (0, 3)) or c == 1 else 10.0 * c + m, c != 1) for c in (0, 1, 2) for m in range(4)]
    grid = spark.createDataFrame(rows, "cell long, m_5min long, value double, direct boolean").repartition(3, "direct")
    history = spark.createDataFrame([(0, 2, 4.0), (0, 2, 8.0), (0, 0, 99.0), (0, 3, None), (1, 1, 50.0)], "cell long, m_5min long, value double")
    out = gaps.augment_grid(grid, history)
    assert shuffles(spark, out, "direct") == 0
    got = {(r["cell"], r["m_5min"]): (r["value"], r["source"]) for r in out.collect()}
    assert got[0, 2] == (6.0, "hist") and got[0, 0] == (0.0, "observed") and (0, 3) not in got and len(got) == 11
    near = {(0, 1): 1.0, (2, 1): 21.0, (0, 0): 0.0, (0, 2): 6.0, (2, 0): 20.0, (2, 2): 22.0, (2, 3): 23.0}
    weight = {at: math.exp(-(abs(at[0] - 1) + abs(at[1] - 1) - 1)) for at in near}
    assert got[1, 1][1] == "knn" and math.isclose(got[1, 1][0], sum(near[k] * weight[k] for k in near) / sum(weight.values()))


def test_demand_is_summed_where_it_is_dealt(spark, monkeypatch):
    """Sums lie by blocks of bins: no shuffle goes by step, and what a task sums is a block's, over the same grid as the
    expanded form."""
    monkeypatch.setattr(load, "BLOCK_CELLS", 4)
    spec = load.PadSpec()
    cells = spark.createDataFrame([(c, 0.1 + 0.07 * (c % 5)) for c in range(20)], "cell long, length double")
    vht = spark.createDataFrame([(c, s, 1.0 + c * s % 7) for c in range(20) for s in range(6) if (c + s) % 4], "cell long, step long, vht double")
    n = int(load.cell_positions(cells, spec.dx).agg(F.sum("n")).first()[0])
    out = load.charging_demand(vht, cells, spec, 0.8, 300.0, n)
    assert out.columns == ["step", "bin", "energy_wh"] and shuffles(spark, out, "step") == 0
    long = load.demand_long(vht, cells, spec, 0.8, n).groupBy("step", F.floor(F.col("position") * spec.dx / 300.0).alias("bin")).agg(F.sum("energy_wh").alias("e"))
    want = {(r["step"], r["bin"]): r["e"] for r in long.collect()}
    got = {(r["step"], r["bin"]): r["energy_wh"] for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
