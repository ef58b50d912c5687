"""Checks as tables of violations: empty where all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_contiguous(ts: DataFrame, expected: int) -> DataFrame:
    """Stations whose number of rows is not ``expected``."""
    return ts.groupBy("station_id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") != expected).withColumn("expected", F.lit(expected).cast("long"))


def require_no_null(ts: DataFrame, column: str) -> DataFrame:
    return ts.groupBy("station_id").agg(F.count_if(F.col(column).isNull()).alias("n_null")).where("n_null > 0")


def _report(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return df.select(key, F.explode(broken).alias("violation"))


def freeway_violations(cells: DataFrame, dt_hours: float, rtol: float = 1e-3) -> DataFrame:
    """(cell, violation) of a cell parameter table; a null capacity is unbounded, absent gamma and xi are 1."""
    x = {n: F.col(n) for n in ("length", "q_max", "v_f", "w", "rho_jam", "rho_crit")}
    gamma = F.coalesce(F.col("gamma"), F.lit(1.0)) if "gamma" in cells.columns else F.lit(1.0)
    xi = F.coalesce(F.col("xi"), F.lit(1.0)) if "xi" in cells.columns else F.lit(1.0)
    rules = [(f"{n}_not_positive", ~(F.coalesce(v, F.lit(0.0)) > 0)) for n, v in x.items()]
    rules += [
        ("rho_crit_not_below_jam", x["rho_crit"] >= x["rho_jam"]),
        ("gamma_out_of_range", (gamma < 0) | (gamma > 1)),
        ("xi_out_of_range", (xi <= 0) | (xi > 1)),
        ("on_capacity_not_positive", F.col("on_ramp_capacity") <= 0),
        ("off_capacity_not_positive", F.col("off_ramp_capacity") <= 0),
        ("on_capacity_without_ramp", F.col("on_ramp_capacity").isNotNull() & ~F.col("on_ramp")),
        ("off_capacity_without_ramp", F.col("off_ramp_capacity").isNotNull() & ~F.col("off_ramp")),
        ("free_flow_identity", F.abs(x["q_max"] - x["v_f"] * x["rho_crit"]) > rtol * x["q_max"]),
        ("congestion_identity", F.abs(x["q_max"] - x["w"] * (x["rho_jam"] - x["rho_crit"])) > rtol * x["q_max"]),
        ("stability", x["v_f"] * dt_hours > x["length"]),
    ]
    return _report(cells, "cell", rules)


def scenario_violations(scenario: DataFrame, cells: DataFrame, horizon: int) -> DataFrame:
    """(cell, violation, n) over a long scenario (step, cell, demand, beta) and the initial state in ``cells`` (rho0, q0)."""
    known = cells.select("cell", "on_ramp", "off_ramp", "rho_jam", "rho0", "q0")
    rows = scenario.join(known.withColumn("known", F.lit(True)), "cell", "left")
    known_cell = F.coalesce("known", F.lit(False))
    found = _report(rows, "cell", [
        ("cell_unknown", ~known_cell),
        ("beta_out_of_range", (F.col("beta") < 0) | (F.col("beta") > 1)),
        ("demand_negative", F.col("demand") < 0),
        ("demand_without_ramp", known_cell & (F.col("demand") != 0) & ~F.col("on_ramp")),
        ("beta_without_ramp", known_cell & (F.col("beta") != 0) & ~F.col("off_ramp")),
    ])
    start = _report(known, "cell", [
        ("rho0_negative", F.col("rho0") < 0), ("q0_negative", F.col("q0") < 0), ("rho0_above_jam", F.col("rho0") > F.col("rho_jam")),
    ])
    count = scenario.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") != horizon).select("cell", F.lit("row_count").alias("violation"))
    return reduce(DataFrame.unionByName, (found, start, count)).groupBy("cell", "violation").agg(F.count("*").alias("n"))


def presence_without_vds(cells: DataFrame, side: str) -> DataFrame:
    """Cells flagged with a ramp on ``side`` (on, off) that list no station for it."""
    return cells.where(F.col(f"{side}_ramp") & (F.size(F.coalesce(f"{side}_ramp_vds_ids", F.array().cast("array<string>"))) == 0))


def lane_mismatch(cells: DataFrame) -> DataFrame:
    """Directly assigned cells whose station has another number of lanes, or no station at all."""
    direct = F.col("vds_source").isin("direct", "direct_tiebreak")
    return cells.where(direct & (F.col("vds_id").isNull() | ~F.col("lanes").eqNullSafe(F.col("vds_lanes"))))


def pad_spec_violations(specs: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(spec_id, violation) of charging pad layouts: positive fields, pad and gap whole multiples of dx."""
    off = lambda n: F.abs(F.rint(F.col(n) / F.col("dx")) * F.col("dx") - F.col(n)) > tol
    rules = [(f"{n}_not_positive", ~(F.coalesce(F.col(n), F.lit(0.0)) > 0)) for n in ("alpha", "lambda_gap", "delta", "beta", "beta_prime", "dx")]
    rules += [(f"{n}_off_grid", (F.col("dx") > 0) & off(n)) for n in ("alpha", "lambda_gap", "delta")]
    return _report(specs, "spec_id", rules)


def fd_gate(params: DataFrame, rtol: float = 0.05) -> DataFrame:
    """Calibration code and reason of fitted triangles: 0, or 4 with the first failing test; failed rows lose their numbers.

    Rows that already carry a code other than 0 keep it.
    """
    names = ("capacity", "free_flow_speed", "congestion_wave_speed", "jam_density", "critical_density")
    q, v, w, jam, crit = (F.col(n) for n in names)
    tests = [(f"{n}_not_positive", ~(F.coalesce(F.col(n), F.lit(0.0)) > 0)) for n in names]
    tests += [
        ("wave_not_slower", w >= v), ("critical_not_below_jam", crit >= jam),
        ("free_flow_identity", F.abs(q - v * crit) > rtol * q), ("congestion_identity", F.abs(q - w * (jam - crit)) > rtol * q),
    ]
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in tests])
    prior = F.coalesce(F.col("calibration_code"), F.lit(0)) if "calibration_code" in params.columns else F.lit(0)
    code = F.when(prior != 0, prior).when(reason.isNotNull(), 4).otherwise(0).cast("int")
    out = params.withColumn("_code", code).withColumn("reason", F.when(F.col("_code") == 4, reason))
    for n in names:
        out = out.withColumn(n, F.when(F.col("_code") == 0, F.col(n)))
    return out.withColumn("calibration_code", F.col("_code")).drop("_code")
