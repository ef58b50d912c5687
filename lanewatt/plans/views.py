"""Detector, corridor and simulation tables derived from the driver's tables, by one SQL text for Spark and for DuckDB.

Doubles are written with an exponent, which both engines read as double; sample 0 is Monday 2024-01-01 00:00.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2024-01-01 00:00:00"
HORIZON = 8640

VIEWS: dict[str, str] = {
    # per-lane truth: a triangle of free speed 60, wave speed 15, jam density 150; a station for 16 suppliers, so that
    # stations grow with the tables while each has about one line item a sample
    "truth": """
SELECT station_id, m_5min, 1e0 + CAST(total AS DOUBLE) / CAST(n AS DOUBLE) / 1e1 + 1373131e-10 AS rho
FROM (SELECT CAST(floor(l_suppkey / 16e0) AS BIGINT) AS station_id, CAST(l_orderkey % 8640 AS BIGINT) AS m_5min, SUM((l_partkey * 7919 + l_orderkey * 31) % 1490) AS total, COUNT(*) AS n
      FROM {lineitem} GROUP BY 1, 2) s""",
    "det": """
SELECT station_id, m_5min, CASE WHEN (m_5min + station_id * 3) % 23 = 0 THEN NULL ELSE q * 2500731e-7 END AS total_flow_5min,
       q / rho AS avg_speed_mph, CASE WHEN (m_5min * 7 + station_id) % 10 < 9 THEN 1e2 ELSE 6e1 END AS pct_observed
FROM (SELECT station_id, m_5min, rho, CASE WHEN rho <= 30e0 THEN 60e0 * rho ELSE 15e0 * (150e0 - rho) END AS q FROM {truth}) t""",
    "obs5": "SELECT station_id, m_5min, total_flow_5min * 12e0 AS flow, total_flow_5min * 12e0 / nullif(avg_speed_mph, 0e0) AS density FROM {det}",
    "cells": """
SELECT concat('c', CAST(corridor AS STRING)) AS corridor_id, cell, length, lanes, on_ramp, off_ramp, pm_end - length AS pm_start, pm_end, vds_id,
       CASE WHEN vds_id IS NULL THEN 'missing' WHEN cell % 5 = 0 THEN 'direct_tiebreak' ELSE 'direct' END AS vds_source,
       CASE WHEN vds_id IS NULL THEN NULL ELSE 3 + cell % 2 END AS vds_lanes, pm_end - length / 3e0 AS vds_pm,
       60e0 AS v_f, 15e0 AS w, 1800e0 * lanes AS q_max, 150e0 * lanes AS rho_jam, 30e0 * lanes AS rho_crit
FROM (SELECT *, SUM(length) OVER (PARTITION BY corridor ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pm_end
      FROM (SELECT cell, corridor, 23e-2 + CAST(cell % 7 AS DOUBLE) * 11e-2 AS length, CAST(3 + cell % 3 AS BIGINT) AS lanes,
                   cell % 3 = 1 AS on_ramp, cell % 4 = 2 AS off_ramp, CASE WHEN cell % 4 < 3 THEN CAST(floor(cell / 4e0) AS BIGINT) END AS vds_id
            FROM (SELECT DISTINCT CAST(floor(s_suppkey / 4e0) AS BIGINT) AS cell, CAST(floor(s_suppkey / 100e0) AS BIGINT) AS corridor FROM {supplier}) k) a) b""",
    "traj": """
SELECT 'r1' AS run_id, m_5min * 2 + i AS step, cell, rho_post, queue_post, flow, flow / rho_post AS speed FROM (
  SELECT t.m_5min, i, cell, t.rho * lanes + CAST((t.station_id * 13 + t.m_5min * 7 + i * 3 + cell) % 11 AS DOUBLE) * 70031e-5 + 271828e-9 AS rho_post,
         CAST((t.m_5min + cell) % 5 AS DOUBLE) * 3e-1 AS queue_post,
         CASE WHEN t.rho <= 30e0 THEN 60e0 * t.rho ELSE 15e0 * (150e0 - t.rho) END * lanes * (950013e-6 + CAST((t.m_5min * 3 + cell + i) % 10 AS DOUBLE) * 100031e-7) AS flow
  FROM {truth} t JOIN {cells} c ON t.station_id = c.vds_id CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) k) z""",
    # two runs side by side, the second denser and slower
    "two_runs": """
SELECT run_id, step, cell, rho_post, queue_post, flow, speed FROM {traj}
UNION ALL SELECT 'r2' AS run_id, step, cell, rho_post * 1037129e-6 + 314159e-6 AS rho_post, queue_post, flow * 968371e-6 AS flow, flow * 968371e-6 / (rho_post * 1037129e-6 + 314159e-6) AS speed FROM {traj}""",
    "stations": """
SELECT CAST(s_suppkey AS BIGINT) AS station_id, concat('c', CAST(CAST(floor(s_suppkey / 100e0) AS BIGINT) AS STRING)) AS corridor_id, CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 1e2 AS abs_pm, CAST(5 + s_nationkey % 2 AS INT) AS route,
       CASE s_nationkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS direction,
       CASE WHEN s_suppkey % 5 < 3 THEN 'ML' WHEN s_suppkey % 10 = 3 THEN 'OR' WHEN s_suppkey % 10 = 4 THEN 'FR' END AS type,
       CASE s_suppkey % 10 WHEN 8 THEN 'Main St on ramp' WHEN 9 THEN 'to 5th Ave' ELSE s_name END AS name,
       CAST(3 + s_suppkey % 3 AS BIGINT) AS lanes, 34e0 + CAST((s_suppkey * 37) % 1000 AS DOUBLE) / 1e4 AS latitude, -118e0 + CAST((s_suppkey * 53) % 1000 AS DOUBLE) / 1e4 AS longitude,
       4e-1 + CAST(s_suppkey % 9 AS DOUBLE) * 7e-2 AS length
FROM {supplier}""",
}
_EPOCH = {"spark": "SELECT user_id, value, unix_seconds(CAST(ts AS TIMESTAMP)) AS epoch_s FROM {events}", "duckdb": "SELECT user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s FROM events"}
TABLES = ("nation", "supplier", "lineitem", "events", "part", "customer", "orders")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a driver table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _EPOCH["spark"] if name == "events_s" else VIEWS[name]
    needs = [n for n in (*TABLES, *VIEWS, "events_s") if "{" + n + "}" in text]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in needs})


def sql(query: str) -> str:
    """DuckDB SQL with the views as common table expressions before ``query``."""
    class Same(dict):
        def __missing__(self, key):
            return key

    ctes = [("events_s", _EPOCH["duckdb"]), *((n, t.format_map(Same())) for n, t in VIEWS.items())]
    head = ", ".join(f"{n} AS ({t})" for n, t in ctes)
    body = query.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def with_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.expr(f"timestamp_ntz'{START}' + make_dt_interval(0, 0, m_5min * 5, 0)"))


def sample(ts: str = "ts") -> Column:
    """The 5-minute sample of a wall-clock time."""
    return F.expr(f"timestampdiff(MINUTE, timestamp_ntz'{START}', {ts}) div 5")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n, kind in df.dtypes if kind == "double"})
