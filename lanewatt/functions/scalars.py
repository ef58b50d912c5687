"""Scalar expressions of the detector, corridor and charging operators. All native; null in, null out, unless said."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grid of detector samples, unit conversions and the earth's radius.
SAMPLE_MINUTES = 5
SAMPLES_PER_HOUR = 12
METRES_PER_MILE = 1609.344
EARTH_RADIUS_M = 6_371_009.0
JUST_BELOW_ONE = 0.9999999999999999


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def standardize(df: DataFrame) -> DataFrame:
    """Per-lane flow (veh/h) and density from 5-minute counts, mean speed and lanes; the raw columns go."""
    flow = F.try_divide(F.col("total_flow_5min") * SAMPLES_PER_HOUR, F.col("lanes"))
    return df.withColumn("flow", flow).withColumn("density", F.try_divide("flow", "avg_speed_mph")).drop("total_flow_5min", "avg_speed_mph")


def total_flow_density(df: DataFrame) -> DataFrame:
    """Whole-road flow and density; density is missing where the speed is zero."""
    flow = F.col("total_flow_5min") * SAMPLES_PER_HOUR
    return df.withColumn("flow", flow).withColumn("density", F.try_divide(F.col("flow"), F.col("avg_speed_mph")))


def min_observed(df: DataFrame, threshold: float = 100.0) -> DataFrame:
    return df.where(F.col("pct_observed") >= threshold)


def time_window(df: DataFrame, start, end, column: str = "ts") -> DataFrame:
    """Rows in [start, end); plain comparisons, so that they reach the scan."""
    return df.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def slot_of_week(ts: Column | str, minutes: int = SAMPLE_MINUTES) -> Column:
    """The block of the week, Monday 00:00 being 0: weekday and time of day in one integer."""
    per_day = 1440 // minutes
    return F.weekday(c(ts)) * per_day + F.floor((F.hour(c(ts)) * 60 + F.minute(c(ts))) / minutes).cast("int")


def route_number(ref: Column | str, join_digits: bool = False) -> Column:
    """The first run of digits of a route's name, or all digits joined; null if it has none."""
    digits = F.regexp_replace(c(ref), r"\D", "") if join_digits else F.regexp_extract(c(ref), r"\d+", 0)
    return F.when(digits != "", digits)


def parse_ramp_ids(ids: Column | str) -> Column:
    """Station ids out of a list in a string, brackets or not, parted by commas, semicolons or spaces.

    Blanks and ``nan`` go, ``900.0`` becomes ``900``; virtual ids (``v...``) stay as they are. Null is an empty list.
    """
    bare = F.regexp_replace(F.coalesce(c(ids).cast("string"), F.lit("")), r"[\[\]()'\"]", "")
    parts = F.filter(F.split(bare, r"[,;\s]+"), lambda x: (x != "") & (F.lower(x) != "nan"))
    return F.transform(parts, lambda x: F.coalesce(x.try_cast("double").cast("long").cast("string"), x))


def numeric_ids(ids: Column | str) -> Column:
    return F.filter(F.transform(c(ids), lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def classify_ramp_flow(kind: Column | str, name: Column | str) -> Column:
    """on, off or review: by the station type, else by whole words of the name."""
    text = F.coalesce(c(name), F.lit(""))
    return (
        F.when(c(kind) == "OR", "on").when(c(kind) == "FR", "off")
        .when(text.rlike(r"(?i)\b(off|to)\b"), "off").when(text.rlike(r"(?i)\b(on|from)\b"), "on").otherwise("review")
    )


def parse_tags(tag: Column | str) -> Column:
    """A map tag as an array: values parted by semicolons, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c(tag), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def parse_lanes(tag: Column | str) -> Column:
    """Lanes from a tag: the number before the first ``;``; 0 if there is none."""
    return F.coalesce(F.trim(F.element_at(F.split(c(tag), ";"), 1)).try_cast("int"), F.lit(0))


def lanes_of_list(tags: Column | str) -> Column:
    """Lanes from an array of tags: the commonest of their numbers, the smallest of equals; 0 if there is none."""
    nums = F.filter(F.transform(F.coalesce(c(tags), F.array().cast("array<string>")), lambda x: F.trim(F.element_at(F.split(x, ";"), 1)).try_cast("int")), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(nums), lambda x: F.struct((-F.size(F.filter(nums, lambda y: y == x))).alias("n"), x.alias("v")))
    return F.coalesce(F.array_min(counted)["v"], F.lit(0))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(c(lat1)), F.radians(c(lat2))
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(c(lon2)) - F.radians(c(lon1))) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.sqrt(half), F.lit(1.0)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    a, b, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2)) - F.radians(c(lon1))
    angle = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.pmod(F.degrees(angle) + 360, F.lit(360.0))


def bearing_close(b: Column | str, target: float | str, tolerance: float = 60.0) -> Column:
    """Whether two bearings differ by at most ``tolerance`` the short way round; a compass letter stands for its angle."""
    angle = {"N": 0.0, "E": 90.0, "S": 180.0, "W": 270.0}.get(target, target) if isinstance(target, str) else target
    diff = F.pmod(c(b) - F.lit(float(angle)), F.lit(360.0))
    return F.least(diff, F.lit(360.0) - diff) <= tolerance


def length_warning(length: Column | str, shortest: float = 0.2, longest: float = 1.0) -> Column:
    if shortest > longest:
        raise ValueError("the shortest length is over the longest")
    return F.when(c(length) < shortest, "too_short").when(c(length) > longest, "too_long").otherwise("ok")


def geh(m: Column | str, o: Column | str) -> Column:
    """The GEH statistic: sqrt(2 (m - o)^2 / (m + o)); 0 where both are zero."""
    total = c(m) + c(o)
    return F.when(total == 0, 0.0).otherwise(F.sqrt(F.try_divide(2 * (c(m) - c(o)) * (c(m) - c(o)), total)))


def pct_diff(sim: Column | str, obs: Column | str) -> Column:
    return F.try_divide(100 * (c(sim) - c(obs)), c(obs))


def pct_attenuation(base: Column | str, other: Column | str) -> Column:
    return F.when(c(base) == 0, 0.0).otherwise(F.try_divide(100 * (c(base) - c(other)), c(base)))


def clip_split_ratio(beta: Column | str) -> Column:
    """Into [0, the largest double below 1]."""
    return F.least(F.greatest(c(beta), F.lit(0.0)), F.lit(JUST_BELOW_ONE))


def split_ratio_report(df: DataFrame, beta: str = "beta") -> DataFrame:
    """How many ratios lie below 0 or at 1 and above, and by how much on average."""
    low, high = F.col(beta) < 0, F.col(beta) > JUST_BELOW_ONE
    return df.agg(
        F.count_if(low).alias("n_below"), F.avg(F.when(low, -F.col(beta))).alias("mean_below"),
        F.count_if(high).alias("n_above"), F.avg(F.when(high, F.col(beta) - 1)).alias("mean_above"),
    )


def snap_to_grid(miles: Column | str, dx: float) -> Column:
    """Miles to metres on a grid of ``dx``, halves to the even step."""
    return F.rint(c(miles) * METRES_PER_MILE / dx) * dx


def window_label(seconds: Column | str) -> Column:
    """Seconds below a minute as ``45s``, else minutes, with a fraction where there is one: ``15min``, ``1.5min``."""
    s = c(seconds)
    plain = lambda x: F.regexp_replace(x.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    return F.when(s < 60, F.concat(plain(s), F.lit("s"))).otherwise(F.concat(plain(s / 60), F.lit("min")))


def off_grid(ts: Column | str, dt_s: Column | float) -> Column:
    """Whether a time is off the grid that a step of ``dt_s`` goes by: five minutes for a step up to that, else an hour."""
    grid = F.when(F.lit(dt_s) <= 300, 300).otherwise(3600)
    return F.unix_seconds(c(ts).cast("timestamp")) % grid != 0


def window_problem(start: Column | str, end: Column | str, dt_s: Column | str) -> Column:
    """Why a window and a step don't fit a grid, null if they do: the table form of ``require_grid_aligned``."""
    dt = c(dt_s)
    grid = F.when(dt <= 300, 300.0).otherwise(3600.0)
    n = F.rint(grid / dt)
    return (
        F.when((dt <= 0) | (dt > 3600), "dt_out_of_range").when(F.abs(n * dt - grid) > 1e-9 * grid, "dt_does_not_divide").when(c(end) <= c(start), "empty_window")
        .when(off_grid(start, dt) | off_grid(end, dt), "off_grid")
    )


def resolved_start(given: Column | str, kept: Column | str) -> Column:
    """The stored start, else the given one: the table form of ``resolve_start``; null where ``start_problem`` tells why."""
    return F.when(start_problem(given, kept).isNull(), F.coalesce(c(kept), c(given)))


def start_problem(given: Column | str, kept: Column | str) -> Column:
    return F.when(c(given) != c(kept), "not_the_stored_one").when(c(given).isNull() & c(kept).isNull(), "none")


# Checks of scalar arguments, on the driver.


def exact_divisor(whole_seconds: int, dt: float) -> int:
    """How many steps of ``dt`` make up the span; an error if they don't fit."""
    n = round(whole_seconds / dt)
    if dt <= 0 or n < 1 or abs(n * dt - whole_seconds) > 1e-9 * whole_seconds:
        raise ValueError(f"{dt} s does not divide {whole_seconds} s")
    return n


def require_grid_aligned(start: datetime, end: datetime, dt: float) -> int:
    """The grid (300 s or 3600 s) that a window and a step of ``dt`` go by; an error if the window is off it."""
    if not 0 < dt <= 3600:
        raise ValueError("dt must be over 0 and at most an hour")
    grid = 300 if dt <= 300 else 3600
    exact_divisor(grid, dt)
    if end <= start:
        raise ValueError("the window is empty")
    for t in (start, end):
        if (t - datetime(1970, 1, 1)).total_seconds() % grid:
            raise ValueError(f"{t} is not on the grid of {grid} s")
    return grid


def choose_dt(freeway: DataFrame, explicit: float | None = None) -> float:
    """The largest 300 / n seconds strictly below the least time a cell takes to cross; or ``explicit``, checked."""
    bound = freeway.agg(F.min(F.col("length") / F.col("v_f")).alias("b")).first()["b"] * 3600
    if explicit is not None:
        exact_divisor(300, explicit)
        if explicit >= bound:
            raise ValueError(f"{explicit} s is not below the bound of {bound} s")
        return explicit
    n = int(300 // bound) + 1
    while 300 / n >= bound:
        n += 1
    return 300 / n


def resolve_start(given: datetime | None, kept: datetime | None) -> datetime:
    if kept is not None and given is not None and kept != given:
        raise ValueError("the given start is not the stored one")
    if kept is None and given is None:
        raise ValueError("no start is stored or given")
    return kept if kept is not None else given
