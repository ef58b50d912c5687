"""Charging load from vehicle hours: pad profiles, energy by step and position bin, and its analysis."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import METRES_PER_MILE, c, pct_attenuation
from ..sources.scratch import written
from .quantiles import exact_percentiles
from .running import running_share, running_sum

#: Neighbouring cells, or bins, whose energy one task sums.
BLOCK_CELLS = 32


@dataclass(frozen=True)
class PadSpec:
    """A pad layout in metres: pads of ``alpha`` with gaps of ``lambda_gap``, a receiver of ``delta``; powers in W."""

    alpha: float = 3.5
    lambda_gap: float = 0.5
    delta: float = 1.5
    beta: float = 150_000.0
    beta_prime: float = 150_000.0
    dx: float = 0.5

    def steps(self, metres: float) -> int:
        n = round(metres / self.dx)
        if n < 1 or abs(n * self.dx - metres) > 1e-6:
            raise ValueError(f"{metres} m is not a positive multiple of {self.dx} m")
        return n

    @property
    def grid(self) -> tuple[int, int, int]:
        return self.steps(self.alpha), self.steps(self.lambda_gap), self.steps(self.delta)


def overlap(j: Column, n: int, alpha: int, gap: int, delta: int) -> Column:
    """Pad positions under the receiver at traversal position j, in whole numbers: the count of pad positions in [0, x) is
    floor(x / tile) * alpha + min(x mod tile, alpha)."""
    on = lambda x: F.floor(x / (alpha + gap)) * alpha + F.least(x % (alpha + gap), F.lit(alpha))
    return on(F.least(j + 1, F.lit(n))) - on(F.greatest(j - delta + 1, F.lit(0)))


def power_profile(spark: SparkSession, n: int, spec: PadSpec) -> DataFrame:
    """(position, power) for n grid positions of road: n + delta - 1 traversal positions, the largest being the smaller
    of the two powers. A projection over a range: no window, no sort."""
    a, g, d = spec.grid
    rows = spark.range(n + d - 1).select(F.col("id").alias("position"), overlap(F.col("id"), n, a, g, d).alias("o"))
    return rows.select("position", (F.col("o") * (min(spec.beta, spec.beta_prime) / largest_overlap(n, a, g, d))).alias("power"))


def mainline_vht(traj: DataFrame, cells: DataFrame, dt_hours: float) -> DataFrame:
    """(cell, step, vht): vehicles on the main line times the step; queues on ramps don't count."""
    return traj.join(cells.select("cell", "length"), "cell").select("cell", "step", (F.col("rho_post") * F.col("length") * dt_hours).alias("vht"))


def cell_positions(cells: DataFrame, dx: float) -> DataFrame:
    """(cell, start, n): the cell's first grid position and how many it has, its length snapped to the grid; cells follow
    one another by number."""
    sized = cells.select("cell", F.rint(F.col("length") * METRES_PER_MILE / dx).cast("long").alias("n"))
    return running_sum(sized, ["cell"], "n", "upto").select("cell", (F.col("upto") - F.col("n")).alias("start"), "n")


def cell_ranges(cells: DataFrame, spec: PadSpec) -> DataFrame:
    """(cell, first, stop, weight): the traversal positions of every cell as a range, shifted by half the receiver, and a
    position's share of the cell; one row a cell, whatever the grid."""
    shift = (spec.grid[2] - 1) // 2
    p = cell_positions(cells, spec.dx)
    return p.select("cell", (F.col("start") + shift).alias("first"), (F.col("start") + F.col("n") + shift).alias("stop"), F.try_divide(F.lit(1.0), F.col("n")).alias("weight"))


def position_map(cells: DataFrame, spec: PadSpec) -> DataFrame:
    """(cell, position, weight): the ranges of ``cell_ranges`` expanded; the ends of the road belong to none."""
    return cell_ranges(cells, spec).where("stop > first").select("cell", F.explode(F.sequence(F.col("first"), F.col("stop") - 1)).alias("position"), "weight")


def overlap_upto(x: Column, n: int, alpha: int, gap: int, delta: int) -> Column:
    """The sum of ``overlap`` over the traversal positions below x, in closed form and whole numbers.

    An overlap is the difference of two counts of pad positions, on(j + 1) and on(j - delta + 1); the sum of on(i) over
    all i below y is a square for the whole tiles below y and a square or a line for the last one.
    """
    tile = alpha + gap

    def on(y: int) -> int:
        return y // tile * alpha + min(y % tile, alpha)

    def area(y: Column) -> Column:
        whole, rest = F.floor(y / tile).cast("long"), F.pmod(y, F.lit(tile)).cast("long")
        below = F.when(rest <= alpha, (rest * (rest - 1) / 2).cast("long")).otherwise(alpha * (alpha - 1) // 2 + alpha * (rest - alpha))
        full = alpha * (alpha - 1) // 2 + alpha * (tile - alpha)
        pairs = F.when(whole % 2 == 0, (whole / 2).cast("long") * (whole - 1)).otherwise(whole * ((whole - 1) / 2).cast("long"))
        return pairs * (tile * alpha) + whole * full + whole * alpha * rest + below

    x = F.greatest(x, F.lit(0)).cast("long")
    head = area(F.least(x, F.lit(n)) + 1) + F.greatest(x - n, F.lit(0)) * on(n)
    return head - area(F.greatest(x - delta + 1, F.lit(0)))


def largest_overlap(n: int, alpha: int, gap: int, delta: int) -> int:
    """Reached within the first tiles, or at once on a road shorter than that."""
    on = lambda y: y // (alpha + gap) * alpha + min(y % (alpha + gap), alpha)
    return max(on(min(j + 1, n)) - on(max(j - delta + 1, 0)) for j in range(min(n + delta - 1, 2 * (alpha + gap) + 2 * delta)))


def bin_weights(cells: DataFrame, spec: PadSpec, bin_metres: float, n: int) -> DataFrame:
    """(cell, bin, w): per cell and position bin the sum of power over the cell's positions, shared among them.

    A row is made for each bin that a cell reaches, and its sum is the difference of two closed forms: neither rows nor
    time depend on the width of the grid.
    """
    a, g, d = spec.grid
    bin_of = lambda p: F.floor(p * spec.dx / bin_metres)

    def begin(b: Column) -> Column:
        """The first position of a bin, by the rule that puts positions into bins."""
        guess = F.ceil(b * bin_metres / spec.dx)
        return F.when(bin_of(guess - 1) >= b, guess - 1).when(bin_of(guess) < b, guess + 1).otherwise(guess)

    r = cell_ranges(cells, spec).withColumn("stop", F.least("stop", F.lit(n + d - 1))).where("stop > first")
    x = r.withColumn("bin", F.explode(F.sequence(bin_of(F.col("first")), bin_of(F.col("stop") - 1))))
    lo, hi = F.greatest("first", begin(F.col("bin"))), F.least("stop", begin(F.col("bin") + 1))
    upto = lambda p: overlap_upto(p, n, a, g, d)
    unit = min(spec.beta, spec.beta_prime) / largest_overlap(n, a, g, d)
    return x.where(hi > lo).select("cell", "bin", ((upto(hi) - upto(lo)) * unit * F.col("weight")).alias("w"))


def charging_demand(vht: DataFrame, cells: DataFrame, spec: PadSpec, eta: float, bin_metres: float, n: int) -> DataFrame:
    """(step, bin, energy_wh): energy by step and bin, never expanded to positions.

    Energy at a position is eta * vht / n_cell * power, so a bin's is vht times a weight that the bin and cell decide:
    rows grow with steps times the cells' bins, not with steps times positions. Cells meet their weights in as many parts as
    there are blocks of cells, and what comes of it is dealt out by blocks of bins, in which it is summed: neither the join
    nor the sums of a task grow with the table.
    """
    if not 0 <= eta <= 1:
        raise ValueError("eta must lie between 0 and 1")
    parts = cells.count() // BLOCK_CELLS + 1
    w = bin_weights(cells, spec, bin_metres, n).repartition(parts, "cell")
    energy = vht.repartition(parts, "cell").join(w, "cell").select("step", "bin", (F.lit(eta) * F.col("vht") * F.col("w")).alias("_e"), F.floor(F.col("bin") / BLOCK_CELLS).alias("_block"))
    return energy.repartition(parts, "_block").groupBy("_block", "step", "bin").agg(F.sum("_e").alias("energy_wh")).drop("_block")


def demand_long(vht: DataFrame, cells: DataFrame, spec: PadSpec, eta: float, n: int) -> DataFrame:
    """(step, position, energy_wh): the expanded form, for small corridors and as a check of the other."""
    x = position_map(cells, spec).join(power_profile(cells.sparkSession, n, spec), "position")
    return vht.join(x, "cell").select("step", "position", (F.lit(eta) * F.col("vht") * F.col("weight") * F.col("power")).alias("energy_wh"))


def observed_demand(obs5: DataFrame, cells: DataFrame, spec: PadSpec, eta: float, bin_metres: float, n: int) -> DataFrame:
    """Charging energy straight from detectors: a cell's density over five minutes stands for its vehicle hours."""
    own = cells.select("cell", "length", F.col("vds_id").alias("station_id"))
    vht = obs5.where("density IS NOT NULL").join(own, "station_id").select("cell", F.col("m_5min").alias("step"), (F.col("density") * F.col("length") / 12).alias("vht"))
    return charging_demand(vht, cells, spec, eta, bin_metres, n)


def energy_per_step(demand: DataFrame) -> DataFrame:
    return demand.groupBy("step").agg(F.sum("energy_wh").alias("energy_wh"))


def peak_power(per_step: DataFrame, dt_hours: float) -> DataFrame:
    """(total_wh, peak_w, peak_step): the first of equal peaks."""
    return per_step.agg(
        F.sum("energy_wh").alias("total_wh"), (F.max("energy_wh") / dt_hours).alias("peak_w"),
        F.min_by("step", F.struct((-F.col("energy_wh")).alias("e"), "step")).alias("peak_step"),
    )


def bin_profiles(demand: DataFrame, dt_hours: float, bin_miles: float, horizon: int) -> DataFrame:
    """MW per mile by bin: at the corridor's peak step, largest, mean over all steps, load factor, and percentiles."""
    mw = F.col("energy_wh") / dt_hours / 1e6 / bin_miles
    demand = written(demand, "demand")  # read for the peak, the profiles and the percentiles
    steps = energy_per_step(demand)
    peak = steps.agg(F.min_by("step", F.struct((-F.col("energy_wh")).alias("e"), "step")).alias("peak_step"))
    x = demand.withColumn("mw", mw).crossJoin(F.broadcast(peak))  # one row
    out = x.groupBy("bin").agg(
        F.max(F.when(F.col("step") == F.col("peak_step"), F.col("mw"))).alias("at_peak"), F.max("mw").alias("absolute_peak"),
        (F.sum("mw") / horizon).alias("average"),
    )
    shares = {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)}
    out = out.join(exact_percentiles(x, ["bin"], "mw", shares), "bin", "left")
    factor = F.when(F.col("absolute_peak") == 0, 0.0).otherwise(F.try_divide("average", "absolute_peak"))
    return out.select("bin", F.coalesce("at_peak", F.lit(0.0)).alias("at_peak"), "absolute_peak", "average", factor.alias("load_factor"), *shares)


def clamped_bin(position_m: Column | str, bin_metres: float, bins: int) -> Column:
    """Bins of equal width; positions outside go to the first or the last."""
    return F.least(F.greatest(F.floor(c(position_m) / bin_metres), F.lit(0)), F.lit(bins - 1))


def mile_segment(position_m: Column | str, length_mi: float, total_mi: float) -> Column:
    """The segment of ``length_mi`` miles; null outside [0, total)."""
    miles = c(position_m) / METRES_PER_MILE
    return F.when((miles >= 0) & (miles < total_mi), F.floor(miles / length_mi))


def rebin_sum(per_step: DataFrame, s: int) -> DataFrame:
    """(block, energy_wh, n): sums over blocks of s steps; a short last block keeps its own count."""
    return per_step.groupBy(F.floor(F.col("step") / s).alias("block")).agg(F.sum("energy_wh").alias("energy_wh"), F.count("*").alias("n"))


def window_power(blocks: DataFrame, dt_hours: float) -> DataFrame:
    return blocks.withColumn("power_w", F.col("energy_wh") / (F.col("n") * dt_hours))


def load_duration_curve(power: DataFrame, n: int = 512, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, power_w) of rows (keys, power_w, weight): the power at (i + 0.5) / n of the weight, largest first."""
    x = running_share(power.select(*keys, "power_w", "weight"), list(keys), [F.desc("power_w")], "weight")
    banded = x.withColumn("hi", F.col("upto") / F.col("total")).withColumn("lo", (F.col("upto") - F.col("weight")) / F.col("total"))
    # a point x belongs to the first band whose right edge is x or more
    first = F.floor(F.col("lo") * n - 0.5) + 1
    last = F.least(F.floor(F.col("hi") * n - 0.5), F.lit(n - 1))
    return banded.where(last >= first).select(*keys, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("i"), "power_w")


def ldc_divergence(a: DataFrame, b: DataFrame, mean_w: float | Column) -> DataFrame:
    """Mean absolute difference of two curves on one grid, over the mean power; 0 if that is 0."""
    d = a.select("i", F.col("power_w").alias("x")).join(b.select("i", F.col("power_w").alias("y")), "i").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("d"))
    m = c(mean_w) if isinstance(mean_w, Column) else F.lit(float(mean_w))
    return d.select(F.when(m == 0, 0.0).otherwise(F.try_divide(F.col("d"), m)).alias("divergence"))


def load_duration_table(power: DataFrame, dt_hours: float) -> DataFrame:
    """(rank, hours, power_w): all steps, largest first."""
    ranked = running_sum(power.select("step", "power_w", F.lit(1).cast("long").alias("one")), [F.desc("power_w"), "step"], "one", "rank")
    return ranked.select("rank", (F.col("rank") * dt_hours).alias("hours"), "step", "power_w")


def bin_centers(blocks: DataFrame, dt_hours: float) -> DataFrame:
    """(block, center_h): the middle of each block, in hours from the start."""
    return running_sum(blocks.select("block", "n"), ["block"], "n", "upto").select("block", ((2 * F.col("upto") - F.col("n")) / 2 * dt_hours).alias("center_h"))


def window_lattice(sizes: list[int]) -> dict[int, int]:
    """From each window, in steps, to the largest other one that divides it, which it is summed from; those that no other
    divides come from single steps (0)."""
    return {s: max((o for o in sizes if o < s and s % o == 0), default=0) for s in sorted(set(sizes))}


def aggregation_windows(per_step: DataFrame, dt_s: float, windows_s: list[float]) -> DataFrame:
    """(window_s, block, energy_wh, n, power_w) for every window at once; windows below one step are left out.

    A window is a whole number of steps, halves to even; the native step comes as a window of its own, and each other
    window is summed from its largest divisor, so that steps are read once and no step is copied.
    """
    steps = {w: max(1, round(w / dt_s)) for w in sorted({dt_s, *(w for w in windows_s if w > dt_s)})}
    made = {0: written(per_step.groupBy(F.col("step").alias("block")).agg(F.sum("energy_wh").alias("energy_wh"), F.count("*").alias("n")), "steps")}
    lattice = window_lattice(list(steps.values()))
    for s, of in lattice.items():
        level = made[of].groupBy(F.floor(F.col("block") / (s // max(of, 1))).alias("block")).agg(F.sum("energy_wh").alias("energy_wh"), F.sum("n").alias("n"))
        made[s] = written(level, "windows") if s > 1 and s in lattice.values() else made[0] if s == 1 else level
    parts = [made[s].select(F.lit(float(w)).alias("window_s"), "block", "energy_wh", "n") for w, s in steps.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("power_w", F.col("energy_wh") / (F.col("n") * dt_s / 3600))


def temporal_aggregation_summary(per_step: DataFrame, dt_s: float, windows_s: list[float], grid: int = 512) -> DataFrame:
    """(window_s, peak_w, attenuation_pct, peak_time_h, peak_shift_h, divergence, energy_wh, energy_error): from
    (window, block) rows that are made once; the divergence is that of the load-duration curve from the native one's."""
    x = written(aggregation_windows(per_step, dt_s, windows_s), "windows")
    timed = running_share(x, ["window_s"], ["block"], "n").withColumn("center_h", (2 * F.col("upto") - F.col("n")) / 2 * (dt_s / 3600))
    best = timed.groupBy("window_s").agg(
        F.max("power_w").alias("peak_w"), F.min_by("center_h", F.struct((-F.col("power_w")).alias("p"), "block")).alias("peak_time_h"),
        F.sum("energy_wh").alias("energy_wh"), F.sum("n").alias("n"),
    )
    best = written(best, "peaks")
    native = best.where(F.col("window_s") == dt_s).select(F.col("peak_w").alias("p0"), F.col("peak_time_h").alias("t0"), F.col("energy_wh").alias("e0"), (F.col("energy_wh") / (F.col("n") * dt_s / 3600)).alias("m0"))
    curve = written(load_duration_curve(x.select("window_s", "power_w", F.col("n").alias("weight")), grid, ("window_s",)), "curves")
    ref = curve.where(F.col("window_s") == dt_s).select("i", F.col("power_w").alias("ref"))
    gap = curve.join(ref, "i").groupBy("window_s").agg(F.avg(F.abs(F.col("power_w") - F.col("ref"))).alias("gap"))
    return best.join(gap, "window_s").crossJoin(F.broadcast(native)).select(  # one row
        "window_s", "peak_w", pct_attenuation("p0", "peak_w").alias("attenuation_pct"), "peak_time_h", (F.col("peak_time_h") - F.col("t0")).alias("peak_shift_h"),
        F.when(F.col("m0") == 0, 0.0).otherwise(F.try_divide("gap", "m0")).alias("divergence"), "energy_wh", F.try_divide(F.col("energy_wh") - F.col("e0"), F.col("e0")).alias("energy_error"),
    )


def segment_peak_attenuation(demand: DataFrame, dt_s: float, windows_s: list[float], bin_metres: float, lengths_mi: list[float], total_mi: float) -> DataFrame:
    """(length_mi, window_s, segment, attenuation_pct): the segment whose peak a window flattens most, the first of equals."""
    lengths = [x for x in lengths_mi if x <= total_mi]
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("length_mi")) for x in lengths]))
    miles = (F.col("bin") + 0.5) * bin_metres / METRES_PER_MILE
    seg = demand.withColumn("l", each).where(miles < total_mi).select("step", "energy_wh", F.col("l.length_mi").alias("length_mi"), F.floor(miles / F.col("l.length_mi")).alias("segment"))
    per = seg.groupBy("length_mi", "segment", "step").agg(F.sum("energy_wh").alias("energy_wh"))
    steps = {float(w): max(1, round(w / dt_s)) for w in [dt_s, *windows_s] if w >= dt_s}
    wins = F.explode(F.array(*[F.struct(F.lit(w).alias("window_s"), F.lit(n).alias("s")) for w, n in steps.items()]))
    blocks = per.withColumn("w", wins).groupBy("length_mi", "segment", "w.window_s", F.floor(F.col("step") / F.col("w.s")).alias("block")).agg((F.sum("energy_wh") / F.count("*")).alias("p"))
    peaks = blocks.groupBy("length_mi", "segment", "window_s").agg(F.max("p").alias("peak"))
    native = peaks.where(F.col("window_s") == float(dt_s)).select("length_mi", "segment", F.col("peak").alias("p0"))
    a = peaks.join(native, ["length_mi", "segment"]).withColumn("a", pct_attenuation("p0", "peak"))
    return a.groupBy("length_mi", "window_s").agg(F.min_by("segment", F.struct((-F.col("a")).alias("x"), "segment")).alias("segment"), F.max("a").alias("attenuation_pct"))
