"""Analytics over metrics in long form, and reports of epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papergrove.functions.names import LABELS, kernel_name_by_part
from papergrove.functions.scalar import by_magnitude


def pivot_mean(m: DataFrame, metrics: list[str], by: tuple[str, ...] = ("kernel",)) -> DataFrame:
    """A row a group, a column a known metric: its mean."""
    return m.where(F.col("metric").isin(metrics)).groupBy(*by).pivot("metric", metrics).agg(F.avg("value"))


def metric_table(m: DataFrame, category: str) -> DataFrame:
    """(source, years, agents, kernel) and a category's metrics by their labels, as text; m is of metric files.

    Means by kernel's short name. Both kinds of predicated instructions give their sum (a missing one counts as 0).
    Columns that no row has are left out; the largest amount of a column tells the form of its numbers.
    """
    by = ("source", "years", "agents", "kernel")
    known = [n for columns in LABELS.values() for n, _ in columns if n != "insts"]
    wide = pivot_mean(m.withColumn("kernel", kernel_name_by_part(F.col("kernel"))), known, by)
    wide = wide.withColumn("insts", F.coalesce("fp32_insts", F.lit(0.0)) + F.coalesce("fp64_insts", F.lit(0.0)))
    seen = wide.agg(*[F.count(n).alias(n) for n in known]).first().asDict()  # one row
    seen["insts"] = min(seen["fp32_insts"], seen["fp64_insts"])
    every = Window.partitionBy()  # a row a kernel and file
    cells = [by_magnitude(F.col(n), F.max(F.abs(F.col(n))).over(every)).alias(label) for n, label in LABELS[category] if seen[n]]
    return wide.select(*by, *cells).orderBy("years", "agents", "kernel")


def pivot_sum(df: DataFrame, by: str, kind: str, value: str, kinds: list, order: str) -> DataFrame:
    """A row a group, a column a kind: its sum, or 0; place is the group's in the order in which groups are first seen."""
    first = df.groupBy(by).agg(F.min(order).alias("_first"))
    placed = first.select(F.col(by).alias("_by"), F.row_number().over(Window.orderBy("_first", by)).alias("place"))  # a row a group
    wide = df.groupBy(by).pivot(kind, kinds).agg(F.sum(value)).fillna(0)
    return wide.join(placed, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").orderBy("place")


def weighted_mean(value: str, weight: str) -> Column:
    """Mean by weight over rows with a value; the plain mean where any of their weights is 0 or missing."""
    w = F.when(F.col(value).isNotNull(), F.coalesce(F.col(weight), F.lit(0)))
    weighted = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(w))
    return F.when(F.min(F.abs(w)) > 0, weighted).otherwise(F.avg(value))


def divergence(launches: DataFrame) -> DataFrame:
    """By kernel: launches, threads active and predicated on (and their share of a warp), uniform branches, divergence.

    Launches have active, pred_on, uniform, targets, divergent, and duration as the weight. Divergence is what uniform
    branches leave of 100; where these are not known, divergent ones of all targets.
    """
    by = launches.withColumn("_w", F.coalesce("duration", F.lit(0.0))).groupBy("kernel")
    targets, divergent = (F.sum(F.coalesce(c, F.lit(0))) for c in ("targets", "divergent"))
    d = by.agg(F.count("*").alias("launches"), weighted_mean("active", "_w").alias("a"), weighted_mean("pred_on", "_w").alias("p"), weighted_mean("uniform", "_w").alias("u"), F.when(targets != 0, divergent / targets * 100).alias("r"))
    return d.select(
        "kernel", "launches", F.bround("a", 2).alias("active_threads_per_warp"), F.bround(F.col("a") / 32 * 100, 1).alias("thread_util_pct"),
        F.bround("p", 2).alias("pred_on_threads_per_warp"), F.bround(F.col("p") / 32 * 100, 1).alias("pred_util_pct"), F.bround("u", 1).alias("branch_uniform_pct"),
        F.bround(F.coalesce(100 - F.col("u"), F.col("r")), 1).alias("divergence_pct"), F.bround("r", 1).alias("divergence_pct_recomputed"),
    )


def scenario_names(*frames: DataFrame) -> DataFrame:
    """(kernel) of all scenarios, each once, in order."""
    out = frames[0].select("kernel")
    for f in frames[1:]:
        out = out.union(f.select("kernel"))
    return out.distinct().orderBy("kernel")


def utilisation(spark: SparkSession, samples: DataFrame | None, names: DataFrame | None, known: list[str], kernels: DataFrame | None) -> DataFrame:
    """One row (percent, approximate): the mean of the first sampled metric of known names; else the share of busy time.

    samples: (metric_id, value); names: (metric_id, name); kernels: (start, end). Tables may be missing (None).
    """
    sampled, busy = F.lit(None).cast("double"), F.lit(None).cast("double")
    one = spark.range(1)
    if samples is not None and names is not None:
        ids = names.where(F.col("name").isin(known)).orderBy("metric_id").limit(1).select("metric_id")
        one = one.crossJoin(samples.join(F.broadcast(ids), "metric_id").agg(F.avg("value").alias("_sampled")))  # a row each
        sampled = F.col("_sampled")
    if kernels is not None:
        wall = F.max("end") - F.min("start")
        one = one.crossJoin(kernels.agg(F.when(wall > 0, F.sum(F.col("end") - F.col("start")) / wall * 100).alias("_busy")))
        busy = F.col("_busy")
    return one.select(F.coalesce(sampled, busy).alias("percent"), sampled.isNull().alias("approximate"))


def baseline_delta(m: DataFrame, base: str) -> DataFrame:
    """(kernel, scenario, mean, delta) against the kernel's mean in the base scenario."""
    means = m.groupBy("kernel", "scenario").agg(F.avg("value").alias("mean"))
    at_base = F.first(F.when(F.col("scenario") == base, F.col("mean")), ignorenulls=True).over(Window.partitionBy("kernel"))
    return means.withColumn("delta", F.col("mean") - at_base)


#: Limits under (or over) which a launch is flagged.
LIMITS = {"low_occupancy": 25, "low_bandwidth": 10, "few_waves": 1, "many_registers": 64, "low_l2": 50}


def health_flags(occupancy: Column, bandwidth: Column, waves: Column, registers: Column, l2: Column) -> dict[str, Column]:
    return {"low_occupancy": occupancy < LIMITS["low_occupancy"], "low_bandwidth": bandwidth < LIMITS["low_bandwidth"], "few_waves": waves < LIMITS["few_waves"], "many_registers": registers > LIMITS["many_registers"], "low_l2": l2 < LIMITS["low_l2"]}


def running_stats(value: str) -> list[Column]:
    """Total, mean, least, largest and deviation (0 for fewer than two)."""
    return [F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"), F.when(F.count(value) < 2, F.lit(0.0)).otherwise(F.stddev_pop(value)).alias("std")]


def distribution(df: DataFrame, phase: str, seconds: str) -> DataFrame:
    """Seconds and percent of the whole by phase."""
    s = df.groupBy(phase).agg(F.sum(seconds).alias("seconds"))
    return s.withColumn("percent", F.try_divide(100 * F.col("seconds"), F.sum("seconds").over(Window.partitionBy())))


def breakdown(total: Column, *parts: Column) -> Column:
    """What the parts leave of the total, at least 0."""
    rest = total
    for p in parts:
        rest = rest - p
    return F.greatest(rest, F.lit(0.0))


def epoch_report(spark: SparkSession, years: list[tuple[str, float]], phases: list[tuple[str, str, float, int]]) -> list[str]:
    """Lines about a run's years (label, seconds) and their phases (label, phase, seconds, rows).

    Statistics of the years; each year's share and what its phases leave of it; each phase's statistics and share; and
    the edges of all years with their rate, as the phase that wrote them counted them.
    """
    rows, parts = spark.createDataFrame(years, "label string, seconds double"), spark.createDataFrame(phases, "label string, phase string, seconds double, rows long")
    s = rows.agg(*running_stats("seconds")).first()
    lines = [f"years: total={s['total']:.1f} s mean={s['mean']:.1f} std={s['std']:.1f} min={s['least']:.1f} max={s['largest']:.1f}"]
    inside = parts.groupBy("label").agg(F.sum("seconds").alias("inside"), F.sum(F.when(F.col("phase") == "edges", F.col("rows"))).alias("edges"))
    by_year = distribution(rows, "label", "seconds").join(inside, "label", "left").select("label", "seconds", "percent", breakdown(F.col("seconds"), F.coalesce("inside", F.lit(0.0))).alias("residual"), F.coalesce("edges", F.lit(0)).alias("edges")).orderBy("label")
    for r in by_year.collect():  # a row a year
        lines.append(f"{r['label']}: {r['seconds']:.1f} s ({r['percent'] or 0:.1f} %), {r['residual']:.1f} s residual, {r['edges']} edges")
    by_phase = parts.groupBy("phase").agg(*running_stats("seconds"), F.sum("rows").alias("rows")).withColumn("percent", F.lit(100.0) * F.try_divide(F.col("total"), F.lit(s["total"] or 0.0)))
    for r in by_phase.orderBy(F.desc("total"), "phase").collect():  # a row a phase
        lines.append(f"phase {r['phase']}: {r['total']:.1f} s ({r['percent'] or 0:.1f} %) mean={r['mean']:.2f} std={r['std']:.2f} min={r['least']:.2f} max={r['largest']:.2f}, {r['rows']} rows")
    edges = sum(n for _, phase, _, n in phases if phase == "edges")
    return [*lines, f"{edges} new edges, {edges / s['total'] if s['total'] else 0:.0f} a second"]
