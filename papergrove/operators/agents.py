"""A year's cohort: generators, out-degrees, weights, same-year citers, fitness, planted nodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papergrove.config import SimConfig
from papergrove.functions.rand import h32, pick, uniform
from papergrove.operators.graph import small

WEIGHTS = ("pa_weight", "rec_weight", "fit_weight")


def drawn_weights(seed: int, ident: Column) -> dict[str, Column]:
    """Three draws over their sum."""
    u = {w: uniform(seed, ident, w) for w in WEIGHTS}
    total = u["pa_weight"] + u["rec_weight"] + u["fit_weight"]
    return {w: x / total for w, x in u.items()}


def given_weights(cfg: SimConfig) -> tuple[float, float, float]:
    """The three weights of a configuration over their sum."""
    total = cfg.preferential_weight + cfg.recency_weight + cfg.fitness_weight
    return cfg.preferential_weight / total, cfg.recency_weight / total, cfg.fitness_weight / total


def cohort(spark: SparkSession, first: int, size: int, cfg: SimConfig, bag: DataFrame, bag_size: int) -> DataFrame:
    """(growth_idx, id, generator, same_year, out_degree, weights, alpha) of the nodes first .. first + size - 1."""
    ident = F.col("id")
    a = spark.range(size).select(F.col("id").alias("growth_idx"), (F.col("id") + first).alias("id"))
    a = a.withColumn("generator", pick(cfg.seed, ident, first, "generator")).withColumn("pos", pick(cfg.seed, ident, bag_size, "outdegree"))
    a = a.join(small(bag, bag_size), "pos").drop("pos")
    weights = dict(zip(WEIGHTS, map(F.lit, given_weights(cfg)))) if cfg.fixed_weights() else drawn_weights(cfg.seed, ident)
    a = a.withColumns(weights).withColumn("alpha", uniform(cfg.seed, ident, "alpha") if cfg.alpha < 0 else F.lit(float(cfg.alpha)))
    chosen = same_year(spark, first, size, cfg).withColumn("same_year", F.lit(True))
    return a.join(chosen, "id", "left").withColumn("same_year", F.coalesce("same_year", F.lit(False)))


def same_year(spark: SparkSession, first: int, size: int, cfg: SimConfig) -> DataFrame:
    """(id) of the floor(size * share) nodes that also cite their own year: the least by hash.

    Counts by cell of the hash tell the cell in which the last of them is; only that cell's nodes are ordered.
    """
    due = math.floor(size * cfg.same_year_proportion)
    cell = F.shiftright("h", 20)
    ids = spark.range(first, first + size).withColumn("h", h32(cfg.seed, F.col("id"), "sameyear"))
    ahead, last = 0, None
    for r in ids.groupBy(cell.alias("c")).count().orderBy("c").collect():  # 4096 cells
        if ahead + r["count"] > due:
            last = r["c"]
            break
        ahead += r["count"]
    if last is None:
        return ids.select("id")
    rest = ids.where(cell == last).orderBy("h", "id").limit(due - ahead)
    return ids.where(cell < last).select("id").unionByName(rest.select("id"))


def fitness_cdf(spark: SparkSession, most: int, exponent: float) -> DataFrame:
    """(k, lo, hi): the share of peak values below k and up to k, for weights k ** -exponent."""
    w = [k**-exponent for k in range(1, most + 1)]
    total, at, rows = sum(w), 0.0, []
    for k, x in enumerate(w, 1):
        rows.append((k, at / total, 1.0 if k == most else (at + x) / total))
        at += x
    return spark.createDataFrame(rows, "k int, lo double, hi double")


def draw_fitness(spark: SparkSession, df: DataFrame, cfg: SimConfig, cells: int = 1024) -> DataFrame:
    """df with fitness_peak: the k whose (lo, hi] holds a draw. Joined by a cell of the unit interval, then by range."""
    cdf = fitness_cdf(spark, cfg.fitness_max, cfg.fitness_exponent)
    last = F.lit(cells - 1)
    cdf = cdf.select("*", F.explode(F.sequence(F.least(F.floor(F.col("lo") * cells), last), F.least(F.floor(F.col("hi") * cells), last))).alias("cell"))
    u = uniform(cfg.seed, F.col("id"), "fitness")
    drawn = df.withColumn("_u", u).withColumn("_cell", F.least(F.floor(F.col("_u") * cells), last))
    found = drawn.join(F.broadcast(cdf), (F.col("_cell") == F.col("cell")) & (F.col("_u") > F.col("lo")) & (F.col("_u") <= F.col("hi")))  # at most 2 * cells + fitness_max rows
    return found.withColumnRenamed("k", "fitness_peak").drop("_u", "_cell", "cell", "lo", "hi")


def planted_ranges(plan: DataFrame) -> DataFrame:
    """The plan with each line's range [lo, hi) of growth indices in its year."""
    w = Window.partitionBy("year").orderBy("line_no")
    return plan.withColumn("hi", F.sum("count").over(w)).withColumn("lo", F.col("hi") - F.col("count"))


def range_join(points: DataFrame, intervals: DataFrame, at: str, lo: str, hi: str) -> DataFrame:
    """points with the intervals [lo, hi) that hold their whole number `at`, each pair once.

    An interval is put in bins as wide as the power of two that is no less than its length, of which it touches two at
    most; a point looks for it in one bin of each width there is, 64 at most. So wide intervals are not split into many
    rows, and both sides meet by an equality, whatever their number.
    """
    length = F.col(hi) - F.col(lo)
    level = F.when(length <= 1, F.lit(0)).otherwise(F.length(F.bin(length - 1)))
    binned = intervals.where(f"`{lo}` < `{hi}`").withColumn("_level", level)
    levels = [r[0] for r in binned.select("_level").distinct().collect()]  # a row a width
    bins = lambda c: F.expr(f"shiftright({c}, _level)")
    binned = binned.withColumn("_bin", F.explode(F.array_distinct(F.array(bins(f"CAST(`{lo}` AS BIGINT)"), bins(f"CAST(`{hi}` AS BIGINT) - 1")))))
    found = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_b", F.expr(f"shiftright(CAST(`{at}` AS BIGINT), _l)"))
    small_bins = small(binned, binned.count())
    return found.join(small_bins, (F.col("_l") == F.col("_level")) & (F.col("_b") == F.col("_bin"))).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_l", "_b", "_level", "_bin")


def plant(agents: DataFrame, plan: DataFrame, cycle: int, size: int) -> DataFrame:
    """(id, line_no, lag, peak, dur) of the nodes a plan's line sets in a cycle (from 1)."""
    lines = planted_ranges(plan.where(F.col("year") == cycle))
    need = lines.agg(F.max("hi")).first()[0]
    if need is not None and need > size:
        raise ValueError(f"the plan of cycle {cycle} sets {need} nodes of {size}")
    return range_join(agents, lines, "growth_idx", "lo", "hi").select("id", "line_no", "lag", "peak", "dur")
