"""Statistics of a growing graph, kept over years: refreshed by a year's nodes and edges, never counted anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrove.operators import graph as G


class KeptStatistics:
    """The state that all statistics follow from, and what a year changes of it.

    degrees: (id, in_degree, out_degree); histogram: how many nodes have each pair of degrees, of which sums, extremes,
    deviations and logarithms are made; roots: (id, component); sizes: (component, size). A year's edges move the nodes
    they touch from one place of the histogram to another, and link components: only these links are contracted.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame):
        self.spark = spark
        self.degrees = G.cut(G.degrees(nodes, edges), "kept-degrees")
        self.histogram = G.cut(self.degrees.groupBy("in_degree", "out_degree").agg(F.count("*").alias("nodes")), "kept-histogram")
        self.roots = G.components(spark, nodes, edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        self.sizes = G.cut(self.roots.groupBy("component").agg(F.count("*").alias("size")), "kept-sizes")

    def add(self, born: DataFrame, edges: DataFrame) -> None:
        """Takes a year's new nodes (id) and edges (src, dst) in. The edges are new ones, each given once."""
        held: list[DataFrame] = []
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        more = edges.select(F.col("dst").alias("id"), one.alias("i"), zero.alias("o")).unionByName(edges.select(F.col("src").alias("id"), zero.alias("i"), one.alias("o")))
        more = more.unionByName(born.select("id", zero.alias("i"), zero.alias("o"))).groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        touched = G.cut(more.join(self.degrees, "id", "left"), "touched", held)  # what they had is null for new nodes
        now = touched.select("id", (F.coalesce("in_degree", zero) + F.col("i")).alias("in_degree"), (F.coalesce("out_degree", zero) + F.col("o")).alias("out_degree"))
        moved = now.select("in_degree", "out_degree", one.alias("nodes")).unionByName(touched.where("in_degree IS NOT NULL").select("in_degree", "out_degree", (-one).alias("nodes")))
        histogram = self.histogram.unionByName(moved).groupBy("in_degree", "out_degree").agg(F.sum("nodes").alias("nodes")).where("nodes > 0")
        degrees = self.degrees.join(touched.select("id"), "id", "left_anti").select("id", "in_degree", "out_degree").unionByName(now)

        fresh = born.select("id", F.col("id").alias("component")).distinct()
        roots = self.roots.unionByName(fresh)
        s, d = roots.toDF("src", "a"), roots.toDF("dst", "b")
        links = G.cut(edges.join(s, "src").join(d, "dst").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links", held)
        ends = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
        merged = G.components(self.spark, ends, links).where("id <> component").toDF("was", "to")
        name = F.coalesce("to", "component").alias("component")
        roots = roots.join(merged, roots["component"] == merged["was"], "left").select("id", name)
        sizes = self.sizes.unionByName(fresh.select("component", one.alias("size")))
        sizes = sizes.join(merged, sizes["component"] == merged["was"], "left").groupBy(name).agg(F.sum("size").alias("size"))

        before = self.degrees, self.histogram, self.roots, self.sizes
        self.degrees, self.histogram = G.cut(degrees, "kept-degrees"), G.cut(histogram, "kept-histogram")
        self.roots, self.sizes = G.cut(roots, "kept-roots"), G.cut(sizes, "kept-sizes")
        G.drop(*before, *held, merged)

    def report(self) -> DataFrame:
        """(metric, value), as the statistics of the whole graph."""
        n, both = F.col("nodes").cast("double"), (F.col("in_degree") + F.col("out_degree")).cast("double")
        total = F.sum("nodes").cast("double")
        edges = F.sum(F.col("out_degree") * n)
        columns = [total.alias("nodes"), edges.alias("edges")]
        for c in ("in_degree", "out_degree"):
            mean = F.sum(F.col(c) * n) / total
            spread = F.sqrt(F.greatest(F.sum(F.col(c).cast("double") * F.col(c) * n) / total - mean * mean, F.lit(0.0)))
            columns += [F.min(c).cast("double").alias(f"min_{c}"), F.max(c).cast("double").alias(f"max_{c}"), mean.alias(f"avg_{c}"), spread.alias(f"std_{c}")]
        columns += [F.try_divide(edges, total * (total - 1)).alias("density"), F.coalesce(F.sum(F.when(both == 0, n)), F.lit(0.0)).alias("isolated"), (1 + F.sum(F.when(both > 0, n)) / F.sum(F.when(both > 0, n * F.ln(both)))).alias("powerlaw_alpha")]
        giant = self.sizes.agg(F.max("size").cast("double").alias("giant_size"), (F.max("size") / F.sum("size")).alias("giant_share"))
        wide = self.histogram.agg(*columns).crossJoin(giant)  # one row each
        return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, wide.columns)), F.array(*wide.columns))).alias("metric", "value")).select("metric", F.round("value", 9).alias("value"))

    def drop(self) -> None:
        G.drop(self.degrees, self.histogram, self.roots, self.sizes)
