"""Edges kept for joins by node: runs of a bucketed table, to which a year's edges are appended."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrove.operators.graph import both_ways, cut, delete, drop, shared_dir, small


class EdgeStore:
    """The neighbours of all nodes, in both directions, in `buckets` buckets by node.

    What is added is dealt to the buckets once and written as a run of files sorted by node; after `most_runs` runs all
    are merged into one. Joins on a node read the buckets where they are, so that the edges of all years are never
    shuffled again: only the other side is. The edges of a hub (of more than `hub` degrees) are dealt to `cells` buckets
    by their other end, so that no task has all of them; what was written before it became one stays in its first cell.
    An edge may be held more than once.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, hub: int = 1 << 20, cells: int = 64, most_runs: int = 16):
        self.spark, self.hub, self.cells, self.most_runs = spark, hub, cells, most_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.hubs: DataFrame | None = None
        self.n_hubs = self.runs = 0
        self._begin()

    def _begin(self) -> None:
        key = uuid.uuid4().hex
        self.name, self.path = f"papergrove_edges_{key}", f"{shared_dir(self.spark)}/papergrove/store-{key}"

    def _write(self, rows: DataFrame) -> None:
        """Rows (k, u, v) as a run: a file for each bucket."""
        out = rows.repartition(self.buckets, "k").write.format("parquet").bucketBy(self.buckets, "k").sortBy("k")
        out.option("path", self.path).mode("append").saveAsTable(self.name)
        self.runs += 1

    def add(self, edges: DataFrame, degrees: DataFrame | None = None) -> None:
        """Appends edges (src, dst). degrees (id, in_degree, out_degree), with these edges in, tell the hubs."""
        if degrees is not None:
            hubs, was = degrees.where(F.col("in_degree") + F.col("out_degree") > self.hub).select(F.col("id").alias("h")), self.hubs
            self.n_hubs = hubs.count()
            self.hubs = cut(hubs, "hubs") if self.n_hubs else None  # mostly there are none to write
            if was is not None:
                drop(was)
        self._write(self._celled(both_ways(edges)))
        if self.runs > self.most_runs:
            self.merge()

    def _celled(self, rows: DataFrame) -> DataFrame:
        """(u, v) with the key of their bucket: the node, or a hash of hub and cell."""
        if not self.n_hubs:
            return rows.select(F.col("u").alias("k"), "u", "v")
        cell = F.pmod(F.xxhash64("v"), F.lit(self.cells))
        return rows.join(small(self.hubs, self.n_hubs), F.col("u") == F.col("h"), "left").select(F.when(F.col("h").isNotNull() & (cell > 0), F.xxhash64("u", cell)).otherwise(F.col("u")).alias("k"), "u", "v")

    def merge(self) -> None:
        """All runs as one."""
        rows, was, path = self.spark.table(self.name).select("u", "v"), self.name, self.path
        self._begin()
        self.runs = 0
        self._write(self._celled(rows))
        self._delete(was, path)

    def neighbours(self) -> DataFrame:
        """(u, v): all that is held."""
        return self.spark.table(self.name).select("u", "v")

    def expand(self, rows: DataFrame, on: str, count: int | None = None) -> DataFrame:
        """rows with v, once for each neighbour of the node in the column `on`.

        rows are broadcast where their counted number allows it; else they go to the buckets, and the edges stay.
        """
        node = F.col(on)
        if self.n_hubs:
            hashed = F.concat(F.array(node), F.transform(F.sequence(F.lit(1), F.lit(self.cells - 1)), lambda c: F.xxhash64(node, c.cast("long"))))
            rows = rows.join(small(self.hubs, self.n_hubs), node == F.col("h"), "left").withColumn("_k", F.explode(F.when(F.col("h").isNotNull(), hashed).otherwise(F.array(node)))).drop("h")
        else:
            rows = rows.withColumn("_k", node)
        if count is not None:
            rows = small(rows, count * (self.cells if self.n_hubs else 1))
        found = rows.join(self.spark.table(self.name), F.col("_k") == F.col("k"))
        # by exclusive or: an equality would ask for buckets by both columns
        return found.where(F.col("u").bitwiseXOR(node) == 0).drop("_k", "k", "u")

    def _delete(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, path)

    def drop(self) -> None:
        self._delete(self.name, self.path)
        if self.hubs is not None:
            drop(self.hubs)


def buckets_for(edges: int, rows: int = 4 << 20) -> int:
    """Buckets that hold about `rows` rows of edges in both directions each."""
    return max(1, math.ceil(2 * edges / rows))


def sized(spark: SparkSession, edges: int) -> int:
    """Buckets of a store that begins with so many edges: the session's shuffle partitions, or more where these would hold
    over about a million rows each, which a task sorts in memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_for(edges, 1 << 20))


def crowded(edges: DataFrame, hub: int = 1 << 20, cells: int = 1 << 16) -> DataFrame:
    """(id, in_degree, out_degree) of some nodes, all that have more than `hub` degrees among them.

    Ends are first counted by cells of their hash, `cells` rows a task at most; only the nodes of cells of more than
    `hub` ends are counted one by one, so that the edges of the others are not shuffled for it.
    """
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("o"))
    ends = ends.union(edges.select("src", F.lit(0).cast("long"), F.lit(1).cast("long"))).withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)))
    full = [r["cell"] for r in ends.groupBy("cell").count().where(F.col("count") > hub).select("cell").collect()]  # `cells` at most
    return ends.where(F.col("cell").isin(full) if full else F.lit(False)).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
