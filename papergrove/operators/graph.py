"""Graph operators on nodes (id, year) and edges (src, dst)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


#: Settings of the session that tables of any size need, where it has none of its own. A written table counts as many times
#: its files: ids in order and columns of one value take a few bits a row, so that by its bytes alone Spark would broadcast
#: one of millions of rows. Shuffles begin with many partitions, which Spark joins again up to a size, so that a task's
#: memory follows that size and not the table.
SETTINGS = {"spark.sql.sources.fileCompressionFactor": "32.0", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
#: Rows of a side that is broadcast, at most (rows of a few numbers), and bytes of one with wider rows.
SMALL, SMALL_BYTES = 200_000, 64 << 20


def settle(spark: SparkSession) -> None:
    """Makes the SETTINGS that the session does not have."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast where its counted rows are within the bound."""
    return F.broadcast(df) if rows <= SMALL else df


def small_in_bytes(df: DataFrame, width: Column) -> DataFrame:
    """df marked for broadcast where its rows and their bytes (by `width`), both counted, are within the bounds."""
    rows, size = df.agg(F.count("*"), F.sum(width.cast("long"))).first()
    return F.broadcast(df) if rows <= SMALL and (size or 0) <= SMALL_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset on one machine, the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: the executors of a cluster need a folder they share")
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one."""
    if "/papergrove/" in folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, which nothing reads any more."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            delete(t.sparkSession, folder)


def cut(df: DataFrame, name: str, held: list[DataFrame] | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage of an iteration.

    The table is added to `held`, which the caller drops when nothing reads it any more.
    """
    spark = df.sparkSession
    settle(spark)
    path = f"{shared_dir(spark)}/papergrove/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if held is not None:
        held.append(table)
    return table


class Phases:
    """What a run's written steps took: (label, phase, seconds, rows), rows counted by the jobs that write them."""

    def __init__(self) -> None:
        self.label = ""
        self.rows: list[tuple[str, str, float, int]] = []

    def cut(self, df: DataFrame, name: str, held: list[DataFrame] | None = None, phase: str | None = None) -> DataFrame:
        """cut(), timed and counted as a phase of the current label."""
        seen, began = Observation(), time.monotonic()
        table = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name, held)
        self.rows.append((self.label, phase or name, time.monotonic() - began, seen.get["n"]))
        return table

    def last(self) -> int:
        """The rows of the step that was written last."""
        return self.rows[-1][3]

    def timed(self, phase: str, work: Callable[[], None], rows: int = 0) -> None:
        began = time.monotonic()
        work()
        self.rows.append((self.label, phase, time.monotonic() - began, rows))


def dense_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """(orig_id, seq_id): dense numbers from 0 in ascending order of the id.

    Ranges of ids are numbered each and based on a prefix sum of their sizes, so no single task orders them all.
    """
    part = ids.select(F.col(column).alias("orig_id")).distinct().repartitionByRange("orig_id").withColumn("p", F.spark_partition_id())
    part = cut(part, "ids")
    sizes = sorted((r["p"], r["count"]) for r in part.groupBy("p").count().collect())
    rows, total = [], 0
    for p, n in sizes:
        rows.append((p, total))
        total += n
    bases = ids.sparkSession.createDataFrame(rows, "p int, base long")
    order = F.row_number().over(Window.partitionBy("p").orderBy("orig_id"))
    return part.join(F.broadcast(bases), "p").select("orig_id", (F.col("base") + order - 1).alias("seq_id"))


def encode_edges(edges: DataFrame, idmap: DataFrame) -> DataFrame:
    """Edges in dense ids; an edge with an unknown end is dropped, repeated edges merge."""
    s, d = idmap.toDF("src", "s"), idmap.toDF("dst", "d")
    return edges.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v): edges and their reverses, what is cited in both directions twice; needs no shuffle."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src"))


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v): edges and their reverses."""
    return both_ways(edges).distinct()


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new).dropDuplicates(["src", "dst"])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree), zero where a node has none: one aggregate over both ends."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    ends = ends.union(nodes.select("id", F.lit(0), F.lit(0)))
    found = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return found.join(nodes.select("id"), "id", "left_semi")


def refresh_degrees(known: DataFrame, new: DataFrame) -> DataFrame:
    """Degrees after new edges, from the old degrees and the new edges alone."""
    more = new.select(F.col("dst").alias("id"), F.lit(1).cast("long").alias("in_degree"), F.lit(0).cast("long").alias("out_degree")).union(new.select("src", F.lit(0).cast("long"), F.lit(1).cast("long")))
    return known.select("id", "in_degree", "out_degree").union(more).groupBy("id").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))


def adjacency(und: DataFrame) -> DataFrame:
    """(u, neighbours) in ascending order."""
    return und.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("neighbours"))


def csr_offsets(deg: DataFrame, block: int = 4096) -> DataFrame:
    """(id, offset, degree): out-degrees before a node in the order of ids.

    Sums go by blocks of ids and by blocks of blocks: one task orders a row for every block ** 2 ids, all others a block.
    """
    def upto(c: str):
        return Window.partitionBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    of = lambda c: F.floor(F.col(c) / block).cast("long")
    rows = deg.select("id", F.col("out_degree").cast("long").alias("degree"), of("id").alias("b"))
    sums = rows.groupBy("b").agg(F.sum("degree").alias("t")).withColumn("bb", of("b"))
    tops = sums.groupBy("bb").agg(F.sum("t").alias("tt"))
    tops = tops.select("bb", (F.sum("tt").over(Window.orderBy("bb")) - F.col("tt")).alias("top"))  # a row for block ** 2 ids
    base = sums.join(tops, "bb").select("b", (F.col("top") + F.sum("t").over(upto("bb").orderBy("b")) - F.col("t")).alias("base"))
    return rows.join(base, "b").select("id", (F.col("base") + F.sum("degree").over(upto("b").orderBy("id")) - F.col("degree")).alias("offset"), "degree")


def hops(starts: DataFrame, und: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """(g, n, hop) with hop 1 or 2: nodes at that distance from each start, whatever the direction.

    Starts are expanded once each; the least distance per pair does away with what was visited before. und may hold
    an edge more than once. Starts and first hops are broadcast where their counts allow it, so that the edges are not
    shuffled; beyond that they are joined, and a hub's edges are split by the skewed join.
    """
    starts = cut(starts.select("g").distinct(), "starts", held)
    first = cut(small(starts, starts.count()).join(und, F.col("g") == und["u"]).where("v <> g").select("g", F.col("v").alias("n")).distinct(), "first", held)
    second = small(first, first.count()).join(und, F.col("n") == und["u"]).where("v <> g").select("g", F.col("v").alias("n"), F.lit(2).alias("hop"))
    return first.select("g", "n", F.lit(1).alias("hop")).union(second).groupBy("g", "n").agg(F.min("hop").alias("hop"))


def degree_stats(deg: DataFrame) -> DataFrame:
    """One row: least, largest, mean and population deviation of both degrees."""
    out = []
    for c in ("in_degree", "out_degree"):
        out += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"avg_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return deg.agg(*out)


def components(spark: SparkSession, nodes: DataFrame, und: DataFrame) -> DataFrame:
    """(id, component): least id of the component, by contraction to the least neighbour until no edge is left.

    und may hold an edge in one direction or both, and more than once. Edges are kept once, from the lesser end (a) to the
    greater (b): a node that goes to a lesser neighbour is one that is a greater end. The nodes are read once, at the end,
    when the rounds' steps, which get fewer from round to round, have been joined to one from the last to the first.
    """
    edges = cut(und.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), "edges")
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        step = cut(edges.groupBy("b").agg(F.min("a").alias("to")), "step").toDF("from", "to")
        s1, s2 = step.toDF("f1", "t1"), step.toDF("f2", "t2")
        moved = edges.join(s1, edges["b"] == s1["f1"]).join(s2, F.col("a") == s2["f2"], "left").select(F.coalesce("t2", "a").alias("a"), F.col("t1").alias("b"))
        was = edges
        edges = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        steps.append(step)
        drop(was)
    drop(edges)
    found = None  # (from, to): where the rounds from one on have taken a node
    for step in reversed(steps):
        if found is None:
            found = step
            continue
        later = found.toDF("f", "t")
        rest = found.join(step.select("from"), "from", "left_anti")  # a node that others went to may have gone on itself
        whole = cut(step.join(later, step["to"] == later["f"], "left").select("from", F.coalesce("t", "to").alias("to")).union(rest), "joined")
        drop(step, found)
        found = whole
    if found is None:
        return cut(nodes.select("id", F.col("id").alias("component")), "roots")
    roots = cut(nodes.select("id").join(found, F.col("id") == found["from"], "left").select("id", F.coalesce("to", "id").alias("component")), "roots")
    drop(found)
    return roots


def giant_component(comp: DataFrame) -> DataFrame:
    """Size and share of the largest component, and the number of components."""
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(F.max("size").alias("giant_size"), F.count("*").alias("components"), (F.max("size") / F.sum("size")).alias("giant_share"))


def statistics(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole report as (metric, value)."""
    deg = degrees(nodes, edges)
    both = F.col("in_degree") + F.col("out_degree")
    flat = deg.agg(
        F.count("*").cast("double").alias("nodes"), F.sum("out_degree").cast("double").alias("edges"),
        *[f(c).cast("double").alias(f"{n}_{c}") for c in ("in_degree", "out_degree") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_pop))],
        F.try_divide(F.sum("out_degree").cast("double"), F.count("*").cast("double") * (F.count("*") - 1)).alias("density"), F.count_if(both == 0).cast("double").alias("isolated"),
        (1 + F.count_if(both > 0) / F.sum(F.when(both > 0, F.ln(both)))).alias("powerlaw_alpha"),
    )
    giant = giant_component(components(spark, nodes, edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))).select(F.col("giant_size").cast("double").alias("giant_size"), "giant_share")
    wide = flat.crossJoin(giant)  # one row each
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, wide.columns)), F.array(*wide.columns))).alias("metric", "value")).select("metric", F.round("value", 9).alias("value"))
