"""Fixture frames derived from the star-schema tables: a citation graph, parameter tables, a profiler trace."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papergrove.operators.graph import cut, dense_ids, settle, shared_dir
from papergrove.sources.sqlite import write_parts

_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nodes: (id, year)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order cites the previous one with the same part: (src, dst). Written once an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        _WRITTEN[key] = cut(_edges(spark, sf_dir), "fixture")
    return _WRITTEN[key]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "o_orderdate").distinct()
    before = F.lag("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("o_orderdate", "l_orderkey"))
    return rows.select(F.col("l_orderkey").alias("src"), before.alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degrees to draw from: (pos, out_degree). Written once an application."""
    key = spark.sparkContext.applicationId, f"{sf_dir}:bag"
    if key not in _WRITTEN:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("orig_id"), (5 + F.col("p_size") % 16).cast("int").alias("out_degree"))
        _WRITTEN[key] = cut(dense_ids(part, "orig_id").join(part, "orig_id").select(F.col("seq_id").cast("long").alias("pos"), "out_degree"), "bag")
    return _WRITTEN[key]


def recency(nodes: DataFrame, year: int) -> DataFrame:
    """(age, prob) for the ages present, but 3."""
    return nodes.select((F.lit(year) - F.col("year")).alias("age")).distinct().where("age <> 3").select("age", (F.lit(1.0) / (F.col("age") + 1).cast("double")).alias("prob"))


def planted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, 0, 900, 5, 3), (1, 2, 2, 500, 3, 2), (2, 3, 0, 1000, 1, 4)], "year int, line_no int, lag int, peak int, dur int, count int")


def planted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of a line for each supplier, over three years."""
    k = F.col("s_suppkey")
    number = F.row_number().over(Window.partitionBy(k % 3).orderBy(k)).cast("int")
    return table(spark, sf_dir, "supplier").select((1 + k % 3).cast("int").alias("year"), number.alias("line_no"), (k % 4).cast("int").alias("lag"), (1 + k * 37 % 1000).cast("int").alias("peak"), (1 + k % 6).cast("int").alias("dur"), (1 + k % 3 + k % 2).cast("int").alias("count"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, value): a kernel's signature for each event type."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select(F.row_number().over(Window.orderBy("event_type")).alias("id"), F.concat(F.lit("void ns::"), "event_type", F.lit("<int>(int*)")).alias("value"))


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A launch for each event."""
    e = table(spark, sf_dir, "events")
    names = strings(spark, sf_dir).select("id", F.regexp_extract("value", "ns::(.*)<int>", 1).alias("kind"))
    start = (F.col("event_id") * 1000).cast("long")
    return e.join(F.broadcast(names), F.col("event_type") == F.col("kind")).select(
        F.col("event_id").cast("long").alias("event_id"), F.col("id").alias("name_id"), start.alias("start"), (start + F.floor(F.abs("value") * 100).cast("long")).alias("end"),
        (16 + F.col("event_id") % 100).cast("int").alias("regs"), F.element_at(F.array(*map(F.lit, (64, 128, 256, 512))), (F.col("event_id") % 4 + 1).cast("int")).alias("block"),
        (1 + F.col("user_id")).cast("long").alias("grid"), F.when(F.col("event_id") % 5 == 0, 4096).otherwise(0).alias("shmem"),
    )


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy for each line item: (kind, bytes, dur)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("kind"), F.floor("l_extendedprice").cast("long").alias("bytes"), F.floor("l_quantity").cast("long").alias("dur"), F.col("l_returnflag").alias("run"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("pos"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in long form: (kernel, scenario, metric, value, weight); two groups have a weight that is missing or 0."""
    few = F.col("l_orderkey") % 50
    weight = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 3) & (few == 0), F.lit(None).cast("double")).when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 4) & (few == 1), 0.0).otherwise(F.col("l_extendedprice").cast("double"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kernel"), F.col("l_linestatus").alias("scenario"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("metric"), F.col("l_quantity").cast("double").alias("value"), weight.alias("weight"))


#: Signatures of launches, some of which the name rules know.
SIGNATURES = [
    "void kernelCallStage1_warped<int>(int*)", "kernelCallStage2(int)", "void ABMKernelStage4<4>(int)", "GetOneAndTwoHopNeighborhood_Warp(a)", "void cuco::static_map::insert_if<int>(x)",
    "cub::DeviceRadixSortKernel<1>(k)", "void ns::plain_kernel<int>(int*)", "a_plain_name_of_more_than_thirty_letters", "thrust::cuda_cub::copy<a>(b)", "void cub::detail::for_each::static_kernel<initialize_functor>()",
]


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A launch for each event with all axes and memories; some have no registers or no threads."""
    i = F.col("event_id")
    at = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    start = (i * 1000).cast("long")
    return table(spark, sf_dir, "events").select(
        i.cast("long").alias("event_id"), at(SIGNATURES, i).alias("name"), start.alias("start"), (start + F.floor(F.abs("value") * 100).cast("long")).alias("end"), (i % 100).cast("int").alias("regs"),
        at([64, 65, 128, 256, 512, 0, 1024, 33], F.floor(i / 10)).alias("block_x"), (1 + i % 2).cast("int").alias("block_y"), F.lit(1).alias("block_z"),
        (1 + F.col("user_id") % 50).cast("int").alias("grid_x"), (1 + i % 3).cast("int").alias("grid_y"), F.lit(1).alias("grid_z"),
        F.when(i % 5 == 0, 4096).otherwise(0).alias("shared_static"), F.when(i % 7 == 0, 1000).otherwise(0).alias("shared_dynamic"), F.when(i % 4 > 0, (16 * (i % 4)).cast("int")).alias("local"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An API call for each event: (name_id, start, end); some ids have no name."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select((1 + i % 9).cast("int").alias("name_id"), (i * 50).cast("long").alias("start"), (i * 50 + i % 37).cast("long").alias("end"))


def divergent_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launches with what is counted of their branches: kernels lack some of it, or have launches without time."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    kernel = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        kernel.alias("kernel"), F.when(n != 7, q % 33).alias("active"), F.when(kernel != "AF", q % 32).alias("pred_on"), F.when(kernel != "NO", 50 + q).alias("uniform"),
        (q + n).alias("targets"), F.when(n > 1, F.floor(q / 3).cast("double")).alias("divergent"), F.when((kernel == "RF") & (n == 2), F.lit(None).cast("double")).when((kernel == "NF") & (n == 2), 0.0).otherwise(F.col("l_extendedprice").cast("double")).alias("duration"),
    )


def trace_tables(spark: SparkSession, sf_dir: str) -> dict[str, tuple[str, DataFrame]]:
    """Declared columns and rows of a profiler database's tables: launches, copies, ranges, waits, calls and the device."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a row a type
    known = F.create_map(*[x for k, s in enumerate(SIGNATURES) for x in (F.lit(s), F.lit(k + 1))])
    types = F.create_map(*[x for k, t in enumerate(kinds) for x in (F.lit(t), F.lit(101 + k))])
    launch = launches(spark, sf_dir).select(known[F.col("name")].cast("long"), "start", "end", "regs", "block_x", "grid_x", "shared_static", "shared_dynamic", "local")
    copy = e.select((i % 16).cast("int"), F.floor(F.abs("value") * 1000).cast("long"), i * 100, i * 100 + u % 50)
    text_id = F.when(i % 3 == 0, types[F.col("event_type")]).when(i % 3 == 1, (900 + u % 3).cast("int"))
    ranges = e.select(text_id, F.when(i % 3 == 2, F.concat(F.lit("own"), (u % 2).cast("string"))), F.when(i % 11 > 0, i * 10), F.when(i % 9 > 0, i * 10 + u))
    return {
        "CUPTI_ACTIVITY_KIND_KERNEL": ("demangledName INTEGER, start INTEGER, end INTEGER, registersPerThread INTEGER, blockX INTEGER, gridX INTEGER, staticSharedMemory INTEGER, dynamicSharedMemory INTEGER, localMemoryPerThread INTEGER", launch),
        "CUPTI_ACTIVITY_KIND_MEMCPY": ("copyKind INTEGER, bytes INTEGER, start INTEGER, end INTEGER", copy),
        "NVTX_EVENTS": ("textId INTEGER, text TEXT, start INTEGER, end INTEGER", ranges),
        "CUPTI_ACTIVITY_KIND_SYNCHRONIZATION": ("syncType INTEGER, start INTEGER, end INTEGER", e.select((i % 4).cast("int"), i, i + i % 7)),
        "CUPTI_ACTIVITY_KIND_RUNTIME": ("nameId INTEGER, start INTEGER, end INTEGER", e.select((1 + i % 12).cast("int"), i, i + i % 37)),
        "PROFILER_OVERHEAD": ("start INTEGER, end INTEGER", e.where(i % 4 == 0).select(i, i + i % 5)),
        "ANALYSIS_DETAILS": ("duration INTEGER, startTime INTEGER, stopTime INTEGER", e.agg(F.max(i) * 2000, F.lit(0), F.lit(1))),
        "StringIds": ("id INTEGER, value TEXT", spark.createDataFrame([(k + 1, s) for k, s in enumerate(SIGNATURES)] + [(101 + k, t) for k, t in enumerate(kinds)], "id int, value string")),
        "TARGET_INFO_GPU": ("id INTEGER, memoryBandwidth INTEGER, maxWarpsPerSm INTEGER, maxShmemPerSm INTEGER, threadsPerWarp INTEGER", spark.createDataFrame([(0, 936_000_000_000, 48, 102_400, 32)], "a int, b long, c int, d int, e int")),
        "META_DATA_CAPTURE": ("name TEXT, value TEXT", spark.createDataFrame([("PROCESS_0:ARGUMENT_0", "--a"), ("PROCESS_0:COMMAND", "grow"), ("PROCESS_0:ARGUMENT_1", "b"), ("DEVICE_DISPLAY_NAME", "node7")], "a string, b string")),
    }


def trace_database(spark: SparkSession, sf_dir: str) -> str:
    """A profiler database made of the events, as one file that the driver writes: for small tables. Its path."""
    path = f"{tempfile.mkdtemp(prefix='papergrove-')}/trace-3y-6p.sqlite"  # the driver's: it is shipped from there
    with sqlite3.connect(path) as c:
        for name, (columns, rows) in trace_tables(spark, sf_dir).items():
            c.execute(f"CREATE TABLE {name} ({columns})")
            c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows.columns))})", (tuple(r) for r in rows.toLocalIterator()))
    return path


def trace_parts(spark: SparkSession, sf_dir: str) -> str:
    """The same in parts that tasks write, for tables of any size. Its path."""
    path = f"{shared_dir(spark)}/papergrove/database-{uuid.uuid4().hex}/trace-3y-6p.sqlite"
    write_parts(spark, path, trace_tables(spark, sf_dir))
    return path
