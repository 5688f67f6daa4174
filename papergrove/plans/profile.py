"""From profiler databases to their five reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrove.functions import hardware as H
from papergrove.functions.names import copy_kind, kernel_name, run_label
from papergrove.operators import trace as T
from papergrove.sources import profiler
from papergrove.sources.sqlite import sqlite_table

#: The tables and columns that reports are made of.
KERNEL = ("CUPTI_ACTIVITY_KIND_KERNEL", ["demangledName", "start", "end", "registersPerThread", "blockX", "gridX", "staticSharedMemory", "dynamicSharedMemory", "localMemoryPerThread"])
COPY = ("CUPTI_ACTIVITY_KIND_MEMCPY", ["copyKind", "bytes", "start", "end"])
SYNC = ("CUPTI_ACTIVITY_KIND_SYNCHRONIZATION", ["syncType", "start", "end"])
RANGE = ("NVTX_EVENTS", ["textId", "text", "start", "end"])
OVERHEAD = ("PROFILER_OVERHEAD", ["start", "end"])
CALL = ("CUPTI_ACTIVITY_KIND_RUNTIME", ["nameId", "start", "end"])
SESSION = ("ANALYSIS_DETAILS", ["duration"])
CAPTURE = ("META_DATA_CAPTURE", ["name", "value"])
#: A session's share that counts as active, in the summary's utilisation (fixed value).
ACTIVE = 0.8


def _strings(spark: SparkSession, path: str) -> DataFrame:
    found = sqlite_table(spark, path, "StringIds", ["id", "value"])
    return found if found is not None else spark.createDataFrame([], "id long, value string")


def kernels(spark: SparkSession, path: str, hw: H.Hardware) -> DataFrame:
    """A row a kernel, the longest first (place): launches, times, means of what a launch asks for, occupancy, share."""
    table = sqlite_table(spark, path, *KERNEL)
    d = F.col("end") - F.col("start")
    by = table.groupBy("demangledName").agg(
        F.count("*").alias("Launches"), F.sum(d).alias("ns"), F.avg(d).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"),
        *[F.coalesce(F.avg(c), F.lit(0)).cast("long").alias(n) for c, n in (("registersPerThread", "Regs"), ("blockX", "Block"), ("gridX", "Grid"), ("staticSharedMemory", "Shmem_static_B"), ("dynamicSharedMemory", "Shmem_dyn_B"), ("localMemoryPerThread", "Lmem_B"))],
    )
    named = by.join(_strings(spark, path), F.col("demangledName") == F.col("id"), "left").withColumn("raw", F.coalesce("value", F.col("demangledName").cast("string")))
    shared = F.col("Shmem_static_B") + F.col("Shmem_dyn_B")
    ms = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.lit(1e6)
    order = T.rank_by(F.desc("ns"), F.col("demangledName"))  # a row a kernel
    return named.select(
        order.alias("place"), kernel_name(F.col("raw")).alias("Kernel"), "raw", "Launches", "ns", ms("ns").alias("Total_ms"), ms("mean").alias("Avg_ms"), ms("least").alias("Min_ms"), ms("most").alias("Max_ms"),
        "Block", "Grid", "Regs", "Shmem_static_B", "Shmem_dyn_B", "Lmem_B", H.occupancy(F.col("Regs"), F.col("Block"), shared, hw).alias("ThOcc_pct"), H.limiter_by_threshold(F.col("Regs"), F.col("Block"), shared).alias("Limiter"),
        F.coalesce(F.bround(T.share("ns"), 2), F.lit(0.0)).alias("pct_GPU"),
    )


def copies(spark: SparkSession, path: str) -> DataFrame:
    """A row a kind of copies, that of the most bytes first (place)."""
    table = sqlite_table(spark, path, *COPY)
    if table is None:
        return spark.createDataFrame([], "place int, Kind string, Ops long, bytes long, ns long, Bytes_MB double, Time_ms double, AvgSize_KB double, MaxSize_KB double, BW_GBs double")
    s = T.copy_summary(table.select(F.col("copyKind").alias("kind"), "bytes", (F.col("end") - F.col("start")).alias("dur")))
    of = lambda c, unit: F.coalesce(F.col(c), F.lit(0)) / F.lit(unit)
    return s.select(T.rank_by(F.desc("bytes"), F.col("kind")).alias("place"), copy_kind(F.col("kind")).alias("Kind"), F.col("ops").alias("Ops"), "bytes", F.col("total").alias("ns"), of("bytes", 1e6).alias("Bytes_MB"), of("total", 1e6).alias("Time_ms"), of("mean", 1e3).alias("AvgSize_KB"), of("largest", 1e3).alias("MaxSize_KB"), F.col("bandwidth").alias("BW_GBs"))


def _total(spark: SparkSession, path: str, table: tuple[str, list[str]], name: str) -> DataFrame:
    """One row: the time of a table's rows in ns, 0 where the database has none."""
    found = sqlite_table(spark, path, *table)
    if found is None:
        return spark.range(1).select(F.lit(0).cast("long").alias(name))
    return found.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(name))


def ranges(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """The n longest ranges by name."""
    found = sqlite_table(spark, path, *RANGE)
    if found is None:
        return spark.createDataFrame([], "name string, n long, total_ns long, avg_ns double")
    return T.named_ranges(found.select(F.col("textId").alias("text_id"), "text", "start", "end"), _strings(spark, path), n)


def calls(spark: SparkSession, path: str) -> DataFrame:
    """API calls by name, the longest first."""
    found = sqlite_table(spark, path, *CALL)
    if found is None:
        return spark.createDataFrame([], "name_id long, calls long, total_ns long, avg_ns double, name string")
    return T.api_summary(found.select(F.col("nameId").alias("name_id"), "start", "end"), _strings(spark, path))


def capture(spark: SparkSession, path: str) -> DataFrame:
    """One row: the command line that was captured, and the host."""
    found = sqlite_table(spark, path, *CAPTURE)
    found = found if found is not None else spark.createDataFrame([], "name string, value string")
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    number = F.regexp_extract("name", r"^PROCESS_0:ARGUMENT_(\d+)$", 1)
    arguments = F.sort_array(F.collect_list(F.when(number != "", F.struct(number.try_cast("int").alias("i"), F.col("value").alias("v")))))  # a row an argument
    return found.agg(F.concat_ws(" ", F.coalesce(value("PROCESS_0:COMMAND"), F.lit("")), F.array_join(F.transform(arguments, lambda a: a["v"]), " ")).alias("command"), F.coalesce(value("DEVICE_DISPLAY_NAME"), F.lit("unknown")).alias("host"))


def session(spark: SparkSession, path: str, preset: H.Hardware) -> dict[str, DataFrame]:
    """The frames of a database's five reports."""
    hw = profiler.hardware(spark, path, preset)
    k, c = kernels(spark, path, hw), copies(spark, path)
    one = sqlite_table(spark, path, *SESSION).limit(1).select(F.col("duration").cast("double").alias("session"))
    k_sum = k.agg(F.coalesce(F.sum("ns"), F.lit(0)).cast("double").alias("kernel"), F.coalesce(F.sum("Launches"), F.lit(0)).alias("Kernel_launches"))
    c_sum = c.agg(F.coalesce(F.sum("ns"), F.lit(0)).cast("double").alias("copy"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("double").alias("bytes"))
    both = one.crossJoin(k_sum).crossJoin(c_sum).crossJoin(_total(spark, path, SYNC, "sync")).crossJoin(_total(spark, path, OVERHEAD, "overhead"))  # a row each
    wall = F.when(F.col("session") == 0, F.lit(1.0)).otherwise(F.coalesce("session", F.lit(1.0)))
    none = F.lit(0.0)
    rate = F.coalesce(F.try_divide(F.col("bytes"), F.col("copy")), none)
    over = F.bround(F.coalesce(F.try_divide(F.col("copy"), F.col("kernel")), none) * 100, 2)
    ms = lambda n: F.col(n) / F.lit(1e6)
    summary = both.select(
        ms("session").alias("Session_ms"), ms("kernel").alias("Kernel_ms"), ms("copy").alias("Memcpy_ms"), F.bround(F.col("kernel") / (F.lit(ACTIVE) * wall) * 100, 2).alias("GPU_util_pct"), over.alias("Memcpy_ovh_pct"),
        (F.col("bytes") / 1e6).alias("Total_MB"), F.bround(rate, 3).alias("EffBW_GBs"), F.bround(rate / F.lit(hw.bandwidth) * 100, 4).alias("BW_pct"), "Kernel_launches", ms("sync").alias("Sync_ms"), ms("overhead").alias("Profiler_ovh_ms"),
    )
    used = both.select(F.bround(F.when(F.col("kernel") > 0, F.col("kernel")).otherwise(F.lit(1.0)) / wall * 100, 2).alias("GPU_util_pct"), over.alias("Memcpy_ovh_pct"))
    return {"summary": summary, "kernels": k, "memcpy": c, "occupancy": k, "gpu_util": used}


def label_of(spark: SparkSession, path: str) -> str:
    """The run's label by its file's name."""
    return spark.range(1).select(run_label(F.lit(path))).first()[0]


def reports(spark: SparkSession, runs: dict[str, str], preset: H.Hardware) -> dict[str, dict[str, DataFrame]]:
    """The frames of all runs (label to database) by report."""
    found = {label: session(spark, path, preset) for label, path in runs.items()}
    return {kind: {label: frames[kind] for label, frames in found.items()} for kind in profiler.REPORTS}


def write(spark: SparkSession, runs: dict[str, str], folder: str, prefix: str, preset: H.Hardware) -> list[str]:
    """The five reports of all runs as CSV files."""
    return profiler.write_reports(folder, prefix, reports(spark, runs, preset))
