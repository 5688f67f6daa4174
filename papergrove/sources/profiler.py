"""Profiler databases: their device table and views, and the files of their five reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrove.functions.hardware import Hardware, from_device_row
from papergrove.functions.scalar import fixed
from papergrove.sources.sqlite import sqlite_table, table_exists, table_names
from papergrove.sources.text import write_csv

__all__ = ["hardware", "register_all", "report_frame", "sqlite_table", "table_exists", "write_reports"]

def hardware(spark: SparkSession, path: str, preset: Hardware) -> Hardware:
    """The preset with the limits that the database's device table has; of several devices the last counts."""
    table = sqlite_table(spark, path, "TARGET_INFO_GPU")
    for row in table.collect() if table is not None else []:  # a row a device
        preset = from_device_row(row.asDict(), preset)
    return preset


def register_all(spark: SparkSession, path: str) -> list[str]:
    """Every table of a database as a temporary view."""
    names = table_names(spark, path)
    for n in names:
        sqlite_table(spark, path, n).createOrReplaceTempView(n)
    return names


#: The columns of the five reports, in order.
REPORTS = {
    "summary": ["Label", "Session_ms", "Kernel_ms", "Memcpy_ms", "GPU_util_pct", "Memcpy_ovh_pct", "Total_MB", "EffBW_GBs", "BW_pct", "Kernel_launches", "Sync_ms", "Profiler_ovh_ms"],
    "kernels": ["Label", "Kernel", "Launches", "Total_ms", "Avg_ms", "Min_ms", "Max_ms", "Block", "Grid", "Regs", "Shmem_static_B", "Shmem_dyn_B", "Lmem_B", "ThOcc_pct", "Limiter", "pct_GPU"],
    "memcpy": ["Label", "Kind", "Ops", "Bytes_MB", "Time_ms", "AvgSize_KB", "MaxSize_KB", "BW_GBs"],
    "occupancy": ["Label", "Kernel", "Launches", "Total_ms", "Avg_ms", "Block", "Grid", "Regs", "Shmem_static_B", "Shmem_dyn_B", "Lmem_B", "ThOcc_pct", "Limiter", "pct_GPU"],
    "gpu_util": ["Label", "GPU_util_pct", "Memcpy_ovh_pct"],
}
#: Digits after the point in the reports.
DIGITS = {
    "Session_ms": 3, "Kernel_ms": 3, "Memcpy_ms": 3, "Sync_ms": 3, "Profiler_ovh_ms": 3, "Total_MB": 3, "EffBW_GBs": 4, "BW_pct": 5, "Total_ms": 4, "Avg_ms": 5, "Min_ms": 5, "Max_ms": 5,
    "Bytes_MB": 4, "Time_ms": 4, "AvgSize_KB": 2, "MaxSize_KB": 2, "BW_GBs": 4, "ThOcc_pct": 1, "pct_GPU": 2, "GPU_util_pct": 2, "Memcpy_ovh_pct": 2,
}


def report_frame(kind: str, runs: dict[str, DataFrame]) -> DataFrame:
    """The rows of all runs (by label) in the columns of a report, numbers with their digits.

    The runs' rows stay in their order, that of the column `place` where they have it.
    """
    out = None
    for k, (label, df) in enumerate(runs.items()):
        cells = [fixed(F.col(c), DIGITS[c]).alias(c) if c in DIGITS else F.col(c) for c in REPORTS[kind][1:]]
        place = F.col("place") if "place" in df.columns else F.lit(0)
        rows = df.select(F.lit(k).alias("_run"), place.alias("_place"), F.lit(label).alias("Label"), *cells)
        out = rows if out is None else out.unionByName(rows)
    return out


def write_reports(folder: str, prefix: str, reports: dict[str, dict[str, DataFrame]]) -> list[str]:
    """A CSV file for each report given, named by the prefix and its kind."""
    out = []
    for kind, runs in reports.items():
        out.append(f"{folder.rstrip('/')}/{prefix}_{kind}.csv")
        write_csv(report_frame(kind, runs).orderBy("_run", "_place").drop("_run", "_place"), out[-1], REPORTS[kind])
    return out
