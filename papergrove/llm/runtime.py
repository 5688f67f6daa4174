"""What all operators here share: the shared folder, written stages, code shipping and bounded Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python, and bytes where Spark knows that setting.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Rows of a side that is broadcast, at most (rows of a few numbers), and bytes of one with wider rows.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: the executors of a cluster need a folder they share")
        else:
            base = Path(tempfile.mkdtemp(prefix="papergrove-")).as_uri()
            spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    return base if "://" in base or base.startswith("file:") else Path(base).absolute().as_uri()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared folder; made by whoever writes there first."""
    return f"{shared_dir(spark)}/papergrove/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as a table of the shared folder and read again: cuts lineage and survives lost executors."""
    path = work_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that stage() wrote, which nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        if "/papergrove/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def prepare(spark: SparkSession) -> SparkSession:
    """Ships this package to the executors once per application and bounds the Arrow batches of the session."""
    sc = spark.sparkContext
    if not getattr(sc, "_papergrove_shipped", False):
        root = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="papergrove-code-")) / "papergrove.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
        sc._papergrove_shipped = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    with contextlib.suppress(Exception):  # not known to older versions
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def file_system(uri: str):
    """The file system of a URI and the path in it; runs on executors too."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def has(df: DataFrame, *names: str) -> DataFrame:
    """df cut to the named columns, so that further columns of any name cannot clash."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[n] for n in names])


def small_or_not(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast where its counted rows are within the bound; otherwise left to a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_in_bytes(df: DataFrame, width: Column) -> DataFrame:
    """df marked for broadcast where its rows and their bytes (by `width`), both counted, are within the bounds."""
    rows, size = df.agg(F.count("*"), F.sum(width.cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver's cleaner delete the shuffle files that no plan refers to any more.

    Spark ties them to objects of the driver, whose collector may not run for long; for use after a written step.
    """
    spark.sparkContext._jvm.System.gc()
