"""SQLite tables as a Python data source: ranges of rowids are partitions, read by the executors.

A database can also be a folder of parts that tasks wrote: each part is a SQLite database of some rows of one table, as
bytes of a row of that table's folder; a database without rows, in the folder `schema`, tells what tables there are.
Parts are written and read by the executors, in any file system that Spark knows; the driver sees the one without rows.
"""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from papergrove.operators.graph import shared_dir

#: Types of columns by the first word of what a table declares; others are text.
KINDS = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "BLOB": "binary"}
_SHIPPED: dict[tuple, str] = {}
#: Rows of a part of a database, at most.
PART_ROWS = 20_000


def local_path(spark: SparkSession, path: str) -> tuple[str, str]:
    """Where the driver opens a database, and the name that executors know it by (empty: the same path).

    On a cluster Spark ships the file to every executor; it may lie in any file system that Spark reads. What is
    shipped is a copy under a new name, made once for a path as long as the file there stays the same.
    """
    plain = re.sub(r"^file:/*", "/", path)
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster") and "://" not in plain:
        return plain, ""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    source = jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file:{os.path.abspath(path)}")
    status = source.getFileSystem(conf).getFileStatus(source)
    key = spark.sparkContext.applicationId, path, status.getLen(), status.getModificationTime()
    if key not in _SHIPPED:
        name = f"{uuid.uuid4().hex}.sqlite"
        copy = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/papergrove/databases/{name}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, copy.getFileSystem(conf), copy, False, conf)
        spark.sparkContext.addFile(copy.toString())
        _SHIPPED[key] = name
    return SparkFiles.get(_SHIPPED[key]), _SHIPPED[key]


def table_exists(path: str, name: str) -> bool:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return c.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (name,)).fetchone() is not None


def _columns(c: sqlite3.Connection, name: str) -> list[tuple[str, str]]:
    return [(r[1], KINDS.get((str(r[2]).upper().split("(")[0].split() or [""])[0], "string")) for r in c.execute(f'PRAGMA table_info("{name}")')]


def columns_of(path: str, name: str) -> list[tuple[str, str]]:
    """Names and types of a table's columns."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return _columns(c, name)


def _rowids(path: str, name: str) -> tuple[int, int] | None:
    """The least and the largest rowid; None for a view or a table without rowids, which is one partition."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        try:
            found = c.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
        except sqlite3.OperationalError:
            return None
        some = c.execute(f'SELECT 1 FROM "{name}" LIMIT 1').fetchone()
    return found if isinstance(found[0], int) or some is None else None


def _batches():
    """What reads a table's columns in batches; defined in a function, so that it reaches the executors by value."""

    def batches(c, table: str, where: str, kinds_of: list):
        import pyarrow as pa

        kinds = {"bigint": (pa.int64(), int), "double": (pa.float64(), float), "string": (pa.string(), str), "binary": (pa.binary(), bytes)}
        fields = [(name, *kinds[kind]) for name, kind in kinds_of]

        def cell(value, kind):
            if value is None or kind is bytes and isinstance(value, bytes):
                return value
            try:
                return kind(value.decode() if isinstance(value, bytes) else value) if kind is not bytes else str(value).encode()
            except (ValueError, UnicodeDecodeError):  # a column holds what it likes: no number is null
                return None

        names = ", ".join('"' + f[0].replace('"', '""') + '"' for f in fields)
        found = c.execute('SELECT %s FROM "%s"%s' % (names, table.replace('"', '""'), where))
        while part := found.fetchmany(4096):
            yield pa.RecordBatch.from_arrays([pa.array([cell(v, kind) for v in column], to) for column, (_, to, kind) in zip(zip(*part), fields)], [f[0] for f in fields])

    return batches


def _source() -> type[DataSource]:
    """The data source; defined in a function, so that it reaches the executors by value."""
    batches = _batches()

    class Rows(InputPartition):
        def __init__(self, low: int, high: int):
            super().__init__((low, high))

    class Reader(DataSourceReader):
        def __init__(self, options: dict, schema):
            self.options, self.schema = options, schema

        def partitions(self):
            if self.options.get("low") is None:
                return [Rows(0, -1)]
            low, high, n = int(self.options["low"]), int(self.options["high"]), int(self.options["partitions"])
            step = max(1, -(-(high - low + 1) // n))
            return [Rows(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

        def read(self, partition):
            import sqlite3

            from pyspark import SparkFiles

            path = SparkFiles.get(self.options["shipped"]) if self.options.get("shipped") else self.options["file"]
            low, high = partition.value
            where = f" WHERE rowid BETWEEN {low} AND {high}" if high >= low else ""
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                yield from batches(c, self.options["table"], where, [(f.name, f.dataType.simpleString()) for f in self.schema.fields])

    class Sqlite(DataSource):
        @classmethod
        def name(cls):
            return "papergrove_sqlite"

        def reader(self, schema):
            return Reader(dict(self.options), schema)

    return Sqlite


def write_parts(spark: SparkSession, path: str, tables: dict[str, tuple[str, DataFrame]]) -> None:
    """A database in parts, from the declared columns and the rows of its tables. Tasks write it."""

    def parts(declared: str, most: int):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import sqlite3

            import pyarrow as pa

            for b in batches:
                for k in range(0, len(b), most):
                    c = sqlite3.connect(":memory:")
                    c.execute(f"CREATE TABLE {declared}")
                    some = b.slice(k, most)
                    c.executemany(f"INSERT INTO {declared.split()[0]} VALUES ({', '.join('?' * b.num_columns)})", zip(*(column.to_pylist() for column in some.columns)))
                    c.commit()
                    image = c.serialize()
                    c.close()
                    yield pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], ["image"])

        return part

    with closing(sqlite3.connect(":memory:")) as c:
        for name, (columns, _) in tables.items():
            c.execute(f"CREATE TABLE {name} ({columns})")
        c.commit()
        empty = c.serialize()
    for name, (columns, rows) in tables.items():
        rows = rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))
        rows.mapInArrow(parts(f"{name} ({columns})", PART_ROWS), "image binary").write.parquet(f"{path}/{name}")
    spark.createDataFrame([(bytearray(empty),)], "image binary").write.parquet(f"{path}/schema")


def _in_parts(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(at, "schema"))


def _without_rows(spark: SparkSession, path: str) -> sqlite3.Connection:
    """The database without rows that tells a database in parts."""
    c = sqlite3.connect(":memory:")
    c.deserialize(bytes(spark.read.parquet(f"{path}/schema").first()["image"]))
    return c


def table_names(spark: SparkSession, path: str) -> list[str]:
    """The tables of a database, whole or in parts."""
    whole = not _in_parts(spark, path)
    with closing(sqlite3.connect(f"file:{local_path(spark, path)[0]}?mode=ro", uri=True) if whole else _without_rows(spark, path)) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]


def _chosen(name: str, known: list[tuple[str, str]], columns: list[str] | None) -> str:
    """The schema of a table's columns, or of some of them."""
    if columns is not None and (missing := set(columns) - {c for c, _ in known}):
        raise ValueError(f"{name} has no {', '.join(sorted(missing))}")
    return ", ".join(f"`{c}` {k}" for c, k in known if columns is None or c in columns)


def _table_in_parts(spark: SparkSession, path: str, name: str, columns: list[str] | None) -> DataFrame | None:
    with closing(_without_rows(spark, path)) as c:
        known = _columns(c, name)
    if not known:
        return None
    batches = _batches()
    fields = [(c, {"long": "bigint"}.get(k, k)) for c, k in known if columns is None or c in columns]

    def rows(images: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for b in images:
            for image in b.column(0):
                c = sqlite3.connect(":memory:")
                c.deserialize(image.as_py())
                yield from batches(c, name, "", fields)
                c.close()

    return spark.read.parquet(f"{path}/{name}").mapInArrow(rows, _chosen(name, known, columns))


def sqlite_table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None, partitions: int | None = None) -> DataFrame | None:
    """A table of a SQLite database, or some of its columns; None where it is missing.

    Each partition is a range of rowids that an executor reads by the primary key; only the columns asked for are read,
    and no row goes through the driver. A view is one partition. Of a database in parts, tasks read some parts each.
    """
    if _in_parts(spark, path):
        return _table_in_parts(spark, path, name, columns)
    at, shipped = local_path(spark, path)
    if not table_exists(at, name):
        return None
    schema = _chosen(name, columns_of(at, name), columns)
    rowids = _rowids(at, name)
    if rowids is not None and rowids[0] is None:
        return spark.createDataFrame([], schema)
    spark.dataSource.register(_source())
    options = {"file": at, "shipped": shipped, "table": name, "partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    if rowids is not None:
        options |= {"low": str(rowids[0]), "high": str(rowids[1])}
    return spark.read.format("papergrove_sqlite").schema(schema).options(**options).load()
