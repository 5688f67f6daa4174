"""Delimited text: sniffed node and edge lists, parameter files, and the two sinks."""

from __future__ import annotations

import csv
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrove.functions.names import METRICS, file_agents, file_years
from papergrove.functions.scalar import clean_number, general, lenient_int, lenient_long, node_type
from papergrove.operators.graph import dense_ids

#: The header of the edge sink, the columns of the node sink, and what a seed has in them.
EDGE_HEADER = ("#source", "target")
NODE_HEADER = ["node_id", "type", "year", "pa_weight", "rec_weight", "fit_weight", "fit_lag_duration", "fit_peak_value", "fit_peak_duration", "alpha", "in_degree", "out_degree", "assigned_out_degree", "planted_nodes_line_number", "generator_node_string"]
SEED, NO_GENERATOR = "-1", "no_generators"
#: Lines in which the header of a metric file is looked for before all are read.
HEAD = 1000
#: Names that the column of kernels goes by.
KERNEL_COLUMNS = ["Kernel Name", "Kernel Name ", "Function Name"]


def sniff(spark: SparkSession, path: str) -> str:
    """Comma, tab or blank: the first of them that the first line has."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    for c in ",\t ":
        if c in line:
            return c
    raise ValueError(f"no delimiter in the first line of {path}")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without comments and blank ones, and their order in the file."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.monotonically_increasing_id().alias("at"))
    return rows.where("line NOT LIKE '#%' AND trim(line) <> ''")


def read_edgelist(spark: SparkSession, path: str) -> DataFrame:
    """(source, target), repeated rows included; a first field that begins with # is a comment."""
    sep = sniff(spark, path)
    parts = F.split("line", "\\t" if sep == "\t" else sep)
    return _lines(spark, path).select(lenient_long(parts[0]).alias("source"), lenient_long(F.get(parts, F.lit(1))).alias("target"))


def read_nodelist(spark: SparkSession, path: str) -> DataFrame:
    """(node, year); of a repeated node the last row counts."""
    sep = sniff(spark, path)
    parts = F.split("line", "\\t" if sep == "\t" else sep)
    rows = _lines(spark, path).select(lenient_long(parts[0]).alias("node"), lenient_int(F.get(parts, F.lit(1))).alias("year"), "at")
    return rows.groupBy("node").agg(F.max_by("year", "at").alias("year"))


def read_bag(spark: SparkSession, path: str) -> DataFrame:
    """(pos, out_degree): the second column, in file order."""
    rows = _lines(spark, path).select(lenient_int(F.get(F.split("line", ","), F.lit(1))).alias("out_degree"), "at")
    return rows.join(dense_ids(rows.select("at"), "at"), F.col("at") == F.col("orig_id")).select(F.col("seq_id").cast("long").alias("pos"), "out_degree")


def read_recency(spark: SparkSession, path: str) -> DataFrame:
    """(age, prob); the last row of an age counts."""
    parts = F.split("line", ",")
    rows = _lines(spark, path).select(lenient_int(parts[0]).alias("age"), F.get(parts, F.lit(1)).try_cast("double").alias("prob"), "at")
    return rows.groupBy("age").agg(F.max_by("prob", "at").alias("prob"))


PLANTED = "year int, line_no int, lag int, peak int, dur int, count int"


def read_planted(spark: SparkSession, path: str | None) -> DataFrame:
    """(year, line_no, lag, peak, dur, count) with line numbers from 1; no path: no rows. Comments are not known here."""
    if not path:
        return spark.createDataFrame([], PLANTED)
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    rows = rows.join(dense_ids(rows.select("at"), "at"), F.col("at") == F.col("orig_id"))
    at = lambda k: lenient_int(F.get(F.split("value", ","), F.lit(k)))
    return rows.select(at(0).alias("year"), (F.col("seq_id") + 1).cast("int").alias("line_no"), at(1).alias("lag"), at(2).alias("peak"), at(3).alias("dur"), at(4).alias("count"))


def _table(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """The rows of a CSV file by column name, all as text, and its name as `source`.

    The header is the first line that has all needed names; lines before it, a byte-order mark, and rows with another
    number of fields are skipped.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"), F.monotonically_increasing_id().alias("at"))
    def first_head(of: DataFrame) -> list:
        for n in needed:
            of = of.where(F.contains("line", F.lit(n)))
        return of.orderBy("at").limit(1).collect()

    head = first_head(lines.where(F.col("at") < HEAD).limit(HEAD)) or first_head(lines)  # mostly without reading all
    if not head:
        raise ValueError(f"no line of {path} has the columns {', '.join(needed)}")
    names = next(csv.reader([head[0]["line"]]))
    fields = ", ".join(f"c{k} string" for k in range(len(names) + 1))  # one more tells longer rows
    rows = lines.where(F.col("at") > head[0]["at"]).where("trim(line) <> ''").select(F.from_csv("line", F.lit(fields), {"mode": "PERMISSIVE"}).alias("r"), F.col("line"))
    full = rows.where(F.col(f"r.c{len(names)}").isNull() & F.col(f"r.c{len(names) - 1}").isNotNull())
    first = {n: k for k, n in reversed(list(enumerate(names)))}
    return full.select(*[F.col(f"r.c{k}").alias(n) for n, k in first.items()])


def read_metric_csv(spark: SparkSession, path: str, known: dict[str, str] | None = METRICS) -> DataFrame:
    """(kernel, metric, value) of a long metric file, its columns found by name.

    Only metrics of `known` are kept, by their short names (None: all, as they are); values that are no number are not.
    """
    rows = _table(spark, path, ["Kernel Name", "Metric Name"])
    value, kernel, metric = clean_number(F.col("`Metric Value`")), F.trim(F.col("`Kernel Name`")), F.trim(F.col("`Metric Name`"))
    if known is not None:
        metric = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[metric]
    return rows.select(kernel.alias("kernel"), metric.alias("metric"), value.alias("value")).where("kernel <> '' AND metric <> '' AND value IS NOT NULL")


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small text file, from the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    out.write(bytearray("".join(x + "\n" for x in lines).encode()))
    out.close()


def files_of(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern names, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def read_metric_files(spark: SparkSession, pattern: str, known: dict[str, str] | None = METRICS) -> DataFrame:
    """All metric files of a pattern, with years, agents and the file's name from each name; columns may differ."""
    out = None
    for path in files_of(spark, pattern):
        name = F.lit(path)
        rows = read_metric_csv(spark, path, known).withColumns({"years": file_years(name), "agents": file_agents(name), "source": F.element_at(F.split(name, "/"), -1)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no files matched: {pattern}")
    return out


def read_wide_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """(kernel, ...) of a raw metric file: columns maps its metrics to names; a metric it lacks is null.

    The column of kernels goes by several names; rows with another number of fields are dropped.
    """
    head = spark.read.text(path).limit(1).collect()
    names = next(csv.reader([head[0][0].lstrip("\ufeff")])) if head else []
    kernel = next((c for c in KERNEL_COLUMNS if c in names), None)
    if kernel is None:
        raise ValueError(f"no column of kernels among {names}")
    rows = _table(spark, path, [kernel])
    return rows.select(F.col(f"`{kernel}`").alias("kernel"), *[(clean_number(F.col(f"`{c}`")) if c in rows.columns else F.lit(None).cast("double")).alias(n) for c, n in columns.items()])


def edge_frame(edges: DataFrame, idmap: DataFrame) -> DataFrame:
    """Edges with original ids: (source, target)."""
    s, d = idmap.select(F.col("id").alias("src"), F.col("orig_id").alias("source")), idmap.select(F.col("id").alias("dst"), F.col("orig_id").alias("target"))
    return edges.join(s, "src").join(d, "dst").select("source", "target")


def join_parts(spark: SparkSession, folder: str, path: str, header: str | None = None) -> None:
    """The part files of a folder, in their order, as one file under a header line; the folder is deleted.

    A file system that can join files does so without moving a byte; elsewhere they are copied in buffers, never whole.
    The file takes its name when it is complete.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    Path = jvm.org.apache.hadoop.fs.Path
    source, whole = Path(folder), Path(f"{path}.joining")
    fs, to = source.getFileSystem(conf), Path(path).getFileSystem(conf)
    parts = [f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen()]
    parts.sort(key=lambda p: int(p.getName().split("-")[1].split(".")[0]))

    def begun():
        out = to.create(whole, True)
        if header is not None:
            out.write(bytearray((header + "\n").encode()))
        return out

    begun().close()
    if parts and not (header is not None and to.getUri().equals(fs.getUri()) and _concatenated(spark, to, whole, parts)):
        out = begun()
        for p in parts:
            part = fs.open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        out.close()
    to.delete(Path(path), True)
    to.rename(whole, Path(path))
    fs.delete(source, True)


def _concatenated(spark: SparkSession, fs, whole, parts: list) -> bool:
    """Whether the file system appended the parts to a file by itself."""
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
    for k, p in enumerate(parts):
        array[k] = p
    try:
        fs.concat(whole, array)
        return True
    except (Py4JJavaError, PySparkException):  # not every one can
        return False


def write_csv(df: DataFrame, path: str, header: list[str] | None = None) -> None:
    """df, in its order, as one CSV file under its header: written in parts, which are then joined."""
    spark = df.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    df.write.option("emptyValue", "").csv(parts)
    join_parts(spark, parts, path, ",".join(header or df.columns))


def write_edges(edges: DataFrame, path: str) -> None:
    """One CSV file under the header `#source,target`, sorted by both: the header is a comment to the reader."""
    rows = edges.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))
    write_csv(rows.orderBy("source", "target"), path, list(EDGE_HEADER))


def show_edges(edges: DataFrame, n: int | None = None) -> None:
    """Edges (src, dst) in order to the screen, a line each; some at a time where n is None, so all can be shown."""
    rows = edges.select("src", "dst").orderBy("src", "dst")
    for r in (rows if n is None else rows.limit(n)).toLocalIterator():
        print(f"{r['src']}-{r['dst']}")


def attribute_frame(nodes: DataFrame) -> DataFrame:
    """The 15 columns of the node sink, by name; seeds have -1 and no_generators, agents 0 where no plan has them.

    generator_id is the generator's original id.
    """
    seed = F.col("type") == 0
    g = lambda c: F.when(seed, F.lit(SEED)).otherwise(general(F.col(c).cast("double")))
    i = lambda c: F.when(seed, F.lit(int(SEED))).otherwise(c)
    columns = [
        F.col("orig_id"), node_type(F.col("type")), F.col("year"), g("pa_weight"), g("rec_weight"), g("fit_weight"),
        F.col("fitness_lag"), F.col("fitness_peak"), F.col("fitness_duration"), g("alpha"), F.col("in_degree"), F.col("out_degree"),
        i(F.col("assigned_out_degree")), i(F.coalesce("planted_line", F.lit(0))), F.when(seed, F.lit(NO_GENERATOR)).otherwise(F.col("generator_id").cast("string")),
    ]
    return nodes.select(*[c.alias(n) for c, n in zip(columns, NODE_HEADER)])


def write_attributes(nodes: DataFrame, path: str) -> None:
    """One CSV file with header, sorted by node."""
    write_csv(attribute_frame(nodes).orderBy("node_id"), path, NODE_HEADER)
