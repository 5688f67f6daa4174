"""Analytics over a profiler trace: launches (start, end, ...), copies (kind, bytes, dur), names (id, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papergrove.functions import hardware as H
from papergrove.functions.names import copy_kind, kernel_name, kernel_name_kept
from papergrove.operators.graph import small_in_bytes


def decode(df: DataFrame, names: DataFrame, ident: str, to: str, prefix: str = "") -> DataFrame:
    """df with the name of an id; the id itself, after a prefix, where there is no name."""
    n = small_in_bytes(names.select(F.col("id").alias("_i"), F.col("value").alias("_v")), F.length("_v"))
    return df.join(n, F.col(ident) == F.col("_i"), "left").withColumn(to, F.coalesce("_v", F.concat(F.lit(prefix), F.col(ident).cast("string")))).drop("_i", "_v")


def kernel_summary(k: DataFrame, by: str = "name") -> DataFrame:
    d = (F.col("end") - F.col("start")).cast("double")
    return k.groupBy(by).agg(F.count("*").alias("calls"), F.sum(d).alias("total_ns"), F.avg(d).alias("avg_ns"), F.min(d).alias("min_ns"), F.max(d).alias("max_ns"), F.avg("regs").alias("avg_regs"), F.avg("block").alias("avg_block"), F.avg("grid").alias("avg_grid")).orderBy(F.desc("total_ns"), by)


def copy_summary(c: DataFrame) -> DataFrame:
    """By kind: operations, bytes, time in ns, bytes of the mean and the largest copy, bandwidth in GB/s (0 without time)."""
    s = c.groupBy("kind").agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"), F.sum("dur").alias("total"), F.avg("bytes").alias("mean"), F.max("bytes").alias("largest"))
    bandwidth = F.when(F.col("total") > 0, F.col("bytes").cast("double") / F.col("total")).otherwise(F.lit(0.0))
    return s.withColumn("name", copy_kind(F.col("kind"))).withColumn("bandwidth", bandwidth).orderBy(F.desc("bytes"), "kind")


def api_summary(calls: DataFrame, names: DataFrame) -> DataFrame:
    """By API call: name (api_<id> where there is none), calls, total and mean time; the longest first."""
    d = F.col("end") - F.col("start")
    s = calls.groupBy("name_id").agg(F.count("*").alias("calls"), F.sum(d).alias("total_ns"), F.avg(d).alias("avg_ns"))
    return decode(s, names, "name_id", "name", "api_").orderBy(F.desc("total_ns"), "name_id")


def ranges(events: DataFrame, n: int) -> DataFrame:
    """By text: closed ranges (both ends known), their time; the n longest. Texts are those of an id, else their own."""
    closed = events.where("start IS NOT NULL AND end IS NOT NULL")
    s = closed.groupBy("text").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("total_ns"))
    return s.orderBy(F.desc("total_ns"), "text").limit(n)


def named_ranges(events: DataFrame, names: DataFrame, n: int = 20) -> DataFrame:
    """By name: closed ranges, their time and mean; the n longest. events: (text_id, text, start, end).

    A range goes by its text id, where it has one, else by its own text; an id's name is that of the table of texts
    (id, value), or nvtx_ and the id where that has none.
    """
    closed = events.where("start IS NOT NULL AND end IS NOT NULL")
    d = F.col("end") - F.col("start")
    s = closed.groupBy("text_id", F.when(F.col("text_id").isNull(), F.col("text")).alias("own")).agg(F.count("*").alias("n"), F.sum(d).alias("total_ns"), F.avg(d).alias("avg_ns"))
    top = s.orderBy(F.desc("total_ns"), "text_id", "own").limit(n)
    named = top.join(names.select(F.col("id").alias("_i"), F.col("value").alias("_v")), F.col("text_id") == F.col("_i"), "left")
    name = F.coalesce("_v", "own", F.concat(F.lit("nvtx_"), F.col("text_id").cast("string")))
    return named.select(name.alias("name"), "n", "total_ns", "avg_ns").orderBy(F.desc("total_ns"), "name")


def positive(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Rows with more than 0 of a column, and columns by their names for reports."""
    return df.where(F.col(column) > 0).withColumnsRenamed(names)


def first_seen(k: DataFrame, hw: H.Hardware, order: str = "event_id") -> DataFrame:
    """By kernel: calls, total, least and largest time, and the registers, block, shared and local memory seen first,
    with the theoretical occupancy of these."""
    d = F.col("end") - F.col("start")
    s = k.groupBy("name").agg(F.count("*").alias("count"), F.sum(d).alias("total_ns"), F.min(d).alias("min_ns"), F.max(d).alias("max_ns"), F.min_by(F.struct("regs", "block_x", "shared_static", "local"), F.col(order)).alias("f"))
    s = s.select("name", "count", "total_ns", "min_ns", "max_ns", "f.*")
    return s.withColumn("occupancy", H.occupancy(F.col("regs"), F.col("block_x"), F.col("shared_static"), hw))


def busy_ratio() -> Column:
    d = F.sum(F.col("end") - F.col("start")).cast("double")
    return F.try_divide(d, (F.max("end") - F.min("start")).cast("double"))


def share(total: str, *by: str) -> Column:
    """Percent of the sum over the group."""
    return F.try_divide(100 * F.col(total).cast("double"), F.sum(F.col(total).cast("double")).over(Window.partitionBy(*by)))


def rank_by(*order: Column) -> Column:
    """The place in an order, from 1; for summaries, whose rows are few."""
    return F.row_number().over(Window.orderBy(*order))


def top_per_group(df: DataFrame, by: list[str], order: str, tie: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(order).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def launch_signatures(k: DataFrame, hw: H.Hardware) -> DataFrame:
    """By launch signature (kernel, block and grid over their three axes, registers, static, dynamic and local memory):
    launches, time in ms (reports round it), share of all time, occupancy and the limit that binds; the longest first."""
    rows = k.select(kernel_name_kept(F.col("name")).alias("kernel"), (F.col("block_x") * F.col("block_y") * F.col("block_z")).alias("block"), (F.col("grid_x") * F.col("grid_y") * F.col("grid_z")).alias("grid"),
                    "regs", "shared_static", "shared_dynamic", F.coalesce("local", F.lit(0)).alias("local"), (F.col("end") - F.col("start")).alias("ns"))
    key = ["kernel", "block", "grid", "regs", "shared_static", "shared_dynamic", "local"]
    s = rows.groupBy(*key).agg(F.count("*").alias("launches"), F.sum("ns").alias("ns"))
    percent, limiter = H.occupancy_by_least_limit(F.col("regs"), F.col("block"), F.col("shared_static") + F.col("shared_dynamic"), hw)
    s = s.withColumn("share", share("ns"))
    return s.select(*key, "launches", (F.col("ns") / F.lit(1e6)).alias("total_ms"), (F.col("ns") / F.lit(1e6) / F.col("launches")).alias("avg_ms"), percent.alias("occupancy"), limiter.alias("limiter"), "share").orderBy(F.desc("total_ms"), *key)


def kernel_shares(k: DataFrame) -> DataFrame:
    """By kernel: launches, seconds, percent of all time, mean grid and block over their three axes; the longest first."""
    d = (F.col("end") - F.col("start")).cast("double")
    s = k.groupBy(kernel_name(F.col("name")).alias("kernel")).agg(F.count("*").alias("launches"), F.sum(d).alias("ns"), F.avg(F.col("grid_x") * F.col("grid_y") * F.col("grid_z")).alias("grid"), F.avg(F.col("block_x") * F.col("block_y") * F.col("block_z")).alias("block"))
    return s.select("kernel", "launches", (F.col("ns") / 1e9).alias("total_s"), share("ns").alias("share"), "grid", "block").orderBy(F.desc("total_s"), "kernel")


def category_order(c: Column, categories: list[str]) -> Column:
    """Position among the categories; 99 for others."""
    at = F.array_position(F.array(*map(F.lit, categories)), c)
    return F.when(at > 0, at - 1).otherwise(F.lit(99)).cast("int")


def command_line(args: DataFrame, by: str, number: str, value: str) -> DataFrame:
    """Numbered arguments joined in their order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(number).alias("i"), F.col(value).alias("v"))))
    return args.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["v"]), " ").alias("command"))
