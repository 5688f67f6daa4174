"""Scores of nodes: popularity, recency, fitness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raised(raw: str, gamma: int = 3) -> Column:
    """What scores are shares of: the value to a power, and one."""
    return F.pow(F.col(raw).cast("double"), F.lit(float(gamma))) + 1


def normalised(df: DataFrame, raw: str, name: str, gamma: int = 3) -> DataFrame:
    """raised() over its sum: the sum is one aggregated row joined back."""
    x = raised(raw, gamma)
    total = df.agg(F.sum(x).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, x / F.col("_total")).drop("_total")  # one row


def rated_ages(ages: DataFrame, table: DataFrame) -> DataFrame:
    """ages (age, n, ...) with rec: an age's probability over the sum of all ages' (0 where the table has none), shared
    by its n nodes. A table of probabilities has a row an age; it is joined to the ages, of which there are few."""
    known = table.select("age", "prob").join(F.broadcast(ages.select("age")), "age", "left_semi")
    rows = ages.join(known, "age", "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    total = F.sum("prob").over(Window.partitionBy())  # a row an age
    return rows.withColumn("rec", F.coalesce(F.try_divide(F.col("prob"), F.col("n") * total), F.lit(0.0))).drop("prob")


def recency_scores(nodes: DataFrame, table: DataFrame, year: int) -> DataFrame:
    """(id, rec): an age's probability (0 where the table has none), shared by the nodes of the age."""
    aged = nodes.select("id", (F.lit(year) - F.col("year")).alias("age"))
    rated = rated_ages(aged.groupBy("age").agg(F.count("*").alias("n")), table).select("age", "rec")
    return aged.join(F.broadcast(rated), "age").select("id", "rec")  # a row a year


def candidate_score() -> Column:
    return F.col("pa") * F.col("pa_weight") + F.col("rec") * F.col("rec_weight") + F.col("fit") * F.col("fit_weight")
