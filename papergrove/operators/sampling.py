"""Citation quotas, weighted sampling without replacement, uniform fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papergrove.functions.rand import pick, uniform
from papergrove.functions.scalar import float_ceil, float_floor


def inner_quotas(agents: DataFrame, first: DataFrame, random_share: float) -> DataFrame:
    """agents with reserved, h1, inside and need: how many of the second neighbourhood they ask for, at most.

    first has (id, h1). One citation is the generator's.
    """
    a = agents.join(first, "id", "left").withColumn("h1", F.coalesce("h1", F.lit(0).cast("long")))
    a = a.withColumn("sy", F.col("same_year").cast("int")).withColumn("reserved", float_floor(F.col("out_degree") * F.lit(float(random_share))))
    free = F.col("out_degree") - 1 - F.col("sy") - F.col("reserved")
    a = a.withColumn("inside", F.least(float_ceil(free * F.col("alpha")), F.col("h1").cast("int")))
    return a.withColumn("need", free - F.col("inside"))


def outer_quotas(agents: DataFrame, second: DataFrame) -> DataFrame:
    """agents of inner_quotas with outside and random; second has (id, h2), which may be capped at need.

    A shortfall of the neighbourhoods goes to random.
    """
    a = agents.join(second, "id", "left").withColumn("h2", F.coalesce("h2", F.lit(0).cast("long")))
    a = a.withColumn("outside", F.least("need", F.col("h2").cast("int")))
    return a.withColumn("random", F.col("out_degree") - 1 - F.col("sy") - F.col("inside") - F.col("outside")).drop("need")


def quotas(agents: DataFrame, sizes: DataFrame, random_share: float) -> DataFrame:
    """agents with reserved, inside, outside and random; sizes has (id, h1, h2)."""
    return outer_quotas(inner_quotas(agents, sizes.select("id", "h1"), random_share), sizes.select("id", "h2"))


def sampling_key(seed: int, agent: Column, node: Column, score: Column) -> Column:
    """ln(u) / score: the largest keys are a weighted sample without replacement. A score of 0 comes last."""
    return F.when(score > 0, F.ln(uniform(seed, agent, "cand:", node)) / score)


def top_by_key(cand: DataFrame, group: list[str], key: str, item: str, most: str, bound: int) -> DataFrame:
    """The `most` items (a column) of each group with the largest keys; bound is a literal no group exceeds.

    An item that comes several times in a group, with one key, counts once. The literal lets Spark keep only so many
    items of a group in each task before the shuffle: what is shuffled grows with groups and tasks, not with candidates.
    """
    w = Window.partitionBy(*group).orderBy(F.col(key).desc_nulls_last(), F.col(item))
    top = cand.withColumn("_rank", F.dense_rank().over(w)).where((F.col("_rank") <= bound) & (F.col("_rank") <= F.col(most)))
    return top.drop("_rank").dropDuplicates([*group, item])


def capped_distinct(rows: DataFrame, group: str, item: str, cap: str, bound: int) -> DataFrame:
    """(group, n): the distinct items of each group, but `cap` (a column of the group's rows) where there are more.

    The count stops at the cap: a task keeps the least `bound` (a literal no cap exceeds) distinct items of a group
    before the shuffle, whatever it has read.
    """
    w = Window.partitionBy(group).orderBy(item)
    least = rows.withColumn("_rank", F.dense_rank().over(w)).where((F.col("_rank") <= bound) & (F.col("_rank") <= F.col(cap)))
    return least.groupBy(group).agg(F.max("_rank").cast("long").alias("n"))


def _ranks(need: Column, free: Column, draw) -> Column:
    """`need` different ranks of [0, free) by one draw each: the k-th is its draw, or the last rank it could be, if taken."""
    first = free - need
    step = lambda held, k: F.concat(held, F.array(F.when(F.array_contains(held, draw(k, first + k + 1)), first + k).otherwise(draw(k, first + k + 1))))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), need - 1), F.array().cast("array<bigint>"), step)


def _unranked(rank: Column, taken: Column) -> Column:
    """The node of a rank among those that are not in the sorted array `taken`."""
    return F.aggregate(taken, rank, lambda node, t: F.when(t <= node, node + 1).otherwise(node))


def uniform_fill(spark: SparkSession, agents: DataFrame, taken: DataFrame, domain: int, seed: int, slack: int) -> DataFrame:
    """(id, node): each agent's `random` further nodes of [0, domain), other than those of taken (id, node).

    The first free ones of random + slack draws; slack covers repeats and what is taken. What these leave short is drawn
    by rank: different ranks among the nodes that are neither taken nor drawn yet, each mapped to its node by the sorted
    list of those. Both are uniform over sets, there are no rounds, and an agent that needs more nodes than are left gets
    them all. An agent's taken nodes and draws are arrays of its row, as long as its citations.
    """
    sorted_ = taken.where((F.col("node") >= 0) & (F.col("node") < domain)).groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("_taken"))
    none = F.array().cast("array<bigint>")
    a = agents.where(f"random > 0 AND {domain} > 0").select("id", F.col("random").cast("long").alias("random")).join(sorted_, "id", "left").withColumn("_taken", F.coalesce("_taken", none))
    drawn = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("random") + slack - 1), lambda j: pick(seed, F.col("id"), domain, "fill:", j)))
    a = a.withColumn("_got", F.slice(F.filter(drawn, lambda x: ~F.array_contains("_taken", x)), F.lit(1), F.col("random").cast("int")))
    a = a.withColumn("_held", F.when(F.size("_got") < F.col("random"), F.array_sort(F.concat("_taken", "_got"))).otherwise(none))
    free = F.lit(domain) - F.size("_held")
    short = F.least(F.col("random") - F.size("_got"), free)
    draw = lambda k, n: pick(seed, F.col("id"), n, "rank:", k)
    rest = F.when(short > 0, F.transform(_ranks(short, free, draw), lambda r: _unranked(r, F.col("_held")))).otherwise(none)
    return a.select("id", F.explode(F.concat("_got", rest)).alias("node"))
