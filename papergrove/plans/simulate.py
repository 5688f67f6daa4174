"""Growth of a citation graph year by year: one plan a year, state written between years."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papergrove.config import SimConfig
from papergrove.functions.rand import pick
from papergrove.functions.scalar import fitness_at
from papergrove.operators import agents as A
from papergrove.operators import graph as G
from papergrove.operators import sampling as S
from papergrove.operators import scores as C
from papergrove.operators.store import EdgeStore, sized


def final_size(nodes: int, rate: float, cycles: int) -> int:
    """Nodes after some cycles, each growing by the next whole number."""
    for _ in range(cycles):
        nodes += math.ceil(nodes * rate)
    return nodes


def scored(nodes: DataFrame, degrees: DataFrame, recency: DataFrame, year: int, held: list[DataFrame], phases: G.Phases) -> DataFrame:
    """(id, pa, rec, fit) of every node; nodes have fitness_lag, fitness_peak, fitness_duration, degrees in_degree.

    What scores are made of is written once, by node; all that is summed over nodes is then in one row an age.
    """
    age = F.lit(year) - F.col("year")
    raw = nodes.join(degrees.select("id", "in_degree"), "id").withColumns({"age": age, "fitness": fitness_at(age, F.col("fitness_lag"), F.col("fitness_peak"), F.col("fitness_duration"))})
    raw = phases.cut(raw.select("id", "age", C.raised("in_degree").alias("x"), C.raised("fitness").alias("y")), "scores", held)
    by_age = raw.groupBy("age").agg(F.count("*").alias("n"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))
    rated = phases.cut(C.rated_ages(by_age, recency).select("age", "rec", *[F.sum(c).over(Window.partitionBy()).alias(c) for c in ("xs", "ys")]), "ages", held)  # a row an age
    return raw.join(F.broadcast(rated), "age").select("id", (F.col("x") / F.col("xs")).alias("pa"), "rec", (F.col("y") / F.col("ys")).alias("fit"))


def first_hop(starts: DataFrame, store: EdgeStore, count: int | None = None) -> DataFrame:
    """(id, g, n): the neighbours of each start's node g, each once."""
    return store.expand(starts.select("id", "g"), "g", count).where("v <> g").select("id", "g", F.col("v").alias("n")).distinct()


def second_hop(first: DataFrame, among: DataFrame, store: EdgeStore, count: int) -> DataFrame:
    """The neighbours v of first neighbours (id, g, n) of the ids of `among`, with its columns: a row for each way to v.

    Neither g nor a first neighbour is among them. Nothing is written or gathered by id: what takes them (a bounded
    count or sample) does so in the task that found them.
    """
    rows = store.expand(first.join(among, "id"), "n", count).where("v <> g")
    near = first.select(F.col("id").alias("_i"), F.col("n").alias("_n"))
    return rows.join(G.small(near, count), (F.col("id") == F.col("_i")) & (F.col("v") == F.col("_n")), "left_anti").drop("g", "n")


def keyed(rows: DataFrame, node: str, scores: DataFrame, n: int, cfg: SimConfig) -> DataFrame:
    """rows (id, weights, node) with the keys of a weighted sample by the scores of their nodes."""
    rated = rows.join(G.small(scores.withColumnRenamed("id", "_s"), n), F.col(node) == F.col("_s")).withColumn("score", C.candidate_score())
    return rated.select("id", F.col(node).alias("node"), "most", S.sampling_key(cfg.seed, F.col("id"), F.col(node), F.col("score")).alias("key"))


def near(agents: DataFrame, size: int, store: EdgeStore, scores: DataFrame, n: int, cfg: SimConfig, bound: int, held: list[DataFrame], phases: G.Phases) -> tuple[DataFrame, DataFrame]:
    """The agents with their quotas, and (id, node, hop): what they cite of their neighbourhoods.

    First neighbourhoods are written; second ones never are: their samples say how many each agent found, up to its
    need, and that is all that quotas ask. With `max_batch`, about so many agents are worked on at once, those of one
    generator together; draws go by ids, so batches change no result.
    """
    batches = math.ceil(size / cfg.max_batch) if cfg.max_batch else 1
    agents = phases.cut(agents, "agents", held)
    parts: list[tuple[DataFrame, DataFrame]] = []
    for b in range(batches):
        own = agents.where(F.pmod(F.xxhash64("generator"), F.lit(batches)) == b) if batches > 1 else agents
        wide: list[DataFrame] = []
        first = phases.cut(first_hop(own.select("id", F.col("generator").alias("g")), store, size), "first", wide, "neighbours")
        count = phases.last()
        inner = S.inner_quotas(own, first.groupBy("id").agg(F.count("*").alias("h1")), cfg.fully_random_citations)
        one = first.join(inner.where("inside > 0").select("id", F.col("inside").alias("most"), *A.WEIGHTS), "id")
        two = second_hop(first, inner.where("need > 0").select("id", F.col("need").alias("most"), *A.WEIGHTS), store, count)
        found = S.top_by_key(keyed(one, "n", scores, n, cfg), ["id"], "key", "node", "most", bound).select("id", "node", F.lit(1).alias("hop"))
        found = found.unionByName(S.top_by_key(keyed(two, "v", scores, n, cfg), ["id"], "key", "node", "most", bound).select("id", "node", F.lit(2).alias("hop")))
        found = phases.cut(found, "picked", held, "picks")
        quota = S.outer_quotas(inner, found.where("hop = 2").groupBy("id").agg(F.count("*").alias("h2")))
        parts.append((phases.cut(quota, "quotas", held), found))
        G.drop(*wide)
    return tuple(reduce(DataFrame.unionByName, p) for p in zip(*parts))


def epoch(spark: SparkSession, nodes: DataFrame, store: EdgeStore, n: int, year: int, cfg: SimConfig, bag: DataFrame, recency: DataFrame, degrees: DataFrame, held: list[DataFrame] | None = None, phases: G.Phases | None = None) -> tuple[DataFrame, DataFrame, int]:
    """A year's new edges (src, dst, kind), its agents with their quotas, and how many they are.

    The store has the edges so far, which degrees count. The tables that edges and agents are read from are added to
    `held`, for the caller to drop.
    """
    held, phases = [] if held is None else held, phases or G.Phases()
    size = math.ceil(n * cfg.growth_rate)
    bag_stats = bag.agg(F.count("*"), F.max("out_degree")).first()
    agents = A.cohort(spark, n, size, cfg, bag, bag_stats[0])
    scores = scored(nodes, degrees, recency, year, held, phases)
    quota, found = near(agents, size, store, scores, n, cfg, int(bag_stats[1] or 0), held, phases)
    own = quota.where("same_year").select("id", (F.lit(n) + pick(cfg.seed, F.col("id"), size, "own")).alias("node"))
    if not cfg.allow_self_loop:
        own = own.where("node <> id")
    taken = found.select("id", "node").unionByName(quota.select("id", F.col("generator").alias("node")))
    fill = S.uniform_fill(spark, quota, taken, n - int(cfg.last_node_excluded), cfg.seed, cfg.slack)
    out = quota.select(F.col("id").alias("src"), F.col("generator").alias("dst"), F.lit("generator").alias("kind"))
    out = out.union(own.select("id", "node", F.lit("same_year")))
    out = out.union(found.select("id", "node", F.when(F.col("hop") == 1, "one_hop").otherwise("two_hop")))
    return out.union(fill.select("id", "node", F.lit("random"))), quota, size


def with_fitness(spark: SparkSession, nodes: DataFrame, cfg: SimConfig) -> DataFrame:
    """Nodes (id, year) with drawn fitness."""
    return A.draw_fitness(spark, nodes, cfg).withColumns({"fitness_lag": F.lit(cfg.fitness_lag), "fitness_duration": F.lit(cfg.fitness_duration)}).select("id", "year", "fitness_lag", "fitness_peak", "fitness_duration")


#: What a node of the result has beside id, year, cycle and type: null for seeds.
AGENT = {"generator": "long", "out_degree": "int", "pa_weight": "double", "rec_weight": "double", "fit_weight": "double", "alpha": "double"}


def run(spark: SparkSession, nodes: DataFrame, edges: DataFrame, cfg: SimConfig, bag: DataFrame, recency: DataFrame, planted: DataFrame | None = None, log: Callable[[str], None] = lambda text: None, phases: G.Phases | None = None) -> tuple[DataFrame, DataFrame]:
    """All cycles from nodes (id, year) with dense ids and edges (src, dst): the final nodes and edges.

    Nodes and edges have the cycle they came in (0: seed); nodes have their type, fitness and an agent's attributes
    (out_degree is as `assigned_out_degree`). Each cycle adds written tables; earlier ones are not written again.
    Degrees are kept, and refreshed by a year's edges alone. `phases` takes each year's times and counts.
    """
    phases = phases or G.Phases()
    agent = {("assigned_out_degree" if c == "out_degree" else c): F.lit(None).cast(k) for c, k in AGENT.items()}
    nodes = G.cut(with_fitness(spark, nodes, cfg).withColumns({"cycle": F.lit(0), "type": F.lit(0), "planted_line": F.lit(None).cast("int"), **agent}), "nodes")
    edges = G.cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct().select("src", "dst", F.lit("seed").alias("kind"), F.lit(0).alias("cycle")), "edges")
    degrees = G.cut(G.degrees(nodes, edges), "degrees")
    n, first = nodes.agg(F.count("*"), F.max("year")).first()
    store = EdgeStore(spark, sized(spark, edges.count()))
    store.add(edges, degrees)
    for cycle in range(1, cfg.num_cycles + 1):
        year, held = first + cycle, []
        phases.label = f"year {year}"
        if cfg.model == "er-gnp":
            from papergrove.plans import er

            size = math.ceil(n * cfg.growth_rate)
            new = er.cohort_edges(spark, n, size, cfg)
            quota = spark.range(n, n + size).select("id", *[F.lit(None).cast(k).alias(c) for c, k in AGENT.items()])
        else:
            new, quota, size = epoch(spark, nodes, store, n, year, cfg, bag, recency, degrees, held, phases)
        new = phases.cut(new.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "kind").withColumn("cycle", F.lit(cycle)), "edges")
        edges, made = edges.unionByName(new), phases.last()
        born = with_fitness(spark, quota.select("id", F.lit(year).alias("year")), cfg).withColumns({"cycle": F.lit(cycle), "type": F.lit(1)})
        born = born.join(quota.select("id", *AGENT).withColumnRenamed("out_degree", "assigned_out_degree"), "id")
        if planted is not None:
            own = A.plant(spark.range(n, n + size).select("id", (F.col("id") - n).alias("growth_idx")), planted, cycle, size)
            born = born.join(own, "id", "left").withColumns({"fitness_lag": F.coalesce("lag", "fitness_lag"), "fitness_peak": F.coalesce("peak", "fitness_peak"), "fitness_duration": F.coalesce("dur", "fitness_duration"), "planted_line": F.col("line_no")})
        else:
            born = born.withColumn("planted_line", F.lit(None).cast("int"))
        born = phases.cut(born.select(*nodes.columns), "nodes")
        nodes, was = nodes.unionByName(born), degrees
        none = F.lit(0).cast("long")
        degrees = phases.cut(G.refresh_degrees(degrees.unionByName(born.select("id", none.alias("in_degree"), none.alias("out_degree"))), new), "degrees")
        phases.timed("store", lambda new=new, degrees=degrees: store.add(new, degrees), made)
        G.drop(was, *held)
        n += size
        log(f"year {year}: {size} nodes")
    store.drop()
    return nodes, edges
