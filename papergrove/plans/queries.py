"""Registered queries over the fixture tables; sql.py has the same in SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papergrove import __main__ as program
from papergrove.config import SimConfig
from papergrove.functions import hardware as H
from papergrove.functions import names as N
from papergrove.functions import scalar as X
from papergrove.functions.rand import pick, uniform
from papergrove.operators import agents as A
from papergrove.operators import graph as G
from papergrove.operators import metrics as M
from papergrove.operators import sampling as S
from papergrove.operators import scores as C
from papergrove.operators import trace as T
from papergrove.operators.kept import KeptStatistics
from papergrove.operators.store import EdgeStore, crowded, sized
from papergrove.plans import er, profile, simulate
from papergrove.sources import fixture as X0
from papergrove.sources import tables, text

CFG = SimConfig()
YEAR = 2002
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _n(nodes: DataFrame) -> int:
    return nodes.count()


def _agents(spark: SparkSession, sf: str, cfg: SimConfig = CFG) -> tuple[DataFrame, int, int]:
    n = _n(X0.raw_nodes(spark, sf))
    size = -(-n * 3 // 100)
    bag = X0.bag(spark, sf)
    return A.cohort(spark, n, size, cfg, bag, bag.count()), n, size


def _r(name: str, digits: int = 9):
    return F.round(F.col(name).cast("double"), digits).alias(name)


# Ingest


def _file(spark, name: str) -> str:
    return f"{G.shared_dir(spark)}/papergrove/{name}-{uuid.uuid4().hex}.csv"


@query
def scan_nodelist(spark, sf):
    """The nodes, from a file that the query writes."""
    path = _file(spark, "nodes")
    text.write_csv(X0.raw_nodes(spark, sf), path, ["#node", "year"])
    return text.read_nodelist(spark, path).select(F.col("node").alias("id"), "year")


@query
def scan_edgelist(spark, sf):
    """The edges, from a file that the sink of edges writes."""
    path = _file(spark, "edges")
    text.write_edges(X0.raw_edges(spark, sf).toDF("source", "target"), path)
    return text.read_edgelist(spark, path).toDF("src", "dst")


def _lines_file(spark, name: str, rows: DataFrame, header: str | None = None) -> str:
    """rows (at, line), in the order of `at`, as one file; rows (line) in any order."""
    path = _file(spark, name)
    (rows.orderBy("at") if "at" in rows.columns else rows).select("line").write.text(f"{path}.parts")
    text.join_parts(spark, f"{path}.parts", path, header)
    return path


@query
def scan_delimited(spark, sf):
    """The edges from three files, each with its own delimiter and line ends, comments and blank lines."""
    e, out = X0.raw_edges(spark, sf), []
    for k, (name, sep, end) in enumerate((("comma", ",", ""), ("tab", "\t", "\r"), ("blank", " ", "\r"))):
        line = F.concat(F.when(F.col("dst") % 50 == 1, F.concat(F.lit("# "), "dst")).when(F.col("dst") % 50 == 2, F.lit(" ")).otherwise(F.concat_ws(sep, "src", "dst")), F.lit(end))
        path = _lines_file(spark, name, e.where(F.col("src") % 3 == k).select(F.struct("src", "dst").alias("at"), line.alias("line")), f"#source{sep}target")
        out.append(text.read_edgelist(spark, path).select(F.lit(name).alias("file"), "source", "target"))
    return reduce(DataFrame.unionByName, out)


def _bag_file(spark, rows: DataFrame) -> str:
    """Rows (at, out_degree) as a bag's file."""
    return _lines_file(spark, "bag", rows.select("at", F.concat_ws(",", "at", "out_degree").alias("line")), "#index,out_degree")


@query
def scan_bag(spark, sf):
    """Out-degrees, from a file that the query writes: its index has gaps and does not count."""
    rows = X0.table(spark, sf, "part").select((F.col("p_partkey") * 3 + 1).alias("at"), (5 + F.col("p_size") % 16).alias("out_degree"))
    return text.read_bag(spark, _bag_file(spark, rows))


@query
def scan_recency(spark, sf):
    """Probabilities by age from a file with a line for each node: the last line of an age counts."""
    line = F.concat_ws(",", F.lit(YEAR) - F.col("year"), F.lit(1.0) / (F.col("id") % 97 + 1).cast("double"))
    path = _lines_file(spark, "recency", X0.raw_nodes(spark, sf).select(F.col("id").alias("at"), line.alias("line")), "#age,probability")
    return text.read_recency(spark, path)


@query
def scan_planted(spark, sf):
    """A plan of a line for each supplier, by its place in a file; blanks before numbers, some lines without a count."""
    k = F.col("s_suppkey")
    fields = [1 + k % 3, F.concat(F.lit(" "), k % 4), 1 + k * 37 % 1000, 1 + k % 6, F.when(k % 5 > 0, 1 + k % 4)]
    rows = X0.table(spark, sf, "supplier").select(k.alias("at"), F.concat_ws(",", *[f.cast("string") for f in fields]).alias("line"))
    return text.read_planted(spark, _lines_file(spark, "planted", rows))


@query
def scan_wide_metrics(spark, sf):
    """A raw metric file by the names of its columns: numbers with commas, rows cut short, a metric it lacks."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    name = F.concat(F.lit("k<"), "l_returnflag", F.lit(", "), "l_linestatus", F.lit(">"))
    time = F.format_number(F.col("l_quantity").cast("double") * 1000 + 0.5, 2)
    line = F.concat_ws(",", quoted(F.col("l_linenumber").cast("string")), quoted(name), "l_orderkey", quoted(time), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber").cast("string")))
    rows = X0.table(spark, sf, "lineitem").select(line.alias("line"))  # their order is not read
    path = _lines_file(spark, "raw", rows, '"ID","Kernel Name","m.key","m.time","m.lines"')
    return text.read_wide_csv(spark, path, {"m.key": "key", "m.time": "time", "m.lines": "lines", "m.none": "none"})


@query
def dense_ids(spark, sf):
    return G.dense_ids(X0.table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("id")))


@query
def edge_encode_join(spark, sf):
    ids = X0.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("orig_id"), (F.col("o_orderkey") * 2).alias("seq_id"))
    return G.encode_edges(X0.raw_edges(spark, sf), ids)


@query
def node_type_decode(spark, sf):
    return X0.raw_nodes(spark, sf).select("id", X.node_type((F.col("id") % 3).cast("int")).alias("type"))


@query
def dict_decode(spark, sf):
    k = X0.kernels(spark, sf).select("event_id", (F.col("name_id") + F.col("event_id") % 2 * 100).alias("name_id"))
    return T.decode(k, X0.strings(spark, sf), "name_id", "name")


def _metric_files(spark, sf):
    """Two exports of metrics, written for the query: a preamble, values with commas, a metric that is not known."""
    known = [*N.METRICS][:6] + ["of.no.interest"]
    rows = X0.table(spark, sf, "lineitem").groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("double")).alias("v")).orderBy("l_linestatus", "l_returnflag", "l_linenumber").collect()
    folder = f"{G.shared_dir(spark)}/papergrove/metrics-{uuid.uuid4().hex}"
    for status, name in (("F", "run-3y-1p-details.csv"), ("O", "run-10y-5p-details.csv")):
        lines = ["==PROF== one, two", '"ID","Kernel Name","Metric Name","Metric Unit","Metric Value"']
        lines += [f'"{k}","k<{r["l_returnflag"]}, 1>","{known[r["l_linenumber"] - 1]}","u","{r["v"]:,.2f}"' for k, r in enumerate(r for r in rows if r["l_linestatus"] == status)]
        text.write_lines(spark, f"{folder}/{name}", [*lines, "cut off"])
    return text.read_metric_files(spark, f"{folder}/run-*-details.csv")


@query
def multi_file_union(spark, sf):
    return _metric_files(spark, sf)


@query
def metric_files_pivot(spark, sf):
    p = M.pivot_mean(_metric_files(spark, sf), [*N.METRICS.values()], ("source", "years", "agents", "kernel"))
    return p.select("source", "years", "agents", "kernel", *[_r(n, 6) for n in N.METRICS.values()]).orderBy("years", "agents", "kernel")


@query
def metric_report(spark, sf):
    """Two categories of the files' metrics, as reports write them."""
    files = _metric_files(spark, sf)
    rows = [M.metric_table(files, c) for c in ("WARP DIVERGENCE (proxy)", "MEMORY BANDWIDTH")]
    long = [t.select("source", "years", "agents", "kernel", F.explode(F.map_from_arrays(F.array(*map(F.lit, t.columns[4:])), F.array(*[F.col(f"`{c}`") for c in t.columns[4:]]))).alias("label", "cell")) for t in rows]
    return long[0].unionByName(long[1])


@query
def scenario_names(spark, sf):
    m = X0.metrics(spark, sf)
    return M.scenario_names(m.where("scenario = 'F'"), m.where("scenario = 'O'"))


# Structure


@query
def undirected_edges(spark, sf):
    return G.undirected(X0.raw_edges(spark, sf))


@query
def edge_merge(spark, sf):
    e = X0.raw_edges(spark, sf)
    return G.merge_edges(e, e.select("src", (F.col("dst") + 1).alias("dst")))


@query
def adjacency_lists(spark, sf):
    return G.adjacency(G.undirected(X0.raw_edges(spark, sf))).select("u", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query
def degrees(spark, sf):
    return G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf))


@query
def degree_refresh(spark, sf):
    n = X0.raw_nodes(spark, sf)
    e = X0.raw_edges(spark, sf).join(n.select(F.col("id").alias("src"), "year"), "src")
    old = G.degrees(n, e.where(F.col("year") < YEAR - 1).select("src", "dst"))
    return G.refresh_degrees(old, e.where(F.col("year") >= YEAR - 1).select("src", "dst"))


@query
def csr_offsets(spark, sf):
    return G.csr_offsets(G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf)))


# Statistics


@query
def degree_stats(spark, sf):
    s = G.degree_stats(G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf)))
    return s.select(*[_r(c) for c in s.columns])


@query
def graph_density(spark, sf):
    d = G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf))
    return d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.round(F.sum("out_degree").cast("double") / (F.count("*").cast("double") * (F.count("*") - 1)), 12).alias("density"))


@query
def isolated_nodes(spark, sf):
    return G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf)).agg(F.count_if(F.col("in_degree") + F.col("out_degree") == 0).alias("isolated"))


@query
def degree_histogram(spark, sf):
    d = G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf))
    return d.groupBy((F.col("in_degree") + F.col("out_degree")).alias("degree")).agg(F.count("*").alias("nodes"))


@query
def powerlaw_alpha(spark, sf):
    d = G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf)).select((F.col("in_degree") + F.col("out_degree")).alias("d")).where("d > 0")
    return d.agg(F.round(1 + F.count("*") / F.sum(F.ln("d")), 9).alias("alpha"))


@query
def graph_statistics(spark, sf):
    return G.statistics(spark, X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf))


@query
def statistics_by_year(spark, sf):
    """The same report, kept over the years in which the nodes came."""
    n, e = X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf)
    e = G.cut(e.join(n.select(F.col("id").alias("src"), "year"), "src"), "dated")
    first = n.agg(F.min("year")).first()[0]
    kept = KeptStatistics(spark, n.where(F.col("year") <= first).select("id"), e.where(F.col("year") <= first).select("src", "dst"))
    for (year,) in n.select("year").distinct().where(F.col("year") > first).orderBy("year").collect():  # a row a year
        kept.add(n.where(F.col("year") == year).select("id"), e.where(F.col("year") == year).select("src", "dst"))
    return kept.report()


@query
def giant_component(spark, sf):
    g = G.giant_component(G.components(spark, X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf).toDF("u", "v")))
    return g.select("giant_size", "components", _r("giant_share"))


# Scores


@query
def age_histogram(spark, sf):
    return X0.raw_nodes(spark, sf).groupBy((F.lit(YEAR) - F.col("year")).alias("age")).agg(F.count("*").alias("nodes"))


@query
def pa_scores(spark, sf):
    return C.normalised(G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf)).select("id", "in_degree"), "in_degree", "pa").select("id", _r("pa", 14))


@query
def recency_scores(spark, sf):
    n = X0.raw_nodes(spark, sf)
    return C.recency_scores(n, X0.recency(n, YEAR), YEAR).select("id", _r("rec", 14))


@query
def fitness_decay(spark, sf):
    p = X0.table(spark, sf, "part")
    age, lag, peak, dur = F.col("p_size").cast("int"), (F.col("p_partkey") % 5).cast("int"), (1 + F.col("p_partkey") % 1000).cast("int"), (F.col("p_partkey") % 7).cast("int")
    return p.select("p_partkey", X.fitness_at(age, lag, peak, dur).alias("fitness"))


@query
def candidate_score(spark, sf):
    n = X0.raw_nodes(spark, sf)
    pa = C.normalised(G.degrees(n, X0.raw_edges(spark, sf)).select("id", "in_degree"), "in_degree", "pa")
    rows = pa.join(C.recency_scores(n, X0.recency(n, YEAR), YEAR), "id").withColumns({"fit": F.lit(0.001), "pa_weight": F.lit(0.33), "rec_weight": F.lit(0.33), "fit_weight": F.lit(0.33)})
    return rows.select("id", F.round(C.candidate_score(), 14).alias("score"))


# Draws


@query
def generator_pick(spark, sf):
    return _agents(spark, sf)[0].select("id", "generator")


@query
def outdegree_draw(spark, sf):
    return _agents(spark, sf)[0].select("id", "out_degree")


@query
def agent_weights(spark, sf):
    a = _agents(spark, sf, SimConfig(preferential_weight=-1, alpha=-1))[0]
    return a.select("id", *[_r(w, 12) for w in (*A.WEIGHTS, "alpha")])


@query
def same_year_flag(spark, sf):
    return _agents(spark, sf)[0].select("id", "same_year")


@query
def same_year_citation(spark, sf):
    a, n, size = _agents(spark, sf)
    return a.where("same_year").select("id", (F.lit(n) + pick(CFG.seed, F.col("id"), size, "own")).alias("cited"))


@query
def agent_params(spark, sf):
    a = _agents(spark, sf)[0]
    return a.select("growth_idx", "id", "generator", "same_year", "out_degree", *A.WEIGHTS, "alpha")


@query
def fitness_cdf(spark, sf):
    """The shares of peak values up to each, and the nodes that drew it."""
    drawn = A.draw_fitness(spark, X0.raw_nodes(spark, sf), CFG).groupBy(F.col("fitness_peak").alias("k")).agg(F.count("*").alias("nodes"))
    return A.fitness_cdf(spark, CFG.fitness_max, CFG.fitness_exponent).join(drawn, "k", "left").select("k", _r("hi", 10), F.coalesce("nodes", F.lit(0)).alias("nodes"))


@query
def fitness_draw(spark, sf):
    return A.draw_fitness(spark, X0.raw_nodes(spark, sf), CFG).select("id", "fitness_peak")


@query
def planted_nodes(spark, sf):
    _, n, size = _agents(spark, sf)
    rows = spark.range(n, n + size).select("id", (F.col("id") - n).alias("growth_idx"))
    return A.plant(rows, X0.planted_lines(spark, sf), 1, size)


@query
def events_in_ranges(spark, sf):
    """Launches and the ranges of other events they begin in: ranges of very different lengths."""
    e = X0.table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    lo = (i * 1000 + u * 7).cast("long")
    spans = e.where("event_id % 3 > 0").select(i.alias("span"), lo.alias("lo"), (lo + F.when(i % 100 == 1, 20_000).otherwise(u % 40 * 50)).alias("hi"))
    points = X0.kernels(spark, sf).select("event_id", (F.col("start") + F.col("event_id") % 17 * 90).alias("at"))
    return A.range_join(points, spans, "at", "lo", "hi").select("event_id", "span")


# Neighbourhood


def _starts(spark, sf):
    """The generators of a year's agents."""
    return _agents(spark, sf)[0].select(F.col("generator").alias("g")).distinct()


@query
def one_hop(spark, sf):
    return G.hops(_starts(spark, sf), G.undirected(X0.raw_edges(spark, sf))).where("hop = 1").select("g", "n")


@query
def two_hop(spark, sf):
    return G.hops(_starts(spark, sf), G.undirected(X0.raw_edges(spark, sf))).where("hop = 2").select("g", "n")


@query
def hop_sizes(spark, sf):
    h = G.hops(_starts(spark, sf), G.undirected(X0.raw_edges(spark, sf)))
    return h.groupBy("g").agg(F.count_if(F.col("hop") == 1).alias("h1"), F.count_if(F.col("hop") == 2).alias("h2"))


# Sampling and simulation


def _store(spark, sf) -> EdgeStore:
    """The store of the fixture's edges, written once an application."""
    key = spark.sparkContext.applicationId, sf
    if key not in _STORES:
        edges = X0.raw_edges(spark, sf)
        _STORES[key] = EdgeStore(spark, sized(spark, edges.count()))
        _STORES[key].add(edges, crowded(edges, _STORES[key].hub))
    return _STORES[key]


_STORES: dict[tuple[str, str], EdgeStore] = {}


def _epoch(spark, sf, cfg: SimConfig = CFG):
    n = X0.raw_nodes(spark, sf)
    nodes = simulate.with_fitness(spark, n, cfg)
    return simulate.epoch(spark, nodes, _store(spark, sf), _n(n), YEAR, cfg, X0.bag(spark, sf), X0.recency(n, YEAR), G.degrees(n, X0.raw_edges(spark, sf)))


def _first(spark, sf) -> tuple[DataFrame, DataFrame, int, int, EdgeStore]:
    """A year's agents, their first neighbourhoods and how many rows these have, the nodes, and the store."""
    a, n, size = _agents(spark, sf)
    a, store = G.cut(a, "agents"), _store(spark, sf)
    first = G.cut(simulate.first_hop(a.select("id", F.col("generator").alias("g")), store, size), "first")
    return a, first, first.count(), n, store


def _quotas(spark, sf) -> tuple[DataFrame, int]:
    """Quotas whose counts of second neighbourhoods stop at what an agent needs."""
    a, first, count, n, store = _first(spark, sf)
    inner = S.inner_quotas(a, first.groupBy("id").agg(F.count("*").alias("h1")), CFG.fully_random_citations)
    rows = simulate.second_hop(first, inner.where("need > 0").select("id", "need"), store, count)
    return S.outer_quotas(inner, S.capped_distinct(rows, "id", "v", "need", 20).select("id", F.col("n").alias("h2"))), n


@query
def citation_quota(spark, sf):
    return _quotas(spark, sf)[0].select("id", "reserved", "inside", "outside", "random")


@query
def weighted_topk(spark, sf):
    """For each agent as many of its neighbourhood as its out-degree, by popularity."""
    a, first, count, n, store = _first(spark, sf)
    scores = C.normalised(G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf)), "in_degree", "score").select(F.col("id").alias("node"), "score")
    most = a.select("id", F.col("out_degree").alias("most"))
    cand = first.join(most, "id").select("id", F.col("n").alias("node"), "most").unionByName(simulate.second_hop(first, most, store, count).select("id", F.col("v").alias("node"), "most"))
    rows = cand.join(G.small(scores, n), "node").withColumn("key", S.sampling_key(CFG.seed, F.col("id"), F.col("node"), F.col("score")))
    return S.top_by_key(rows, ["id"], "key", "node", "most", 20).select("id", "node")


@query
def uniform_fill(spark, sf):
    q, n = _quotas(spark, sf)
    need = G.cut(q.select("id", "generator", "random"), "need")
    return S.uniform_fill(spark, need, need.select("id", F.col("generator").alias("node")), n - 1, CFG.seed, CFG.slack)


@query
def simulate_one_year(spark, sf):
    return _epoch(spark, sf)[0]


@query
def batched_year(spark, sf):
    """The same year by batches of about a quarter of its agents."""
    return _epoch(spark, sf, SimConfig(max_batch=-(-_n(X0.raw_nodes(spark, sf)) * 3 // 400)))[0]


@query
def program_year(spark, sf):
    """A year by the program, from files to files: the edges of its sink, those it was given among them."""
    n = X0.raw_nodes(spark, sf)
    nodes, edges, grown, attributes = (_file(spark, x) for x in ("nodes", "edges", "grown", "attributes"))
    text.write_csv(n, nodes, ["#node", "year"])
    text.write_edges(X0.raw_edges(spark, sf).toDF("source", "target"), edges)
    bag = _bag_file(spark, X0.bag(spark, sf).withColumnRenamed("pos", "at"))
    recency = _lines_file(spark, "recency", X0.recency(n, YEAR).select(F.col("age").alias("at"), F.concat_ws(",", "age", "prob").alias("line")), "#age,probability")
    options = {"edgelist": edges, "nodelist": nodes, "out-degree-bag": bag, "recency-probabilities": recency, "output-file": grown, "auxiliary-information-file": attributes, "log-file": os.devnull}
    options |= {"growth-rate": CFG.growth_rate, "num-cycles": 1, "same-year-proportion": CFG.same_year_proportion, "alpha": CFG.alpha}
    options |= {"preferential-weight": CFG.preferential_weight, "recency-weight": CFG.recency_weight, "fitness-weight": CFG.fitness_weight, "seed": CFG.seed}
    program.main([x for k, v in options.items() for x in (f"--{k}", str(v))], spark)
    return text.read_edgelist(spark, grown)


@query
def epoch_edges(spark, sf):
    return _epoch(spark, sf)[0].groupBy("kind").agg(F.count("*").alias("edges"))


@query
def simulate_second_year(spark, sf):
    """The second of two years: its agents also cite those of the first."""
    n = X0.raw_nodes(spark, sf)
    _, edges = simulate.run(spark, n, X0.raw_edges(spark, sf), SimConfig(num_cycles=2), X0.bag(spark, sf), X0.recency(n, YEAR))
    return edges.where("cycle = 2").select("src", "dst", "kind")


@query
def simulate_three_years(spark, sf):
    n = X0.raw_nodes(spark, sf)
    _, edges = simulate.run(spark, n, X0.raw_edges(spark, sf), SimConfig(num_cycles=3), X0.bag(spark, sf), X0.recency(n, YEAR), X0.planted(spark))
    return edges.groupBy("cycle", "kind").agg(F.count("*").alias("edges"))


@query
def simulated_attributes(spark, sf):
    """The node sink of a simulated year, with its agents' attributes."""
    n = X0.raw_nodes(spark, sf)
    nodes, edges = simulate.run(spark, n, X0.raw_edges(spark, sf), SimConfig(num_cycles=1), X0.bag(spark, sf), X0.recency(n, YEAR))
    named = nodes.join(G.degrees(nodes, edges), "id").withColumns({"orig_id": F.col("id") * 2, "generator_id": F.col("generator") * 2})
    return text.attribute_frame(named).where("type = 'agent'").select("node_id", "year", "pa_weight", "fit_peak_value", "alpha", "out_degree", "assigned_out_degree", "planted_nodes_line_number", "generator_node_string")


@query
def final_graph_size(spark, sf):
    """The nodes after some years of growth from those there are."""
    n = _n(X0.raw_nodes(spark, sf))
    return spark.createDataFrame([(c, simulate.final_size(n, 0.03, c)) for c in (3, 10, 30)], "cycles int, nodes long")


@query
def er_gnp_edges(spark, sf):
    """The edges of a whole year's new nodes."""
    n = _n(X0.raw_nodes(spark, sf))
    return er.gnp_edges(spark, n, -(-n * 3 // 100), 0.001, CFG.seed)


@query
def er_edges_per_node(spark, sf):
    n = _n(X0.raw_nodes(spark, sf))
    return er.gnp_edges(spark, n, -(-n * 3 // 100), er.probability(SimConfig(er_edges_per_node=4.0), n), CFG.seed)


# Sinks


@query
def sink_edges(spark, sf):
    ids = X0.raw_nodes(spark, sf).select("id", (F.col("id") * 10 + 3).alias("orig_id"))
    return text.edge_frame(X0.raw_edges(spark, sf), ids).select(F.concat_ws(",", "source", "target").alias("line"))


def _numbered(spark, path: str) -> DataFrame:
    """The lines of a file and their places from 0."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    return rows.join(G.dense_ids(rows.select("at"), "at"), F.col("at") == F.col("orig_id")).select(F.col("seq_id").alias("line_no"), F.col("value").alias("line"))


@query
def sink_edge_file(spark, sf):
    """The edge sink's one file, line by line: its header, then the edges in order."""
    path = _file(spark, "edges")
    text.write_edges(X0.raw_edges(spark, sf).toDF("source", "target"), path)
    return _numbered(spark, path)


@query
def paper_table(spark, sf):
    """A report as a paper's table, line by line."""
    rows = X0.table(spark, sf, "lineitem").groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("flag_status"))
    rows = rows.agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"), F.max(F.when(F.col("l_returnflag") == "N", F.col("l_linenumber"))).alias("most")).orderBy("flag_status")
    path = _file(spark, "table")
    text.write_lines(spark, path, tables.latex(rows, "Lines by flag", "tab:flags").splitlines())
    return _numbered(spark, path)


@query
def sink_attributes(spark, sf):
    n = simulate.with_fitness(spark, X0.raw_nodes(spark, sf), CFG).join(G.degrees(X0.raw_nodes(spark, sf), X0.raw_edges(spark, sf)), "id")
    i = F.col("id").cast("double")
    n = n.withColumns({"orig_id": F.col("id"), "type": (F.col("id") % 2).cast("int"), "pa_weight": 1 / (i + 1), "rec_weight": i / 1e9, "fit_weight": F.lit(0.25), "alpha": (F.col("id") % 3) / F.lit(2.0), "assigned_out_degree": F.lit(7), "planted_line": F.when(F.col("id") % 10 == 1, 2), "generator_id": F.col("id") + 1})
    return text.attribute_frame(n)


@query
def general_format(spark, sf):
    """Doubles of all magnitudes as text."""
    x = F.col("l_extendedprice").cast("double") * F.pow(F.lit(10.0), (F.col("l_linenumber") * 5 - 20).cast("double")) * F.when(F.col("l_orderkey") % 2 == 0, -1).otherwise(1)
    return X0.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.general(X.round_even(x, 12)).alias("text"))


# Trace


def _named(spark, sf):
    return T.decode(X0.kernels(spark, sf), X0.strings(spark, sf), "name_id", "name")


@query
def trace_string_join(spark, sf):
    return _named(spark, sf).select("event_id", "name", (F.col("end") - F.col("start")).alias("ns"))


@query
def kernel_summary(spark, sf):
    s = T.kernel_summary(_named(spark, sf))
    return s.select("name", "calls", *[_r(c, 6) for c in s.columns[2:]])


@query
def memcpy_summary(spark, sf):
    s = T.copy_summary(X0.copies(spark, sf))
    return s.select("kind", "name", "ops", "bytes", "total", _r("mean", 6), "largest", _r("bandwidth", 6))


@query
def memset_total(spark, sf):
    return X0.copies(spark, sf).where("kind = 7").agg(F.count("*").alias("ops"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("dur"), F.lit(0)).alias("total"))


@query
def api_summary(spark, sf):
    s = T.api_summary(X0.calls(spark, sf), X0.strings(spark, sf))
    return s.select("name", "calls", "total_ns", _r("avg_ns", 6))


@query
def profiler_reports(spark, sf):
    """The main figures of the five reports of a profiler database that the query writes, and its named ranges."""
    path = X0.trace_parts(spark, sf)
    found = profile.session(spark, path, H.DEVICES["A30"])
    row = lambda df, kind, place, name, n, ms, share: df.select(F.lit(kind).alias("report"), place.cast("int").alias("place"), name.cast("string").alias("name"), n.cast("long").alias("n"), F.round(ms.cast("double"), 6).alias("ms"), F.round(share.cast("double"), 6).alias("share"))
    c, none = F.col, F.lit(None)
    rows = [
        row(found["kernels"], "kernels", c("place"), c("Kernel"), c("Launches"), c("Total_ms"), c("pct_GPU")),
        row(found["occupancy"], "occupancy", c("place"), c("Limiter"), c("Regs"), c("Avg_ms"), c("ThOcc_pct")),
        row(found["memcpy"], "memcpy", c("place"), c("Kind"), c("Ops"), c("Time_ms"), c("BW_GBs")),
        row(found["summary"], "summary", F.lit(1), F.lit("session"), c("Kernel_launches"), c("Session_ms"), c("GPU_util_pct")),
        row(found["summary"], "summary", F.lit(2), F.lit("copies"), none, c("Sync_ms"), c("Memcpy_ovh_pct")),
        row(found["gpu_util"], "gpu_util", F.lit(1), F.lit(profile.label_of(spark, path)), none, none, c("GPU_util_pct")),
        row(profile.ranges(spark, path), "ranges", none, c("name"), c("n"), c("total_ns") / 1e6, none),
        row(profile.capture(spark, path), "capture", none, F.concat_ws("@", "command", "host"), none, none, none),
    ]
    return reduce(DataFrame.unionByName, rows)


@query
def sync_summary(spark, sf):
    k = X0.kernels(spark, sf).withColumn("sync", (F.col("event_id") % 4).cast("int"))
    names = spark.createDataFrame([(0, "event"), (1, "stream wait"), (2, "stream")], "id int, value string")
    return T.decode(k, names, "sync", "label").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("total_ns"))


@query
def range_topk(spark, sf):
    e = X0.table(spark, sf, "events")
    label = F.coalesce(F.when(F.col("user_id") % 2 == 0, F.col("event_type")), F.concat(F.lit("user"), F.col("user_id").cast("string")))
    end = F.when(F.col("event_id") % 9 > 0, F.col("event_id") * 10 + F.col("user_id"))
    return T.ranges(e.select(label.alias("text"), F.when(F.col("event_id") % 11 > 0, F.col("event_id") * 10).alias("start"), end.alias("end")), 20)


@query
def positive_rows(spark, sf):
    k = X0.kernels(spark, sf).groupBy("name_id", "block").agg((F.sum(F.when(F.col("regs") > 60, F.col("end") - F.col("start")).otherwise(0)) / 1e6).alias("total"), F.count("*").alias("calls"))
    p = T.positive(k.where("block < 512"), "total", {"total": "Total_ms", "calls": "Launches"})
    return p.select("name_id", "block", _r("Total_ms", 6), "Launches")


@query
def busy_ratio(spark, sf):
    return X0.kernels(spark, sf).agg(F.round(T.busy_ratio(), 9).alias("ratio"))


@query
def time_decomposition(spark, sf):
    k = X0.kernels(spark, sf).agg(F.sum(F.col("end") - F.col("start")).cast("double").alias("kernel"), (F.max("end") - F.min("start")).cast("double").alias("wall"))
    c = X0.copies(spark, sf).agg(F.sum(F.when(F.col("kind") < 7, F.col("dur"))).cast("double").alias("copy"), F.sum(F.when(F.col("kind") == 7, F.col("dur"))).cast("double").alias("set"))
    rows = k.crossJoin(c).withColumn("other", M.breakdown(F.col("wall"), F.col("kernel"), F.col("copy"), F.col("set")))  # one row each
    return rows.select(*[_r(x, 3) for x in ("wall", "kernel", "copy", "set", "other")], F.round(F.try_divide(F.col("kernel"), F.col("wall")), 9).alias("kernel_share"))


@query
def launch_signature(spark, sf):
    s = T.launch_signatures(X0.launches(spark, sf), H.ARCHITECTURES["h100"])
    return s.withColumn("share", F.round("share", 6))


@query
def kernel_share(spark, sf):
    s = T.kernel_shares(X0.launches(spark, sf))
    return s.select("kernel", "launches", _r("total_s", 9), _r("share", 6), _r("grid", 6), _r("block", 6))


@query
def kernel_first_seen(spark, sf):
    return T.first_seen(X0.launches(spark, sf), H.DEVICES["H100"])


@query
def gpu_utilisation(spark, sf):
    """The sampled metric; then busy time, where no known metric was sampled, or nothing was; then neither."""
    k = X0.kernels(spark, sf)
    samples = X0.table(spark, sf, "events").select((F.col("event_id") % 5).cast("int").alias("metric_id"), F.col("value").cast("double").alias("value"))
    names = spark.createDataFrame([(1, "x"), (2, "SMs Active"), (3, "SM Active")], "metric_id int, name string")
    known = ["SM Active", "SMs Active", "SMs Active [Throughput %]"]
    cases = [(samples, names, known, k), (samples, names, ["y"], k), (None, None, known, k), (samples.where("metric_id = 9"), names, known, k), (None, names, known, None)]
    out = [M.utilisation(spark, *c).select(F.lit(i).alias("case"), F.round("percent", 9).alias("percent"), "approximate") for i, c in enumerate(cases)]
    return reduce(lambda a, b: a.unionByName(b), out)


@query
def session_metrics(spark, sf):
    k = X0.kernels(spark, sf).agg(F.sum(F.col("end") - F.col("start")).cast("double").alias("kernel"), (F.max("end") - F.min("start")).cast("double").alias("session"))
    c = X0.copies(spark, sf).agg(F.sum("bytes").cast("double").alias("bytes"), F.sum("dur").cast("double").alias("copy"))
    r = k.crossJoin(c)  # one row each
    d = F.try_divide
    return r.select(
        F.round(100 * d(F.col("kernel"), F.lit(0.8) * F.col("session")), 9).alias("util_scaled"), F.round(100 * d(F.col("kernel"), F.col("session")), 9).alias("util"),
        F.round(100 * d(F.col("copy"), F.col("kernel")), 9).alias("copy_over_kernel"), F.round(100 * d(F.col("copy"), F.col("copy") + F.col("kernel")), 9).alias("copy_share"),
        F.round(d(F.col("bytes"), F.col("copy")), 6).alias("bandwidth"), F.round(100 * d(d(F.col("bytes"), F.col("copy")), F.lit(3350.0)), 6).alias("peak_percent"),
    )


@query
def topn_per_group(spark, sf):
    s = X0.copies(spark, sf).groupBy("run", "kind").agg(F.sum("bytes").alias("bytes"))
    return T.top_per_group(s, ["run"], "bytes", "kind", 3)


@query
def custom_order(spark, sf):
    e = X0.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.withColumn("place", T.category_order(F.col("event_type"), ["purchase", "click"]))


@query
def cmdline_join(spark, sf):
    rows = X0.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("--p"), F.col("l_partkey").cast("string")).alias("arg"))
    return T.command_line(rows, "l_orderkey", "l_linenumber", "arg")


@query
def memcpy_kind_decode(spark, sf):
    return X0.copies(spark, sf).select("kind").distinct().withColumn("name", N.copy_kind(F.col("kind")))


@query
def memcpy_by_code(spark, sf):
    """Copies of every code there is, and of one without a name."""
    code = (F.col("l_linenumber") + F.col("l_orderkey") % 2 * 7).cast("int")
    rows = X0.table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 10 == 1, 0).otherwise(code).alias("kind"), F.floor("l_extendedprice").cast("long").alias("bytes"))
    return rows.groupBy("kind", N.copy_kind(F.col("kind")).alias("name")).agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"))


# Metrics

NAMES = [f"m{k}" for k in range(1, 8)]


@query
def metric_pivot(spark, sf):
    p = M.pivot_mean(X0.metrics(spark, sf), NAMES)
    return p.select("kernel", *[_r(n, 9) for n in NAMES])


@query
def memcpy_pivot(spark, sf):
    c = X0.copies(spark, sf).where("kind <> 3 OR run <> 'R'")
    p = M.pivot_sum(c, "run", "kind", "bytes", [1, 2, 3], "pos")
    return p.select("run", "place", *[F.col(str(k)).alias(f"k{k}") for k in (1, 2, 3)])


@query
def weighted_mean(spark, sf):
    return X0.metrics(spark, sf).groupBy("kernel", "metric").agg(F.round(M.weighted_mean("value", "weight"), 9).alias("mean"))


@query
def divergence_summary(spark, sf):
    return M.divergence(X0.divergent_launches(spark, sf))


@query
def report_cells(spark, sf):
    """Attributes with their defaults, and numbers as reports write them."""
    p = X0.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("size"), F.when(F.col("p_size") % 5 > 0, F.col("p_retailprice").cast("double")).alias("price"))
    big, every = (F.col("p_partkey") * 12_345).cast("double"), Window.partitionBy((F.col("p_partkey") % 3).alias("column"))
    big = F.when(F.col("p_partkey") % 3 == 0, big).when(F.col("p_partkey") % 3 == 1, F.col("p_partkey") * 2 + 0.5).otherwise((F.col("p_partkey") % 997) / F.lit(8.0))
    return p.select("p_partkey", X.attribute_or(F.col("size"), X.UNKNOWN_INT).cast("int").alias("size"), X.attribute_or(F.col("price"), X.UNKNOWN_DOUBLE).alias("price"), X.dash_for_none(F.col("size")).alias("cell"), X.by_magnitude(big, F.max(F.abs(big)).over(every)).alias("count"), X.elapsed(F.col("p_partkey") * 97).alias("elapsed"))


@query
def baseline_delta(spark, sf):
    d = M.baseline_delta(X0.metrics(spark, sf), "F")
    return d.select("kernel", "scenario", _r("mean", 9), _r("delta", 9))


@query
def health_flags(spark, sf):
    k = X0.kernels(spark, sf)
    o = H.occupancy(F.col("regs"), F.col("block"), F.col("shmem"), H.DEVICES["H100"])
    f = M.health_flags(o, F.col("event_id") % 20, F.col("grid") / F.lit(132.0), F.col("regs"), F.col("event_id") % 100)
    return k.select("event_id", *[v.alias(n) for n, v in f.items()])


@query
def clean_numeric(spark, sf):
    p = X0.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" 1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".5 "))).alias("raw"))
    return p.select("o_orderkey", X.clean_number(F.col("raw")).alias("value"))


@query
def lenient_cast(spark, sf):
    p = X0.table(spark, sf, "orders").select("o_orderkey", F.concat(F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("x"), F.lit("\t+")), (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_orderkey").cast("string"), F.lit("z9")).alias("raw"))
    return p.select("o_orderkey", X.lenient_int(F.col("raw")).alias("value"))


@query
def normalize_name(spark, sf):
    n = X0.launches(spark, sf).groupBy("name").agg(F.count("*").alias("launches"))
    c = F.col("name")
    return n.select("name", "launches", N.kernel_name(c).alias("short"), N.kernel_name_kept(c).alias("kept"), N.kernel_name_by_part(c).alias("by_part"))


@query
def infer_label(spark, sf):
    i = F.col("n_nationkey")
    y, g = (i + 1).cast("string"), (i % 6 + 1).cast("string")
    file = F.when(i % 4 == 0, F.concat(F.lit("/a/nsys-pa-"), y, F.lit("y-"), g, F.lit("p.sqlite"))).when(i % 4 == 1, F.concat(F.lit("NSYS"), y, F.lit("y_"), g, F.lit("p"))).when(i % 4 == 2, F.concat(F.lit("b/run_"), y, F.lit("y"), g, F.lit("p.csv"))).otherwise(F.lit("nsyspa-base.one.csv"))
    n = X0.table(spark, sf, "nation").select(file.alias("file"), "n_nationkey")
    return n.select("n_nationkey", N.run_label(F.col("file")).alias("label"), N.file_years(F.col("file")).alias("years"), N.file_agents(F.col("file")).alias("agents"))


@query
def scenario_grid(spark, sf):
    years, growth = (spark.createDataFrame([(v,) for v in vs], f"{n} int") for n, vs in (("years", (3, 10, 30)), ("growth", (1, 3, 5, 6))))
    have = X0.table(spark, sf, "nation").select((F.col("n_nationkey") % 6 + 1).cast("int").alias("growth"), F.element_at(F.array(F.lit(3), F.lit(10), F.lit(30)), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("years"))
    return years.crossJoin(growth).join(have, ["years", "growth"], "left_semi")  # 3 by 4 rows


# Hardware arithmetic


@query
def occupancy(spark, sf):
    k = X0.launches(spark, sf)
    regs, block, shared = F.col("regs"), F.col("block_x"), F.col("shared_static") + F.col("shared_dynamic")
    return k.select("event_id", H.occupancy(regs, block, shared, H.DEVICES["H100"]).alias("h100"), H.occupancy(regs, block, shared, H.from_device_row({"maxWarpsPerSm": 48, "maxShmemPerSm": 102400, "threadsPerWarp": 32}, H.DEVICES["A30"])).alias("by_row"))


@query
def occupancy_limiter(spark, sf):
    k = X0.launches(spark, sf)
    regs, block, shared = F.col("regs"), F.col("block_x") * F.col("block_y") * F.col("block_z"), F.col("shared_static") + F.col("shared_dynamic")
    percent, limiter = H.occupancy_by_least_limit(regs, block, shared, H.ARCHITECTURES["rtx4090"])
    return k.select("event_id", percent.alias("percent"), limiter.alias("limiter"), H.limiter_by_threshold(regs, block, shared).alias("by_threshold"))


@query
def roofline(spark, sf):
    q = F.col("l_quantity").cast("double")
    r = H.roofline(F.when(F.col("l_linenumber") > 1, q * 100), F.when(F.col("l_linenumber") < 6, q * 7), F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice").cast("double") / 100), F.col("l_partkey"), H.DEVICES["H100"])
    k = X0.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in r.items()])
    return k.select("l_orderkey", "l_linenumber", _r("ai", 9), _r("gflops", 9), F.round(H.roofline_ceiling(F.col("ai"), H.DEVICES["H100"]), 6).alias("ceiling"), "bound")


# Reports


def _phases(spark, sf):
    return X0.copies(spark, sf).select(F.concat(F.lit("phase"), F.col("kind").cast("string")).alias("phase"), F.col("dur").cast("double").alias("seconds"), F.col("bytes"))


@query
def epoch_stats(spark, sf):
    s = _phases(spark, sf).groupBy("phase").agg(*M.running_stats("seconds"))
    return s.select("phase", *[_r(c, 9) for c in s.columns[1:]])


@query
def time_distribution(spark, sf):
    return M.distribution(_phases(spark, sf), "phase", "seconds").select("phase", _r("seconds", 6), _r("percent", 9))


@query
def pipeline_breakdown(spark, sf):
    p = _phases(spark, sf).agg(F.sum("seconds").alias("total"), *[F.sum(F.when(F.col("phase") == f"phase{k}", F.col("seconds"))).alias(f"p{k}") for k in (1, 2, 3)], F.sum("bytes").cast("double").alias("edges"))
    return p.select("total", "p1", "p2", "p3", M.breakdown(F.col("total"), F.col("p1"), F.col("p2"), F.col("p3")).alias("unaccounted"), F.round(F.coalesce(F.try_divide(F.col("edges"), F.col("total")), F.lit(0.0)), 6).alias("rate"))
