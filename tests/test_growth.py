"""The edge store, counts and samples that stop at a column's value, and fills by rank."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papergrove.operators import graph as G
from papergrove.operators import metrics as M
from papergrove.operators import sampling as S
from papergrove.operators.kept import KeptStatistics
from papergrove.operators.store import EdgeStore, buckets_for, crowded, sized
from papergrove.plans import simulate


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def degrees_of(spark, rows):
    return G.degrees(spark.createDataFrame([(v,) for v in sorted({x for r in rows for x in r})], "id long"), edges_of(spark, rows))


@pytest.mark.parametrize("hub,most_runs", [(1 << 20, 16), (6, 16), (6, 2)])
def test_store_gives_all_neighbours(spark, hub, most_runs):
    """Hubs, also such that become one in a later year, and merged runs."""
    rng, store, rows = random.Random(hub), EdgeStore(spark, 3, hub, 5, most_runs), []
    for _ in range(4):
        new = [(rng.randrange(1, 40), 0 if rng.random() < 0.4 else rng.randrange(40)) for _ in range(30)]
        rows += new
        store.add(edges_of(spark, new), degrees_of(spark, rows))
    assert store.runs <= most_runs + 1 and (hub > 6) == (store.n_hubs == 0)
    want = Counter((k, v) for k in range(-1, 45) for a, b in rows for u, v in ((a, b), (b, a)) if u == k)
    probe = spark.range(-1, 45).select(F.col("id").alias("g"), (F.col("id") * 2).alias("tag"))
    for count in (None, 46):
        got = store.expand(probe, "g", count).collect()
        assert Counter((r["g"], r["v"]) for r in got) == want and all(r["tag"] == 2 * r["g"] for r in got)
    assert Counter(tuple(r) for r in store.neighbours().collect()) == want
    store.drop()


def test_edges_of_ten_years_are_not_shuffled(spark):
    store = EdgeStore(spark, 4)
    for year in range(10):
        store.add(edges_of(spark, [(year * 10 + k, k) for k in range(1, 9)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.expand(spark.range(100).toDF("g").repartition(3), "g")._jdf.queryExecution().executedPlan().toString()
        assert store.runs == 10 and store.expand(spark.range(100).toDF("g"), "g").count() == 160
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[: plan.index("FileScan parquet spark_catalog")].splitlines()
    above, indent = [], len(scan[-1])
    for line in reversed(scan):  # the nodes above the scan of edges, up to the join
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if depth < indent:
            above.append(line)
            indent = depth
    until = next(k for k, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[:until]) and "Exchange" in plan
    assert buckets_for(0) == 1 and buckets_for(10_000_000) == 5
    store.drop()


def test_buckets_grow_with_the_edges_and_only_crowded_cells_are_counted(spark):
    assert sized(spark, 100) == 4 and sized(spark, 100_000_000) == 191
    rows = [(k, 0) for k in range(1, 60)] + [(7, k) for k in range(100, 130)] + [(1, 2)]
    got = {r["id"]: (r["in_degree"], r["out_degree"]) for r in crowded(edges_of(spark, rows), 25, 1 << 12).collect()}
    assert got[0] == (59, 0) and got[7] == (0, 31) and len(got) < 10
    assert crowded(edges_of(spark, rows), 1000).count() == 0


def test_first_and_second_neighbours_by_agent(spark):
    rows = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 3), (5, 6), (6, 1), (7, 7)]
    store = EdgeStore(spark, 2)
    store.add(edges_of(spark, rows))
    starts = spark.createDataFrame([(100, 1), (101, 1), (102, 7), (103, 9)], "id long, g long")
    first = simulate.first_hop(starts, store).cache()
    assert {(r["id"], r["n"]) for r in first.collect()} == {(i, n) for i in (100, 101) for n in (2, 5, 6)}
    among = spark.createDataFrame([(100, 7)], "id long, need int")
    for count in (first.count(), 10**9):
        assert {tuple(r) for r in simulate.second_hop(first, among, store, count).select("id", "v", "need").collect()} == {(100, 3, 7)}
    store.drop()


def test_capped_counts_stop_at_the_cap(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(12), g % 9) for g in range(40) for _ in range(rng.randrange(40))]
    df = spark.createDataFrame(rows, "g long, item long, cap int").repartition(7)
    want = {g: min(c, len({i for x, i, _ in rows if x == g})) for g, _, c in rows if c}
    assert {r["g"]: r["n"] for r in S.capped_distinct(df, "g", "item", "cap", 8).collect()} == want
    plan = S.capped_distinct(df, "g", "item", "cap", 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Partial", plan.index("WindowGroupLimit"))  # cut before the shuffle and after it


def test_samples_count_an_item_once(spark):
    rng = random.Random(5)
    rows = [(g, i, float(hash((g, i)) % 97), 1 + g % 4) for g in range(30) for i in (rng.randrange(15) for _ in range(40))]
    df = spark.createDataFrame(rows, "g long, item long, key double, most int").repartition(6)
    got = sorted((r["g"], r["item"]) for r in S.top_by_key(df, ["g"], "key", "item", "most", 4).collect())
    want = []
    for g in range(30):
        mine = sorted({(-k, i) for x, i, k, _ in rows if x == g})[: 1 + g % 4]
        want += [(g, i) for _, i in mine]
    assert got == sorted(want)


@pytest.mark.parametrize("domain,need,slack", [(6, 2, 0), (5, 4, 0), (9, 3, 1)])
def test_fills_follow_the_law_of_sets(spark, domain, need, slack):
    """All sets of free nodes are drawn equally often, whether by draws or by rank."""
    agents = 6000
    free = [v for v in range(domain) if v not in (1, 3)]
    a = spark.range(agents).select("id", F.lit(need).alias("random"))
    taken = spark.range(agents).select("id", F.explode(F.array(*[F.lit(v).cast("long") for v in (1, 3, domain + 4)])).alias("node"))
    by = {}
    for r in S.uniform_fill(spark, a, taken, domain, 7, slack).collect():
        by.setdefault(r["id"], []).append(r["node"])
    assert len(by) == agents and all(len(v) == len(set(v)) == min(need, len(free)) and set(v) <= set(free) for v in by.values())
    sets = list(itertools.combinations(free, min(need, len(free))))
    seen = Counter(tuple(sorted(v)) for v in by.values())
    mean = agents / len(sets)
    assert sum((seen[s] - mean) ** 2 / mean for s in sets) < len(sets) + 5 * (2 * len(sets)) ** 0.5
    assert S.uniform_fill(spark, a, taken, 0, 7, slack).count() == 0


def test_fills_by_rank_are_one_plan(spark, tmp_path, monkeypatch):
    """No table is written, and what draws leave short is what a plain walk over ranks gives."""
    monkeypatch.setattr(G, "cut", lambda *a, **k: pytest.fail("a written table"))
    a = spark.createDataFrame([(k, 60) for k in range(50)], "id long, random int")
    got = {}
    for r in S.uniform_fill(spark, a, a.select("id", F.col("id").alias("node")), 80, 7, 0).collect():
        got.setdefault(r["id"], set()).add(r["node"])
    assert all(len(v) == 60 and k not in v and max(v) < 80 and min(v) >= 0 for k, v in got.items())


def test_kept_statistics_are_those_of_the_whole_graph(spark):
    rng = random.Random(11)
    nodes, edges, kept = list(range(20)), [(k, k // 2) for k in range(1, 12)], None
    for year in range(4):
        if year:
            born = list(range(len(nodes), len(nodes) + 8))
            new = sorted({(rng.choice(born), rng.choice(nodes + born)) for _ in range(14)} - set(edges))
            kept.add(spark.createDataFrame([(b,) for b in born], "id long"), edges_of(spark, new))
            nodes, edges = nodes + born, edges + new
        else:
            kept = KeptStatistics(spark, spark.createDataFrame([(k,) for k in nodes], "id long"), edges_of(spark, edges))
        n, e = spark.createDataFrame([(k,) for k in nodes], "id long"), edges_of(spark, edges)
        assert {r[0]: r[1] for r in kept.report().collect()} == pytest.approx({r[0]: r[1] for r in G.statistics(spark, n, e).collect()}, abs=1e-8)
        assert {tuple(r) for r in kept.roots.collect()} == {tuple(r) for r in G.components(spark, n, G.undirected(e)).collect()}
        assert sorted(map(tuple, kept.degrees.collect())) == sorted(map(tuple, G.degrees(n, e).collect()))
    kept.drop()


def test_phases_are_counted_by_the_jobs_that_write(spark):
    phases = G.Phases()
    phases.label = "year 1"
    assert phases.cut(spark.range(50), "x", None, "edges").count() == 50 and phases.last() == 50
    phases.timed("store", lambda: None, 7)
    assert [(r[0], r[1], r[3]) for r in phases.rows] == [("year 1", "edges", 50), ("year 1", "store", 7)]
    lines = M.epoch_report(spark, [("year 1", 4.0), ("year 2", 6.0)], [("year 1", "edges", 1.0, 50), ("year 1", "store", 2.0, 7), ("year 2", "edges", 3.0, 150)])
    assert lines == [
        "years: total=10.0 s mean=5.0 std=1.0 min=4.0 max=6.0", "year 1: 4.0 s (40.0 %), 1.0 s residual, 50 edges", "year 2: 6.0 s (60.0 %), 3.0 s residual, 150 edges",
        "phase edges: 4.0 s (40.0 %) mean=2.00 std=1.00 min=1.00 max=3.00, 200 rows", "phase store: 2.0 s (20.0 %) mean=2.00 std=0.00 min=2.00 max=2.00, 7 rows", "200 new edges, 20 a second",
    ]


def test_degrees_of_a_stream(spark, tmp_path):
    """Edges that arrive in files: the table the stream keeps is that of all edges."""
    from papergrove.streaming.edges import running_degrees

    rows = [(k, k // 3) for k in range(1, 30)]
    for k in range(3):
        edges_of(spark, rows[k::3]).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = running_degrees(arriving).writeStream.outputMode("complete").format("memory").queryName("degrees_seen").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert len(run.recentProgress) > 1
    assert sorted(map(tuple, spark.table("degrees_seen").collect())) == sorted(map(tuple, degrees_of(spark, rows).collect()))


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_offsets_are_sums_of_what_is_before(spark, block):
    rows = [(k * 7 % 101, k % 5) for k in range(60)]
    deg = spark.createDataFrame(rows, "id long, out_degree int")
    got = {r["id"]: (r["offset"], r["degree"]) for r in G.csr_offsets(deg, block).collect()}
    assert got == {i: (sum(d for j, d in rows if j < i), d) for i, d in rows}


def test_components_keep_an_edge_once_and_read_the_nodes_once(spark, monkeypatch):
    rng, written = random.Random(5), []
    pairs = [(a, b) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(70))] + [(k + 1, k) for k in range(100, 130)] + [(7, 7), (100, 101)]
    up = {k: k for k in range(131)}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    cut = G.cut

    def counted(df, name, *rest):
        table = cut(df, name, *rest)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(G, "cut", counted)
    found = G.components(spark, spark.range(131), spark.createDataFrame(pairs, "u long, v long"))
    assert {r["id"]: r["component"] for r in found.collect()} == {k: top(k) for k in range(131)}
    assert written[0][1] <= len(pairs) and [n for name, n in written if name == "roots"] == [131]
