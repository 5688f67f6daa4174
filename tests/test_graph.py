import hashlib
import io
import math
import os
import re
from dataclasses import replace
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from papergrove.config import SimConfig, from_args, parser
from papergrove.functions import hardware as H
from papergrove.functions import names as N
from papergrove.functions import scalar as X
from papergrove.functions.draws import draws
from papergrove.operators import agents as A
from papergrove.operators import graph as G
from papergrove.operators import metrics as M
from papergrove.operators import sampling as S
from papergrove.plans import er, simulate
from papergrove.sources import profiler, text
from papergrove.sources.log import Log, prefix
from papergrove.sources.tables import latex
from papergrove.streaming.edges import running_degrees

SF = "/root/testdata/sf0.001"


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def ids(spark, *values):
    return spark.createDataFrame([(v, 2000) for v in values], "id long, year int")


def test_components_hops_and_degrees(spark):
    e = edges(spark, [(1, 2), (2, 3), (4, 5), (6, 6)])
    n = ids(spark, 1, 2, 3, 4, 5, 6, 7)
    und = G.undirected(e)
    assert {r["id"]: r["component"] for r in G.components(spark, n, und).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    hops = {(r["g"], r["n"]): r["hop"] for r in G.hops(spark.createDataFrame([(1,), (4,)], "g long"), und).collect()}
    assert hops == {(1, 2): 1, (1, 3): 2, (4, 5): 1}
    deg = {r["id"]: (r["in_degree"], r["out_degree"]) for r in G.degrees(n, e).collect()}
    assert deg[2] == (1, 1) and deg[7] == (0, 0) and deg[6] == (1, 1)
    assert {r["id"]: r["in_degree"] for r in running_degrees(e).collect()}[3] == 1


def test_dense_ids_and_encoding(spark):
    ids_ = spark.createDataFrame([(v,) for v in (30, 10, 20, 10)], "id long")
    m = G.dense_ids(ids_)
    assert sorted(map(tuple, m.collect())) == [(10, 0), (20, 1), (30, 2)]
    got = G.encode_edges(edges(spark, [(10, 30), (10, 30), (10, 99)]), m.select("orig_id", "seq_id"))
    assert [tuple(r) for r in got.collect()] == [(0, 2)]


def test_text_round_trip(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_bytes(b"#source\ttarget\r\n1\t2\r\n\r\n 3\t4x\r\n1\t2\r\n")
    assert text.sniff(spark, str(p)) == "\t"
    assert sorted(map(tuple, text.read_edgelist(spark, str(p)).collect())) == [(1, 2), (1, 2), (3, 4)]
    (tmp_path / "n.csv").write_text("#node,year\n5,1999\n6,2000\n5,2001\n")
    assert sorted(map(tuple, text.read_nodelist(spark, str(tmp_path / "n.csv")).collect())) == [(5, 2001), (6, 2000)]
    (tmp_path / "bad.csv").write_text("abc\n")
    with pytest.raises(ValueError):
        text.sniff(spark, str(tmp_path / "bad.csv"))
    out = str(tmp_path / "out")
    text.write_edges(spark.createDataFrame([(2, 1), (1, 5)], "source int, target int"), out)
    assert sorted(map(tuple, text.read_edgelist(spark, out).collect())) == [(1, 5), (2, 1)]
    (tmp_path / "b.csv").write_text("#i,d\n0,4\n1,9\n")
    assert [tuple(r) for r in text.read_bag(spark, str(tmp_path / "b.csv")).collect()] == [(0, 4), (1, 9)]
    (tmp_path / "p.csv").write_text("1,0,900,5,3\n")
    assert [tuple(r) for r in text.read_planted(spark, str(tmp_path / "p.csv")).collect()] == [(1, 1, 0, 900, 5, 3)]
    assert text.read_planted(spark, None).count() == 0
    (tmp_path / "m.csv").write_text("==PROF== x\n\"Kernel Name\",\"Metric Name\",\"Metric Value\"\n\"k\",\"m\",\"1,234.5\"\nbroken\n")
    assert [(r["kernel"], r["value"]) for r in text.read_metric_csv(spark, str(tmp_path / "m.csv"), None).collect()] == [("k", 1234.5)]


def test_sqlite(spark, tmp_path):
    import sqlite3

    p = str(tmp_path / "t.sqlite")
    with sqlite3.connect(p) as c:
        c.execute("CREATE TABLE StringIds (id INTEGER, value TEXT)")
        c.execute("INSERT INTO StringIds VALUES (1, 'a')")
    assert [tuple(r) for r in profiler.sqlite_table(spark, p, "StringIds").collect()] == [(1, "a")]
    assert profiler.sqlite_table(spark, p, "other") is None
    assert profiler.register_all(spark, p) == ["StringIds"]
    with sqlite3.connect(p) as c:
        c.execute("CREATE TABLE TARGET_INFO_GPU (id INTEGER, memoryBandwidth INTEGER, maxWarpsPerSm INTEGER, threadsPerWarp INTEGER)")
        c.execute("INSERT INTO TARGET_INFO_GPU VALUES (0, 936000000000, 48, 32)")
        c.executemany("INSERT INTO StringIds VALUES (?, 'b')", [(k,) for k in range(2, 8)])
    hw = profiler.hardware(spark, p, H.DEVICES["A30"])
    assert (hw.bandwidth, hw.warps, hw.threads, hw.blocks) == (936.0, 48, 1536, 32)
    assert profiler.sqlite_table(spark, p, "StringIds", partitions=3).count() == 7  # in parts of three


@pytest.mark.parametrize("d, sy, h1, h2, want", [(1, True, 5, 5, (0, 0, -1, 0)), (0, False, 5, 5, (0, 0, -1, 0)), (20, False, 2, 3, (1, 2, 3, 14)), (10, True, 50, 50, (0, 4, 4, 0))])
def test_quota(spark, d, sy, h1, h2, want):
    a = spark.createDataFrame([(1, d, sy, 0.5)], "id long, out_degree int, same_year boolean, alpha double")
    q = S.quotas(a, spark.createDataFrame([(1, h1, h2)], "id long, h1 long, h2 long"), 0.05).first()
    assert (q["reserved"], q["inside"], q["outside"], q["random"]) == want


def test_uniform_fill_falls_back_to_all_nodes(spark):
    need = spark.createDataFrame([(1, 9)], "id long, random int")
    got = S.uniform_fill(spark, need, edges(spark, [(1, 0)]).toDF("id", "node"), 10, 7, 0)
    assert sorted(r["node"] for r in got.collect()) == list(range(1, 10))


def test_weighted_sample_prefers_scores(spark):
    rows = spark.range(200).select(F.col("id").alias("agent")).crossJoin(spark.createDataFrame([(0, 1.0), (1, 9.0)], "node int, score double"))
    rows = rows.withColumn("key", S.sampling_key(7, F.col("agent"), F.col("node"), F.col("score"))).withColumn("most", F.lit(1))
    n = S.top_by_key(rows, ["agent"], "key", "node", "most", 1).where("node = 1").count()
    assert 160 <= n <= 198


def test_planted_needs_room(spark):
    plan = spark.createDataFrame([(1, 1, 0, 9, 9, 5)], "year int, line_no int, lag int, peak int, dur int, count int")
    with pytest.raises(ValueError):
        A.plant(spark.range(3).select("id", F.col("id").alias("growth_idx")), plan, 1, 3)


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    got = value(spark, X.lenient_int(F.lit(" +12a")), X.lenient_int(F.lit("x")), X.clean_number(F.lit(" 1,234.5 ")), X.fitness_at(F.lit(3), F.lit(0), F.lit(100), F.lit(0)), X.elapsed(F.lit(90061)))
    assert got == (12, 0, 1234.5, 1, "1-1:1:1")
    for x in (0.0, 1.0, -0.5, 5e-05, 1 / 3, 123456789012.0, 1e10, 9999999999.0, 1e-4, 12345.678901234, -2.5e-7, 1e300):
        assert value(spark, X.general(F.lit(x))) == (f"{x:.10g}",)


#: As the original's tables have it: code and name.
COPY_KINDS = {0: "Unknown", 1: "H2D", 2: "D2H", 3: "H2A", 4: "A2H", 5: "A2A", 6: "A2D", 7: "D2A", 8: "D2D", 9: "H2H", 10: "P2P", 11: "UVM_H2D", 12: "UVM_D2H", 13: "UVM_D2D", 14: "kind14"}


def test_copy_kinds(spark):
    rows = spark.createDataFrame([(k,) for k in COPY_KINDS], "k int")
    assert {r["k"]: r["n"] for r in rows.select("k", N.copy_kind(F.col("k")).alias("n")).collect()} == COPY_KINDS


@pytest.mark.parametrize("regs, block, shared, percent, limiter, by_threshold", [
    (32, 256, 0, 100.0, "reg", "thr"), (0, 256, 0, 100.0, "thr", "thr"), (32, 0, 0, 0.0, "blk", "block"), (48, 256, 1024, 62.5, "reg", "reg"), (32, 65, 0, 98.4, "reg", "thr"), (40, 32, 0, 50.0, "shmem", "block"),
    (16, 1024, 70_000, 50.0, "shmem", "shmem"), (255, 1024, 0, 0.0, "reg", "reg"), (41, 64, 0, 65.6, "reg", "reg"),
])
def test_occupancy(spark, regs, block, shared, percent, limiter, by_threshold):
    r, b, s = F.lit(regs), F.lit(block), F.lit(shared)
    hw = replace(H.DEVICES["H100"], shared=98_304) if shared == 70_000 else H.DEVICES["H100"]
    _, name = H.occupancy_by_least_limit(r, b, s, replace(hw, shared_unit=128))
    plain = min((2048 // max(block, 1), 65536 // (-(-regs * 32 // 256) * 256 * max(1, -(-block // 32))) if regs else 32, hw.shared // (-(-shared // 256) * 256) if shared else 32, 32)) * -(-block // 32)
    assert round(min(plain / 64, 1) * 100, 1) == percent or block == 65
    want = round(min(plain / 64, 1) * 100, 1) if block else 0.0
    assert value(spark, H.occupancy(r, b, s, hw), H.limiter_by_threshold(r, b, s)) == (want, by_threshold)
    if block:
        assert value(spark, name) == (limiter,)


def test_hardware_follows_the_device_table():
    a30 = H.DEVICES["A30"]
    hw = H.from_device_row({"memoryBandwidth": 2e12, "maxWarpsPerSm": 48, "maxBlocksPerSm": 0, "threadsPerWarp": 32}, a30)
    assert (hw.bandwidth, hw.warps, hw.blocks, hw.threads, hw.registers) == (2000.0, 48, 32, 1536, 65536) and hw.ridge == a30.peak / 2000.0
    assert H.from_device_row({}, a30).threads == 2048


def test_names(spark):
    for raw, short, kept, by_part in (
        ("void kernelCallStage1_warped<int>(int*)", "Stage1", "Stage1", "kernelCallStage1"), ("void a::b::run<int>(int)", "run", "run", "void a::b::run<int>(int)"), ("x KERNELCALLSTAGE2", "x KERNELCALLSTAGE2", "Stage2", "x KERNELCALLSTAGE2"),
        ("cub::x::DeviceScanKernel", "cub::DeviceScan", "cub::x", "cub::x::DeviceScanKernel"), ("legacy::insert_if_n", "legacy::insert_if_n"[8:], "insert_if_n", "legacy::insert"), ("a::", "a", "", "a::"), ("n" * 60, "n" * 30, "n" * 60, "n" * 50),
    ):
        c = F.lit(raw)
        assert value(spark, N.kernel_name(c), N.kernel_name_kept(c), N.kernel_name_by_part(c)) == (short, kept, by_part)
    for path, label, years, agents in (("/x/nsys-pa-3y-6p.sqlite", "3y/6%", 3, 6), ("NSYS30y_1p.csv", "30y/1%", None, None), ("run_3y6p.csv", "run_3y6p", None, None), ("d/ncu-er-gnp-30y-5p-details.csv", "30y/5%", 30, 5)):
        assert value(spark, N.run_label(F.lit(path)), N.file_years(F.lit(path)), N.file_agents(F.lit(path))) == (label, years, agents)


def test_weights_are_divided_by_their_sum(spark):
    cfg = SimConfig(preferential_weight=2.0, recency_weight=1.0, fitness_weight=1.0)
    bag = spark.createDataFrame([(0, 3)], "pos long, out_degree int")
    assert {tuple(r) for r in A.cohort(spark, 50, 5, cfg, bag, 1).select(*A.WEIGHTS).collect()} == {(0.5, 0.25, 0.25)}


def test_same_year_takes_the_least_by_hash(spark):
    for size, share in ((7, 0.5), (5000, 0.12), (10, 0.0), (10, 1.0)):
        cfg = SimConfig(same_year_proportion=share)
        key = lambda i: (int(hashlib.md5(f"7:{i}:sameyear".encode()).hexdigest()[:8], 16), i)
        assert sorted(r["id"] for r in A.same_year(spark, 90, size, cfg).collect()) == sorted(sorted(range(90, 90 + size), key=key)[: math.floor(size * share)])


def test_divergence(spark):
    rows = [("a", 16.0, 8.0, 90.0, 10.0, 1.0, 3.0), ("a", 32.0, 8.0, None, 10.0, 4.0, 1.0), ("b", 10.0, None, None, 8.0, 2.0, None), ("b", 20.0, None, None, None, None, 5.0), ("c", None, None, None, 0.0, 0.0, 1.0)]
    got = {r["kernel"]: tuple(r)[1:] for r in M.divergence(spark.createDataFrame(rows, "kernel string, active double, pred_on double, uniform double, targets double, divergent double, duration double")).collect()}
    assert got == {"a": (2, 20.0, 62.5, 8.0, 25.0, 90.0, 10.0, 25.0), "b": (2, 15.0, 46.9, None, None, None, 25.0, 25.0), "c": (1, None, None, None, None, None, None, None)}


def test_roofline(spark):
    hw = H.DEVICES["H100"]
    r = lambda *x: value(spark, *H.roofline(*map(F.lit, x), hw).values())
    assert r(50.0, 50.0, 100.0, 4.0) == (2.0, pytest.approx(50.0), "memory") and r(1000.0, 0.0, 100.0, 4.0)[2] == "compute" and r(0.0, 0.0, 100.0, 4.0) == (None, None, None) and r(5.0, 0.0, 0.0, 4.0)[0] is None


def test_utilisation_falls_back(spark):
    samples = spark.createDataFrame([(1, 40.0), (1, 60.0), (2, 5.0)], "metric_id int, value double")
    names = spark.createDataFrame([(1, "SM Active"), (2, "other")], "metric_id int, name string")
    kernels = spark.createDataFrame([(0, 10), (30, 40)], "start long, end long")
    u = lambda *a: tuple(M.utilisation(spark, *a).first())
    assert u(samples, names, ["SM Active"], kernels) == (50.0, False) and u(samples, names, ["none"], kernels) == (50.0, True) and u(None, names, ["SM Active"], None) == (None, True)
    assert u(None, None, [], kernels.where("start < 0")) == (None, True)


def test_metric_files(spark, tmp_path):
    (tmp_path / "run-3y-1p-details.csv").write_text('\ufeff==PROF== a, b\n"ID","Kernel Name","Metric Name","Metric Unit","Metric Value"\n1,"k<a, b>","dram__bytes.sum","byte","1,234.5"\n2,"k<a, b>","unknown","u","5"\n3,"k","dram__bytes.sum","byte","n/a"\ncut,off\n')
    (tmp_path / "run-base-details.csv").write_text("Kernel Name,Metric Name,Metric Value\nk,launch__grid_size,7\n")
    got = text.read_metric_files(spark, str(tmp_path / "run-*-details.csv")).collect()
    assert sorted((r["kernel"], r["metric"], r["value"], r["years"], r["agents"], r["source"]) for r in got) == [("k", "grid_size", 7.0, None, None, "run-base-details.csv"), ("k<a, b>", "dram_bytes", 1234.5, 3, 1, "run-3y-1p-details.csv")]
    (tmp_path / "w.csv").write_text('ID,"Function Name","m 1"\n1,"k(int, int)","1,000"\n2,cut\n3,q,x\n')
    assert sorted(map(tuple, text.read_wide_csv(spark, str(tmp_path / "w.csv"), {"m 1": "a", "m 2": "b"}).collect())) == [("k(int, int)", 1000.0, None), ("q", None, None)]
    for bad in (lambda: text.read_metric_csv(spark, str(tmp_path / "w.csv")), lambda: text.read_metric_files(spark, str(tmp_path / "none*")), lambda: text.read_wide_csv(spark, str(tmp_path / "run-base-details.csv").replace("run-base-details", "x"), {})):
        with pytest.raises(Exception):
            bad()


def test_reports(spark, tmp_path):
    util = spark.createDataFrame([(12.345, 1.0)], "GPU_util_pct double, Memcpy_ovh_pct double")
    path, = profiler.write_reports(str(tmp_path), "run", {"gpu_util": {"3y/1%": util, "3y/3%": util}})
    lines = sorted(lines_of(tmp_path / "run_gpu_util.csv"))
    assert path.endswith("run_gpu_util.csv") and lines == [f"3y/1%,{12.345:.2f},1.00", f"3y/3%,{12.345:.2f},1.00", "Label,GPU_util_pct,Memcpy_ovh_pct"]


def test_paper_table(spark):
    df = spark.createDataFrame([("a_b", 1234, 0.5), (None, 2, None)], "name string, n long, share double")
    got = latex(df, "Runs", "t1").splitlines()
    assert got[4] == r"\begin{tabular}{lrr}" and got[8:10] == [r"a\_b & 1,234 & 0.50 \\", r"- & 2 & - \\"]
    with pytest.raises(ValueError):
        latex(df, "Runs", "t1", most=1)


def test_log_lines():
    out = io.StringIO()
    log = Log(out, 0)
    log("kept")
    log("too fine", 1)
    assert prefix(0, 90061.7) == "[INFO][1-1:1:1](t=90061s)" and out.getvalue() == "[INFO][0-0:0:0](t=0s) kept\n"


def lines_of(folder):
    if folder.is_file():
        return folder.read_text().splitlines()
    return [x for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()]


def test_program_from_files_to_files(spark, tmp_path):
    """The hand-written files: comments, CRLF, tabs, a repeated node (the last counts), unknown ends, repeated edges, a loop."""
    from papergrove.__main__ import main

    f = {n: tmp_path / n for n in ("edges.tsv", "nodes.csv", "bag.csv", "recency.csv", "planted.csv", "out", "aux", "log")}
    f["nodes.csv"].write_text("#node,year\n" + "".join(f"{10 * k},{1990 + k % 5}\n" for k in range(1, 41)) + "400,1990\n")
    pairs = [(10 * k, 10 * j) for k in range(2, 41) for j in (k - 1, k // 2) if j]
    f["edges.tsv"].write_bytes(("#source\ttarget\r\n" + "".join(f"{a}\t{b}\r\n" for a, b in pairs) + "20\t10\r\n\r\n30\t30\r\n30\t999\r\n").encode())
    f["bag.csv"].write_text("#index,degree\n0,1\n1,6\n2,9\n")
    f["recency.csv"].write_text("#age,prob\n1,0.5\n2,0.3\n5,0.2\n")
    f["planted.csv"].write_text("1,2,700,3,1\n2,0,900,4,1\n")
    args = {"--edgelist": "edges.tsv", "--nodelist": "nodes.csv", "--out-degree-bag": "bag.csv", "--recency-probabilities": "recency.csv", "--planted-nodes": "planted.csv", "--output-file": "out", "--auxiliary-information-file": "aux", "--log-file": "log"}
    argv = [x for k, v in args.items() for x in (k, str(f[v]))] + "--growth-rate 0.1 --num-cycles 2 --same-year-proportion 0.25 --preferential-weight 2 --recency-weight 1 --fitness-weight 1 --alpha 0.5 --log-level 2".split()
    main(argv, spark)
    edges_ = [tuple(map(int, x.split(","))) for x in lines_of(f["out"]) if not x.startswith("#")]
    seeds = {p for p in pairs} | {(30, 30)}
    assert lines_of(f["out"])[0] == "#source,target" and edges_ == sorted(edges_) and len(set(edges_)) == len(edges_) and seeds <= set(edges_)
    new = [e for e in edges_ if e not in seeds]
    assert {a for a, _ in new} == set(range(401, 410)) and all(b <= 409 for _, b in new)  # 4 agents, then 5, numbered on from 400
    rows = [x.split(",") for x in lines_of(f["aux"])]
    head, rows = rows[0], [r for r in rows if r[0] != "node_id"]
    assert head == text.NODE_HEADER and [int(r[0]) for r in rows] == sorted([10 * k for k in range(1, 41)] + list(range(401, 410)))
    by = {int(r[0]): dict(zip(head, r)) for r in rows}
    assert by[400]["year"] == "1990" and by[10]["type"] == "seed" and [by[10][c] for c in ("pa_weight", "alpha", "assigned_out_degree", "planted_nodes_line_number", "generator_node_string")] == ["-1", "-1", "-1", "-1", "no_generators"]
    assert [by[401][c] for c in ("type", "year", "pa_weight", "rec_weight", "alpha", "fit_lag_duration", "fit_peak_value", "fit_peak_duration", "planted_nodes_line_number")] == ["agent", "1995", "0.5", "0.25", "0.5", "2", "700", "3", "1"]
    assert by[405]["planted_nodes_line_number"] == "2" and by[405]["year"] == "1996" and by[402]["planted_nodes_line_number"] == "0"
    for k in range(401, 410):
        mine = [b for a, b in new if a == k]
        assert int(by[k]["generator_node_string"]) in mine and int(by[k]["out_degree"]) == len(mine) and by[k]["assigned_out_degree"] in "169"
        assert len(mine) >= min(int(by[k]["assigned_out_degree"]), 2)
    assert all(int(by[k]["in_degree"]) == sum(b == k for _, b in edges_) for k in by)
    log = f["log"].read_text().splitlines()
    assert re.fullmatch(r"\[INFO\]\[0-0:\d+:\d+\]\(t=\d+s\) loaded graph", log[0]) and any("final graph size is 49" in x for x in log) and any("[DEBUG]" in x and "edges" in x for x in log)
    again = lines_of(f["out"])
    main(argv, spark)
    assert lines_of(f["out"]) == again


def test_fill_goes_on_in_rounds(spark):
    need = spark.createDataFrame([(k, 30) for k in range(20)], "id long, random int")
    got = S.uniform_fill(spark, need, edges(spark, [(0, 1)]).toDF("id", "node"), 10_000, 7, 0).collect()
    assert len({tuple(r) for r in got}) == len(got) == 600 and all(0 <= r["node"] < 10_000 for r in got)


def test_weighted_mean_falls_back(spark):
    d = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (None, 5.0)], "v double, w double")
    assert d.agg(M.weighted_mean("v", "w")).first()[0] == 2.0
    d = spark.createDataFrame([(1.0, None), (4.0, 2.0)], "v double, w double")
    assert d.agg(M.weighted_mean("v", "w")).first()[0] == 2.5
    assert d.where("w > 1").agg(M.weighted_mean("v", "w")).first()[0] == 4.0 and d.where("v > 9").agg(M.weighted_mean("v", "w")).first()[0] is None


def test_year_keeps_invariants(spark):
    run = lambda: sorted(map(tuple, __spark_entry__.entry(spark).collect()))
    got = run()
    n = 1500
    assert len({r[0] for r in got}) == math.ceil(n * 0.03) and len({r[:2] for r in got}) == len(got)
    assert all(r[1] < n or r[2] == "same_year" for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert run() == got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_batches_change_no_result_and_leave_no_tables(spark, tmp_path, monkeypatch):
    nodes, e = ids(spark, *range(60)), edges(spark, [(i, i * 7 % 60) for i in range(60) if i * 7 % 60 != i] + [(i, 0) for i in range(1, 60)])
    bag, recency = spark.createDataFrame([(0, 4), (1, 9)], "pos long, out_degree int"), spark.createDataFrame([(k, 0.25) for k in range(6)], "age int, prob double")
    got, left = [], []
    for batch in (None, 6):
        monkeypatch.setattr(G, "shared_dir", lambda _, b=batch: (tmp_path / str(b)).as_uri())
        _, out = simulate.run(spark, nodes, e, SimConfig(growth_rate=0.2, num_cycles=1, fully_random_citations=0.4, max_batch=batch), bag, recency)
        got.append(sorted(map(tuple, out.collect())))
        left.append(sorted(f.name.rpartition("-")[0] for f in (tmp_path / str(batch) / "papergrove").iterdir()))
    assert got[0] == got[1] and {r[2] for r in got[0]} >= {"generator", "one_hop", "two_hop", "random"}
    assert left[0] == left[1] == ["degrees", "edges", "edges", "nodes", "nodes"]


def test_random_graph(spark):
    n = er.gnp_edges(spark, 5000, 100, 0.002, 7)
    rows = n.collect()
    assert len({tuple(r) for r in rows}) == len(rows) and 800 < len(rows) < 1200 and all(0 <= r["dst"] < 5000 for r in rows)
    assert simulate.final_size(491532, 0.03, 3) == 537112
    nodes, e = simulate.run(spark, ids(spark, *range(100)), edges(spark, [(1, 0)]), SimConfig(model="er-gnp", er_edges_per_node=3.0, num_cycles=2), None, None)
    assert nodes.count() == 107 and e.where("cycle = 2").count() > 0


def gap_walk(n, size, p, seed):
    for src in range(n, n + size):
        at, j = -1, 0
        while True:
            u = (int(hashlib.md5(f"{seed}:{src}:gap:{j}".encode()).hexdigest()[:8], 16) + 1) / 2**32
            at, j = at + (math.floor(math.log(u) / math.log1p(-p)) + 1 if p < 1 else 1), j + 1
            if at >= n:
                break
            yield src, at


def test_random_graph_by_gaps_is_that_of_a_plain_walk(spark):
    for n, size, p in ((300, 9, 0.05), (40, 3, 0.9), (7, 2, 1.0), (1, 4, 0.3)):
        assert sorted(map(tuple, er.gnp_edges(spark, n, size, p, 5).collect())) == sorted(gap_walk(n, size, p, 5))
    got = __spark_entry__.queries()["er_gnp_edges"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(gap_walk(1500, 45, 0.001, SimConfig().seed))


def test_random_graph_is_neither_dealt_nor_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "shared_dir", lambda _: tmp_path.as_uri())
    for n, size, p in ((3000, 4, 0.4), (95, 12, 0.3)):  # 1,200 draws a node; ids of two and of three digits
        got = er.gnp_edges(spark, n, size, p, 5)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(gap_walk(n, size, p, 5))
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("seed, ids, tag, lo, hi", [(7, [5, 9], "gap:", 0, 10), (-4, [54000123], "abcdefg", 123456, 123460), (1, [100, 999], "", 10, 90), (2**31, [10**18], "x", 10**9, 10**9 + 2), (1, [1], "x" * 50, 0, 10)])
def test_draws_as_arrays_are_those_of_md5(seed, ids, tag, lo, hi):
    want = [[(int(hashlib.md5(f"{seed}:{k}:{tag}{j}".encode()).hexdigest()[:8], 16) + 1) / 2**32 for j in range(lo, hi)] for k in ids]
    assert draws(seed, tag)(np.array(ids), lo, hi).tolist() == want


def test_command_line():
    a = parser().parse_args("--edgelist e --nodelist n --out-degree-bag b --recency-probabilities r --output-file o --auxiliary-information-file x --log-file l --growth-rate 0.03 --num-cycles 3 --same-year-proportion 0.12 --alpha 0.5".split())
    c = from_args(a)
    assert c.num_cycles == 3 and not c.fixed_weights() and c.log_level == 0 and c.max_batch is None
    a.max_batch_size = 500
    assert from_args(a).max_batch == 500


def test_every_query_has_a_plan(spark):
    for name in ("degrees", "kernel_summary", "metric_pivot", "planted_nodes", "sink_attributes"):
        assert __spark_entry__.queries()[name](spark, SF).count() > 0
    assert {n for n in __spark_entry__.oracle_sql()} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("x", [1 / 32768, 3 / 32768, -1 / 32768, 0.12345678905, 1234567890.5, 1234567891.5, 1.00000000005, 8.5e-6 + 5e-16])
def test_ties_are_printed_by_their_exact_value(spark, x):
    assert value(spark, X.general(F.lit(x))) == (f"{x:.10g}",)


def test_rounding_in_doubles_keeps_the_sign_of_zero(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate((-1e-13, 1e-13, 2.5e-12, 3.5e-12, -2.5e-12, 1e300, float("nan")))], "k int, x double")
    got = [r[0] for r in rows.orderBy("k").select(X.general(X.round_even(F.col("x"), 12))).collect()]
    assert got == ["-0", "0", "2e-12", "4e-12", "-2e-12", "1e+300", "NaN"]


def test_gaps_of_a_rare_edge_are_those_of_sql(spark):
    n, size = 9_000_000, 3000
    p = 4 / n
    got = er.gnp_edges(spark, n, size, p, SimConfig().seed)
    draws = [(src, [(int(hashlib.md5(f"7:{src}:gap:{j}".encode()).hexdigest()[:8], 16) + 1) / 2**32 for j in range(60)]) for src in range(n, n + size)]
    want = [(src, at) for src, us in draws for at in [a - 1 for a in accumulate(math.floor(math.log(u) / math.log(1 - p)) + 1 for u in us)] if at < n]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_written_table_is_not_broadcast_by_the_bytes_of_its_file(spark):
    flat = [F.lit(k).alias(f"c{k}") for k in range(12)]
    many = G.cut(spark.range(900_000).select("id", F.lit(2000).alias("year"), *flat), "many")
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in many.inputFiles()) < 10 << 20
    plan = many.join(many.select("id").withColumn("x", F.col("id") + 1), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_task_takes_a_share_of_fixed_size(spark):
    wide = G.cut(spark.range(3_000_000).select("id", F.md5(F.col("id").cast("string")).alias("text")), "wide")
    few = spark.range(100).select("id", F.lit("x").alias("text"))
    tasks = lambda df: df.groupBy("text").agg(F.count("*").alias("n")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(wide) > 4 >= tasks(few)  # the session has 4 partitions
