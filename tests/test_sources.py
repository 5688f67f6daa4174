"""Databases by ranges of rowids, one-file sinks, ids of 64 bits, range joins, reports from a database."""

import random
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from papergrove import registry
from papergrove.functions import hardware as H
from papergrove.functions import scalar as X
from papergrove.operators import agents as A
from papergrove.operators import graph as G
from papergrove.operators import trace as T
from papergrove.plans import profile
from papergrove.sources import fixture, sqlite, text
from papergrove.sources.sqlite import sqlite_table

SF = "/root/testdata/sf0.001"


def test_database_is_read_in_partitions(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (a INTEGER, b REAL, c TEXT, d BLOB, e VARCHAR(9))")
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(k, k / 2, f"é{k}", bytes([k % 256]), None if k % 3 else "x") for k in range(1000)])
        c.execute("DELETE FROM t WHERE a BETWEEN 100 AND 399")  # rowids with a gap
        c.execute("INSERT INTO t VALUES ('no number', 'nor this', 7, 'text', 8)")
        c.execute('CREATE TABLE "none" (a INTEGER)')
        c.execute("CREATE VIEW v AS SELECT a, c FROM t WHERE a < 5")
        c.execute("CREATE TABLE w (k TEXT PRIMARY KEY, n BIGINT) WITHOUT ROWID")
        c.execute("INSERT INTO w VALUES ('q', 3000000000)")
    t = sqlite_table(spark, path, "t", partitions=4)
    assert t.rdd.getNumPartitions() == 4 and t.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "binary"), ("e", "string")]
    rows = {r["a"]: r for r in t.collect()}
    assert len(rows) == 701 and set(rows) == {*range(100), *range(400, 1000), None}
    assert tuple(rows[999]) == (999, 499.5, "é999", bytearray([231]), "x") and tuple(rows[None])[1:] == (None, "7", bytearray(b"text"), "8")
    sizes = [r[0] for r in t.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 300  # no partition has most of the rows
    some = sqlite_table(spark, path, "t", ["c", "a"])
    assert some.columns == ["a", "c"] and some.where("a = 7").first()["c"] == "é7"
    assert [tuple(r) for r in sqlite_table(spark, path, "v").orderBy("a").limit(2).collect()] == [(0, "é0"), (1, "é1")]
    assert [tuple(r) for r in sqlite_table(spark, path, "w").collect()] == [("q", 3_000_000_000)]
    assert sqlite_table(spark, path, "none").count() == 0 and sqlite_table(spark, path, "absent") is None
    with pytest.raises(ValueError):
        sqlite_table(spark, path, "t", ["z"])


def test_tasks_write_and_read_a_database_in_parts(spark, tmp_path, monkeypatch):
    """The rows of a database that is made of tables do not go through the driver."""
    monkeypatch.setattr(sqlite, "PART_ROWS", 7)
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    path = fixture.trace_parts(spark, SF)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert spark.read.parquet(f"{path}/NVTX_EVENTS").count() >= n / 7 and sqlite_table(spark, path, "NVTX_EVENTS").count() == n
    assert sqlite_table(spark, path, "absent") is None and "StringIds" in sqlite.table_names(spark, path)
    rows = [(k, None if k % 5 == 0 else k / 2, f"é{k}", bytearray([k % 256])) for k in range(50)]
    sqlite.write_parts(spark, f"{tmp_path}/d", {"t": ("a INTEGER, b REAL, c TEXT, d BLOB", spark.createDataFrame(rows, "x int, y double, z string, w binary")), "none": ("a INTEGER", spark.createDataFrame([], "a int"))})
    t = sqlite_table(spark, f"{tmp_path}/d", "t", ["a", "b", "c", "d"])
    assert t.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "binary")] and sorted(map(tuple, t.collect())) == rows
    assert sqlite_table(spark, f"{tmp_path}/d", "t", ["c"]).columns == ["c"] and sqlite_table(spark, f"{tmp_path}/d", "none").count() == 0
    with pytest.raises(ValueError):
        sqlite_table(spark, f"{tmp_path}/d", "t", ["z"])


def test_sinks_are_one_file_byte_by_byte(spark, tmp_path):
    out = tmp_path / "e.csv"
    rows = [(a * 3_000_000_000, b) for a in range(30) for b in range(5)]
    random.Random(1).shuffle(rows)
    for n in (1, 7):  # again over the file that is there
        text.write_edges(spark.createDataFrame(rows, "source long, target long").repartition(n), str(out))
        assert out.read_bytes() == ("#source,target\n" + "".join(f"{a},{b}\n" for a, b in sorted(rows))).encode()
    assert sorted(map(tuple, text.read_edgelist(spark, str(out)).collect())) == sorted(rows)
    text.write_edges(spark.createDataFrame([], "source long, target long"), str(out))
    assert out.read_bytes() == b"#source,target\n"
    nodes = spark.createDataFrame([(2, 1, 2001), (1, 0, 2000)], "orig_id long, type int, year int").withColumns({"pa_weight": F.lit(0.25), "rec_weight": F.lit(1 / 3), "fit_weight": F.lit(0.5), "alpha": F.lit(0.5), "fitness_lag": F.lit(0), "fitness_peak": F.lit(9), "fitness_duration": F.lit(3), "in_degree": F.lit(4), "out_degree": F.lit(5), "assigned_out_degree": F.lit(6), "planted_line": F.lit(None).cast("int"), "generator_id": F.lit(1)})
    text.write_attributes(nodes, str(tmp_path / "n.csv"))
    head = "node_id,type,year,pa_weight,rec_weight,fit_weight,fit_lag_duration,fit_peak_value,fit_peak_duration,alpha,in_degree,out_degree,assigned_out_degree,planted_nodes_line_number,generator_node_string"
    assert (tmp_path / "n.csv").read_bytes() == f"{head}\n1,seed,2000,-1,-1,-1,0,9,3,-1,4,5,-1,-1,no_generators\n2,agent,2001,0.25,0.3333333333,0.5,0,9,3,0.5,4,5,6,0,1\n".encode()
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith(".")) == ["e.csv", "n.csv"]


def test_parts_are_joined_in_the_order_of_their_numbers(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for k in (0, 2, 10, 100_000):
        (folder / f"part-{k:05d}-abc.csv").write_text(f"{k}\n")
    (folder / "_SUCCESS").write_text("")
    text.join_parts(spark, str(folder), str(tmp_path / "all"), "h")
    assert (tmp_path / "all").read_text() == "h\n0\n2\n10\n100000\n" and not folder.exists()


def test_ids_of_64_bits_stay_apart(spark, tmp_path):
    (tmp_path / "e").write_text("3000000000,5\n3000000001,6\n9223372036854775807,-1\n")
    assert sorted(map(tuple, text.read_edgelist(spark, str(tmp_path / "e")).collect())) == [(3_000_000_000, 5), (3_000_000_001, 6), (2**63 - 1, -1)]
    (tmp_path / "n").write_text("3000000000,1999\n3000000001,2000\n")
    assert sorted(map(tuple, text.read_nodelist(spark, str(tmp_path / "n")).collect())) == [(3_000_000_000, 1999), (3_000_000_001, 2000)]
    for kind, value in ((X.lenient_long, "9223372036854775808"), (X.lenient_int, "3000000000")):
        with pytest.raises(Exception, match="over the range"):
            spark.range(1).select(kind(F.lit(value))).collect()
    assert spark.range(1).select(X.lenient_long(F.lit("")), X.lenient_long(F.lit(None).cast("string"))).first()[:] == (0, 0)


@pytest.mark.parametrize("small", [True, False])
def test_range_joins_are_those_of_the_nested_loop(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL", 200_000 if small else -1)
    rng = random.Random(8)
    points = [(k, rng.choice([rng.randrange(-500, 500), 7, -(2**40), 2**40 + 3])) for k in range(300)]
    spans = [(k, lo, lo + rng.choice([0, 1, 2, 3, 16, 17, 900, 2**41, -4])) for k, lo in enumerate([rng.choice([-(2**40), rng.randrange(-600, 600)]) for _ in range(200)])]
    p, s = spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(spans, "s long, lo long, hi long")
    got = sorted((r["p"], r["s"]) for r in A.range_join(p, s, "at", "lo", "hi").collect())
    assert got == sorted((k, j) for k, at in points for j, lo, hi in spans if lo <= at < hi)
    assert A.range_join(p, s.where("lo > hi"), "at", "lo", "hi").count() == 0


def test_a_wide_interval_takes_two_bins_at_most(spark):
    spans = spark.createDataFrame([(1, 5, 5 + 2**50), (2, 0, 1)], "s long, lo long, hi long")
    plan = A.range_join(spark.createDataFrame([(2**49,)] * 50, "at long"), spans, "at", "lo", "hi")
    assert plan.count() == 50 and "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_ranges_go_by_their_names(spark):
    names = spark.createDataFrame([(1, "one"), (2, "two")], "id long, value string")
    events = spark.createDataFrame([(1, None, 0, 5), (1, "own", 5, 7), (9, None, 0, 3), (None, "mine", 0, 2), (None, None, 0, 1), (2, None, None, 4)], "text_id long, text string, start long, end long")
    assert [tuple(r) for r in T.named_ranges(events, names).collect()] == [("one", 2, 7, 3.5), ("nvtx_9", 1, 3, 3.0), ("mine", 1, 2, 2.0), (None, 1, 1, 1.0)]


def test_numbers_by_the_largest_of_their_column(spark):
    for most, want in ((2e6, ["0.00M", "1.50M", ""]), (2e3, ["0", "1500000", ""]), (9.0, ["0.12", "1500000.00", ""])):
        df = spark.createDataFrame([(0.125,), (1.5e6,), (None,)], "x double")
        assert [r[0] for r in df.select(X.by_magnitude(F.col("x"), F.lit(most))).collect()] == want
    for x, digits in ((0.615, 2), (2.675, 2), (12.03125, 4), (1234567.5, 0), (-0.001, 2), (1e9 / 3, 3)):
        assert spark.range(1).select(X.fixed(F.lit(x), digits)).first()[0] == f"{x:.{digits}f}"


def test_one_command_from_a_database_to_its_reports(spark, tmp_path):
    from papergrove.__main__ import main

    path = fixture.trace_database(spark, SF)
    main(["report", "--sqlite", path, "run A", "--sqlite", path, "", "--outdir", str(tmp_path / "out"), "--prefix", "p", "--gpu", "A30"], spark)
    files = {f.name: f.read_text().splitlines() for f in (tmp_path / "out").iterdir() if not f.name.startswith(".")}
    assert sorted(files) == [f"p_{kind}.csv" for kind in ("gpu_util", "kernels", "memcpy", "occupancy", "summary")]
    assert [x.split(",")[0] for x in files["p_summary.csv"]] == ["Label", "run A", "3y/6%"] and files["p_summary.csv"][1].split(",")[1:] == files["p_summary.csv"][2].split(",")[1:]
    with sqlite3.connect(path) as c:
        ns, n = c.execute("SELECT sum(end - start), count(*) FROM CUPTI_ACTIVITY_KIND_KERNEL").fetchone()
        wall, = c.execute("SELECT duration FROM ANALYSIS_DETAILS").fetchone()
        kinds = c.execute("SELECT copyKind, count(*), sum(bytes) FROM CUPTI_ACTIVITY_KIND_MEMCPY GROUP BY 1 ORDER BY 3 DESC").fetchall()
    cells = dict(zip(files["p_summary.csv"][0].split(","), files["p_summary.csv"][1].split(",")))
    assert cells["Kernel_ms"] == f"{ns / 1e6:.3f}" and cells["Kernel_launches"] == str(n) and cells["GPU_util_pct"] == f"{round(ns / (0.8 * wall) * 100, 2):.2f}"
    assert [x.split(",")[2] for x in files["p_memcpy.csv"][1 : len(kinds) + 1]] == [str(k[1]) for k in kinds]
    assert len(files["p_kernels.csv"]) == len(files["p_occupancy.csv"]) == 2 * 10 + 1
    with sqlite3.connect(path) as c:
        for name in ("CUPTI_ACTIVITY_KIND_MEMCPY", "NVTX_EVENTS", "CUPTI_ACTIVITY_KIND_SYNCHRONIZATION", "PROFILER_OVERHEAD", "META_DATA_CAPTURE", "StringIds", "CUPTI_ACTIVITY_KIND_RUNTIME"):
            c.execute(f"DROP TABLE {name}")
    bare = profile.session(spark, path, H.DEVICES["A30"])
    assert bare["memcpy"].count() == 0 and bare["summary"].first()["Memcpy_ovh_pct"] == 0 and bare["kernels"].count() == 10
    assert profile.ranges(spark, path).count() == profile.calls(spark, path).count() == 0 and profile.capture(spark, path).first()["host"] == "unknown"


def test_edges_on_the_screen(spark, capsys):
    text.show_edges(spark.createDataFrame([(2, 1), (1, 9), (1, 3)], "src long, dst long"))
    text.show_edges(spark.createDataFrame([(2, 1), (1, 9), (1, 3)], "src long, dst long"), 1)
    assert capsys.readouterr().out == "1-3\n1-9\n2-1\n1-3\n"


@pytest.mark.parametrize("name", ["scan_delimited", "scan_bag", "scan_recency", "scan_planted", "scan_wide_metrics", "sink_edge_file", "paper_table", "memcpy_by_code", "batched_year", "program_year"])
def test_files_written_and_read_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = registry.QUERIES[name](spark, SF)
    wanted = con.execute(registry.SQL[name])
    assert sorted(found.columns) == sorted(d[0] for d in wanted.description)
    rows = found.select(*[d[0] for d in wanted.description]).collect()
    assert rows and sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted.fetchall()))


def test_parameter_files_with_odd_lines(spark, tmp_path):
    def file(name, content):
        (tmp_path / name).write_bytes(content)
        return str(tmp_path / name)

    bag = text.read_bag(spark, file("bag", b"#index,out_degree\r\n9,3\r\n\r\n1, 4\r\n5\r\n"))
    assert sorted(map(tuple, bag.collect())) == [(0, 3), (1, 4), (2, 0)]  # in file order; a missing field is 0
    recency = text.read_recency(spark, file("recency", b"#age,probability\n1,0.5\n2,x\n1,0.25\n"))
    assert sorted(map(tuple, recency.collect())) == [(1, 0.25), (2, None)]
    plan = text.read_planted(spark, file("plan", b"1,0,900,5,3\n2,-1, 7,1\n"))
    assert sorted(map(tuple, plan.collect())) == [(1, 1, 0, 900, 5, 3), (2, 2, -1, 7, 1, 0)]
    assert text.read_planted(spark, file("none", b"")).count() == 0 and text.read_planted(spark, None).count() == 0
    assert text.read_bag(spark, file("only", b"#index,out_degree\n")).count() == 0
    for sep in (",", "\t", " "):
        edges = text.read_edgelist(spark, file(f"e{ord(sep)}", f"#a{sep}b\n3000000000{sep}1\n\n#{sep}\n7{sep}2\n7{sep}2\n".encode()))
        assert sorted(map(tuple, edges.collect())) == [(7, 2), (7, 2), (3_000_000_000, 1)]
    with pytest.raises(ValueError, match="no delimiter"):
        text.read_edgelist(spark, file("bare", b"7\n8\n"))


def test_a_metric_file_needs_no_order_and_its_header_may_be_late(spark, monkeypatch):
    from papergrove.plans import queries

    rows = spark.createDataFrame([(f'"k{k}","{k},000.5"',) for k in range(20)], "line string")
    for late, header in ((False, '"Kernel Name","m"'), (True, 'a\nb\nc\n"Kernel Name","m"')):
        monkeypatch.setattr(text, "HEAD", 2)
        path = queries._lines_file(spark, "raw", rows, header)
        got = sorted((r["Kernel Name"], r["m"]) for r in text._table(spark, path, ["Kernel Name"]).collect())
        assert got == sorted((f"k{k}", f"{k},000.5") for k in range(20)), late
