"""The program: from a node list, an edge list and parameter files to the two sinks and a log.

    python -m papergrove --edgelist ... --nodelist ... --out-degree-bag ... --recency-probabilities ...
        --growth-rate 0.03 --num-cycles 3 --same-year-proportion 0.12
        --output-file ... --auxiliary-information-file ... --log-file ...

The sinks are one file each; the log is a file of the driver.

    python -m papergrove report --sqlite a.sqlite "3y/1%" --sqlite b.sqlite "" --outdir out --prefix run --gpu H100

makes the five reports of profiler databases, each with its label (empty: by the file's name).
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrove.config import from_args, parser
from papergrove.functions.hardware import DEVICES
from papergrove.operators import graph as G
from papergrove.operators import metrics as M
from papergrove.plans import profile, simulate
from papergrove.sources import log as lines
from papergrove.sources import text
from papergrove.sources.log import DEBUG, Log


def grown(nodes: DataFrame, idmap: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with original ids and degrees as the sink takes them, and edges in original ids.

    New nodes are numbered on from the largest original id.
    """
    n, most = idmap.agg(F.count("*"), F.max("orig_id")).first()
    ids = idmap.select(F.col("seq_id").alias("id"), F.col("orig_id").cast("long").alias("orig_id"))
    ids = ids.unionByName(nodes.where("type = 1").select("id", (F.col("id") - n + 1 + most).alias("orig_id")))
    ids = G.cut(ids, "ids")
    degrees = G.degrees(nodes, edges)
    named = nodes.join(ids, "id").join(degrees, "id").join(ids.select(F.col("id").alias("generator"), F.col("orig_id").alias("generator_id")), "generator", "left")
    return named, text.edge_frame(edges, ids)


def report(argv: list[str], spark: SparkSession | None = None) -> list[str]:
    """The reports of profiler databases; the paths of the files written."""
    p = argparse.ArgumentParser(prog="papergrove report")
    p.add_argument("--sqlite", nargs=2, action="append", required=True, metavar=("DATABASE", "LABEL"))
    p.add_argument("--outdir", default=".")
    p.add_argument("--prefix", default="profile")
    p.add_argument("--gpu", choices=sorted(DEVICES), default="H100")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("papergrove").getOrCreate()
    runs = {label or profile.label_of(spark, path): path for path, label in args.sqlite}
    return profile.write(spark, runs, args.outdir, args.prefix, DEVICES[args.gpu])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["report"]:
        report(argv[1:], spark)
        return
    args = parser().parse_args(argv)
    cfg = from_args(args)
    spark = spark or SparkSession.builder.appName("papergrove").getOrCreate()
    with open(args.log_file, "w") as out:
        log, began = Log(out, cfg.log_level), time.monotonic()
        listed = text.read_nodelist(spark, args.nodelist)
        idmap = G.cut(G.dense_ids(listed, "node"), "idmap")
        nodes = G.cut(listed.join(idmap, F.col("node") == F.col("orig_id")).select(F.col("seq_id").alias("id"), "year"), "seeds")
        edges = G.cut(G.encode_edges(text.read_edgelist(spark, args.edgelist).toDF("src", "dst"), idmap), "seed-edges")
        bag, recency, planted = text.read_bag(spark, args.out_degree_bag), text.read_recency(spark, args.recency_probabilities), text.read_planted(spark, args.planted_nodes or None)
        log(lines.LOADED)
        start = nodes.count()
        log(lines.GROWN.format(simulate.final_size(start, cfg.growth_rate, cfg.num_cycles)))
        years: list[tuple[str, float]] = []
        last, phases = [time.monotonic()], G.Phases()

        def told(line: str) -> None:
            log(line)
            years.append((line.partition(":")[0], time.monotonic() - last[0]))
            last[0] = time.monotonic()

        all_nodes, all_edges = simulate.run(spark, nodes, edges, cfg, G.cut(bag, "bag"), recency, planted, told, phases)
        log(lines.FINISHED)
        named, out_edges = grown(all_nodes, idmap, all_edges)
        text.write_edges(out_edges, args.output_file)
        text.write_attributes(named, args.auxiliary_information_file)
        log(lines.WROTE)
        if years:
            for line in M.epoch_report(spark, years, phases.rows):
                log(line, DEBUG)
        log(lines.TOOK.format(cfg.num_cycles, 100 * cfg.growth_rate, int(time.monotonic() - began)))


if __name__ == "__main__":
    main()
