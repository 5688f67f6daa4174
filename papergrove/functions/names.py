"""Short names of kernels, labels of runs, and names of metrics: tables of fixed values and the rules that apply them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern and name, the first that is found counts.
KERNELS = [
    ("kernelCallStage1", "Stage1"),
    ("kernelCallStage2", "Stage2"),
    ("kernelCallStage3", "Stage3"),
    ("kernelCallStage4", "Stage4"),
    ("ABMKernelStage2", "ABMStage2"),
    ("ABMKernelStage4", "ABMStage4"),
    ("MakeSameYear", "SameYearCite"),
    ("MakeUniform", "UniformCite"),
    ("GetOneAndTwoHopNeighborhood_Warp", "2HopWarp"),
    ("GetOneAndTwoHop", "2Hop"),
    ("kernel_extract_vector", "ExtractSizes"),
    ("cuco.*initialize", "cuco::init"),
    ("cuco.*insert_if", "cuco::insert_if"),
    ("cuco.*insert", "cuco::insert"),
    ("cub.*DeviceRadixSort", "cub::RadixSort"),
    ("cub.*DeviceScan", "cub::DeviceScan"),
    ("cub.*DeviceSelect", "cub::DeviceSelect"),
    ("cub.*for_each|cub.*ForEach", "cub::ForEach"),
    ("thrust.*copy", "thrust::copy"),
    ("thrust.*fill", "thrust::fill"),
    ("uninitialized_fill", "thrust::uninit_fill"),
]
#: Pattern and name; without a name what the pattern found is kept.
KERNELS_KEPT = [
    ("(?i)kernelCallStage1(_warped)?", "Stage1"),
    ("(?i)kernelCallStage2", "Stage2"),
    ("(?i)kernelCallStage3", "Stage3"),
    ("(?i)kernelCallStage4", "Stage4"),
    ("(?i)ABMKernel", "ABMKernel"),
    ("(?i)ExtractSizes", "ExtractSizes"),
    ("cuco::[a-zA-Z_]+", None),
    ("cub::[a-zA-Z_]+", None),
    ("thrust::[a-zA-Z_:]+", None),
]
#: All of the parts must stand in a name, whatever the order.
KERNELS_BY_PART = [
    (("kernelErdosRenyi",), "kernelErdosRenyiGNP"),
    (("kernelCallStage1",), "kernelCallStage1"),
    (("kernelCallStage2",), "kernelCallStage2"),
    (("kernel_extract",), "kernel_extract_vector_sizes"),
    (("legacy::initialize",), "legacy::initialize"),
    (("legacy::insert",), "legacy::insert"),
    (("insert_if_n",), "open_addressing::insert_if_n"),
    (("static_kernel", "initialize_functor"), "cub::static_kernel(init)"),
    (("static_kernel",), "cub::static_kernel(thrust)"),
]
#: Names of copy kinds by code.
COPY_KINDS = {0: "Unknown", 1: "H2D", 2: "D2H", 3: "H2A", 4: "A2H", 5: "A2A", 6: "A2D", 7: "D2A", 8: "D2D", 9: "H2H", 10: "P2P", 11: "UVM_H2D", 12: "UVM_D2H", 13: "UVM_D2D"}
#: Short names of exported metrics.
METRICS = {
    "sm__warps_active.avg.pct_of_peak_sustained_active": "achieved_occ_pct",
    "gpu__dram_throughput.avg.pct_of_peak_sustained_elapsed": "dram_bw_pct",
    "sm__sass_thread_inst_executed_op_fp32_pred_on.sum": "fp32_insts",
    "sm__sass_thread_inst_executed_op_fp64_pred_on.sum": "fp64_insts",
    "dram__bytes.sum": "dram_bytes",
    "gpu__time_duration.sum": "duration_ns",
    "lts__t_sectors_srcunit_tex_op_read_hit_rate.pct": "l2_hit_pct",
    "sm__throughput.avg.pct_of_peak_sustained_elapsed": "sm_throughput_pct",
    "launch__registers_per_thread": "regs",
    "launch__shared_mem_per_block_static": "shmem_B",
    "launch__shared_mem_per_block_dynamic": "shmem_dyn_B",
    "launch__occupancy_theoretical": "th_occ_pct",
    "launch__waves_per_multiprocessor": "waves_sm",
    "launch__block_size": "block_size",
    "launch__grid_size": "grid_size",
    "launch__thread_count": "thread_count",
}


#: The name of the derived sum of instructions, and the columns of metric reports by category: short name
#: of a metric and its label, in order.
INSTRUCTIONS = "Total Pred-ON Insts (Divergence Proxy)"
LABELS = {
    "OCCUPANCY": [
        ("achieved_occ_pct", "Achieved Occupancy (%)"),
        ("th_occ_pct", "Theoretical Occupancy (%)"),
        ("waves_sm", "Waves per SM"),
        ("regs", "Registers / Thread"),
        ("block_size", "Block Size"),
        ("grid_size", "Grid Size"),
        ("thread_count", "Total Threads"),
        ("shmem_dyn_B", "Dynamic Shared Mem / Block (B)"),
        ("shmem_B", "Static Shared Mem / Block (B)"),
    ],
    "MEMORY BANDWIDTH": [
        ("dram_bw_pct", "DRAM BW Util (% peak)"),
        ("dram_bytes", "DRAM Bytes Transferred"),
        ("sm_throughput_pct", "SM Throughput (% peak)"),
        ("l2_hit_pct", "L2 Read Hit Rate (%)"),
        ("duration_ns", "Kernel Duration (ns)"),
    ],
    "WARP DIVERGENCE (proxy)": [
        ("fp32_insts", "FP32 Pred-ON Insts"),
        ("fp64_insts", "FP64 Pred-ON Insts"),
        ("insts", INSTRUCTIONS),
    ],
}


def _chosen(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda out, r: F.when(r[0], r[1]).otherwise(out), reversed(rules), otherwise)


def _bare(c: Column) -> Column:
    """A signature up to its parameters and template arguments."""
    return F.element_at(F.split(F.element_at(F.split(c, r"\("), 1), "<"), 1)


def kernel_name(c: Column, rules: list[tuple[str, str]] = KERNELS, most: int = 30) -> Column:
    """The name of the first rule found; else the last part between ::, cut to `most` letters."""
    parts = F.filter(F.split(_bare(c), "::"), lambda p: p != "")
    return _chosen([(c.rlike(p), F.lit(n)) for p, n in rules], F.substring(F.coalesce(F.try_element_at(parts, F.lit(-1)), c), 1, most))


def kernel_name_kept(c: Column, rules: list[tuple[str, str | None]] = KERNELS_KEPT) -> Column:
    """The same by rules that may keep what they found, uncut."""
    return _chosen([(c.rlike(p), F.lit(n) if n else F.regexp_extract(c, p, 0)) for p, n in rules], F.element_at(F.split(_bare(c), "::"), -1))


def kernel_name_by_part(c: Column, rules: list[tuple[tuple[str, ...], str]] = KERNELS_BY_PART, most: int = 50) -> Column:
    """The name of the first rule whose parts all stand in a name; else its first letters."""
    return _chosen([(reduce(lambda a, b: a & b, [F.contains(c, F.lit(p)) for p in parts]), F.lit(n)) for parts, n in rules], F.substring(c, 1, most))


def copy_kind(code: Column) -> Column:
    """Name of a copy kind; kindN for others."""
    return _chosen([(code == k, F.lit(n)) for k, n in COPY_KINDS.items()], F.concat(F.lit("kind"), code.cast("string")))


def run_label(path: Column) -> Column:
    """3y/6% from a file such as nsys-pa-3y-6p.sqlite (fixed pattern); else the file's base name without that prefix."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<!^)\.[^.]*$", "")
    base = F.regexp_replace(base, r"(?i)^nsys-?pa-?|^nsys-?", "")
    found = r"([0-9]+y)[_-]([0-9]+)p"
    return F.when(base.rlike(found), F.concat(F.regexp_extract(base, found, 1), F.lit("/"), F.regexp_extract(base, found, 2), F.lit("%"))).otherwise(base)


def file_years(path: Column) -> Column:
    """Years of a file such as run-30y-5p-details.csv, null without them."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"([0-9]+)y-([0-9]+)p", 1), F.lit("")).cast("int")


def file_agents(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"([0-9]+)y-([0-9]+)p", 2), F.lit("")).cast("int")
