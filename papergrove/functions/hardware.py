"""A device's limits, and what they leave of a launch."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hardware:
    """Limits of a multiprocessor, and peaks of the device: bandwidth in GB/s, peak in GFLOP/s (fp32)."""

    name: str
    bandwidth: float
    peak: float
    multiprocessors: int
    warp: int = 32
    warps: int = 64
    blocks: int = 32
    threads: int = 2048
    registers: int = 65536
    shared: int = 65536
    register_unit: int = 256
    shared_unit: int = 256

    @property
    def ridge(self) -> float:
        """Operations a byte from which a kernel is bound by arithmetic."""
        return self.peak / self.bandwidth


#: Name, bandwidth, peak and multiprocessors of known devices.
DEVICES = {
    "P100": Hardware("Tesla P100-PCIE-16GB", 732.0, 9300.0, 56),
    "A30": Hardware("NVIDIA A30", 933.0, 10300.0, 56),
    "A100": Hardware("NVIDIA A100 SXM4 80GB", 2039.0, 19500.0, 108),
    "H100": Hardware("NVIDIA H100 80GB HBM3", 3350.0, 67000.0, 114),
    "V100": Hardware("Tesla V100-SXM2-32GB", 900.0, 14000.0, 80),
    "RTX4090": Hardware("NVIDIA GeForce RTX 4090", 1008.0, 82600.0, 128),
}
#: Limits by architecture, for the limiter by the least of them.
ARCHITECTURES = {
    "h100": replace(DEVICES["H100"], threads=2048, warps=64, blocks=32, shared=233472, shared_unit=128),
    "rtx4090": replace(DEVICES["RTX4090"], threads=1536, warps=48, blocks=24, shared=102400, shared_unit=128),
    "a100": replace(DEVICES["A100"], threads=2048, warps=64, blocks=32, shared=167936, shared_unit=128),
}


def from_device_row(row: Mapping[str, object], preset: Hardware) -> Hardware:
    """The preset with what a device table's row has: values that are missing or 0 stay as they were."""
    known = {"maxWarpsPerSm": "warps", "maxBlocksPerSm": "blocks", "maxShmemPerSm": "shared", "maxRegistersPerSm": "registers", "threadsPerWarp": "warp"}
    found = {to: int(row[c]) for c, to in known.items() if row.get(c)}
    if row.get("memoryBandwidth"):
        found["bandwidth"] = float(row["memoryBandwidth"]) / 1e9
    # threads follow the table alone, by its usual values where it has none
    found["threads"] = int(row.get("maxWarpsPerSm", 64) or 0) * int(row.get("threadsPerWarp", 32) or 0)
    return replace(preset, **found)


def _over(a: Column | int, b: Column | int) -> Column:
    """a // b of whole numbers; null where b is 0."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.floor(F.try_divide(lit(a).cast("double"), lit(b).cast("double"))).cast("long")


def _up(a: Column, unit: int) -> Column:
    return F.ceil(a / F.lit(float(unit))).cast("long")


def block_limits(regs: Column, block: Column, shared: Column, hw: Hardware) -> dict[str, Column]:
    """Blocks that a multiprocessor holds under each limit, in the order in which ties are told."""
    warps = F.greatest(_up(block, hw.warp), F.lit(1))
    by_regs = F.when(regs > 0, _over(hw.registers, _up(regs * hw.warp, hw.register_unit) * hw.register_unit * warps)).otherwise(F.lit(hw.blocks))
    by_shared = F.when(shared > 0, _over(hw.shared, _up(shared, hw.shared_unit) * hw.shared_unit)).otherwise(F.lit(hw.blocks))
    return {"reg": by_regs.cast("long"), "thr": _over(hw.threads, F.greatest(block, F.lit(1))), "shmem": by_shared.cast("long"), "blk": F.lit(hw.blocks).cast("long")}


def occupancy(regs: Column, block: Column, shared: Column, hw: Hardware) -> Column:
    """Theoretical occupancy in percent, to one digit, 100 at most; 0 for a block of no threads."""
    active = F.least(*block_limits(regs, block, shared, hw).values()) * F.greatest(_up(block, hw.warp), F.lit(1))
    return F.when(block == 0, F.lit(0.0)).otherwise(F.bround(F.least(active / F.lit(float(hw.warps)), F.lit(1.0)) * 100, 1))


def occupancy_by_least_limit(regs: Column, block: Column, shared: Column, hw: Hardware) -> tuple[Column, Column]:
    """Occupancy and the limit that binds (the first of equal ones: registers, threads, shared memory, blocks).

    A block of no threads counts as one warp here.
    """
    limits = block_limits(regs, block, shared, hw)
    ranked = [F.struct(v.alias("v"), F.lit(k).alias("rank"), F.lit(n).alias("name")) for k, (n, v) in enumerate(limits.items())]
    least = F.array_min(F.array(*ranked))
    percent = least["v"] * F.greatest(_up(block, hw.warp), F.lit(1)) / F.lit(float(hw.warps)) * 100
    return F.bround(F.least(percent, F.lit(100.0)), 1), least["name"]


def limiter_by_threshold(regs: Column, block: Column, shared: Column) -> Column:
    """The limiter by plain thresholds of a launch (fixed values)."""
    return F.when(regs > 40, "reg").when(shared > 0, "shmem").when(block < 64, "block").otherwise("thr")


def roofline(fp32: Column, fp64: Column, bytes_: Column, nanoseconds: Column, hw: Hardware) -> dict[str, Column]:
    """Operations a byte, GFLOP/s and what bounds a kernel, from counted instructions; null where any is not above 0."""
    flops = 2 * (F.coalesce(fp32, F.lit(0)) + F.coalesce(fp64, F.lit(0))).cast("double")
    known = (bytes_ > 0) & (nanoseconds > 0) & (flops > 0)
    ai = F.when(known, flops / bytes_.cast("double"))
    return {"ai": ai, "gflops": F.when(known, flops / (nanoseconds.cast("double") * F.lit(1e-9)) / F.lit(1e9)), "bound": F.when(ai >= F.lit(hw.ridge), "compute").when(known, "memory")}


def roofline_ceiling(ai: Column, hw: Hardware) -> Column:
    return F.when(ai.isNotNull(), F.least(ai * F.lit(hw.bandwidth), F.lit(hw.peak)))
