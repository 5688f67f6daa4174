"""Configuration of a simulation and its command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass


@dataclass(frozen=True)
class SimConfig:
    """Options of a run. A weight or alpha of -1 is drawn for each agent; weights only if not all three are given."""

    growth_rate: float = 0.03
    num_cycles: int = 1
    same_year_proportion: float = 0.12
    fully_random_citations: float = 0.05
    preferential_weight: float = 0.33
    recency_weight: float = 0.33
    fitness_weight: float = 0.33
    alpha: float = 0.5
    seed: int = 7
    model: str = "pa"
    er_probability: float = 0.0
    er_edges_per_node: float = 0.0
    #: The last node is never a random pick, as in the original model.
    last_node_excluded: bool = True
    #: A same-year pick may be the agent itself.
    allow_self_loop: bool = True
    fitness_lag: int = 0
    fitness_duration: int = 1000
    fitness_max: int = 1000
    fitness_exponent: float = 1.634
    #: Extra draws for random fill before the exact fallback.
    slack: int = 32
    #: Agents whose neighbourhoods are written at once; None: all of a year. It bounds disk and changes no result.
    max_batch: int | None = None
    log_level: int = 0

    def fixed_weights(self) -> bool:
        return -1 not in (self.preferential_weight, self.recency_weight, self.fitness_weight)


def _flag(text: str) -> bool:
    return text.lower() in ("1", "true", "yes", "on")


def parser() -> argparse.ArgumentParser:
    """The 22 options of a run, a seed, and the random-graph model. Options about devices have no effect; without a
    largest batch, all agents of a year are one. The names of the options are fixed values: scripts call them."""
    p = argparse.ArgumentParser(prog="papergrove")
    for name in ("edgelist", "nodelist", "out-degree-bag", "recency-probabilities", "output-file", "auxiliary-information-file", "log-file"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--planted-nodes", default="")
    for name, default in (("preferential-weight", -1.0), ("recency-weight", -1.0), ("fitness-weight", -1.0), ("alpha", -1.0), ("fully-random-citations", 0.05), ("er-probability", 0.0), ("er-edges-per-node", 0.0)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--growth-rate", type=float, required=True)
    p.add_argument("--num-cycles", type=int, required=True)
    p.add_argument("--same-year-proportion", type=float, required=True)
    for name in ("use-warp-bfs", "use-batching", "use-multistage-kernel"):
        p.add_argument(f"--{name}", type=_flag, default=True)
    p.add_argument("--max-batch-size", type=int, default=0)
    p.add_argument("--num-processors", type=int, default=1)
    p.add_argument("--log-level", type=int, default=1)
    p.add_argument("--model", choices=("pa", "er-gnp"), default="pa")
    p.add_argument("--seed", type=int, default=7)
    return p


def from_args(args: argparse.Namespace) -> SimConfig:
    return SimConfig(
        growth_rate=args.growth_rate, num_cycles=args.num_cycles, same_year_proportion=args.same_year_proportion, fully_random_citations=args.fully_random_citations,
        preferential_weight=args.preferential_weight, recency_weight=args.recency_weight, fitness_weight=args.fitness_weight, alpha=args.alpha,
        seed=args.seed, model=args.model, er_probability=args.er_probability, er_edges_per_node=args.er_edges_per_node, log_level=args.log_level - 1,
        max_batch=args.max_batch_size if args.use_batching and args.max_batch_size > 0 else None,
    )
