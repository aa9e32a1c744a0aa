"""Tunable defaults, gathered in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Settings of the graph and scoring jobs.

    The sizes at the bottom bound what one task or one broadcast may hold;
    they choose between physical strategies and never change a result.
    """

    k: int = 7                       # memory neighbours per query
    domain_filter: bool = False      # restrict query-query edges to one domain
    threshold: float = 0.5           # probability above which a reward is 1
    strict_zero: bool = False        # treat a consensus of 0.0 as a real consensus
    broadcast_bytes: int = 64 << 20  # largest candidate matrix sent to every task
    block_rows: int = 16384          # most vectors in one block of a block join
    strip_bytes: int = 64 << 20      # sources that a task of a block join holds
