"""How long an action takes, and what it moves."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridloom.plans.matrix import Matrix


@dataclass(frozen=True)
class Flow:
    """Rows and cells that an action went over, bytes at 8 a cell and pass, seconds."""

    rows: int
    cells: int
    bytes: int
    seconds: float

    @property
    def gb_per_second(self) -> float:
        return self.bytes / 1e9 / max(self.seconds, 1e-9)


def flow(x: Matrix, passes: int = 1) -> Flow:
    """Runs the matrix's plan to its end, keeping nothing (action); rows are counted on the way, without a job of their own. passes: how often the plan reads or writes each cell."""
    seen = Observation()
    df = x.df.observe(seen, F.count("*").alias("rows"))
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    rows = seen.get["rows"]
    cells = rows if x.layout == "coo" else rows * x.n
    return Flow(rows, cells, 8 * cells * passes, took)
