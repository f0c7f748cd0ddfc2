"""The superstep loop: one relational pass over the edges, repeated until nothing changes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .journal import Journal
from .lineage import Staged


@dataclass
class Run:
    """What a loop did: its result, rounds and whether it reached a fixpoint."""

    result: DataFrame | None = None
    rounds: int = 0
    converged: bool = False
    seconds: list[float] = field(default_factory=list)
    #: Rows of the result, where it has been written as a whole.
    rows: int | None = None
    #: Rows that each round changed or found, and bytes that it wrote.
    counts: list[int] = field(default_factory=list)
    bytes: list[int] = field(default_factory=list)

    def note(self, table: Staged, changed: int, began: float) -> None:
        """One more round, which has written a table."""
        self.rounds += 1
        self.counts.append(changed)
        self.bytes.append(table.bytes)
        self.seconds.append(time.perf_counter() - began)

    def account(self, spark: SparkSession) -> DataFrame:
        """(round, changed, bytes_written, seconds) of each round of this run; those before a resumed one have no row."""
        first = self.rounds - len(self.counts) + 1
        rows = list(zip(range(first, self.rounds + 1), self.counts, self.bytes, map(float, self.seconds), strict=False))
        return spark.createDataFrame(rows, "round int, changed long, bytes_written long, seconds double")


#: Vertices so few that their ids may be named in a scan's filter.
FEW = 100


def few(rows: DataFrame) -> list[int]:
    """The ids of at most FEW rows."""
    return [r["id"] for r in rows.select("id").limit(FEW + 1).collect()]


def iterate(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], changed: Column, max_rounds: int | None = None, name: str = "state", journal: Journal | None = None) -> Run:
    """Applies step to the staged state until no row is `changed`; a round is one job, which writes one table to the shared folder.

    journal: keeps the last whole round. If it has one already, the loop goes on from there, without `start`.
    """
    run = Run()
    left = journal.load() if journal else None
    if left:
        state = Staged.found(start.sparkSession, left["table"], start.schema)
        run.rounds, run.converged = left["round"], left["converged"]
    else:
        state = Staged(start, name)
    while not run.converged and (max_rounds is None or run.rounds < max_rounds):
        began = time.perf_counter()
        after = Staged(step(state.df, run.rounds + 1), name, changed=F.count_if(changed))
        run.note(after, after.seen["changed"], began)
        run.converged = not after.seen["changed"]
        if journal:
            journal.save(round=run.rounds, table=after.path, converged=run.converged)
        state.drop()
        state = after
    run.result = state.df
    return run
