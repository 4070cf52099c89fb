"""The stored run log: appended by numbered commits, compacted to the newest records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cuestrata import rules
from cuestrata.operators.runs import latest_runs
from cuestrata.sources.commits import Commits


class RunLog:
    """A run log below ``path``.  Every record stays until ``compact`` keeps the newest ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.commits = Commits(spark, path)

    def append(self, records: DataFrame, token: str) -> bool:
        """Add records as one commit; ``token`` names the batch (a run's id), and a repeated one changes nothing."""
        return self.commits.append(records, token)

    def read(self, n: int | None = None) -> DataFrame | None:
        """All records, or the newest ``n``; None before the first commit."""
        log = self.commits.read()
        return log if log is None or n is None else latest_runs(log, n)

    def compact(self, n: int = rules.HISTORY_ROWS) -> bool:
        """One commit with the newest ``n`` records in place of all before; false if another commit came in meanwhile."""
        every = self.commits.all()
        log = self.read(n)
        if log is None:
            return False
        return self.commits.append(log.coalesce(1), f"compact-{uuid.uuid4().hex}", base=True, after=every[-1].number)
