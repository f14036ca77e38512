"""Keyed state on shared storage whose writes follow the size of the batches.

Every micro-batch is reduced by key and written as a run of its own, a folder
``r<first epoch>-<last epoch>``.  Runs of similar size at the end are then merged
(a run joins the merge while it is at most ``RATIO`` times what is merged), so
there are few runs, and a row is rewritten about as often as the state doubles,
not once a batch.  Reading merges the runs that cover all epochs.

A repeated epoch removes what its earlier attempt wrote and starts from the runs
before it: a run that was merged is removed only when a later epoch begins.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession

RATIO = 2


class KeyedState:
    """``reduce`` maps rows to one row per key and is associative: reducing
    reduced parts gives the same as reducing all rows."""

    def __init__(self, spark: SparkSession, path: str, reduce: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.reduce = spark, path, reduce

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> dict[tuple[int, int], int]:
        """Committed runs ``(first, last)`` and their bytes."""
        jvm, root, fs = self._fs()
        found = {}
        for st in fs.listStatus(root) if fs.exists(root) else []:
            m = re.fullmatch(r"r(\d+)-(\d+)", st.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                found[int(m[1]), int(m[2])] = fs.getContentSummary(st.getPath()).getLength()
        return found

    def _folder(self, run: tuple[int, int]) -> str:
        return os.path.join(self.path, f"r{run[0]:010d}-{run[1]:010d}")

    def cover(self, before: int | None = None) -> list[tuple[int, int]]:
        """The widest runs that hold every epoch (before ``before``) once."""
        kept: list[tuple[int, int]] = []
        for lo, hi in sorted(self.runs(), key=lambda r: (r[0], -r[1])):
            if (before is None or hi < before) and (not kept or lo > kept[-1][1]):
                kept.append((lo, hi))
        return kept

    def _union(self, runs: list[tuple[int, int]]) -> DataFrame:
        return fold(DataFrame.unionByName, [self.spark.read.parquet(self._folder(r)) for r in runs])

    def read(self) -> DataFrame | None:
        """One row per key, or None before the first batch."""
        runs = self.cover()
        if not runs:
            return None
        rows = self._union(runs)
        return self.reduce(rows) if len(runs) > 1 else rows

    def _remove(self, runs) -> None:
        jvm, _, fs = self._fs()
        for run in runs:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self._folder(run)), True)

    def apply(self, batch: DataFrame, epoch: int) -> int:
        """Add a micro-batch; returns the bytes written."""
        have, cover = self.runs(), self.cover(before=epoch)
        self._remove(r for r in have if r not in cover)      # merged before, or an earlier attempt
        new = (epoch, epoch)
        self.reduce(batch).write.mode("overwrite").parquet(self._folder(new))
        sizes = self.runs()
        written, taken, total = sizes[new], [new], sizes[new]
        for run in reversed(cover):
            if sizes[run] > RATIO * total:
                break
            taken.insert(0, run)
            total += sizes[run]
        if len(taken) > 1:
            merged = (taken[0][0], epoch)
            self.reduce(self._union(taken)).write.mode("overwrite").parquet(self._folder(merged))
            written += self.runs()[merged]
        return written
