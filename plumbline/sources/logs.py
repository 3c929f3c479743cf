"""Append logs that a stopped run goes on with.

A log is a folder of Parquet batches. A batch is written to a folder of its own attempt; when Spark has written it
whole, a commit file with the batch's name and the attempt's is put in place, by a rename. Readers see committed
attempts only, so a run that stops at any point leaves no part of a batch in the log, and a batch that is committed is
not computed again. One driver writes a log at a time. Rows of one key that is in the log already are left out of later
batches, so no key is there twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ordered import running_before
from plumbline.sources.scratch import delete_folder, materialize


class Log:
    """The log of a folder, with rows told by their keys."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str]) -> None:
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _store(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> dict[str, str]:
        """Batches in the log, each with its attempt's folder."""
        files = self._store
        if not files.exists(self._path("commits")):
            return {}
        names = [s.getPath().getName() for s in files.listStatus(self._path("commits"))]
        return dict(n.split("=", 1) for n in names if "=" in n and n[0] not in "._")

    def read(self) -> DataFrame | None:
        """All rows of the log, with their batch; None if nothing is committed."""
        out = None
        for batch, attempt in sorted(self.committed().items()):
            rows = self.spark.read.parquet(f"{self.folder}/batches/{attempt}").withColumn("batch", F.lit(batch))
            out = rows if out is None else out.unionByName(rows)
        return out

    def pending(self, rows: DataFrame) -> DataFrame:
        """rows whose keys are not in the log."""
        done = self.read()
        if done is None:
            return rows
        match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        return rows.alias("a").join(done.select(*self.keys).alias("b"), match, "left_anti")

    def append(self, batch: str, rows: DataFrame) -> bool:
        """Write and commit a batch; False, and nothing computed, if it is in the log already."""
        if "=" in batch or "/" in batch or batch[:1] in ("", ".", "_"):
            raise ValueError(f"{batch!r} is no name of a batch")
        if batch in self.committed():
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.folder}/batches/{attempt}")
        except Exception:
            delete_folder(self.spark, f"{self.folder}/batches/{attempt}")
            raise
        files, waiting = self._store, self._path(f".commit-{attempt}")
        files.create(waiting, False).close()
        files.mkdirs(self._path("commits"))
        if not files.rename(waiting, self._path(f"commits/{batch}={attempt}")):
            raise OSError(f"batch {batch} could not be committed")
        return True

    def run(self, rows: DataFrame, size: int, solve: Callable[[DataFrame], DataFrame], most: int | None = None) -> list[str]:
        """Solve rows in batches of ``size`` in the order of their keys and append the results; at most ``most`` batches.

        A batch has the same rows in every run on the same rows, so a later run goes on with the first that is not
        committed. Gives the batches that were added.
        """
        placed = running_before(rows, self.keys, {"__at": F.lit(1).cast("long")}, "log-order")
        placed = materialize(placed.withColumn("__batch", F.floor(F.col("__at") / size)).drop("__at"), "log-batches")
        last = placed.agg(F.max("__batch")).first()[0]
        added: list[str] = []
        for n in range(0 if last is None else last + 1):
            name = f"batch-{n:06d}"
            if most is not None and len(added) >= most:
                break
            if name in self.committed():
                continue
            own = self.pending(placed.filter(F.col("__batch") == n).drop("__batch"))
            if self.append(name, solve(own)):
                added.append(name)
        return added
