"""The intervals of :mod:`..operators.lifecycle`, kept up with each batch of runs."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, lifecycle
from .shared import work_folder
from .versions import Versions


class LifecycleTable:
    """Tables ``runs`` (numbered), ``closed`` and ``state`` below a root, in versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    @staticmethod
    def new(spark: SparkSession) -> "LifecycleTable":
        """An empty table in the shared folder of the session."""
        return LifecycleTable(spark, f"{work_folder(spark)}/lifecycle-{uuid.uuid4().hex}")

    def add(self, runs: DataFrame, log: DataFrame) -> int:
        """Put a batch of runs and their log into the table; the version that has them.

        ``runs``: ``repo, run_id, ts``.  Runs of a repository come in the order of time: an earlier run than the last
        one, or the same again, is an error.  Neither older logs nor closed intervals are read.
        """
        change = self.versions.change()
        known = self.versions.read("heads", change.number - 1)
        rows = change.aside("added", runs.select(*history.RUN, "ts"))
        numbered = history.number_runs(rows)
        newest = rows.groupBy("repo").agg(F.max(F.struct("ts", "run_id")).alias("newest"), F.count(F.lit(1)).cast("int").alias("n"))
        if known is None:
            bounds = newest.withColumn("before", F.lit(0))
        else:
            old = known.select("repo", F.col("last").alias("before"), F.col("newest").alias("last_seen"))
            late = rows.join(old, "repo").where(F.struct("ts", "run_id") <= F.col("last_seen"))
            if not late.isEmpty():
                raise ValueError("runs of a repository must come in the order of time")
            bounds = newest.join(old.drop("last_seen"), "repo", "left").fillna(0, ["before"])
        bounds = bounds.select("repo", "before", (F.col("before") + F.col("n")).alias("last"), "newest")
        numbered = numbered.join(bounds.select("repo", "before"), "repo").select(
            *history.RUN, "ts", (F.col("run_ord") + F.col("before")).alias("run_ord"))
        numbered = change.append("runs", numbered)
        found = change.aside("found", lifecycle.islands(numbered, log))  # the one look at the log
        changed, closed = lifecycle.merged(
            self.versions.read("state", change.number - 1), found,
            bounds.select("repo", "before", "last"))
        change.append("closed", closed)
        change.upsert("state", changed, lifecycle.KEY)
        change.upsert("heads", bounds.select("repo", "last", "newest"), ["repo"])
        return change.commit()

    def deltas(self) -> DataFrame:
        return lifecycle.deltas(self.versions.read("runs"), self.versions.read("state"), self.versions.read("closed"))

    def fix_rate(self) -> DataFrame:
        return lifecycle.fix_rate(self.versions.read("runs"), self.versions.read("state"))
