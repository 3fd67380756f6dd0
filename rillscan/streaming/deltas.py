"""What each run introduces and fixes, while runs land.

State holds the fingerprints of the last run of each repository, dealt to ``shards`` by their hash, so that
a repository with very many findings is in as many tasks.  A run is complete once the watermark has
passed its time; it is then compared with the run before it.  Runs that come later than the
watermark allows are left out.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources.versions import Versions
from .sink import into_versions

SHARDS = 16
OUT = "repo string, shard int, run_id long, ts timestamp, introduced long, fixed long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Findings to the shard of their fingerprint, and the row of a run (no fingerprint) to all of them."""
    own = F.array(F.pmod(F.xxhash64("fingerprint"), F.lit(shards)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    return rows.select("repo", "run_id", "ts", "fingerprint",
                       F.explode(F.when(F.col("fingerprint").isNull(), every).otherwise(own)).alias("shard"))


def _processor():
    import pandas as pd

    class LastRun(StatefulProcessor):
        """``waiting``: runs that may still grow, ``found``: their fingerprints, ``last``: those of the last complete run."""

        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "run_id bigint", "millis bigint")
            self.found = handle.getMapState("found", "run_id bigint, fingerprint string", "there boolean")
            self.last = handle.getMapState("last", "fingerprint string", "there boolean")

        def handleInputRows(self, key, rows, timerValues):
            for batch in rows:
                for run, ts, fingerprint in zip(batch["run_id"], batch["ts"], batch["fingerprint"], strict=True):
                    millis = int(pd.Timestamp(ts).timestamp() * 1000)
                    if not self.waiting.containsKey((int(run),)):
                        self.waiting.updateValue((int(run),), (millis,))
                        self.handle.registerTimer(millis)
                    if fingerprint is not None:
                        self.found.updateValue((int(run), fingerprint), (True,))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            upto = expiredTimerInfo.getExpiryTimeInMs()
            done = sorted((millis, run) for (run,), (millis,) in self.waiting.iterator() if millis <= upto)
            if not done:
                return
            by_run = {run: set() for _, run in done}
            for run, fingerprint in self.found.keys():
                if run in by_run:
                    by_run[run].add(fingerprint)
            last = {f for (f,) in self.last.keys()}
            out = []
            for millis, run in done:
                now = by_run[run]
                out.append((key[0], key[1], run, pd.Timestamp(millis, unit="ms"), len(now - last), len(last - now)))
                for fingerprint in last - now:
                    self.last.removeKey((fingerprint,))
                for fingerprint in now - last:
                    self.last.updateValue((fingerprint,), (True,))
                for fingerprint in now:
                    self.found.removeKey((run, fingerprint))
                self.waiting.removeKey((run,))
                last = now
            yield pd.DataFrame(out, columns=["repo", "shard", "run_id", "ts", "introduced", "fixed"])

        def close(self):
            pass

    return LastRun()


def run_deltas(rows: DataFrame, wait: str = "10 MINUTES", shards: int = SHARDS) -> DataFrame:
    """``repo, shard, run_id, ts, introduced, fixed`` of a stream of ``repo, run_id, ts, fingerprint``.

    Each run has a row without fingerprint, so one that finds nothing still fixes things.
    """
    return dealt(rows, shards).withWatermark("ts", wait).groupBy("repo", "shard").transformWithStateInPandas(
        _processor(), OUT, "append", "eventTime")


def keep_deltas(rows: DataFrame, root: str, checkpoint: str, wait: str = "10 MINUTES", shards: int = SHARDS, **trigger) -> StreamingQuery:
    """Write the deltas of a stream into a versioned table below ``root``, each batch once."""
    conf = rows.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)  # timers and map state need it
    try:
        out = run_deltas(rows, wait, shards)
        return into_versions(out, root, "deltas", lambda change, batch: change.append("deltas", batch)).option(
            "checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        conf.set(_PROVIDER, before)


def deltas(spark: SparkSession, root: str) -> DataFrame:
    """``repo, run_id, introduced, fixed`` of the runs that are complete."""
    rows = Versions(spark, root).read("deltas")
    return rows.groupBy("repo", "run_id").agg(F.sum("introduced").alias("introduced"), F.sum("fixed").alias("fixed"))
