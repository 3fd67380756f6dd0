"""Micro-batches into versioned tables, each once."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..sources.versions import Change, Versions

PROGRESS = "stream string, batch long"


def into_versions(rows: DataFrame, root: str, name: str, put: Callable[[Change, DataFrame], None]) -> DataStreamWriter:
    """A writer that calls ``put`` with the next version and a batch, then commits the version.

    The number of the batch is part of the version.  A batch that comes again, because the stream broke off
    after the commit, is left out; one that broke off before it is in no version.  One stream writes below a root.
    """
    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        change = Versions(spark, root).change()
        done = Versions(spark, root).read("progress", change.number - 1)
        if done is not None and not done.where((done["stream"] == name) & (done["batch"] >= number)).isEmpty():
            return
        batch = batch.persist()  # several tables are made of one state
        try:
            put(change, batch)
            change.upsert("progress", spark.createDataFrame([(name, number)], PROGRESS), ["stream"])
            change.commit()
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(one_batch)
