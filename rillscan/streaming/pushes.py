"""Reviewing pushes as they land.

The reference work is one batch per push; this runs the same batch functions on each
micro-batch.  Nothing is kept between batches: tickets and history are tables.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import review
from ..sources import history


def review_pushes(files: DataFrame, root: str, checkpoint: str,
                  policy: review.ReviewPolicy | None = None, **trigger) -> StreamingQuery:
    """Scan arriving files (``repo, run_id, path, content``) into the history below ``root``.

    Both tables are written as :func:`sources.history.record` writes them, so a run without
    findings leaves its row in ``runs``.  Each batch owns one folder and replaces it: a batch that
    is run again after a failure leaves no doubles.
    """
    policy = policy or review.ReviewPolicy()

    def one_batch(batch: DataFrame, number: int) -> None:
        # A batch may hold several runs of a repository: the run tells their files apart.
        keyed = batch.withColumn("commit_sha", F.col("run_id").cast("string"))
        run_type = batch.schema["run_id"].dataType
        found = review.review(keyed, rules=policy).withColumn("run_id", F.col("commit_sha").cast(run_type))
        runs = batch.select("repo", "run_id").distinct().select(
            "*", history.utc_now().alias("ts"), F.lit("").alias("commit_sha"), F.lit("").alias("branch"))
        history.record(found, runs, root, f"stream-{number}", store_code=policy.store_code)

    return (files.writeStream.foreachBatch(one_batch)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
