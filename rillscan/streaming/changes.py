"""Review of pushes as they land, on their changed lines.

Two streams meet: pushes with their diff, and files as they are at the head of a push.  Either may come
first.  Each file that a push changed waits for its text as long as the watermark allows; what
has not come by then is noted as missing, so a push never passes because a file was late.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import history, policy
from ..plans import review
from ..sources import diffs
from ..sources.versions import Change, Versions
from .sink import into_versions

REVIEWED, MISSING, PUSHED = "reviewed", "missing", "pushed"


def awaited_files(pushes: DataFrame, files: DataFrame, wait: str, rules: review.ReviewPolicy) -> DataFrame:
    """``repo, run_id, commit_sha, path, ranges, content, came``: a row for each file that a push
    changed, once it has come or cannot come in time any more (``came`` is null), and one without a path
    for the push itself.

    State holds the ranges of changed lines and the files of the last ``wait``, no diffs.
    """
    asked = pushes.withWatermark("ts", wait).select("repo", "run_id", "commit_sha", "ts", F.explode(F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<struct<first:int,last:bigint>>").alias("ranges"))),
        diffs.by_file(diffs.changed_ranges(F.col("diff_text"))))).alias("f")).select(
        "repo", "run_id", "commit_sha", "ts", "f.path", "f.ranges")
    wanted = F.col("path").isNull() | policy.reviewable_path(F.col("path"), rules.ignore_paths)
    landed = files.withWatermark("ts", wait).select(
        F.col("repo").alias("file_repo"), F.col("commit_sha").alias("file_commit"), F.col("path").alias("file_path"), "content",
        F.col("ts").alias("came"))
    near = F.expr(f"came BETWEEN ts - INTERVAL {wait} AND ts + INTERVAL {wait}")
    return asked.where(wanted).join(
        landed, (F.col("repo") == F.col("file_repo")) & (F.col("commit_sha") == F.col("file_commit"))
        & (F.col("path") == F.col("file_path")) & near, "leftOuter",
    ).select("repo", "run_id", "commit_sha", "path", "ranges", "content", "came")


def review_changes(pushes: DataFrame, files: DataFrame, root: str, checkpoint: str, wait: str = "10 MINUTES",
                   rules: review.ReviewPolicy | None = None, **trigger) -> StreamingQuery:
    """Review ``pushes`` (``repo, run_id, commit_sha, diff_text, ts``) with ``files`` (``repo, commit_sha, path,
    content, ts``) into versioned tables below ``root``.

    ``findings`` has the findings on changed lines; ``files`` a row for each file with what became of
    it, and one for each push.  Each micro-batch is in the tables once.
    """
    rules = rules or review.ReviewPolicy()

    def put(change: Change, batch: DataFrame) -> None:
        # two pushes may have one commit: the run tells their lines apart
        rows = batch.withColumn("run", F.to_json(F.struct("run_id", "commit_sha")))
        here = rows.where("came IS NOT NULL").dropDuplicates(["repo", "run", "path"])
        sources = here.select("repo", F.col("run").alias("commit_sha"), "path", "content")
        changed = here.select("repo", F.col("run").alias("commit_sha"), "path", F.explode(diffs.lines_of(F.col("ranges"))).alias("line"))
        found = review.review(sources, changed, rules)
        names = here.select("repo", F.col("run").alias("commit_sha"), "run_id", F.col("commit_sha").alias("head")).distinct()
        log = found.join(names, ["repo", "commit_sha"]).drop("commit_sha").withColumnRenamed("head", "commit_sha")
        if not rules.store_code:
            log = history.with_fingerprint(log).withColumn("code", F.lit(""))
        else:
            log = history.with_fingerprint(log)
        change.append("findings", log)
        state = F.when(F.col("path").isNull(), PUSHED).when(F.col("came").isNull(), MISSING).otherwise(REVIEWED)
        change.append("files", batch.select("repo", "run_id", "commit_sha", "path", state.alias("state")).distinct())

    rows = awaited_files(pushes, files, wait, rules)
    return into_versions(rows, root, "changes", put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def pushes_reviewed(spark: SparkSession, root: str, fail_on: str = "HIGH") -> DataFrame:
    """Each push with its counts, the number of files reviewed and missing, and ``failed``.

    A push with a missing file is not ``complete``: it may pass only for want of it.
    """
    versions = Versions(spark, root)
    files = versions.read("files").groupBy("repo", "run_id", "commit_sha").agg(
        F.count_if(F.col("state") == REVIEWED).alias("reviewed"), F.count_if(F.col("state") == MISSING).alias("missing"))
    key = F.to_json(F.struct("run_id", "commit_sha"))
    counted = history.run_summaries(
        files.withColumnRenamed("run_id", "run").withColumn("run_id", F.to_json(F.struct(F.col("run").alias("run_id"), "commit_sha"))),
        versions.read("findings").withColumn("run_id", key))
    return history.gate_by_counts(counted, fail_on).drop("run_id").withColumnRenamed("run", "run_id").withColumn(
        "complete", F.col("missing") == 0)
