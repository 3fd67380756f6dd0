"""The history as Parquet tables: ``runs``, ``findings_log`` and ``tickets``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import history, report, tickets
from .versions import Versions

ROWS_PER_FILE = 5_000_000


def run_rows(findings: DataFrame, runs: DataFrame, reviewed: bool) -> DataFrame:
    """Rows for ``runs`` (``repo, run_id, ts, commit_sha, branch``) with their counts."""
    return history.run_summaries(runs, findings).withColumn(
        "engine", report.engine_label(F.lit(reviewed)))


def record(findings: DataFrame, runs: DataFrame, root: str, batch: str,
           reviewed: bool = False, store_code: bool = True) -> None:
    """Add runs and their findings (``repo, run_id`` and the finding columns) to the history.

    The caller gives the run ids, so nothing is read back.  A batch has a folder of its own
    and replaces it: a job that is run again after a failure leaves no doubles.
    """
    _write(history.log_rows(findings, store_code), root, "findings_log", batch)
    _write(run_rows(findings, runs, reviewed), root, "runs", batch)


def _write(rows: DataFrame, root: str, name: str, batch: str) -> None:
    """A file for each repository, and more only for what is measured to be large.

    Rebalancing leaves the sizes to Spark: small repositories share a task, and one that holds
    much of the batch is split over several.
    """
    rows.hint("rebalance", "repo").write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(
        "repo").parquet(f"{root}/{name}/batch={batch}")


def read(spark: SparkSession, root: str, name: str, repo: str | None = None) -> DataFrame:
    """A table of the history; one repository is read from its own partition."""
    path = f"{root}/{name}"
    found = spark.read.parquet(path).schema
    # names of repositories are text: "007" is not 7
    kept = StructType([StructField(f.name, StringType()) if f.name == "repo" else f for f in found])
    rows = spark.read.schema(kept).parquet(path).drop("batch")
    return rows if repo is None else rows.where(F.col("repo") == repo)


def utc_now():
    """The time of a run: whole seconds."""
    return F.date_trunc("SECOND", F.current_timestamp())


def read_tickets(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """The newest complete version of the ticket table and its number; (None, 0) if there is none."""
    versions = Versions(spark, root)
    number = versions.number()
    return versions.read("tickets", number), number


def save_tickets(spark: SparkSession, filed: DataFrame, root: str) -> int:
    """Put ``filed`` into the ticket table as a new version and return its number.

    Only the buckets of the tickets filed are rewritten.  Two writers that start from one version want
    the same next one, and the second fails instead of losing what the first has filed.
    """
    change = Versions(spark, root).change()
    change.upsert("tickets", filed.select(*tickets.TICKET), ["fingerprint"],
                  lambda old, new: new if old is None else tickets.upsert(old, new))
    return change.commit()
