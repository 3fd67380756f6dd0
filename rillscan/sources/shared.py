"""A folder that driver and executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names.  Where it is unset, as in tests, one of our own, which
    only a session in a single process can share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="rillscan-"))
    return _own[0]


def staged(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for what is read several times and costly to make."""
    path = f"{work_folder(rows.sparkSession)}/staged-{uuid.uuid4().hex}"
    with exchanges_dropped(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written here is not made again from its exchanges, so their files go when it is there.  Otherwise they lie
    beside it until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
