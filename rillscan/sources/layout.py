"""Tables laid out by file: written into buckets once, joined and scanned without an exchange after that.

Files, changed lines and findings of one layout have the same buckets, by the hash of their file key and sorted by
it.  Scopes, context windows and the change filter then find the rows of a file where they lie: Spark drops the
exchange of a scan by itself, since its input has the partitioning that it asks for.  A bucket is read by one task, so
their number follows the size of the files.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import ALL_KEYS
from ..operators.lines import file_key

BUCKET_BYTES = 256 << 20


@dataclass(frozen=True)
class Layout:
    buckets: int

    @staticmethod
    def of(sources: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> "Layout":
        """Buckets of about so many bytes of text."""
        size = sources.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
        return Layout(max(1, -(-size // bucket_bytes)))

    def write(self, rows: DataFrame, path: str, table: str) -> DataFrame:
        """Write rows with a file key below ``path`` as an external table, a file for each bucket, and read it."""
        key = file_key(rows)
        rows.repartition(self.buckets, *key).write.bucketBy(self.buckets, *key).sortBy(*key).option("path", path).saveAsTable(table)
        return rows.sparkSession.table(table)


@contextmanager
def by_file(spark: SparkSession) -> Iterator[None]:
    """Scans, and joins on the lines of a file, use its bucket.

    Spark exchanges both sides of a join on (file, line) by all of these unless it is told that the file
    will do.
    """
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)
