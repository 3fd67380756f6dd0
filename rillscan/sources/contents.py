"""A table of scanned contents: what has been scanned is not scanned again.

Below the root lie ``version=<rules>/scanned`` (content keys) and ``version=<rules>/findings``, each in
a folder for every batch.  Findings are written before their keys, so a key is known only when
all its findings are there; a batch that is run again replaces its folders.  Should two batches
have scanned one content at the same time, the first by name counts.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import contents
from ..operators.contents import KEY
from ..operators.joins import partitions
from ..rules import RuleSpec
from .shared import exchanges_dropped, staged, work_folder


class ContentStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def new(spark: SparkSession) -> "ContentStore":
        """An empty store in the shared folder of the session."""
        return ContentStore(spark, f"{work_folder(spark)}/contents-{uuid.uuid4().hex}")

    def _table(self, version: str, name: str) -> DataFrame | None:
        path = f"{self.root}/version={version}/{name}"
        try:
            return self.spark.read.option("basePath", path).parquet(path).withColumn("batch", F.col("batch").cast("string"))
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def scanned(self, version: str) -> DataFrame | None:
        """``content_key, batch`` of what has been scanned with these rules; None if nothing has."""
        rows = self._table(version, "scanned")
        return None if rows is None else rows.groupBy(KEY).agg(F.min("batch").alias("batch"))

    def scan(self, sources: DataFrame, batch: str, rules: list[RuleSpec] | None = None) -> DataFrame:
        """The findings of ``sources``.  Contents that are not in the table are scanned and put there."""
        version = contents.rules_version(rules)
        files, others = contents.keyed(sources, rules), self.scanned(version)
        named = staged(contents.names(files))
        known = None if others is None else others.where(F.col("batch") != batch)
        folder = f"{self.root}/version={version}"
        with exchanges_dropped(self.spark):
            contents.findings_by_content(contents.unscanned(files, known, named), rules).write.mode("overwrite").parquet(f"{folder}/findings/batch={batch}")
            contents.chosen(named, known).select(KEY).write.mode("overwrite").parquet(f"{folder}/scanned/batch={batch}")
        found = self._table(version, "findings").join(self.scanned(version), [KEY, "batch"], "left_semi").drop("batch")
        return contents.on_files(named, found, partitions(sources))
