"""Tables that change by buckets: a version is a list of folders.

Below the root, ``data`` has the files and ``manifest/version=N`` says which folders make up each table in
version N.  A change writes new folders and then the manifest of the next version, so
readers see a whole version or the one before, and what a broken-off job left behind belongs to none.  Two
writers that start from one version want the same manifest, and the second fails.

A keyed table is cut into hash buckets, and an upsert rewrites the buckets of its keys, no others.  When
buckets grow beyond ``BUCKET_ROWS`` their number doubles.  An appended table has a folder for
each batch until it is compacted.  So the files of a version are bounded by its rows, not by the changes so far.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FIRST_BUCKETS = 16
BUCKET_ROWS = 2_000_000
MOST_BATCHES = 32
"""Folders of an appended table, beyond which the next change makes one of them."""
_MANIFEST = "name string, bucket int, buckets int, folder string, n long"


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        """The complete versions: those whose writer has left the mark of success."""
        fs, done = self._fs(f"{self.root}/manifest/version=*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(done) or [])

    def number(self) -> int:
        return max(self.numbers(), default=0)

    def folders(self, number: int | None = None) -> list[Row]:
        """The manifest: as many rows as buckets and batches."""
        number = self.number() if number is None else number
        if number == 0:
            return []
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/version={number}").collect()

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        """The table in a version, the newest by default; None if it has none."""
        return self._read([r for r in self.folders(number) if r["name"] == name])

    def _read(self, rows: list[Row]) -> DataFrame | None:
        paths = [f"{self.root}/data/{r.folder}" for r in rows]
        if not paths:
            return None
        return self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def change(self) -> "Change":
        return Change(self)

    def drop_unused(self, keep: int = 2) -> list[str]:
        """Delete what the newest ``keep`` versions do not use: older manifests and their folders.  No
        writer may be at work, since its folders are in no version yet."""
        if keep < 1:
            raise ValueError("keep one version at least")
        numbers = self.numbers()
        if not numbers:
            return []
        used = {r.folder.split("/")[0] for n in numbers[-keep:] for r in self.folders(n)}
        fs, data = self._fs(f"{self.root}/data/*")
        gone = [s.getPath() for s in fs.globStatus(data) or [] if s.getPath().getName() not in used]
        for n in numbers[:-keep]:
            fs.delete(self._fs(f"{self.root}/manifest/version={n}")[1], True)
        for path in gone:
            fs.delete(path, True)
        return sorted(p.getName() for p in gone)


class Change:
    """The next version, from the one that is newest now."""

    def __init__(self, versions: Versions):
        self.versions, self.spark = versions, versions.spark
        self.number = versions.number() + 1
        self.rows = versions.folders(self.number - 1)

    def _folder(self, name: str) -> str:
        return f"{name}-{self.number}-{uuid.uuid4().hex[:12]}"

    def _written(self, name: str, rows: DataFrame) -> Row:
        folder = self._folder(name)
        rows.write.parquet(f"{self.versions.root}/data/{folder}")
        n = self.spark.read.parquet(f"{self.versions.root}/data/{folder}").count()  # from the file footers
        return Row(name=name, bucket=-1, buckets=0, folder=folder, n=n)

    def aside(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows from a folder that belongs to no version: for what a change reads several times."""
        folder = f"{self.versions.root}/data/{self._folder(name)}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows as a batch and read them from there; many batches become one folder."""
        batch = self._written(name, rows.hint("rebalance"))
        self.rows.append(batch)
        own = [r for r in self.rows if r["name"] == name]
        if len(own) > MOST_BATCHES:
            whole = self._written(name, self.versions._read(own).hint("rebalance"))
            self.rows = [r for r in self.rows if r["name"] != name] + [whole]
        return self.versions._read([batch])

    def upsert(self, name: str, rows: DataFrame, key: list[str],
               merge: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None) -> list[int]:
        """Put rows, one for each key, in place of those of their keys; the buckets that were written.

        ``merge`` makes the new rows of the buckets from the old ones and those given.
        """
        merge = merge or (lambda old, new: _replaced(old, new, key))
        own = [r for r in self.rows if r["name"] == name]
        buckets = own[0].buckets if own else FIRST_BUCKETS
        full = sum(r.n for r in own) > BUCKET_ROWS * buckets
        buckets *= 2 if full else 1
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        asked = rows.select(bucket.alias("bucket")).distinct().collect()  # numbers of buckets
        touched = set(range(buckets)) if full else {r.bucket for r in asked}
        if not touched:
            return []
        old = self.versions._read(own if full else [r for r in own if r.bucket in touched])
        folder = self._folder(name)
        path = f"{self.versions.root}/data/{folder}"
        merged = merge(old, rows).withColumn("bucket", bucket)
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        counts = self.spark.read.parquet(path).groupBy("bucket").count().collect()
        kept = [] if full else [r for r in own if r.bucket not in touched]
        self.rows = [r for r in self.rows if r["name"] != name] + kept + [
            Row(name=name, bucket=r["bucket"], buckets=buckets, folder=f"{folder}/bucket={r['bucket']}", n=r["count"])
            for r in counts]
        return sorted(r["bucket"] for r in counts)

    def commit(self) -> int:
        path = f"{self.versions.root}/manifest/version={self.number}"
        rows = [tuple(r[c] for c in ("name", "bucket", "buckets", "folder", "n")) for r in self.rows]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(path)
        return self.number


def _replaced(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    if old is None:
        return new
    return old.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)
