"""Joins that stay even when one key holds a large part of the rows, and exchanges that stay when rows unfold."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
PART_BYTES = 1 << 20
"""Bytes of input files for a partition whose rows unfold behind the exchange."""
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_LENGTHS = 1000


def partitions(rows: DataFrame) -> int | None:
    """How many partitions the files below ``rows`` ask for; None if they are small or there are none.

    Spark measures an exchange by its compressed bytes and merges what looks small.  Texts that are alike compress
    well and unfold into many times as much, so where they do, the number follows the size of the files.  Of very
    many files some lengths stand for all: they decide the number alone.  Within :func:`layout.by_file` the
    buckets of the tables decide.
    """
    if rows.sparkSession.conf.get(ALL_KEYS) == "false":
        return None
    names = sorted(rows.inputFiles())
    some = names[::len(names) // _LENGTHS + 1]
    context = rows.sparkSession.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)) for name in some]
    found = [(path.getFileSystem(conf), path) for path in paths]
    size = sum(fs.getFileStatus(path).getLen() for fs, path in found if fs.exists(path)) * len(names) // max(1, len(some))
    n = -(-size // PART_BYTES)
    return max(n, context.defaultParallelism) if n > 1 else None


def parted(rows: DataFrame, n: int | None, *key: str) -> DataFrame:
    """The rows exchanged by their key, over ``n`` partitions that Spark does not merge; as they are without a number."""
    return rows if n is None else rows.repartition(n, *key)


def lookup(left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str],
           how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join many rows to the one row of their key.

    ``right`` has one row per key.  It is repeated ``salts`` times and the rows of a hot key
    on the left, told apart by ``spread_by``, go to as many tasks.  No hint is given: Spark
    broadcasts ``right`` when its measured size allows, and otherwise shuffles both sides.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    return left.withColumn("salt", salt).join(
        right.select("*", every), [*on, "salt"], how).drop("salt")
