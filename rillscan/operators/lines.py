"""Files to rulesets and to numbered lines.

``sources`` has one row per file: ``repo, path, content`` and, when several commits are read at
once, ``commit_sha``; all but the content are its key.  A file is one row, so the lines of a
file never exceed what one Spark row can hold (2 GiB): that bounds every per-file window below, however large the corpus or a repository is.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text

_KEY = ("repo", "commit_sha", "path")


def file_key(*frames: DataFrame) -> list[str]:
    """Columns that tell files apart.  If one of the frames knows the commit, all must: lines of
    one commit say nothing about another."""
    if len({"commit_sha" in df.columns for df in frames}) > 1:
        raise ValueError("commit_sha must be given on all sides or on none")
    return [c for c in _KEY if all(c in df.columns for df in frames)]


def extension_rulesets(spark) -> DataFrame:
    """The 15-row dimension ``ext, rulesets``: fixed size, so it is safe to broadcast."""
    return spark.createDataFrame(
        list(fixed.EXTENSION_RULESETS.items()), "ext string, rulesets array<string>")


def with_rulesets(sources: DataFrame) -> DataFrame:
    """Keep files of a supported language and add ``ext`` and ``rulesets``.

    The list of rulesets stays in the row, so a file that two rulesets read is not doubled.
    """
    dim = F.broadcast(extension_rulesets(sources.sparkSession))
    return sources.withColumn("ext", text.extension("path")).join(dim, "ext")


def supported(path: Column) -> Column:
    return text.extension(path).isin(list(fixed.EXTENSION_RULESETS))


def explode_lines(sources: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; trailing empty lines are kept."""
    key = file_key(sources)
    return sources.select(
        *key, F.posexplode(text.split_lines(F.col("content"))).alias("pos", "raw")
    ).select(*key, (F.col("pos") + 1).alias("line"), "raw")


def skipped(s: Column, ruleset: Column) -> Column:
    """True for a trimmed line that is blank or a comment of the ruleset."""
    out = s == ""
    for name, prefixes in fixed.SKIP_PREFIXES.items():
        out = out | ((ruleset == name) & text.starts(s, *prefixes))
    return out
