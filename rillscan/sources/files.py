"""Source trees as a table of files."""

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext.lstrip("."))


def read_tree(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """``repo, path, content`` of all supported files below ``root``.

    Without a name the folders right below the root are the repositories, read all at once; files
    right below the root belong to the repository ''.

    The name pattern is applied while listing, so other files are never opened.  Broken bytes
    are replaced and files that cannot be read are left out.
    """
    names = "*.{" + ",".join(_any_case(e) for e in fixed.EXTENSION_RULESETS) + "}"
    files = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", names)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .load(_qualified(spark, root) if "://" not in root and not root.startswith("file:") else root)
    )
    full = F.url_decode(F.replace(F.regexp_replace(
        F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    below = F.substring(full, F.lit(len(_qualified(spark, root)) + 1), F.length(full))
    parts = F.split(F.when(F.contains(below, F.lit("/")), below).otherwise(F.concat(F.lit("/"), below)), "/", 2)
    return files.select(
        (F.lit(repo) if repo is not None else parts[0]).alias("repo"),
        (below if repo is not None else parts[1]).alias("path"),
        F.make_valid_utf8("value").alias("content"),
    ).where(~F.concat(F.lit("/"), F.col("path")).contains("/.git/"))


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as the file system names it, without scheme and host, with a slash at the end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(re.sub("^/+", "/", root))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = posixpath.normpath(fs.makeQualified(path).toUri().getPath())
    return full.rstrip("/") + "/"
