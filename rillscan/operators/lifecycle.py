"""The life of findings as intervals of runs.

An *interval* is an unbroken row of runs of a repository that have a fingerprint.  Two tables keep
all of them, and nothing that is in them is computed again:

* ``closed``: ``repo, fingerprint, from_ord, to_ord``, only ever added to;
* ``state``: ``repo, fingerprint, intervals, open_from``, one row for each fingerprint ever seen, with
  the first run of the interval that still goes on (null if it is gone now).

What a batch of runs adds follows from its own log and the state of the repositories in it.  A finding that
is still there changes no row, so the work of a batch is that of its log and its changes.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import RUN, distinct_findings
from .joins import lookup

KEY = ["repo", "fingerprint"]


def islands(numbered: DataFrame, log: DataFrame) -> DataFrame:
    """``repo, fingerprint, from_ord, to_ord`` of numbered runs: islands between gaps.

    A finding's window has one row for each run of the batch that saw it.
    """
    seen = lookup(distinct_findings(log), numbered.select(*RUN, "run_ord"), [*RUN], ["fingerprint"], "inner")
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("run_ord"))
    return seen.withColumn("island", F.col("run_ord") - nth).groupBy(*KEY, "island").agg(
        F.min("run_ord").alias("from_ord"), F.max("run_ord").alias("to_ord")).drop("island")


def merged(state: DataFrame | None, found: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch changes: rows of ``state`` in place of those of their keys, and new rows of ``closed``.

    ``found`` are the islands of the batch; ``bounds`` has for each repository in it ``before`` and
    ``last``, the numbers of the run before the batch (0 if there is none) and of its last run.
    """
    at = lookup(found, bounds, ["repo"], ["fingerprint"], "inner")
    if state is None:
        state = found.select(*KEY, F.lit(0).cast("long").alias("intervals"), F.lit(None).cast("int").alias("open_from")).limit(0)
    known = lookup(state, bounds, ["repo"], ["fingerprint"], "inner")
    # each island by itself, and the open interval as an island that ends before the batch
    open_rows = known.where("open_from IS NOT NULL").select(
        *KEY, F.col("open_from").alias("from_ord"), F.col("before").alias("to_ord"), "before", "last", F.lit(True).alias("old"))
    rows = open_rows.unionByName(at.withColumn("old", F.lit(False)))
    grouped = rows.groupBy(*KEY).agg(
        F.max("before").alias("before"), F.max("last").alias("last"),
        F.min(F.when(F.col("old"), F.col("from_ord"))).alias("was_open"),
        F.array_sort(F.collect_list(F.when(~F.col("old"), F.struct("from_ord", "to_ord")))).alias("found"))
    first = F.get("found", F.lit(0))
    goes_on = F.col("was_open").isNotNull() & F.coalesce(first["from_ord"] == F.col("before") + 1, F.lit(False))
    own = F.struct(F.col("was_open").alias("from_ord"), F.col("before").alias("to_ord"))
    glued = F.struct(F.col("was_open").alias("from_ord"), first["to_ord"].alias("to_ord"))
    whole = (F.when(goes_on, F.concat(F.array(glued), F.slice("found", 2, F.greatest(F.size("found") - 1, F.lit(0)))))
             .when(F.col("was_open").isNotNull(), F.concat(F.array(own), F.col("found")))
             .otherwise(F.col("found")))
    lives = grouped.select(*KEY, "last", "was_open", whole.alias("lives"))
    ends = lives.select(*KEY, F.col("last"), F.explode("lives").alias("i")).where(F.col("i.to_ord") < F.col("last"))
    closed = ends.select(*KEY, "i.from_ord", "i.to_ord")
    newest = F.element_at("lives", -1)
    now = lives.select(
        *KEY, "was_open", F.when(newest["to_ord"] == F.col("last"), newest["from_ord"]).alias("open_from"),
        (F.size("lives") - F.when(F.col("was_open").isNotNull(), 1).otherwise(0)).cast("long").alias("more"))
    changes = now.where((F.col("more") > 0) | ~F.col("open_from").eqNullSafe(F.col("was_open")))
    changed = changes.join(state.select(*KEY, "intervals"), KEY, "left").select(
        *KEY, (F.coalesce("intervals", F.lit(0)) + F.col("more")).alias("intervals"), F.col("open_from").cast("int"))
    return changed, closed


def deltas(numbered: DataFrame, state: DataFrame, closed: DataFrame) -> DataFrame:
    """:func:`history.run_deltas` from the intervals: what starts with a run, and what ended with the run before."""
    starts = closed.select("repo", F.col("from_ord").alias("run_ord"), F.lit(1).alias("new"), F.lit(0).alias("gone"))
    opened = state.where("open_from IS NOT NULL").select("repo", F.col("open_from").alias("run_ord"), F.lit(1), F.lit(0))
    ended = closed.select("repo", (F.col("to_ord") + 1).alias("run_ord"), F.lit(0), F.lit(1))
    counts = starts.union(opened).union(ended).groupBy("repo", "run_ord").agg(
        F.sum("new").alias("introduced"), F.sum("gone").alias("fixed"))
    return numbered.join(counts, ["repo", "run_ord"], "left").fillna(0, ["introduced", "fixed"])


def fix_rate(numbered: DataFrame, state: DataFrame) -> DataFrame:
    """:func:`history.fix_rate` from the state alone."""
    runs = numbered.groupBy("repo").agg(F.count(F.lit(1)).alias("runs"))
    seen = state.groupBy("repo").agg(
        F.count(F.lit(1)).alias("distinct"), F.count("open_from").alias("open"))
    return runs.join(seen, "repo", "left").fillna(0, ["distinct", "open"]).select(
        "repo", "distinct", "open", (F.col("distinct") - F.col("open")).alias("resolved"),
        F.coalesce(F.try_divide(F.col("distinct") - F.col("open"), F.col("distinct")), F.lit(0.0)).alias("fix_rate"), "runs")


def reopened(state: DataFrame) -> DataFrame:
    """Findings that came back after they were fixed, with how many times."""
    return state.where("intervals > 1").select(*KEY, (F.col("intervals") - 1).alias("times"), F.col("open_from").isNotNull().alias("open"))
