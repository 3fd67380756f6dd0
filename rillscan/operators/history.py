"""Finding history: counts per run, changes between runs, fix rate, gate.

``runs`` has one row per run: ``repo, run_id, ts`` and more.  ``log`` has one row per finding
of a run: ``repo, run_id, fingerprint, severity`` and more.  Everything is driven from
``runs``, since a run without findings has no row in the log and still fixes things.

No window spans the findings of a repository or of a run: sets are compared by grouping on
(repo, run, fingerprint), a key that no hot repository or run can make heavy.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import severity, text
from .joins import lookup

RUN = ("repo", "run_id")
COUNTS = [s.lower() for s in fixed.SEVERITIES]


def with_fingerprint(findings: DataFrame, file: str = "path") -> DataFrame:
    return findings.withColumn(
        "fingerprint", text.fingerprint(F.col("rule_id"), F.col(file), F.col("code")))


def log_rows(findings: DataFrame, store_code: bool = True) -> DataFrame:
    """Rows for the log.  The identity is taken from the real code even if it is not kept."""
    rows = with_fingerprint(findings)
    if not store_code:
        rows = rows.withColumn("code", F.lit(""))
    return rows.select(
        *RUN, "fingerprint", "rule_id", "title", "category", "severity",
        F.col("path").alias("file"), "line", "code", "why", "fix", "confirmed")


def severity_counts(log: DataFrame, *key: str) -> DataFrame:
    """Total and one count per severity; an unknown severity counts in the total only."""
    return log.groupBy(*(key or RUN)).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in fixed.SEVERITIES])


def run_summaries(runs: DataFrame, log: DataFrame) -> DataFrame:
    counts = severity_counts(log)
    return runs.join(counts, [*RUN], "left").fillna(0, ["total", *COUNTS])


def newest_runs(runs: DataFrame, n: int = fixed.TREND_RUNS) -> DataFrame:
    """The ``n`` latest runs of each repository, with ``age`` 1 for the newest.

    Spark cuts to ``n`` rows per repository before and after the exchange.
    """
    newest = Window.partitionBy("repo").orderBy(F.desc("ts"), F.desc("run_id"))
    return runs.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n)


def number_runs(runs: DataFrame) -> DataFrame:
    """Add ``run_ord``, 1 for the oldest run of a repository.

    Numbers start in the day and continue over days, so that no task sorts all runs of one
    repository: it sees the runs of a day, or one row per day.
    """
    runs = runs.withColumn("day", F.to_date("ts"))
    per_day = runs.groupBy("repo", "day").agg(F.count("*").alias("of_day"))
    earlier = (Window.partitionBy("repo").orderBy("day")
               .rowsBetween(Window.unboundedPreceding, -1))
    per_day = per_day.select(
        "repo", "day", F.coalesce(F.sum("of_day").over(earlier), F.lit(0)).alias("earlier"))
    in_day = Window.partitionBy("repo", "day").orderBy("ts", "run_id")
    return (
        runs.withColumn("in_day", F.row_number().over(in_day))
        .join(per_day, ["repo", "day"])
        .withColumn("run_ord", (F.col("in_day") + F.col("earlier")).cast("int"))
        .drop("day", "in_day", "earlier")
    )


def distinct_findings(log: DataFrame) -> DataFrame:
    """The fingerprints of each run, once."""
    return log.select(*RUN, "fingerprint").distinct()


def _seen(numbered: DataFrame, log: DataFrame) -> DataFrame:
    return lookup(
        distinct_findings(log), numbered.select(*RUN, "run_ord"), [*RUN], ["fingerprint"], "inner")


def run_deltas(numbered: DataFrame, log: DataFrame) -> DataFrame:
    """Fingerprints introduced and fixed by each run against the run before it.

    Each finding is written for its run and for the next one; grouping the pairs tells what
    is new (not in the run before) and what is gone (only there).  One exchange, unique keys.
    """
    both = _seen(numbered, log).select(
        "repo", "fingerprint",
        F.explode(F.array(
            F.struct(F.col("run_ord").alias("ord"), F.lit(1).alias("now"), F.lit(0).alias("was")),
            F.struct((F.col("run_ord") + 1).alias("ord"), F.lit(0).alias("now"),
                     F.lit(1).alias("was")))).alias("p"),
    ).select("repo", "fingerprint", "p.*")
    changes = (
        both.groupBy("repo", "ord", "fingerprint")
        .agg(F.max("now").alias("now"), F.max("was").alias("was"))
        .groupBy("repo", F.col("ord").alias("run_ord"))
        .agg(F.count_if((F.col("now") == 1) & (F.col("was") == 0)).alias("introduced"),
             F.count_if((F.col("now") == 0) & (F.col("was") == 1)).alias("fixed"))
    )
    return numbered.join(changes, ["repo", "run_ord"], "left").fillna(0, ["introduced", "fixed"])


def run_history(runs: DataFrame, log: DataFrame, limit: int = fixed.TREND_RUNS) -> DataFrame:
    """The newest runs with their counts and deltas.

    Deltas look at the shown runs only: all findings of the oldest one count as introduced.
    """
    shown = newest_runs(runs, limit)
    # ages count down to 1, so this numbers the shown runs in time order (from 1 - limit)
    shown = shown.withColumn("run_ord", 1 - F.col("age"))
    return run_deltas(run_summaries(shown, log), log).drop("run_ord")


def fix_rate(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Per repository: distinct findings, those open in the newest run, resolved, rate, runs."""
    newest = runs.groupBy("repo").agg(
        F.max(F.struct("ts", "run_id")).alias("newest"), F.count("*").alias("runs"))
    times = runs.select(*RUN, F.struct("ts", "run_id").alias("seen"))
    seen = lookup(distinct_findings(log), times, [*RUN], ["fingerprint"], "inner")
    by_last = (
        seen.groupBy("repo", "fingerprint").agg(F.max("seen").alias("last"))
        .groupBy("repo", "last").agg(F.count("*").alias("n"))
    )
    totals = (
        by_last.join(newest.select("repo", "newest"), "repo")
        .groupBy("repo")
        .agg(F.sum("n").alias("distinct"),
             F.sum(F.when(F.col("last") == F.col("newest"), F.col("n")).otherwise(0)).alias("open"))
    )
    return newest.join(totals, "repo", "left").fillna(0, ["distinct", "open"]).select(
        "repo", "distinct", "open",
        (F.col("distinct") - F.col("open")).alias("resolved"),
        F.coalesce(F.try_divide(F.col("distinct") - F.col("open"), F.col("distinct")),
                   F.lit(0.0)).alias("fix_rate"),
        "runs")


def gate(runs: DataFrame, log: DataFrame, fail_on: str = "HIGH") -> DataFrame:
    """``failed`` per run: any finding at or above the threshold.  NONE never fails."""
    if fail_on.strip().upper() == "NONE":
        return runs.withColumn("failed", F.lit(False))
    bar = severity.threshold(fail_on, fixed.GATE_DEFAULT_THRESHOLD)
    worst = log.groupBy(*RUN).agg(
        F.min(severity.rank(F.col("severity"), fixed.UNKNOWN_RANK_GATE)).alias("worst"))
    return runs.join(worst, [*RUN], "left").withColumn(
        "failed", F.coalesce(F.col("worst") <= bar, F.lit(False))).drop("worst")


def gate_by_counts(counted: DataFrame, fail_on: str = "HIGH") -> DataFrame:
    """:func:`gate` from the rows of :func:`run_summaries`, without the log."""
    if fail_on.strip().upper() == "NONE":
        return counted.withColumn("failed", F.lit(False))
    bar = severity.threshold(fail_on, fixed.GATE_DEFAULT_THRESHOLD)
    below = sum((F.col(c) for c in COUNTS[bar + 1:]), F.lit(0))
    known = sum((F.col(c) for c in COUNTS), F.lit(0))
    unknown = F.col("total") - known if bar < fixed.UNKNOWN_RANK_GATE else F.lit(0)
    return counted.withColumn("failed", F.col("total") - below - unknown > 0)
