"""Rows behind the reports.  Drawing them is left to others."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import severity

PAGE_ROWS = 10_000


def engine_label(reviewed: Column) -> Column:
    return F.when(reviewed, "static+llm").otherwise("static")


def report_order() -> list[Column]:
    """Severity, file, line; the rule decides between equals."""
    return [severity.rank(F.col("severity")), F.col("file"), F.col("line"), F.col("rule_id")]


def report_rows(findings: DataFrame) -> DataFrame:
    """One row per finding as a report shows it."""
    return findings.withColumns({
        "rank": severity.rank(F.col("severity")),
        "label": severity.category_label(F.col("category")),
        "severity_title": F.initcap("severity"),
        "tag": F.when(F.col("confirmed").isNull(), "")
        .when(F.col("confirmed"), "confirmed").otherwise("possible false positive"),
        "code": F.left("code", F.lit(fixed.REPORT_CODE_CHARS)),
    })


def severity_badges(counts: DataFrame, *key: str) -> DataFrame:
    """``badges``: severities that occur, in fixed order, with their counts."""
    pairs = F.array(*[
        F.struct(F.lit(s.title()).alias("severity"), F.col(s.lower()).alias("n"))
        for s in fixed.SEVERITIES])
    return counts.select(
        *key, F.filter(pairs, lambda p: p["n"] > 0).alias("badges"))


def report_documents(findings: DataFrame, run: list[str], reviewed: Column,
                     page_rows: int = PAGE_ROWS, runs: DataFrame | None = None) -> DataFrame:
    """Nested documents per run: engine, total, counts by severity, findings in report order.

    A document holds ``page_rows`` findings and the last of a run the rest; ``page`` counts them in
    report order, whatever the size of the run.  With ``runs``, a run without findings has one
    empty document.  A finding's place is the number of findings of its run in earlier
    (severity, file) groups, from their counts, and its number within its group: no task
    gathers a run.
    """
    by_severity = findings.groupBy(*run, "severity").agg(F.count("*").alias("n"))
    head = by_severity.groupBy(*run).agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n"))))
        .alias("by_severity"))
    if runs is not None:
        head = runs.select(*run).distinct().join(head, run, "left").withColumns({
            "total": F.coalesce("total", F.lit(0).cast("long")),
            "by_severity": F.coalesce("by_severity", F.create_map().cast("map<string,bigint>"))})
    head = head.withColumn("pages", F.greatest(F.ceil(F.col("total") / page_rows), F.lit(1)).cast("int"))
    pages = head.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))

    columns = [c for c in findings.columns if c not in run]
    group = [*run, "sev_rank", "file"]
    ranked = findings.withColumn("sev_rank", severity.rank(F.col("severity")))
    sizes = ranked.groupBy(*group).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*run).orderBy("sev_rank", "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy(*group).orderBy("line", "rule_id", *[c for c in columns if c not in ("line", "rule_id", "file")])
    placed = ranked.withColumn("nth", F.row_number().over(within)).join(offsets, group)
    place = F.col("before") + F.col("nth") - 1
    item = F.struct(place.alias("place"), F.struct(*columns).alias("finding"))
    bodies = placed.withColumn("page", F.floor(place / page_rows).cast("int")).groupBy(*run, "page").agg(
        F.sort_array(F.collect_list(item)).alias("items"))
    return pages.join(bodies, [*run, "page"], "left").select(
        *run, "page", "pages", engine_label(reviewed).alias("engine"), "total", "by_severity",
        F.coalesce(F.transform("items", lambda i: i["finding"]), F.array()).alias("findings"))


def json_rows(findings: DataFrame) -> DataFrame:
    """Each finding as one JSON object, with its empty fields."""
    return findings.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").partitionBy("repo").json(path)


def trend_series(history: DataFrame) -> DataFrame:
    """Runs of :func:`history.run_history` scaled for a chart, with their labels.

    ``height`` is the total against the largest one shown, ``critical_share`` the critical
    part of it.  The history holds a bounded number of runs per repository; the oldest comes
    first.
    """
    scale = history.groupBy("repo").agg(F.greatest(F.max("total"), F.lit(1)).alias("scale"))
    label = F.when(F.coalesce("commit_sha", F.lit("")) == "", F.col("run_id").cast("string"))
    return history.join(scale, "repo").withColumns({
        "height": F.col("total") / F.col("scale"),
        "critical_share": F.col("critical") / F.greatest("total", F.lit(1)),
        "label": F.left(label.otherwise(F.col("commit_sha")), F.lit(fixed.COMMIT_CHARS)),
        "shown_at": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
    }).drop("scale").orderBy("repo", F.desc("age"))


def whole_percent(rate: Column) -> Column:
    """Rate as a whole percentage, halves to even."""
    return F.bround(rate * 100, 0).cast("int")
