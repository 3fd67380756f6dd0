"""Plans: how often rows are exchanged, what is read, what must never appear."""

import re

import pytest
from pyspark.sql import functions as F

from rillscan.operators import history, joins, policy, scan, verdicts
from rillscan.plans import corpus
from rillscan.plans.queries import QUERIES
from rillscan.rules import rules_for
from rillscan.sources import diffs, layout
from rillscan.sources import history as store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|range|single|round)", plan(df), re.I))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sources"))
    spark.createDataFrame(
        [("r", "a.java", "for (;;) {\n}", "x" * 100)],
        "repo string, path string, content string, other string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_scan_exchanges_once_and_reads_its_columns(stored):
    found = scan.scan(stored)
    assert exchanges(found) == 1
    assert re.search(r"ReadSchema: struct<repo:string,path:string,content:string>", plan(found))
    assert exchanges(scan.scan(stored, rules_for("sql"))) == 0


def test_generated_methods_are_small_enough_to_compile(spark, stored):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = scan.scan(stored)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_top_runs_are_cut_before_the_exchange(spark):
    runs = spark.range(10).select(
        (F.col("id") % 2).alias("repo"), F.col("id").alias("run_id"), F.col("id").alias("ts"))
    assert plan(history.newest_runs(runs, 3)).count("WindowGroupLimit") == 2


def test_one_repository_is_read_from_its_partition(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "repo string, run_id int").write.partitionBy(
        "repo").parquet(f"{tmp_path}/runs")
    rows = store.read(spark, str(tmp_path), "runs", "a")
    assert re.search(r"PartitionFilters: \[[^\]]*repo[^\]]* = a", plan(rows))
    assert [r.run_id for r in rows.collect()] == [1]


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairs_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    python = ("EvalPython", "InPandas", "InArrow") if name != "user_udtf_rule" else ()  # whose rules are Python
    for bad in ("CartesianProduct", "NestedLoopJoin", *python):
        assert bad not in text


def test_lookup_keeps_every_row_of_a_hot_key(spark):
    left = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, "k", "left").select("k", "id", "v")
    salted = joins.lookup(left, right, ["k"], ["id"])
    assert salted.count() == 900
    assert salted.select("k", "id", "v").exceptAll(plain).count() == 0
    gone = joins.lookup(left, right, ["k"], ["id"], "left_anti")
    assert gone.count() == left.join(right, "k", "left_anti").count()


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    """Files, changed lines and findings, each written once by buckets of their file."""
    root = str(tmp_path_factory.mktemp("placed"))
    files = corpus.sources(spark, SF).drop("commit_sha")
    changed = diffs.changed_lines(corpus.diffs(spark, SF)).select("repo", "path", "line").distinct()
    where = layout.Layout(8)
    tables = {"files": where.write(files, f"{root}/files", "placed_files"),
              "changed": where.write(changed, f"{root}/changed", "placed_changed")}
    tables["found"] = where.write(scan.scan(tables["files"]), f"{root}/found", "placed_found")
    yield tables
    for name in ("files", "changed", "found"):
        spark.sql(f"DROP TABLE placed_{name}")


def _moved(df):
    """Exchanges of the plan that runs, but those that broadcast."""
    df.collect()
    return len(re.findall(r"\bExchange (?:hash|range|single|round)", df._jdf.queryExecution().executedPlan().toString(), re.I))


def test_files_in_their_buckets_are_not_exchanged(spark, placed):
    files, found = placed["files"], placed["found"]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables of any size
    try:
        windows = verdicts.context_windows(found, files)
        assert _moved(windows) == 0
        again = scan.scan(files)
        assert _moved(again) == 0
        touched = policy.touched_files(files, placed["changed"])
        assert _moved(touched) == 0
        with layout.by_file(spark):
            narrowed = policy.on_changed_lines(scan.scan(touched), placed["changed"])
            assert _moved(narrowed) == 0
        assert _moved(scan.scan(files.repartition(3))) > 1  # moved away and back
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    plain = corpus.sources(spark, SF)
    for ours, theirs in [(again, scan.scan(plain)), (windows, verdicts.context_windows(scan.scan(plain), plain))]:
        assert ours.count() == theirs.count() and ours.exceptAll(theirs.select(ours.columns)).count() == 0


def test_buckets_follow_the_size(spark):
    files = spark.createDataFrame([("r", "a.py", "x" * 1000)] * 20, "repo string, path string, content string")
    assert layout.Layout.of(files, 5_000).buckets == 4 and layout.Layout.of(files).buckets == 1
    assert layout.Layout.of(files.limit(0)).buckets == 1
