"""Exchanges whose rows unfold: their partitions follow the size of the files."""

import re

import pytest
from pyspark.sql import functions as F

from rillscan.operators import contents, joins, lines, policy, pruned, retrieval, scan, scope, verdicts
from rillscan.rules import rules_for
from rillscan.sources import diffs, shared
from rillscan.sources.lifecycle import LifecycleTable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def widths(df):
    """Partitions of the exchanges that ask for a number."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", plan(df))]


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "PART_BYTES", 1_000)
    body = F.concat_ws("\n", F.lit("for a in b:"), F.concat(F.lit("  c = db.connect("), F.sha2(F.col("id").cast("string"), 512), F.lit(")")))
    made = spark.range(0, 300, 1, 3).select(
        (F.col("id") % 3).cast("string").alias("repo"), F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), body.alias("content"))
    made.write.parquet(f"{tmp_path}/files")
    return spark.read.parquet(f"{tmp_path}/files")


def test_partitions_follow_the_files(spark, files, monkeypatch):
    few = joins.partitions(files)
    assert few > 8
    monkeypatch.setattr(joins, "PART_BYTES", 500)
    assert joins.partitions(files) >= 2 * few - 1
    monkeypatch.setattr(joins, "PART_BYTES", 1 << 20)
    assert joins.partitions(files) is None and joins.partitions(spark.range(9)) is None


def test_scopes_of_large_tables_are_not_merged_into_few_tasks(spark, files):
    n = joins.partitions(files)
    found = scan.scan(files, rules_for("python"))
    assert widths(found) == [n]
    apart = scope.annotate(lines.explode_lines(files), scope.INDENT)
    assert widths(apart) == [n]
    near = spark.createDataFrame(files.collect(), files.schema)
    assert rows(found) == rows(scan.scan(near, rules_for("python"))) and found.count() == 300
    assert rows(apart) == rows(scope.annotate(lines.explode_lines(near), scope.INDENT))


def test_hits_carry_no_texts_of_their_rules_through_the_window(files):
    text = plan(scan.scan(files, rules_for("python", "java")))
    assert "Window [min(" in text
    assert not any("Project [" in line and "why#" in line and "fallback#" in line for line in text.splitlines())


def test_files_meet_changes_findings_and_windows_by_their_key(spark, files, monkeypatch):
    """One exchange of each side, over partitions by the size of the files: nothing moves again for the line."""
    monkeypatch.setattr(joins, "PART_BYTES", 2_000)
    changed = spark.createDataFrame([("0", "f3.py", 2), ("1", "f4.py", 1), ("2", "x.py", 2)], "repo string, path string, line int")
    near = spark.createDataFrame(files.collect(), files.schema)
    found = scan.scan(policy.touched_files(files, changed), rules_for("python"))
    cut = policy.on_changed_lines(found, changed)
    windows = verdicts.context_windows(scan.scan(files, rules_for("python")), files)
    assert rows(cut) == rows(policy.on_changed_lines(scan.scan(near, rules_for("python")), changed)) and cut.count() == 1
    assert rows(windows) == rows(verdicts.context_windows(scan.scan(near, rules_for("python")), near)) and windows.count() == 300
    assert not re.search(r"hashpartitioning\(.*ENSURE_REQUIREMENTS", plan(windows))
    assert set(re.findall(r"hashpartitioning\([^()]*line#\d+, (\d+)\)", plan(cut))) == {str(joins.partitions(found))}


def test_windows_leave_the_row_of_their_file_together(files):
    """The lines of a file are not copied for each of its windows."""
    windows = verdicts.context_windows(scan.scan(files, rules_for("python")), files)
    assert re.search(r"\[repo#\d+, path#\d+\], false, \[line#\d+, snippet#\d+\]", plan(windows))


def test_prompts_move_no_windows(spark, files, tmp_path):
    """Findings meet their files by the file and their references where they lie: nothing moves by line or rule text."""
    found = scan.scan(files, rules_for("python"))
    near = spark.createDataFrame(files.collect(), files.schema)
    notes = spark.createDataFrame([(0, "a", "Database", "connect once"), (1, "b", "Loops", "loop less")], "note_ord int, id string, topic string, text string")
    made = verdicts.prompts(found, files, notes)
    assert not re.search(r"hashpartitioning\([^()]*(line|query)#", plan(made).split("Initial Plan")[0])
    assert rows(made) == rows(verdicts.prompts(scan.scan(near, rules_for("python")), near, notes)) and made.count() == 300


def test_staged_rows_leave_no_exchanges(spark):
    def exchanged():
        return set(re.findall(r"shuffle_\d+", spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(",")))

    before, numbers = exchanged(), spark.range(100).selectExpr("id % 7 AS k")
    kept = shared.staged(numbers.groupBy("k").count())
    assert {(r["k"], r["count"]) for r in kept.collect()} == {(k, len(range(k, 100, 7))) for k in range(7)}
    assert not exchanged() - before and spark.conf.get(shared.CLEANUP) == "false"


def test_scans_exchange_their_files_once(spark, files):
    """As texts: lines, scopes and contents of commits are settled where the files lie."""
    n = joins.partitions(files)

    def dealt(df):
        return [line for line in plan(df).splitlines() if f", {n}), REPARTITION_BY_NUM" in line]

    found = scan.scan(files, rules_for("python"))
    (moved,) = [line for line in plan(found).splitlines() if "Exchange hashpartitioning" in line]
    assert dealt(found) == [moved] and re.search(r"Exchange hashpartitioning.*\n.*Project \[.*content#", plan(found))
    changed = spark.createDataFrame([("0", "f3.py", 2)], "repo string, path string, line int")
    touched = scan.scan(policy.touched_files(files, changed), rules_for("python"), placed=True)
    assert len(dealt(touched)) == 1 and touched.count() == 1
    keyed = contents.keyed(files, rules_for("python"))
    scanned = contents.findings_by_content(contents.unscanned(keyed, named=shared.staged(contents.names(keyed))), rules_for("python"))
    assert 1 <= len(dealt(scanned)) <= 2 and not any("content_key" in line for line in dealt(scanned))


def test_findings_are_copied_for_shared_contents_only(spark, files, monkeypatch):
    monkeypatch.setattr(contents, "SHARED", 10)
    same = files.selectExpr("repo", "concat('g', path) AS path", "IF(repo = '0', 'a = db.connect(x)\nfor a in b:\n  c = db.connect(u)', content) AS content")
    both = files.unionByName(same)
    found = contents.scan_contents(both, rules_for("python"))
    assert rows(found) == rows(scan.scan(both, rules_for("python")))
    assert "sequence(0, 15" not in plan(found)


def test_queries_are_exchanged_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "PART_BYTES", 500)
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 97).cast("string")) for k in (1, 3, 7, 11)])
    spark.range(0, 400, 1, 2).select(F.col("id").alias("q"), words.alias("text")).write.parquet(f"{tmp_path}/q")
    q = spark.read.parquet(f"{tmp_path}/q")
    n = spark.range(40).select(F.col("id").alias("note_ord"), F.lit("").alias("topic"), words.alias("text"))
    plain = retrieval.best_notes(spark.createDataFrame(q.collect(), q.schema), "q", n, 2)
    for ours in (retrieval.best_notes(q, "q", n, 2), pruned.best_notes(q, "q", pruned.NoteIndex.of(n).stored(f"{tmp_path}/i"), 2)):
        assert rows(ours) == rows(plain)
        assert set(widths(ours)) == {joins.partitions(q)}
        assert not any("hashpartitioning(q#" in line and "ENSURE" in line for line in plan(ours).splitlines())


def test_pushes_are_exchanged_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "PART_BYTES", 500)
    body = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x"), F.col("id"), F.lit(".py\n@@ -1,1 +5,2 @@\n-a\n+b\n+++ b/y.py\n"))
    spark.range(200).select(F.lit("r").alias("repo"), F.col("id").alias("push_id"), body.alias("diff_text")).write.parquet(f"{tmp_path}/d")
    pushes = spark.read.parquet(f"{tmp_path}/d")
    found = diffs.changed_lines(pushes)
    assert widths(found) == [joins.partitions(pushes)] and "ENSURE_REQUIREMENTS" not in plan(found)
    assert {(r.path, r.line) for r in found.where("push_id = 7").collect()} == {("x7.py", 5), ("x7.py", 6)} and found.count() == 400


def test_log_is_read_once_by_a_batch(spark, tmp_path):
    log = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "repo string, run_id int, fingerprint string")
    runs = spark.createDataFrame([("r", 1, 1), ("r", 2, 2)], "repo string, run_id int, ts int").selectExpr(
        "repo", "run_id", "timestamp_seconds(ts) AS ts")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    table = LifecycleTable(spark, str(tmp_path / "t"))
    table.add(runs, log.withColumn("fingerprint", counted.asNondeterministic()("fingerprint")))
    assert seen.value == 2
    assert {(r.run_id, r.introduced, r.fixed) for r in table.deltas().collect()} == {(1, 1, 0), (2, 1, 1)}
