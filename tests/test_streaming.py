"""Streams: pushes reviewed on their changed lines, and deltas from keyed state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillscan.operators import history
from rillscan.sources import diffs
from rillscan.sources.versions import Versions
from rillscan.streaming import changes, deltas

PUSHES = "repo string, run_id long, commit_sha string, diff_text string, ts timestamp"
FILES = "repo string, commit_sha string, path string, content string, ts timestamp"


def _at(minute):
    return dt.datetime(2024, 3, 1) + dt.timedelta(minutes=minute)


def _diff(*hunks):
    """(path, start, count) hunks, a file each."""
    return "\n".join(f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1 +{start},{n} @@\n-x" + "\n+y" * n for p, start, n in hunks)


class Landing:
    """Two folders of files that streams read, and the review of them."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def push(self, minute, run, commit, diff_text, repo="r"):
        self.spark.createDataFrame([(repo, run, commit, diff_text, _at(minute))], PUSHES).write.mode("append").parquet(f"{self.folder}/pushes")

    def file(self, minute, commit, path, content, repo="r"):
        self.spark.createDataFrame([(repo, commit, path, content, _at(minute))], FILES).write.mode("append").parquet(f"{self.folder}/files")

    def drain(self, **how):
        streams = [self.spark.readStream.schema(s).parquet(f"{self.folder}/{n}") for n, s in (("pushes", PUSHES), ("files", FILES))]
        query = changes.review_changes(*streams, f"{self.folder}/out", f"{self.folder}/checkpoint", availableNow=True, **how)
        query.awaitTermination(300)
        assert query.exception() is None
        tables = Versions(self.spark, f"{self.folder}/out")
        found = sorted((r.run_id, r.commit_sha, r.path, r.line, r.rule_id) for r in tables.read("findings").collect())
        states = sorted((r.run_id, r.path, r.state) for r in tables.read("files").where("path IS NOT NULL").collect())
        return found, states


def test_changed_lines_of_files_before_and_after_the_push(spark, tmp_path):
    land = Landing(spark, tmp_path)
    land.file(0, "c1", "a.sql", "select *\nselect id\nselect *")
    land.push(1, 1, "c1", _diff(("a.sql", 3, 1), ("b.sql", 1, 2), ("note.md", 1, 1), ("tests/t.sql", 1, 1)))
    found, states = land.drain()
    # line 1 is not changed, b.sql has not come yet; the others are not reviewed
    assert found == [(1, "c1", "a.sql", 3, "sql.select_star")] and states == [(1, "a.sql", "reviewed")]
    # a stream that starts again goes on from its state: the file is late, but in time
    land.file(6, "c1", "b.sql", "like '%x'\nselect *")
    found, states = land.drain()
    assert found == [(1, "c1", "a.sql", 3, "sql.select_star"), (1, "c1", "b.sql", 1, "sql.leading_wildcard"),
                     (1, "c1", "b.sql", 2, "sql.select_star")]
    assert states == [(1, "a.sql", "reviewed"), (1, "b.sql", "reviewed")]
    # the next head has its own text, and one commit may be pushed twice
    land.push(7, 2, "c2", _diff(("a.sql", 1, 3)))
    land.push(7, 3, "c2", _diff(("a.sql", 1, 1)))
    land.file(7, "c2", "a.sql", "select id\nselect *\nselect *")
    found, _ = land.drain()
    assert [f for f in found if f[0] > 1] == [(2, "c2", "a.sql", 2, "sql.select_star"), (2, "c2", "a.sql", 3, "sql.select_star")]
    rows = {r.run_id: r for r in changes.pushes_reviewed(spark, f"{tmp_path}/out", "LOW").collect()}
    assert {k: (r.total, r.reviewed, r.missing, r.complete) for k, r in rows.items()} == {
        1: (3, 2, 0, True), 2: (2, 1, 0, True), 3: (0, 1, 0, True)}
    assert rows[1].failed and not rows[3].failed


def test_missing_and_too_late_files(spark, tmp_path):
    land = Landing(spark, tmp_path)
    land.push(0, 1, "c1", _diff(("a.sql", 1, 1), ("gone.sql", 1, 1)))
    land.file(1, "c1", "a.sql", "select *")
    assert land.drain()[1] == [(1, "a.sql", "reviewed")]
    # time goes on in both streams, past what the push can wait for
    for minute in (60, 90):
        land.push(minute, minute, f"c{minute}", _diff(("z.sql", 1, 1)))
        land.file(minute, f"c{minute}", "z.sql", "select id")
        found, states = land.drain()
    assert (1, "gone.sql", "missing") in states and len(found) == 1
    land.file(2, "c1", "gone.sql", "select *")  # far too late: the push was given up
    assert land.drain()[0] == found
    rows = {r.run_id: r for r in changes.pushes_reviewed(spark, f"{tmp_path}/out").collect()}
    assert (rows[1].reviewed, rows[1].missing, rows[1].complete, rows[60].complete) == (1, 1, False, True)


def test_a_push_without_reviewed_files_leaves_its_row(spark, tmp_path):
    land = Landing(spark, tmp_path)
    for minute in (0, 60, 90):
        land.push(minute, minute, "c", "diff --git a/x.md b/x.md" if minute == 0 else _diff(("z.sql", 1, 1)))
        land.file(minute, "c", "z.sql", "select id")
        land.drain()
    rows = {r.run_id: (r.total, r.reviewed, r.missing, r.failed) for r in changes.pushes_reviewed(spark, f"{tmp_path}/out").collect()}
    assert rows[0] == (0, 0, 0, False) and rows[60] == (0, 1, 0, False)


def test_ranges_mark_the_lines_that_windows_mark(spark):
    """Random diffs, broken ones among them."""
    rng = random.Random(12)
    parts = ["diff --git a/x.c b/x.c", "--- a/x.c", "+++ b/x.c", "+++ b/y.py", "+++ /dev/null", '+++ "b/\\303\\251 z.c"', "+++ b/x.c\t",
             "@@ -1 +5 @@", "@@ -1,3 +2,4 @@ for", "@@ -0,0 +1,0 @@", "@@ -1,2 +99999999999,3 @@", "@@ broken", "@@ -1,99999999999999999999 +7 @@",
             "\\ No newline at end of file", "+x", "-y", " z", "++ b/q.c", "", "+++ b/"]
    rows = [("r", i, "\n".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(600)]
    table = spark.createDataFrame(rows, "repo string, push_id long, diff_text string")
    key = ["repo", "push_id", "path", "line"]
    windows = diffs.changed_lines(table).select(key)
    ranges = diffs.changed_files(table, "repo", "push_id").select(
        "repo", "push_id", "path", F.explode(diffs.lines_of(F.col("ranges"))).alias("line"))
    got, want = ({tuple(r) for r in df.collect()} for df in (ranges, windows))
    assert got == want and len(want) > 200
    assert ranges.count() == len(want)


@pytest.mark.parametrize("text", [None, ""])
def test_diffs_without_text(spark, text):
    table = spark.createDataFrame([("r", 1, text)], "repo string, push_id long, diff_text string")
    assert diffs.changed_files(table, "repo").count() == 0


RUNS_LOG = "repo string, run_id long, ts timestamp, fingerprint string"


def test_deltas_from_state_are_those_of_the_batch(spark, tmp_path):
    """Runs of three repositories land in four pieces, out of order within the watermark; the stream
    starts again for each.  A last run closes the ones before it."""
    rng = random.Random(8)
    seen = {(repo, run): {f"f{i}" for i in rng.sample(range(12), rng.choice([0, 2, 7]))}
            for repo, n in (("hot", 16), ("b", 5), ("c", 2)) for run in range(16 - n, 16)}
    rows = [(repo, run, _at(10 * run), f) for (repo, run), fps in seen.items() for f in [None, *fps]]
    pieces = [[r for r in rows if low <= r[1] < high] for low, high in ((0, 4), (4, 9), (9, 15), (15, 16))]
    for piece in pieces:
        rng.shuffle(piece)
    # half of the rows of run 8 come with the piece after theirs
    late = [r for r in pieces[1] if r[1] == 8][::2]
    pieces[1] = [r for r in pieces[1] if r not in late]
    pieces[2] += late
    pieces.append([("end", 99, _at(1000), None)])
    landing, root = str(tmp_path / "landing"), str(tmp_path / "out")
    for piece in pieces:
        spark.createDataFrame(piece, RUNS_LOG).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(RUNS_LOG).parquet(landing)
        query = deltas.keep_deltas(stream, root, str(tmp_path / "checkpoint"), "15 MINUTES", 3, availableNow=True)
        query.awaitTermination(300)
        assert query.exception() is None
    runs = spark.createDataFrame([(repo, run, _at(10 * run)) for repo, run in seen], "repo string, run_id long, ts timestamp")
    log = spark.createDataFrame([(repo, run, f) for (repo, run), fps in seen.items() for f in fps],
                                "repo string, run_id long, fingerprint string")
    plain = history.run_deltas(history.number_runs(runs), log)
    want = {(r.repo, r.run_id): (r.introduced, r.fixed) for r in plain.collect()}
    got = {(r.repo, r.run_id): (r.introduced, r.fixed) for r in deltas.deltas(spark, root).collect() if r.repo != "end"}
    assert got == want


def test_a_run_goes_to_all_shards_and_a_finding_to_one(spark):
    rows = spark.createDataFrame([("r", 1, _at(0), None), ("r", 1, _at(0), "a"), ("r", 1, _at(0), "b")], RUNS_LOG)
    got = sorted((r.fingerprint or "", r.shard) for r in deltas.dealt(rows, 4).collect())
    assert [s for f, s in got if not f] == [0, 1, 2, 3] and len(got) == 6
