import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from rillscan.operators import history, tickets
from rillscan.sources import history as store

RUNS = "repo string, run_id long, ts timestamp, commit_sha string, branch string"
LOG = ("repo string, run_id long, rule_id string, title string, category string, severity string, "
       "path string, line int, code string, why string, fix string, confirmed boolean")


def _runs(spark, pairs):
    return spark.createDataFrame(
        [(repo, run, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * run), f"sha{run}", "main")
         for repo, run in pairs], RUNS)


def _log(spark, rows):
    return spark.createDataFrame(
        [(repo, run, rule, "t", "MEMORY", sev, f"{rule}.py", 1, code, "w", "f", None)
         for repo, run, rule, code, sev in rows], LOG)


@pytest.fixture(scope="module")
def runs_and_log(spark):
    """Repository a: three runs, in which p stays, q goes and comes back, s and t come late.
    Repository clean: one run without findings."""
    log = _log(spark, [
        ("a", 10, "p.x", "one", "MEDIUM"), ("a", 10, "q.x", "two", "INFO"), ("a", 10, "q.x", "two ", "INFO"),
        ("a", 20, "p.x", "one", "MEDIUM"), ("a", 20, "s.x", "five", "MAJOR"),
        ("a", 30, "p.x", "one", "MEDIUM"), ("a", 30, "q.x", "two", "INFO"), ("a", 30, "t.x", "six", "CRITICAL")])
    return _runs(spark, [("a", 10), ("a", 20), ("a", 30), ("clean", 10)]), history.with_fingerprint(log)


def test_fingerprint(spark):
    rows = spark.createDataFrame(
        [("r", "f", "  x =  1 "), ("r", "f", "x\t= 1"), ("r", "f", "x = 2"), ("r", "f", None),
         ("r", "f", "")], "rule_id string, path string, code string")
    fps = [r.fingerprint for r in history.with_fingerprint(rows).collect()]
    assert fps[0] == fps[1] != fps[2] and fps[3] == fps[4] and {len(f) for f in fps} == {16}
    import hashlib
    assert fps[0] == hashlib.sha1(b"r|f|x = 1").hexdigest()[:16]
    assert fps[3] == hashlib.sha1(b"r|f|").hexdigest()[:16]


def test_fix_rate_and_deltas(runs_and_log):
    runs, log = runs_and_log
    rate = {r.repo: r for r in history.fix_rate(runs, log).collect()}
    a, clean = rate["a"], rate["clean"]
    assert (a.distinct, a.open, a.resolved, a.fix_rate, a.runs) == (4, 3, 1, 0.25, 3)
    assert (clean.distinct, clean.open, clean.resolved, clean.fix_rate, clean.runs) == (0, 0, 0, 0.0, 1)
    rows = {(r.repo, r.run_id): r for r in history.run_history(runs, log).collect()}
    assert [(rows["a", n].introduced, rows["a", n].fixed) for n in (10, 20, 30)] == [(2, 0), (1, 1), (2, 1)]
    # an unknown severity counts in the total only
    assert (rows["a", 20].total, rows["a", 20].medium, rows["a", 20].info) == (2, 1, 0)
    # the oldest shown run has no run before it
    (last,) = [r for r in history.run_history(runs, log, 1).collect() if r.repo == "a"]
    assert (last.run_id, last.introduced, last.fixed) == (30, 3, 0)


def test_gate(runs_and_log):
    runs, log = runs_and_log

    def failed(bar, log=log):
        found = {(r.repo, r.run_id) for r in history.gate(runs, log, bar).collect() if r.failed}
        counts = history.gate_by_counts(history.run_summaries(runs, log), bar)
        assert {(r.repo, r.run_id) for r in counts.collect() if r.failed} == found
        return found

    assert failed("HIGH") == failed("bad name") == failed("critical") == {("a", 30)}
    assert failed("medium") == {("a", 10), ("a", 20), ("a", 30)}
    assert failed("NONE") == set()
    odd = log.where(F.col("severity") == "MAJOR")  # counts as INFO
    assert failed("LOW", odd) == set() and failed("INFO", odd) == {("a", 20)}


def test_deltas_by_brute_force_with_a_hot_repository(spark):
    rng = random.Random(5)
    pairs, rows = [], []
    for repo, n in [("hot", 60), ("b", 5), ("c", 1)]:
        for run in range(n):
            pairs.append((repo, run))
            for _ in range(rng.choice([0, 1, 6])):
                rows.append((repo, run, f"r{rng.randint(1, 4)}", f"c{rng.randint(1, 2)}", "LOW"))
    runs, log = _runs(spark, pairs), history.with_fingerprint(_log(spark, rows))
    sets = {}
    for r in log.collect():
        sets.setdefault((r.repo, r.run_id), set()).add(r.fingerprint)
    got = history.run_deltas(history.number_runs(runs), log).collect()
    assert len(got) == len(pairs)
    for r in got:
        now, was = sets.get((r.repo, r.run_id), set()), sets.get((r.repo, r.run_id - 1), set())
        assert r.run_ord == r.run_id + 1
        assert (r.introduced, r.fixed) == (len(now - was), len(was - now))


def test_record_and_read(spark, runs_and_log, tmp_path):
    """Batches of one run each; one is recorded three times, at last with a model's review and with its code."""
    runs, log = runs_and_log
    root = str(tmp_path)

    def record(run, **how):
        store.record(log.where(F.col("run_id") == run), runs.where(F.col("run_id") == run), root, f"b{run}", **how)

    record(10, store_code=False)
    record(20)
    for how in ({}, {"store_code": False}, {"reviewed": True}):
        record(30, **how)

    def saved(name, repo=None):
        return store.read(spark, root, name, repo)

    # identity comes from the code, kept or not
    assert sorted((r.run_id, r.fingerprint) for r in saved("findings_log").collect()) == sorted(
        (r.run_id, r.fingerprint) for r in log.collect())
    codes = {run: {r.code for r in saved("findings_log", "a").where(F.col("run_id") == run).collect()} for run in (10, 20, 30)}
    assert codes == {10: {""}, 20: {"one", "five"}, 30: {"one", "two", "six"}}
    assert saved("findings_log", "clean").count() == 0

    kept = {(r.repo, r.run_id): r for r in saved("runs").collect()}
    assert {k: r.engine for k, r in kept.items()} == {
        ("a", 10): "static", ("a", 20): "static", ("a", 30): "static+llm", ("clean", 10): "static"}
    assert {k: r.total for k, r in kept.items()} == {("a", 10): 3, ("a", 20): 2, ("a", 30): 3, ("clean", 10): 0}
    assert (kept["a", 30].critical, kept["a", 30].info, kept["a", 20].critical) == (1, 1, 0)
    assert [kept["a", n].commit_sha for n in (10, 20, 30)] == ["sha10", "sha20", "sha30"]

    # what was computed from memory comes out of the tables as well
    for of in (history.fix_rate, history.run_history):
        rows = [sorted(map(str, of(*tables).select(*columns).collect())) for tables in
                [(runs, log), (saved("runs").select(*runs.columns), saved("findings_log"))]
                for columns in [("repo", "distinct", "open") if of is history.fix_rate else ("repo", "run_id", "introduced", "fixed")]]
        assert rows[0] == rows[1]


def _files(root, name, batch):
    return sorted(os.path.relpath(os.path.join(folder, f), root) for folder, _, names in os.walk(f"{root}/{name}/batch={batch}")
                  for f in names if f.endswith(".parquet"))


def test_files_of_a_batch_follow_its_size(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    runs = _runs(spark, [(f"r{i}", 1) for i in range(12)])
    log = _log(spark, [(f"r{i % 12}", 1, f"x{i}", "c", "LOW") for i in range(2400)]).repartition(8)
    store.record(log, runs, root, "small")
    assert len(_files(root, "findings_log", "small")) == len(_files(root, "runs", "small")) == 12
    monkeypatch.setattr(store, "ROWS_PER_FILE", 50)
    store.record(log, runs, root, "large")
    assert len(_files(root, "findings_log", "large")) == 12 * 4
    assert store.read(spark, root, "findings_log").count() == 4800


def _findings(spark, rows):
    return history.with_fingerprint(spark.createDataFrame(
        [(i, rule, "t x", "MEMORY", sev, f"{rule}.py", 7, code, "w", "f", note)
         for i, (rule, sev, code, note) in enumerate(rows)],
        "n int, rule_id string, title string, category string, severity string, path string, "
        "line int, code string, why string, fix string, explanation string")
    ).withColumnRenamed("path", "file")


def test_ticket_queue(spark):
    rows = _findings(spark, [("r1", "CRITICAL", "a", ""), ("r2", "HIGH", "b", ""),
                             ("r1", "CRITICAL", " a ", ""), ("r3", "CRITICAL", "c", "n"),
                             ("r4", "ODD", "d", "")])
    filed = rows.where("n = 3").select(
        "fingerprint", F.lit("K-1").alias("issue_key"), F.lit("u").alias("url"),
        F.lit(dt.datetime(2024, 1, 1)).alias("created_ts"), "severity", "title")
    policy = tickets.TicketPolicy(project_key="P", labels=["a b"])
    live = {r.n: (r.status, r.issue_key) for r in
            tickets.queue(rows, filed, policy, ["n"]).collect()}
    assert live == {0: ("created", None), 2: ("skipped", None), 3: ("skipped", "K-1")}
    dry = tickets.queue(rows, filed, policy, ["n"], dry_run=True)
    assert {r.n: (r.status, r.issue_key) for r in dry.collect()} == {
        0: ("created", "(dry-run)"), 2: ("created", "(dry-run)"), 3: ("skipped", "K-1")}
    total = tickets.summary(dry, True).first()
    assert (total.eligible, total.created, total.skipped, total.dry_run) == (3, 2, 1, True)
    unseen = tickets.queue(rows, None, policy, ["n"]).collect()
    # without a store nothing is known to be filed, so each finding is
    assert {r.n: (r.status, r.issue_key) for r in unseen} == {n: ("created", None) for n in (0, 2, 3)}


def test_payload(spark):
    rows = _findings(spark, [("r1", "CRITICAL", "x" * 600, "seen"), ("r2", "CRITICAL", "", "")])
    policy = tickets.TicketPolicy(project_key="P", labels=["a b"])
    first, second = (r.payload.fields for r in tickets.with_payload(
        tickets.queue(rows, None, policy, ["n"]), policy).orderBy("n").collect())
    assert first.project.key == "P" and first.issuetype.name == "Bug"
    assert first.summary == "[Code Review] CRITICAL: t x (r1.py:7)"
    assert list(first.labels) == ["a-b", "sev-critical"]
    assert "x" * 500 in first.description and "x" * 501 not in first.description
    assert "seen" in first.description and "{code}" not in second.description
    bare = tickets.TicketPolicy(project_key="P", include_code=False, summary_prefix="p" * 300)
    hidden = tickets.with_payload(tickets.queue(rows, None, bare, ["n"]), bare).first().payload.fields
    assert "xxx" not in hidden.description and len(hidden.summary) == 250


def test_upsert(spark, tmp_path):
    cols = "fingerprint string, issue_key string, url string, created_ts long, severity string, title string"
    old = spark.createDataFrame([("a", "1", "u", 1, "HIGH", "t"), ("b", "2", "u", 1, "HIGH", "t")], cols)
    new = spark.createDataFrame([("b", "3", "u", 1, "LOW", "t"), ("c", "4", "u", 2, "LOW", "t")], cols)
    root = str(tmp_path / "tickets")
    assert store.read_tickets(spark, root) == (None, 0)
    assert store.save_tickets(spark, old, root) == 1 and store.save_tickets(spark, new, root) == 2
    table, number = store.read_tickets(spark, root)
    assert {r.fingerprint: r.issue_key for r in table.collect()} == {"a": "1", "b": "3", "c": "4"} and number == 2
    os.remove(f"{root}/manifest/version=2/_SUCCESS")  # a version that was never finished
    table, number = store.read_tickets(spark, root)
    assert {r.fingerprint: r.issue_key for r in table.collect()} == {"a": "1", "b": "2"} and number == 1
    with pytest.raises(Exception, match="exists"):
        store.save_tickets(spark, new, root)


def test_names_of_repositories_stay_text(spark, tmp_path):
    runs = _runs(spark, [("007", 1), ("7", 1), ("7", 2)])
    store.record(_log(spark, [("007", 1, "r1", "a", "LOW")]), runs, str(tmp_path), "b1")
    assert sorted((r.repo, r.run_id) for r in store.read(spark, str(tmp_path), "runs").collect()) == [("007", 1), ("7", 1), ("7", 2)]
    assert store.read(spark, str(tmp_path), "runs", "007").count() == 1
    assert [r.repo for r in store.read(spark, str(tmp_path), "findings_log").collect()] == ["007"]


def test_the_time_of_a_run_is_whole_seconds(spark):
    now = spark.range(1).select(store.utc_now().alias("t")).first().t
    assert now.microsecond == 0
