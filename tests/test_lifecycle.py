"""Intervals of findings over batches, and the versions that keep them."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from rillscan.operators import history, lifecycle
from rillscan.sources import versions as store
from rillscan.sources.lifecycle import LifecycleTable
from rillscan.sources.versions import Versions

RUNS = "repo string, run_id long, ts timestamp"
LOG = "repo string, run_id long, fingerprint string"


def _tables(spark, seen):
    """``seen``: (repo, run) to the fingerprints it found."""
    runs = [(repo, run, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * run)) for repo, run in seen]
    log = [(repo, run, f) for (repo, run), fps in seen.items() for f in fps for _ in range(1 + run % 2)]
    return spark.createDataFrame(runs, RUNS), spark.createDataFrame(log, LOG)


def _by_hand(seen):
    """(repo, fingerprint) to its intervals, by stepping through the runs."""
    out = {}
    for repo in {r for r, _ in seen}:
        runs = sorted(run for r, run in seen if r == repo)
        going = {}
        for at, run in enumerate(runs, 1):
            for f in seen[repo, run] - set(going):
                going[f] = at
            for f in set(going) - seen[repo, run]:
                out.setdefault((repo, f), []).append((going.pop(f), at - 1))
        for f, begin in going.items():
            out.setdefault((repo, f), []).append((begin, None))
    return out


def _random(seed):
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(7)]
    return {(repo, run): set(rng.sample(names, rng.choice([0, 1, 3, 6])))
            for repo, n in [("hot", 24), ("b", 6), ("late", 3)] for run in range(30 - n, 30)}


@pytest.mark.parametrize("cuts", [(30,), (8, 20, 30), (1, 27, 28, 29, 30)])
def test_batches_against_steps_through_the_runs(spark, tmp_path, cuts):
    seen = _random(len(cuts))
    runs, log = _tables(spark, seen)
    table, begin = LifecycleTable(spark, str(tmp_path)), 0
    for end in cuts:
        of_batch = (F.col("run_id") >= begin) & (F.col("run_id") < end)
        table.add(runs.where(of_batch), log.where(of_batch))
        begin = end
    want = _by_hand(seen)
    got = {}
    for r in table.versions.read("closed").collect():
        got.setdefault((r.repo, r.fingerprint), []).append((r.from_ord, r.to_ord))
    state = table.versions.read("state").collect()
    for r in state:
        if r.open_from is not None:
            got.setdefault((r.repo, r.fingerprint), []).append((r.open_from, None))
    assert {k: sorted(v, key=lambda i: i[0]) for k, v in got.items()} == want
    assert {(r.repo, r.fingerprint): r.intervals for r in state} == {k: len(v) for k, v in want.items()}
    back = {(r.repo, r.fingerprint): r.times for r in lifecycle.reopened(table.versions.read("state")).collect()}
    assert back == {k: len(v) - 1 for k, v in want.items() if len(v) > 1}

    deltas = history.run_deltas(history.number_runs(runs), log)
    for ours, plain in [(table.deltas(), deltas), (table.fix_rate(), history.fix_rate(runs, log))]:
        columns = [c for c in ("repo", "run_id", "run_ord", "introduced", "fixed", "distinct", "open", "resolved", "fix_rate", "runs")
                   if c in plain.columns]
        assert sorted(map(str, ours.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))


def test_a_batch_changes_only_what_changes(spark, tmp_path):
    table = LifecycleTable(spark, str(tmp_path))
    same = {f"f{i}" for i in range(50)}
    table.add(*_tables(spark, {("a", 1): same, ("b", 1): {"x"}}))
    before = {r.folder for r in table.versions.folders() if r["name"] == "state"}
    table.add(*_tables(spark, {("a", 2): same}))  # nothing comes or goes
    assert {r.folder for r in table.versions.folders() if r["name"] == "state"} == before
    table.add(*_tables(spark, {("a", 3): same - {"f7"}}))
    after = {r.folder for r in table.versions.folders() if r["name"] == "state"}
    assert len(before - after) == len(after - before) == 1
    assert [tuple(r) for r in table.versions.read("closed").collect()] == [("a", "f7", 1, 2)]


def test_late_runs_are_refused(spark, tmp_path):
    table = LifecycleTable(spark, str(tmp_path))
    table.add(*_tables(spark, {("a", 5): {"x"}, ("b", 9): set()}))
    for late in (4, 5):
        with pytest.raises(ValueError, match="order of time"):
            table.add(*_tables(spark, {("a", late): {"x"}, ("c", 1): {"x"}}))
    table.add(*_tables(spark, {("a", 6): set(), ("c", 1): {"x"}}))
    assert {(r.repo, r.distinct, r.open) for r in table.fix_rate().collect()} == {("a", 1, 0), ("b", 0, 0), ("c", 1, 1)}


ROWS = "k long, v string"


def _rows(spark, keys, v):
    return spark.createDataFrame([(k, v) for k in keys], ROWS)


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    table = Versions(spark, str(tmp_path))

    def upsert(keys, v):
        change = table.change()
        touched = change.upsert("t", _rows(spark, keys, v), ["k"])
        change.commit()
        return touched

    assert table.read("t") is None and table.number() == 0
    assert len(upsert(range(1000), "old")) == store.FIRST_BUCKETS
    first = {r.bucket: r.folder for r in table.folders()}
    touched = upsert([3, 4, 2000], "new")
    second = {r.bucket: r.folder for r in table.folders()}
    assert {b for b in second if first[b] != second[b]} == set(touched) and len(touched) <= 3
    assert {r.k: r.v for r in table.read("t").collect()} == {**dict.fromkeys(range(1000), "old"), 3: "new", 4: "new", 2000: "new"}
    assert {r.v for r in table.read("t", 1).collect()} == {"old"}  # the version before is still there
    assert upsert([], "none") == [] and table.read("t").count() == 1001
    files = [f for r in table.folders() for f in os.listdir(f"{tmp_path}/data/{r.folder}") if f.endswith(".parquet")]
    assert len(files) == store.FIRST_BUCKETS


def test_buckets_double(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 10)
    table = Versions(spark, str(tmp_path))
    for n in (400, 401, 402):
        change = table.change()
        change.upsert("t", _rows(spark, range(n), f"v{n}"), ["k"])
        change.commit()
    assert {r.buckets for r in table.folders()} == {4 * store.FIRST_BUCKETS}
    assert {r.v for r in table.read("t").collect()} == {"v402"} and table.read("t").count() == 402


def test_appended_batches_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_BATCHES", 3)
    table = Versions(spark, str(tmp_path))
    for n in range(9):
        change = table.change()
        assert [r.k for r in change.append("t", _rows(spark, [n], "v")).collect()] == [n]
        change.commit()
        assert len(table.folders()) <= 3
    assert sorted(r.k for r in table.read("t").collect()) == list(range(9))


def test_broken_off_changes_and_two_writers(spark, tmp_path):
    table = Versions(spark, str(tmp_path))
    change = table.change()
    change.upsert("t", _rows(spark, [1], "kept"), ["k"])
    change.commit()
    table.change().upsert("t", _rows(spark, [1, 2], "lost"), ["k"])  # never committed
    assert [tuple(r) for r in table.read("t").collect()] == [(1, "kept")]
    one, other = table.change(), table.change()
    one.append("log", _rows(spark, [1], "one"))
    other.append("log", _rows(spark, [2], "other"))
    one.commit()
    with pytest.raises(Exception, match="exists"):
        other.commit()
    assert [r.v for r in table.read("log").collect()] == ["one"]
    gone = table.drop_unused(keep=1)
    assert len(gone) == 2 and table.numbers() == [2]
    assert [tuple(r) for r in table.read("t").collect()] == [(1, "kept")]
    with pytest.raises(ValueError, match="one version"):
        table.drop_unused(0)
