"""Scans by content against plain scans."""

import dataclasses
import os

import pytest
from pyspark.sql import functions as F

from rillscan.operators import contents, scan
from rillscan.rules import CATALOGUE, RuleSpec, rules_for
from rillscan.sources.contents import ContentStore

FILES = "repo string, commit_sha string, path string, content string"
LOOP = "for x in y:\n  c = db.connect(x)\n  time.sleep(1)"
FETCH = "export async function go() {\nconst x = fetch(u);\n}"


def _files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def heads(spark):
    """Contents shared by commits, paths and repositories; what differs by extension, place and commit."""
    rows = [(r, c, p, t) for r in ("r1", "r2") for c in ("c1", "c2", "c3") for p, t in [
        ("a.py", LOOP), ("lib/copy.py", LOOP), ("a.java", LOOP), ("note.md", LOOP), ("A.PY", LOOP),
        ("x.js", FETCH), ("src/app/x.js", FETCH), ("broken.py", None), ("broken.java", None), ("empty.sql", ""),
        ("q.sql", f"select * from {c}")]]
    return _files(spark, rows)


def test_same_rows_as_a_plain_scan(heads):
    assert _rows(contents.scan_contents(heads)) == _rows(scan.scan(heads))
    one = heads.where("commit_sha = 'c1'").drop("commit_sha")
    assert _rows(contents.scan_contents(one, rules_for("sql", "node"))) == _rows(scan.scan(one, rules_for("sql", "node")))


def test_each_content_is_scanned_once(heads):
    files = contents.keyed(heads)
    # two loops (.py, .java), fetch inside and outside of app, two broken files, empty, and q.sql at three heads
    assert contents.unscanned(files).count() == files.select(contents.KEY).distinct().count() == 2 + 2 + 2 + 1 + 3
    known = files.where("commit_sha <> 'c3'").select(contents.KEY).distinct()
    assert [r.content for r in contents.unscanned(files, known).collect()] == ["select * from c3"]


def test_a_rule_that_reads_the_path(spark, heads):
    own = RuleSpec("own.place", "python", lambda c: c.path.contains("lib/") & c.s.startswith("time"), "w", "f",
                   title="t", category="MEMORY", severity="LOW")
    found = contents.scan_contents(heads, [own])
    assert _rows(found) == _rows(scan.scan(heads, [own]))
    assert {r.path for r in found.where("rule_id = 'own.place'").collect()} == {"lib/copy.py"}
    # one content at three commits, but no sharing between paths
    files = contents.keyed(heads.where("repo = 'r1' AND path LIKE '%.py' AND content IS NOT NULL"), [own])
    assert contents.unscanned(files, None).count() == 2


def test_versions_of_rules():
    version = contents.rules_version()
    assert version == contents.rules_version(list(CATALOGUE)) != contents.rules_version(CATALOGUE[1:])
    changes = [{"severity": "INFO"}, {"why": "another"}, {"min_depth": 7}, {"when": lambda c: F.lit(False)}, {"step": 9}]
    versions = {contents.rules_version([dataclasses.replace(CATALOGUE[0], **change), *CATALOGUE[1:]]) for change in changes}
    assert len(versions) == len(changes) and version not in versions


def _batches(store, spark):
    folder = f"{store.root}/version={contents.rules_version()}/scanned"
    return {b.removeprefix("batch="): spark.read.parquet(f"{folder}/{b}").count() for b in sorted(os.listdir(folder)) if "=" in b}


def test_store_scans_what_is_new(spark, heads, tmp_path):
    store = ContentStore(spark, str(tmp_path / "store"))
    for batch, upto, new in [("b1", "c1", 8), ("b2", "c2", 1), ("b3", "c3", 1), ("b4", "c3", 0)]:
        files = heads.where(F.col("commit_sha") <= upto)
        assert _rows(store.scan(files, batch)) == _rows(scan.scan(files))
        assert _batches(store, spark)[batch] == new
    # a batch that runs again replaces itself, and nothing is doubled
    assert _rows(store.scan(heads.where("commit_sha <= 'c2'"), "b2")) == _rows(scan.scan(heads.where("commit_sha <= 'c2'")))
    assert _batches(store, spark) == {"b1": 8, "b2": 1, "b3": 1, "b4": 0}


def test_batch_that_broke_off_or_ran_twice(spark, heads, tmp_path):
    root = str(tmp_path / "store")
    store, version = ContentStore(spark, root), contents.rules_version()
    files = contents.keyed(heads)
    found = contents.findings_by_content(contents.unscanned(files))
    # findings without their keys: not known, scanned again, not doubled
    found.write.parquet(f"{root}/version={version}/findings/batch=broken")
    assert store.scanned(version) is None
    assert _rows(store.scan(heads, "whole")) == _rows(scan.scan(heads))
    # another batch had the same contents at the same time
    found.write.parquet(f"{root}/version={version}/findings/batch=again")
    contents.unscanned(files).select(contents.KEY).write.parquet(f"{root}/version={version}/scanned/batch=again")
    assert _rows(store.scan(heads, "later")) == _rows(scan.scan(heads))


def test_other_rules_have_their_own_findings(spark, heads, tmp_path):
    store = ContentStore(spark, str(tmp_path / "store"))
    store.scan(heads, "b1")
    assert _rows(store.scan(heads, "b1", rules_for("sql"))) == _rows(scan.scan(heads, rules_for("sql")))


def test_only_names_are_grouped(spark, heads):
    """Contents meet no aggregate: the exchange of the grouping has digests and names."""
    files = contents.keyed(heads)
    plan = contents.unscanned(files)._jdf.queryExecution().executedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate" in line]
    assert aggregates and not any("content#" in line for line in aggregates)


def test_files_of_one_name_and_several_contents(spark):
    """Each content is scanned under the name that was chosen for it, and once."""
    rows = [("r", "c1", "a.sql", "select * from t"), ("r", "c1", "a.sql", "select * from t"), ("r", "c1", "b.sql", "select * from u"),
            ("r", "c1", "a.sql", "select * from u"), ("r", "c1", None, "select * from u"), (None, "c1", "d.sql", "select * from v")]
    files = contents.keyed(spark.createDataFrame(rows, "repo string, commit_sha string, path string, content string"))
    picked = contents.unscanned(files).select("path", "content").collect()
    assert sorted(map(tuple, picked)) == [("a.sql", "select * from t"), ("a.sql", "select * from t"), ("a.sql", "select * from u")]
    assert {r[contents.KEY] for r in contents.chosen(contents.names(files)).collect()} == {r[contents.KEY] for r in files.where("repo IS NOT NULL").collect()}
