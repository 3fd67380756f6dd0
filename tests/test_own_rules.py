"""Rules in Python as a table function."""

import pytest

from rillscan.operators import own_rules, scan
from rillscan.operators.own_rules import FileRule

FILES = "repo string, path string, content string"


def _rules():
    """Functions within a function go to the tasks by their code, wherever the tests lie."""
    def pairs(path, content):
        """Closing brackets that nothing opened: needs a stack."""
        depth = 0
        for line, row in enumerate(content.split("\n"), 1):
            for c in row:
                depth += (c == "(") - (c == ")")
                if depth < 0:
                    yield line, row.strip()
                    depth = 0

    def fragile(path, content):
        yield 1, "seen before it broke"
        if "break" in content:
            raise RuntimeError("cannot read this " + "x" * 1000)
        yield 2, None

    return (FileRule("own.pairs", (".py", ".go"), pairs, "Closed too often", "ALGORITHMIC", "HIGH", "why", "fix"),
            FileRule("own.fragile", (".py",), fragile, "Fragile", "MEMORY", "LOW", "why not", "none"))


PAIRS, FRAGILE = _rules()


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([
        ("r", "a.py", "f(x))\r\ng(y)\r\n)"), ("r", "b.GO", ")("), ("r", "c.py", "break("), ("r", "d.java", ")"),
        ("r", "e.py", None), ("r", "f.py", ""), ("r", "for.py", "for x in y:\n  c = db.connect(x))")], FILES)


def _rows(df):
    return sorted((r.path, r.rule_id, r.line, r.code) for r in df.collect())


def test_findings_and_errors(files):
    found = own_rules.own_findings(files, [PAIRS, FRAGILE])
    error = "engine.detector_error"
    assert _rows(found.where("rule_id <> 'own.fragile'")) == [
        ("a.py", "own.pairs", 1, "f(x))"), ("a.py", "own.pairs", 3, ")"), ("b.GO", "own.pairs", 1, ")("),
        ("c.py", error, 1, ""), ("e.py", error, 1, ""), ("e.py", error, 1, ""),
        ("for.py", "own.pairs", 2, "c = db.connect(x))")]
    # what a rule found in a file before it raised is dropped; other files keep theirs
    fragile = found.where("rule_id = 'own.fragile'").collect()
    assert {(r.path, r.line, r.code) for r in fragile} == {
        (p, n, c) for p in ("a.py", "f.py", "for.py") for n, c in ((1, "seen before it broke"), (2, None))}
    broken = {r.path: r for r in found.where(f"rule_id = '{error}'").collect()}
    assert broken["c.py"].why.startswith("A rule failed on this file: RuntimeError: cannot read this xxx")
    assert len(broken["c.py"].why) < 600 and broken["c.py"].title.endswith("c.py")
    assert broken["e.py"].severity == broken["e.py"].category == "INFO"


def test_next_to_the_catalogue(files):
    both = own_rules.scan_with(files, [PAIRS])
    assert both.columns == scan.scan(files).columns
    assert both.count() == scan.scan(files).count() + own_rules.own_findings(files, [PAIRS]).count()
    last = both.orderBy("repo", *scan.SCAN_ORDER).where("path = 'for.py'").collect()[-1]
    assert last.rule_id == "own.pairs"


def test_from_sql(spark, files):
    own_rules.register(spark, "own_pairs", [PAIRS])
    files.createOrReplaceTempView("own_files")
    rows = spark.sql("SELECT path, line FROM own_files, LATERAL own_pairs(path, '.py', content) WHERE error IS NULL").collect()
    assert sorted((r.path, r.line) for r in rows) == [("a.py", 1), ("a.py", 3), ("b.GO", 1), ("d.java", 1), ("for.py", 2)]


def test_commits_and_ids(spark, files):
    at = files.crossJoin(spark.createDataFrame([("c1",), ("c2",)], "commit_sha string"))
    found = own_rules.own_findings(at, [PAIRS])
    assert found.count() == 2 * own_rules.own_findings(files, [PAIRS]).count() and "commit_sha" in found.columns
    with pytest.raises(ValueError, match="id of its own"):
        own_rules.own_findings(files, [PAIRS, PAIRS])


def test_files_are_not_exchanged(files):
    plan = own_rules.own_findings(files, [PAIRS])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "Exchange hashpartitioning" not in plan
