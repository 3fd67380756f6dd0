import math
import random

from pyspark.sql import functions as F

from rillscan.operators import policy, report, retrieval, verdicts
from rillscan.sources import notes as note_source

NOTES = "note_ord long, topic string, text string"


def _best(spark, queries, notes, k):
    q = spark.createDataFrame(list(enumerate(queries)), "q long, text string")
    rows = retrieval.best_notes(q, "q", spark.createDataFrame(notes, NOTES), k).orderBy("q", "rank").collect()
    out = {i: [] for i in range(len(queries))}
    for r in rows:
        out[r.q].append((r.note_ord, round(r.score, 6)))
    return out


def test_scores_by_hand(spark):
    """Two notes of which one word is shared: its weight is ln(3 / 3) + 1 = 1, that of a word of
    one note ln(3 / 2) + 1, and that of an unknown word ln(3) + 1."""
    one, none = math.log(1.5) + 1, math.log(3) + 1
    notes = [(5, "loops", "nested"), (9, "loops", "index")]
    unit = math.hypot(1, one)
    got = _best(spark, ["loops", "Nested LOOPS", "index zebra", "zebra", "", "of an"], notes, 2)
    assert got == {
        0: [(9, round(1 / unit, 6)), (5, round(1 / unit, 6))],  # a tie: the later note first
        1: [(5, 1.0), (9, round(1 / unit ** 2, 6))],
        2: [(9, round(one / unit * one / math.hypot(one, none), 6))],
        3: [], 4: [], 5: [],
    }


def test_scores_have_the_properties_of_a_cosine(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma9", "delta_x", "of", "Loop", "index", "9x", "été", "queue"]
    notes = [(i, f"topic {i % 3}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(25)]
    queries = [f"{text} {topic}" for _, topic, text in notes] + [" ".join(rng.choices(words, k=6)) for _ in range(30)]
    got = _best(spark, queries, notes, 25)
    for i, (ord_, topic, text) in enumerate(notes):  # a note asked for by its own words scores 1
        assert (ord_, 1.0) in got[i]
    assert all(0 < s <= 1 for v in got.values() for _, s in v)
    assert all([s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in got.values())
    assert {q: v[:2] for q, v in got.items()} == _best(spark, queries, notes, 2)
    assert _best(spark, [q + " " + q for q in queries], notes, 2) == {q: v[:2] for q, v in got.items()}


def test_many_queries_share_their_words(spark):
    """A third of all queries is one text, and all share a word."""
    queries = ["loop index" if i % 3 == 0 else f"loop word{i % 7}" for i in range(600)]
    got = _best(spark, queries, [(0, "a", "loop loop"), (1, "b", "index of loop"), (2, "c", "nothing here")], 1)
    assert all([n for n, _ in got[i]] == [1 if i % 3 == 0 else 0] for i in range(600))
    q = spark.createDataFrame(list(enumerate(queries)), "q long, text string")
    df = {r.term: r.df for r in retrieval.document_frequency(retrieval.terms(q, "q")).collect()}
    assert df["loop"] == 600 and df["index"] == 200


NO = (False, None, None, None, None)
ANSWERS = {  # is it a verdict; confirmed, explanation, severity, fix
    '{"confirmed": false}': (True, False, "", None, None),
    ' {"confirmed": true, "fix": " x "} ': (True, True, "", None, "x"),
    'so {"fix": "y"} it is': (True, True, "", None, "y"),
    "{}": (True, True, "", None, None),
    '{"a": 1} {"b": 2}': NO,
    '{"a": 1}] {}': NO,
    '{"confirmed": null}': (True, False, "", None, None),
    '{"confirmed": "false"}': (True, False, "", None, None),
    "[1]": NO, '"{}"': NO, "12": NO, "": NO, None: NO, "{": NO, "}{": NO, "1, 2": NO,
    '{"severity": "low"}': (True, True, "", "LOW", None),
    '{"severity": "grave"}': (True, True, "", None, None),
    '{"explanation": " e\\n"}': (True, True, "e", None, None),
    'x\n{"confirmed":\nfalse}\ny': (True, False, "", None, None),
    '{"confirmed": 0}': (True, False, "", None, None),
    '{"fix": ""}': (True, True, "", None, None),
    '{"confirmed": ""}': (True, False, "", None, None),
    '{"confirmed": [1]}': (True, True, "", None, None),
}


def test_parse(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "n int, raw string")
    got = {r.raw: tuple(r[2:]) for r in verdicts.parse(rows).select(
        "n", "raw", "is_verdict", "v_confirmed", "v_explanation", "v_severity", "v_fix").collect()}
    for raw, want in ANSWERS.items():
        assert got[raw] == want, raw


def test_of_two_answers_one_holds(spark):
    found = _findings(spark, 2)
    said = spark.createDataFrame(
        [(1, '{"confirmed": false}'), (1, '{"confirmed": true, "fix": "f1"}'), (2, '{"confirmed": false}'), (2, '{"confirmed": false, "fix": "z"}')],
        "line int, raw string")
    rows = verdicts.merge(found, verdicts.parse(said), ["line"]).collect()
    assert {r.line: (r.confirmed, r.fix) for r in rows} == {1: (True, "f1"), 2: (False, "z")} and len(rows) == 2


FINDINGS = ("repo string, path string, line int, rule_id string, title string, category string, "
            "severity string, why string, fix string, confirmed boolean, explanation string")


def _findings(spark, count, repo=lambda i: "r"):
    return spark.createDataFrame(
        [(repo(i), f"f{i % 5}.py", i + 1, "x.y", "Nested loop", "ALGORITHMIC", "LOW", "quadratic",
          "fix", None, "") for i in range(count)], FINDINGS)


def test_merge_and_filter(spark):
    found = _findings(spark, 4)
    said = spark.createDataFrame(
        [(1, '{"confirmed": false}'), (2, '{"severity": "high", "fix": "f2", "explanation": "e"}'),
         (3, "junk")], "line int, raw string")
    merged = verdicts.merge(found, verdicts.parse(said), ["line"])
    rows = {r.line: (r.confirmed, r.severity, r.fix, r.explanation) for r in merged.collect()}
    assert rows == {1: (False, "LOW", "fix", ""), 2: (True, "HIGH", "f2", "e"),
                    3: (None, "LOW", "fix", ""), 4: (None, "LOW", "fix", "")}
    assert sorted(r.line for r in policy.without_false_positives(merged).collect()) == [2, 3, 4]


def test_cap_keeps_the_rest(spark):
    """One run holds most findings."""
    found = _findings(spark, 300, lambda i: "hot" if i % 3 else f"r{i % 6}")
    rows = verdicts.review_cap(found, ["repo"], ["path", "line"], 7).collect()
    assert len(rows) == 300
    by_run = {}
    for r in sorted(rows, key=lambda r: (r.path, r.line)):
        by_run.setdefault(r.repo, []).append(r.reviewed)
    for flags in by_run.values():
        assert flags == [True] * 7 + [False] * (len(flags) - 7)


def test_context_and_prompt(spark):
    text = "\n".join(f"line{i}" for i in range(1, 21))
    sources = spark.createDataFrame([("r", "f0.py", text), ("r", "other.py", text)],
                                    "repo string, path string, content string")
    focus = _findings(spark, 16).where("line in (1, 16)")
    rows = verdicts.prompts(focus, sources, note_source.built_in(spark)).collect()
    by_line = {r.line: r for r in rows}
    assert ">> 1: line1\n   2: line2" in by_line[1].prompt and "8: line8" not in by_line[1].prompt
    assert "   10: line10" in by_line[16].prompt and "   20: line20\n```" in by_line[16].prompt
    assert "   9: line9" not in by_line[16].prompt
    assert by_line[1].kb_refs[0] == "Nested loops" and len(by_line[1].kb_refs) <= 2


def test_prompts_of_repeated_and_nameless_files(spark):
    """Each file of a key that has the line gives a prompt; a finding without a window keeps one without."""
    sources = spark.createDataFrame(
        [("r", "a.py", "one"), ("r", "a.py", "one\ntwo"), ("r", "b.py", None), (None, "c.py", "x")], "repo string, path string, content string")
    rule = ("T", "C", "why", "p.x")
    asked = [("r", "a.py", 1), ("r", "a.py", 2), ("r", "a.py", 2), ("r", "a.py", 3), ("r", "a.py", 0), ("r", "a.py", None), ("r", "b.py", 1), ("r", "z.py", 1), (None, "c.py", 1)]
    found = spark.createDataFrame(
        [(*a, *rule) for a in asked], "repo string, path string, line int, title string, category string, why string, rule_id string")
    rows = verdicts.prompts(found, sources, note_source.built_in(spark)).collect()
    shown = sorted((str(r.repo), r.path, str(r.line), r.prompt.split("```")[1].strip("\n")) for r in rows)
    assert shown == sorted([
        ("r", "a.py", "1", ">> 1: one"), ("r", "a.py", "1", ">> 1: one\n   2: two"),
        ("r", "a.py", "2", "   1: one\n>> 2: two"), ("r", "a.py", "2", "   1: one\n>> 2: two"), ("r", "a.py", "3", ""), ("r", "a.py", "0", ""),
        ("r", "a.py", "None", ""), ("r", "b.py", "1", ""), ("r", "z.py", "1", ""), ("None", "c.py", "1", "")])


def test_documents_in_report_order_over_pages(spark, tmp_path):
    found = _findings(spark, 95).withColumnRenamed("path", "file").withColumn(
        "severity", F.when(F.col("line") % 9 == 0, "CRITICAL").otherwise("LOW"))
    runs = spark.createDataFrame([("r",), ("clean",)], "repo string")
    docs = report.report_documents(found, ["repo"], F.lit(True), 20, runs).orderBy("repo", "page").collect()
    empty, pages = docs[0], docs[1:]
    assert (empty.repo, empty.page, empty.total, empty.findings, empty.by_severity) == ("clean", 0, 0, [], {})
    assert [len(d.findings) for d in pages] == [20, 20, 20, 20, 15] and {d.total for d in pages} == {95}
    assert {d.pages for d in pages} == {5} and {d.engine for d in pages} == {"static+llm"}
    shown = [(f.severity, f.file, f.line) for d in pages for f in d.findings]
    assert shown == sorted(shown) and sum(s == "CRITICAL" for s, *_ in shown[:20]) == 10
    report.write_documents(report.report_documents(found, ["repo"], F.lit(True), 20), str(tmp_path / "d"))
    saved = spark.read.json(str(tmp_path / "d"))
    assert saved.select(F.sum(F.size("findings"))).first()[0] == 95 and saved.count() == 5
    (whole,) = report.report_documents(found, ["repo"], F.lit(False)).collect()
    assert [(f.severity, f.file, f.line) for f in whole.findings] == shown


def test_equal_findings_spread_over_pages(spark):
    same = spark.range(500).select(F.lit("r").alias("repo"), F.lit("a.py").alias("file"), F.lit(1).alias("line"),
                                   F.lit("x.y").alias("rule_id"), F.lit("LOW").alias("severity"))
    docs = report.report_documents(same, ["repo"], F.lit(False), 10).collect()
    assert [len(d.findings) for d in docs] == [10] * 50


def test_report_rows_and_rates(spark):
    rows = report.report_rows(spark.createDataFrame(
        [("IO_DB", "HIGH", None, "x" * 300), ("INFO", "ODD", False, ""), ("NETWORK", "LOW", True, "")],
        "category string, severity string, confirmed boolean, code string")).collect()
    assert [(r.label, r.rank, r.tag, len(r.code)) for r in rows] == [
        ("I/O & Database", 1, "", 200), ("INFO", 9, "possible false positive", 0),
        ("Network", 3, "confirmed", 0)]
    rates = spark.createDataFrame([(0.125,), (0.005,), (0.015,), (1.0,)], "r double")
    assert [r.p for r in rates.select(report.whole_percent(F.col("r")).alias("p")).collect()] == [
        round(x * 100) for x in (0.125, 0.005, 0.015, 1.0)]
