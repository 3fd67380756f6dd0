import hashlib
import re
from collections import Counter

import pytest
from helpers import awkward, prose, table
from pyspark.sql import functions as F

from rillscan.llm import fingerprints, shared


def paragraphs(text):
    n = fingerprints.FOLD
    found = re.findall(rf"[^\n]{{1,{n}}}(?=[ \n]|\Z)|[^\n]{{{n}}}|[^\n]+", text or "")
    return Counter(p.strip(" ") for p in found if p.strip(" "))


def like(a, b):
    a, b = paragraphs(a), paragraphs(b)
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def test_edited_versions_by_brute_force(spark):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 15]
    got = {r.doc_id: r for r in fingerprints.edited_versions(table(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(text, edited))
        assert r.near_next == pytest.approx(like(text, after))
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint


def test_null_ids_repeats_and_the_empty_table(spark):
    rows = awkward()
    got = fingerprints.edited_versions(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert len({r.fingerprint for r in got if r.doc_id == 15}) == 1
    assert fingerprints.edited_versions(table(spark, [])).count() == 0


def test_one_row_is_its_own_next(spark):
    r = fingerprints.edited_versions(table(spark, [(1, "abcdef", "", "", 6)])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1


def test_next_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7 % 1009).alias("k"), F.lit("v").alias("v"))
    got = {r.row.k: r.next.k for r in fingerprints.with_next(df, ["k", "v"], "k").collect()}
    order = sorted(got, reverse=True)
    assert len(order) == 500 and got == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_recovery_retries_and_the_last_resort(spark, monkeypatch):
    pairs = [(k, [hash((k, x, 0)) for x in range(k)], [hash((k, x, x % 3 == 0)) for x in range(k)]) for k in range(0, 120, 3)]
    df = spark.createDataFrame(pairs, "pair long, mine array<long>, theirs array<long>")
    want = {k: (len(set(a) - set(b)), len(set(b) - set(a))) for k, a, b in pairs}
    for rounds, retries in ((12, 6), (3, 6), (1, 1)):  # the last leaves most pairs to the arrays
        monkeypatch.setattr(fingerprints, "ROUNDS", rounds)
        monkeypatch.setattr(fingerprints, "RETRIES", retries)
        got = {r.pair: (r.only_mine, r.only_theirs) for r in fingerprints.differences(df).collect()}
        assert {k: got.get(k, (0, 0)) for k in want} == want


def test_later_tries_have_the_tasks_that_their_pairs_need(spark, monkeypatch):
    judged = []

    def recorded(df):
        if "left" in df.columns:
            judged.append(df.rdd.getNumPartitions())
        return written(df)

    written = fingerprints.written
    monkeypatch.setattr(fingerprints, "written", recorded)
    pairs = [(k, [hash((k, x, 0)) for x in range(40)], [hash((k, x, 1)) for x in range(40)]) for k in range(200)]
    df = spark.createDataFrame(pairs, "pair long, mine array<long>, theirs array<long>")
    want = {k: (40, 40) for k, *_ in pairs}
    assert {r.pair: (r.only_mine, r.only_theirs) for r in fingerprints.differences(df).collect()} == want
    assert judged[0] == 8 and len(judged) > 1 and set(judged[1:]) == {2}
    judged.clear()
    monkeypatch.setattr(fingerprints, "PER_TASK", 3000)  # all 200 pairs of 80 digests fail at first
    assert {r.pair: (r.only_mine, r.only_theirs) for r in fingerprints.differences(df).collect()} == want
    assert judged[:2] == [8, 6]


def test_a_try_writes_as_many_files_as_its_rows_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: str(tmp_path))
    pairs = [(k, [hash((k, x, 0)) for x in range(40)], [hash((k, x, 1)) for x in range(40)]) for k in range(60)]
    df = spark.createDataFrame(pairs, "pair long, mine array<long>, theirs array<long>")
    found = fingerprints.differences(df)
    files = [len(list(t.glob("*.parquet"))) for t in tmp_path.iterdir()]
    assert len(files) > 2 and set(files) == {1}  # all fail at first; a try of 60 rows over 8 partitions wrote 8 files
    assert {r.pair: (r.only_mine, r.only_theirs) for r in found.collect()} == {k: (40, 40) for k, *_ in pairs}


def test_no_python_in_the_plan(spark):
    plan = fingerprints.edited_versions(table(spark, [(1, prose(1, 9), "", "", 1)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
