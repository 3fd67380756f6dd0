"""Retrieval with bounds against retrieval without."""

import random

import pytest

from rillscan.operators import pruned, retrieval

NOTES = "note_ord long, topic string, text string"


def _tables(spark, queries, notes):
    return (spark.createDataFrame(list(enumerate(queries)), "q long, text string"),
            spark.createDataFrame([(i, "", t) for i, t in enumerate(notes)], NOTES))


def _both(queries, notes, k):
    index = pruned.NoteIndex.of(notes)
    plain = retrieval.best_notes(queries, "q", notes, k)
    ours = pruned.best_notes(queries, "q", index, k)
    return [sorted((r.q, r["rank"], r.note_ord, round(r.score, 8)) for r in df.collect()) for df in (plain, ours)]


def _corpus(seed, n_notes, n_queries):
    """Frequent words in all texts, rarer ones in few; some notes are equal."""
    rng = random.Random(seed)
    words = ["every", "note", "has", "these"] + [f"w{i}" for i in range(60)]
    weights = [40] * 4 + [60 / (i + 1) for i in range(60)]
    notes = [" ".join(rng.choices(words, weights, k=rng.randint(1, 30))) for _ in range(n_notes)]
    notes += notes[:5]
    queries = [" ".join(rng.choices(words, weights, k=rng.randint(1, 40))) for _ in range(n_queries)]
    return queries + notes[:10] + ["", "unknown", "every", "every unknown unknown"], notes


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 2), (3, 7), (4, 500)])
def test_same_notes_as_without_bounds(spark, seed, k):
    plain, ours = _both(*_tables(spark, *_corpus(seed, 150, 40)), k)
    assert plain == ours and plain


def test_no_notes_or_queries(spark):
    queries, notes = _tables(spark, ["every note"], ["every note"])
    assert _both(queries.limit(0), notes, 2) == [[], []]
    assert _both(queries, notes.limit(0), 2) == [[], []]


def test_frequent_words_are_not_met(spark):
    """400 notes share three words; a query that names the word of one note meets few postings."""
    notes = [f"every note here own{i}" + " every" * (i % 3) for i in range(400)]
    queries = [f"every note here own{i} own{i + 1}" for i in range(0, 400, 10)]
    q, n = _tables(spark, queries, notes)
    index = pruned.NoteIndex.of(n)
    rows = pruned.met(q, "q", index, 2).count()
    without = retrieval.terms(q, "q").join(index.postings, "term").count()
    assert without == 40 * 3 * 400 + 80 and rows == 80
    plain, ours = _both(q, n, 2)
    assert plain == ours and len(plain) == 80


def test_blocks_below_the_bar_are_skipped(spark):
    """One word: only the notes in which it weighs most can answer."""
    rng = random.Random(6)
    notes = ["every " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(i % 40)) for i in range(300)]
    q, n = _tables(spark, ["every"], notes)
    index = pruned.NoteIndex.of(n)
    assert pruned.met(q, "q", index, 2).count() <= 300 // 40 + 2
    plain, ours = _both(q, n, 2)
    assert plain == ours


def test_stored_index(spark, tmp_path):
    q, n = _tables(spark, *_corpus(9, 60, 10))
    index = pruned.NoteIndex.of(n).stored(str(tmp_path / "index"))
    got = pruned.best_notes(q, "q", index, 3)
    want = retrieval.best_notes(q, "q", n, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_cross_join_and_no_rows_for_unread_words(spark):
    q, n = _tables(spark, *_corpus(11, 50, 10))
    plan = pruned.best_notes(q, "q", pruned.NoteIndex.of(n), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
