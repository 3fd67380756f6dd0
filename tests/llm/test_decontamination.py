import random

import numpy as np
import pytest
from helpers import awkward, prose, table

from rillscan.llm import decontamination as dec


def cell_by_cell(item, window):
    """The alignment recurrence, one cell at a time."""
    h = np.zeros((len(item) + 1, len(window) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dec.MATCH if a == b else dec.MISMATCH), h[i - 1, j] + dec.GAP, h[i, j - 1] + dec.GAP)
    return h.max()


def test_alignment_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        item = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 25))])
        window = np.array([rng.randrange(-1, 6) for _ in range(rng.randrange(1, 40))])
        score, first, last = dec.align(item, window)
        assert score == cell_by_cell(item, window)
        if score:
            assert cell_by_cell(item, window[first:last + 1]) == score


def edited(text, seed):
    rng, out = random.Random(seed), []
    for w in text.split():
        roll = rng.random()
        out += [] if roll < 0.05 else ["zzz"] if roll < 0.1 else [w, "yyy"] if roll < 0.13 else [w.upper() + ","]
    return " ".join(out)


@pytest.fixture(scope="module")
def items():
    return [(k, prose(50 + k, 20 + 3 * k, 900)) for k in range(12)] + [(90, None), (91, ""), (92, "?!"), (93, "one two"), (94, prose(50, 20, 900))]


def test_leaks_edited_copies_and_clean_texts(spark, items):
    of = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, prose(200 + k, 300, 900), "", "", 0) for k in range(30)]
    rows += [(100 + k, prose(300 + k, 80, 900) + t + " " + prose(400 + k, 80, 900), "", "", 0) for k, t in items[:12]]
    rows += [(200 + k, prose(500 + k, 80, 900) + edited(t, k) + " " + prose(600 + k, 80, 900), "", "", 0) for k, t in items[:12]]
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(table(spark, rows), of).collect()}
    same = {(100, 94), (200, 94)}  # equal items are both leaked
    assert got == {(100 + k, k) for k in range(12)} | {(200 + k, k) for k in range(12)} | same
    r = next(r for r in dec.contaminated(table(spark, rows), of).collect() if (r.doc_id, r.item_id) == (103, 3))
    assert r.share == 1 and (r.first_word, r.last_word) == (len(dec.words(prose(303, 80, 900))), len(dec.words(prose(303, 80, 900))) + 28)


def test_a_leak_in_most_documents_is_still_found(spark, items):
    rows = [(k, prose(700 + k, 60, 900) + items[5][1], "", "", 0) for k in range(60)] + [(99, prose(9, 60, 900), "", "", 0)]
    of = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dec.contaminated(table(spark, rows), of).collect()} == {(k, 5) for k in range(60)}


def test_awkward_rows_and_blocks(spark, items, monkeypatch):
    of = spark.createDataFrame([*items, (500, awkward()[0][1])], "item_id long, text string")
    docs = table(spark, awkward())
    want = {(r.doc_id, r.item_id) for r in dec.contaminated(docs, of).collect()}
    assert {(0, 500), (1, 500), (2, 500)} <= want
    monkeypatch.setattr(dec, "BLOCK", 300)
    assert {(r.doc_id, r.item_id) for r in dec.contaminated(docs, of).collect()} == want
    assert dec.with_leaks(docs, of).count() == len(awkward())
    assert dec.contaminated(docs, of.limit(0)).count() == 0 and dec.contaminated(table(spark, []), of).count() == 0


def test_short_items_are_leaked_as_they_stand(spark, items):
    of = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "only one, TWO here", "", "", 0), (2, "one and two", "", "", 0)]
    assert [(r.doc_id, r.item_id) for r in dec.contaminated(table(spark, rows), of).collect()] == [(1, 93)]


@pytest.mark.parametrize("copies", [9, 100, 1000])
def test_edited_and_partial_leaks_in_many_documents(spark, copies):
    edited_one, partial = prose(61, 37, 900), prose(62, 60, 900)
    every_fifth = " ".join("zzz" if k % 5 == 4 else w for k, w in enumerate(edited_one.split()))
    some = " ".join(partial.split()[10:32])
    rows = [(k, f"{prose(2000 + k, 20, 900)} {every_fifth} {prose(4000 + k, 20, 900)}", "", "", 0) for k in range(copies)]
    rows += [(copies + k, f"{prose(6000 + k, 20, 900)} {some} {prose(8000 + k, 20, 900)}", "", "", 0) for k in range(copies)]
    of = spark.createDataFrame([(1, edited_one), (2, partial)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(table(spark, rows, clash=False), of).collect()}
    assert got == {(k, 1) for k in range(copies)} | {(copies + k, 2) for k in range(copies)}


@pytest.mark.parametrize("step", [3, 4, 5])
def test_regular_edits_of_the_supplied_items(spark, step):
    """Every third, fourth or fifth word replaced: all score at least half, and nearly all are found."""
    of = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rows = [(r.item_id, f"{prose(r.item_id, 40, 900)} " + " ".join(
        "zzz" if k % step == step - 1 else w for k, w in enumerate(r.text.split())), "", "", 0) for r in of.collect()]
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(table(spark, rows), of).collect()}
    found = sum((i, i) in got for i, *_ in rows)
    assert found >= 0.9 * len(rows) and all(i == j for i, j in got)


def test_pairs_are_chosen_by_rarity(spark):
    items = [(0, "the one of the two of the three of the four")]
    seeds, pairs = dec.Seeds.of(items), dec.Seeds.of(items, dec.PAIR)
    rows = [(k, "of the " * (k + 1) + "zzz the two of zzz the one zzz one of" + " zzz two of" * k, "", "", 0) for k in range(5)]
    docs = table(spark, rows, clash=False)
    counts = dec.pair_counts(docs, docs.text, pairs)
    spelled = {n: w for w, n in pairs.vocabulary.items()}
    size = len(pairs.vocabulary) + 1
    named = {tuple(spelled[x] for x in divmod(int(key), size)): counts.get(k, 0) for k, key in enumerate(pairs.keys[2])}
    assert named == {(b"of", b"the"): 15, (b"the", b"one"): 5, (b"one", b"of"): 5, (b"the", b"two"): 5, (b"two", b"of"): 15,
                     (b"the", b"three"): 0, (b"three", b"of"): 0, (b"the", b"four"): 0}
    both = seeds.with_rare_pairs(pairs, counts)
    kept = {tuple(spelled[x] for x in divmod(int(key), size)) for key in both.keys[2]}
    assert kept == {(b"the", b"one"), (b"one", b"of"), (b"the", b"two")} and both.lengths == [2, 3]  # half of those that occur
