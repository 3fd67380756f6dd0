import random
import re
from itertools import combinations

import numpy as np
import pytest
from helpers import awkward, prose, table

from rillscan.llm import jaccard, squeeze


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_force(rows, k, percent):
    """By row: size of the set, and the least id reachable over rows (None if all are null)."""
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def checked(spark, rows, k, percent):
    docs = table(spark, [(i, t, "en", "s", None) for i, t in rows])
    got = sorted(map(tuple, jaccard.similar_documents(docs, k, percent).collect()), key=str)
    assert got == brute_force(rows, k, percent)


def copies(seed, groups, copies, words, edits):
    """Groups of copies with up to ``edits`` words replaced, some joined at their ends, and a passage that all share."""
    rng = random.Random(seed)
    rows, passage = [], prose(seed + 99, 25)
    for g in range(groups):
        base = (prose(seed * 100 + g, words, 3000) + passage).split()
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                at = rng.randrange(len(text))
                text[at:at + 1] = rng.choice([[f"new{rng.random()}"], [], [rng.choice(base), "x"]])
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_awkward_rows(spark):
    checked(spark, [(r[0], r[1]) for r in awkward()], 3, 90)
    assert jaccard.similar_documents(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed, k, percent", [(1, 3, 90), (2, 3, 80), (3, 5, 80), (4, 1, 60), (5, 2, 100)])
def test_near_copies(spark, seed, k, percent):
    checked(spark, copies(seed, 4, 30, 60, 6), k, percent)


def test_all_blocks_of_a_list(spark, monkeypatch):
    """Chains: neighbours link, their ends do not, and there is no common pivot that links to all."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[i:i + 60])) for i in range(40)] + [(100 + i, " ".join(words[2 * i:2 * i + 60])) for i in range(20)]
    checked(spark, rows, 3, 90)
    checked(spark, rows[::3], 3, 90)
    checked(spark, rows[::4], 3, 95)


def test_pairs_are_derived_from_the_pivot(spark):
    """Sets that share a rare shingle with the pivot, link to each other and not to the pivot."""
    common = [f"c{i}" for i in range(30)]
    rows = [(0, " ".join([*common, *[f"p{i}" for i in range(10)]]))]
    for k in range(8):
        own = [f"{'ab'[k % 2]}{i}" for i in range(10)]
        rows.append((k + 1, " ".join([*common, *own, f"z{k}"])))
    for percent in (60, 70, 80, 90):
        checked(spark, rows, 1, percent)


def test_small_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 256)
    checked(spark, copies(7, 3, 12, 40, 3), 3, 90)


def test_hashes_are_packed_without_loss():
    values = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 1000, np.uint64))
    assert (squeeze.unpacked(squeeze.packed(values)) == values).all()
    assert len(squeeze.unpacked(squeeze.packed(values[:0]))) == 0
    assert len(jaccard.shingle_hashes("a b c d a b c", 3)) == 4
    assert len(jaccard.shingle_hashes("A b", 3)) == 1 and len(jaccard.shingle_hashes(" \n", 3)) == 0
    known = jaccard._WordHashes()
    assert (jaccard.shingle_hashes("x y z", 3, known) == jaccard.shingle_hashes("X Y\tz", 3)).all()
