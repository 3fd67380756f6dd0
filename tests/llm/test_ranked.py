import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, prose, table

from rillscan.llm import ranked

RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def runs(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(RUN, text or "")]


def brute_force(docs, items, k):
    counts = [(i, Counter(runs(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in runs(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def checked(spark, docs, items, k):
    got = ranked.search(table(spark, [(i, t, "en", "s", None) for i, t in docs]),
                        spark.createDataFrame(items, "item_id long, text string"), k).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute_force(docs, items, k)


def test_awkward_rows(spark):
    docs = [(r[0], r[1]) for r in awkward()]
    items = [(1, prose(1, 40)), (2, None), (3, ""), (4, "word WORD ça é\U0001F600é"), (4, "word word"), (None, "two little-words x"), (5, prose(4, 300))]
    checked(spark, docs, items, 20)
    checked(spark, docs, items, 1)
    assert ranked.search(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert ranked.search(table(spark, awkward()), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("k", [3, 20])
def test_many_documents_with_ties(spark, k):
    rng = random.Random(k)
    docs = [(i, prose(rng.randrange(150), rng.randrange(3, 120), 300)) for i in range(400)]
    items = [(i, prose(1000 + i, 30, 300)) for i in range(12)]
    checked(spark, docs, items, k)


def test_all_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked, "QUERY_BYTES", 200)
    docs = [(i, prose(i, 50, 100)) for i in range(60)]
    checked(spark, docs, [(i, prose(50 + i, 20, 100)) for i in range(9)], 5)


def lists(rng, n_docs, n_terms):
    """A block with random lists, built by hand."""
    held = [np.flatnonzero(rng.random(n_docs) < p) for p in rng.random(n_terms)]
    docs = np.concatenate(held)
    df = [len(h) for h in held]
    row = {"terms": [t for t in range(n_terms) if df[t]], "df": [d for d in df if d], "docs": ranked.squeezed(docs),
           "tf": ranked.squeezed(rng.integers(1, 9, len(docs))), "lengths": ranked.squeezed(rng.integers(9, 99, n_docs))}
    return ranked.Block.of(row, rng.integers(0, 9000, n_terms), n_docs, n_docs * 40)


def test_best_positions_stop_early_and_never_too_early():
    rng = np.random.default_rng(3)
    looked_up = whole = 0
    for _ in range(60):
        block = lists(rng, 2000, 6)
        repeats = rng.integers(1, 4, 6)
        scores = np.zeros(2000, np.int64)
        for t, (begin, end) in block.start.items():
            scores[block.docs[begin:end]] += repeats[t] * block.impact[begin:end]
        order = np.lexsort((np.arange(2000), -scores))[:10]
        best = ranked.Best(10)
        looked_up += ranked.search_block(block, np.arange(6), repeats, list(range(2000)), best)
        whole += int((scores > 0).sum())
        assert best.rows == [(int(scores[d]), int(d)) for d in order if scores[d] > 0]
        # nothing is looked up where an earlier block holds better rows
        full = ranked.Best(10, [(10**12, -i) for i in range(10, 0, -1)])
        assert ranked.search_block(block, np.arange(6), repeats, list(range(2000)), full) == 0
    assert looked_up < 0.7 * whole


def test_equal_scores_at_the_border_are_all_met():
    """An unread document with the k-th score may have a smaller id."""
    block = ranked.Block.of({"terms": [0], "df": [100], "docs": ranked.squeezed(np.arange(100)),
                             "tf": ranked.squeezed(np.ones(100, np.int64)), "lengths": ranked.squeezed(np.full(100, 9))},
                            np.array([500]), 100, 900)
    best = ranked.Best(3)
    ranked.search_block(block, np.array([0]), np.array([1]), list(range(99, -1, -1)), best)
    assert [r[1] for r in best.rows] == [0, 1, 2]


def test_lengths_beyond_64_bits():
    big = np.array([10**6, 10**10], np.int64)
    assert ranked.length_part(big, 10**9, 10**15).tolist() == [75 + 25 * 10**6 * 10**9 // 10**15, 75 + 25 * 10**10 * 10**9 // 10**15]
