import random
from collections import defaultdict

import pytest
from helpers import awkward, n_words, table
from pyspark.sql import functions as F

from rillscan.llm import packing


def tightest(sizes, sources, clusters, capacity):
    """Every bin is looked at; the least residual that suffices wins, then the oldest bin."""
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size
                and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
        bins[k]["room"] -= size
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_by_brute_force(seed):
    rng = random.Random(seed)
    n = 300
    sizes = sorted((rng.randrange(0, 60) for _ in range(n)), reverse=True)
    sources = [rng.choice([None, "hot", "hot", "hot", *"abcdefgh"]) for _ in range(n)]
    clusters = [rng.choice([None, *range(200)]) for _ in range(n)]
    assert packing.best_fit(sizes, sources, clusters, 100)[0] == tightest(sizes, sources, clusters, 100)


def check(df, n_rows, capacity):
    size = F.regexp_count("text", F.lit(r"\S+"))
    got = packing.pack(df, capacity, size, F.col("source"), F.xxhash64("text")).collect()
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
        docs[r.doc_id, r.copy].append(r)
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: (r.bin_start, r.length)):
            assert r.bin_start == at
            at += r.length
        assert at <= capacity
    return got, bins, docs


def test_awkward_rows(spark):
    rows = awkward()
    got, bins, docs = check(table(spark, rows), len(rows), 100)
    source = {(i, t): s for i, t, _, s, _ in rows}
    size = defaultdict(int)
    for r in got:
        size[r.doc_id] += r.length
    for i in {r[0] for r in rows}:
        assert size[i] == sum(n_words(t) for j, t, *_ in rows if j == i)
    for i, text, *_ in rows:
        if i is not None and i != 15:
            parts = sorted(docs[i, 1], key=lambda r: r.part)
            assert [p.part for p in parts] == list(range(len(parts))) and [p.doc_start for p in parts] == [100 * k for k in range(len(parts))]
    assert {c for i, c in docs if i == 15} <= {1, 2} and len(source) <= len(rows)
    assert packing.pack(table(spark, []), 10, F.lit(1), F.col("source"), F.col("text")).count() == 0


def test_conflicts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    rows = [(k, f"w{k % 25} " * (1 + k % 9), "en", "hot" if k % 3 == 0 else f"s{k % 7}", 0) for k in range(400)]
    got, bins, _ = check(table(spark, rows, clash=False), 400, 30)
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    assert len(got) == 400 and len({r.doc_id for r in got}) == 400
    for held in bins.values():
        assert len({source[r.doc_id] for r in held}) == len(held) == len({text[r.doc_id] for r in held})
