import hashlib
import random

import numpy as np
import pytest
from helpers import awkward, prose, table

from rillscan.llm import repeats


def by_brute_force(rows, length=50):
    first = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            w, own = b[k:k + length], repeats.NO_ID if i is None else i
            first[w] = min(own, first.get(w, own))
    out = []
    for i, text, *_ in rows:
        b, own = (text or "").encode(), repeats.NO_ID if i is None else i
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < own:
                gone[k:k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((i is None, i or 0, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df, length=50):
    got = repeats.without_repeats(df, length).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_awkward_rows(spark):
    assert found(table(spark, awkward())) == by_brute_force(awkward())
    assert found(table(spark, [])) == []


@pytest.mark.parametrize("length", [21, 50, 83])
def test_overlaps_runs_and_common_passages(spark, length):
    rng = random.Random(length)
    shared = [prose(k, 14, 60) for k in range(6)] + ["ab" * 60, "x" * 140]
    rows = [(k * 3 % 41, "".join(rng.choice(shared)[rng.randrange(30):] + prose(100 + k, rng.randrange(12), 60)
                                 for _ in range(rng.randrange(1, 6))), "", "", 0) for k in range(40)]
    assert found(table(spark, rows, clash=False), length) == by_brute_force(rows, length)


def test_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 256)
    a = prose(1, 600)
    b = prose(2, 50) + a[333:2500] + prose(3, 50)
    reach = repeats.Reach(50)
    texts = [np.frombuffer(t.encode(), np.uint8) for t in (a, b, "", "short", b, "y" * 50, "y" * 700)]
    names, pos, first, last, owner = repeats.samples(texts, reach)
    assert (np.diff(owner) >= 0).all()
    for k, text in enumerate(texts):
        own = owner == k
        assert own.any() == (len(text) >= 50)
        if own.any():
            f, e, p = first[own], last[own], pos[own]
            assert f[0] == 0 and e[-1] == len(text) - 50 and (f[1:] == e[:-1] + 1).all()
            assert ((p >= e) & (p <= f + reach.before)).all()
    assert (pos[owner == 1] == pos[owner == 4]).mean() == 1
    rows = [(1, a, "", "", 0), (2, b, "", "", 0), (3, b, "", "", 0), (4, "y" * 700, "", "", 0)]
    assert found(table(spark, rows, clash=False)) == by_brute_force(rows)
