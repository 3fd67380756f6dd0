import random
import re
from itertools import combinations

import pytest
import xxhash
from helpers import awkward, table

from rillscan.llm import components, simhash


def fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, near):
    """The least name reachable, by relaxation until nothing changes."""
    label = dict(items)
    names = {n: n for n in label}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(label, 2):
            if near(label[a], label[b]) and names[a] != names[b]:
                names[a] = names[b] = min(names[a], names[b])
                changed = True
    return names


def test_awkward_rows_by_brute_force(spark):
    got = simhash.near_duplicates(table(spark, awkward())).collect()
    assert len(got) == len(awkward())
    want = {i: fingerprint(t) for i, t, *_ in awkward() if i is not None}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got if r.doc_id is not None} == want
    assert all(len(r.fingerprint) == 16 for r in got)
    names = classes(list(want.items()), lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == names
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("pairs", [128, 2])  # with 2 nearly all go through variants
def test_links_join_what_is_near(spark, monkeypatch, distance, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(distance)
    values = {0, (1 << 64) - 1}
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(9)):
            values.add(v)
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
        values.add(v)
    signed = [simhash.signed(v) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance)
    close = lambda a, b: ((a ^ b) & simhash.ONES).bit_count() <= distance
    rows = edges.collect()
    assert all(r.a != r.b and (close(r.a, r.b) or pairs == 2) for r in rows)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert {v: roots.get(v, v) for v in signed} == classes([(v, v) for v in signed], close)


def test_thresholds_cover_the_distance():
    rng = random.Random(1)
    for _ in range(50):
        costs = [{t: rng.random() * 10 ** (t + 1) for t in range(-1, 3)} for _ in range(rng.randrange(1, 5))]
        cost, chosen = simhash.allocate(costs, 2)
        assert sum(t + 1 for t in chosen) == 3
        options = [c for c in _all(len(costs)) if sum(t + 1 for t in c) == 3]
        assert abs(cost - min(sum(k[t] for k, t in zip(costs, c, strict=True)) for c in options)) < 1e-9


def _all(n):
    return [(t, *rest) for t in range(-1, 3) for rest in (_all(n - 1) if n > 1 else [()])]


def test_parts_hold_every_bit_once(spark):
    n, both = simhash._agreement(spark.range(1000).selectExpr("xxhash64(id) as fp"))
    assert n == 1000
    for parts in (2, 3, 4, 5):
        assert sorted(sum(simhash.correlated_parts(n, both, parts), [])) == list(range(64))


def test_components_of_paths_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(300 + k, 300 + (k + 1) % 9) for k in range(9)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{100 + k: 100 for k in range(80)}, **{300 + k: 300 for k in range(9)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
