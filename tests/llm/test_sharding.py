from collections import defaultdict

import pytest
from helpers import awkward, table

from rillscan.llm import sharding


def check(df, shards, n):
    rows = sharding.histogram_shards(df, shards).collect()
    assert len(rows) == n
    slots, sizes, total = defaultdict(list), defaultdict(int), 0
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 1 and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        total += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max((r.size for r in rows), default=0)
    assert all(abs(sizes[k] - total / shards) <= 2 * most + total / shards * 0.002 for k in range(shards)) or n < shards
    return rows, sizes


def test_awkward_rows(spark):
    df = table(spark, awkward())
    rows, _ = check(df, 8, len(awkward()))
    assert {r.at for r in rows} == {"x"}  # other columns stay
    check(table(spark, []), 8, 0)
    check(table(spark, [(None, None, None, None, None)]), 3, 1)


@pytest.mark.parametrize("hot", [0, 300])
def test_sizes_meet_the_tolerance_and_groups_stay(spark, hot):
    rows = [(k, "same text" if k < hot else f"text number {k} " + "y" * (k % 50), "", "", 0) for k in range(900)]
    got, sizes = check(table(spark, rows, clash=False), 8, 900)
    mean = sum(sizes.values()) / 8
    assert max(abs(s - mean) for s in sizes.values()) <= 70
    if hot:  # neighbours in key order: the cut group lies in shards next to each other
        held = sorted({r.shard for r in got if r.text == "same text"})
        assert held == list(range(held[0], held[-1] + 1))


def test_splitters_by_brute_force(spark):
    rows = [(h, i, s) for h, i, s in ((k % 3 * 10**18 - 10**18, k, 1 + k % 7) for k in range(200))]
    df = spark.createDataFrame(rows, "h long, id long, size long")
    order = sharding.Keys(0, 200)
    total = (sum(r[2] for r in rows), len(rows))
    got = sharding.splitters(df, order, total, [(t, 0) for t in (1, 100, 333, 799)])
    for target, (key, n) in zip((1, 100, 333, 799), got, strict=True):
        below = [r for r in rows if (r[0], r[1]) < order.split(key)]
        assert n == len(below) and abs(sum(r[2] for r in below) - target) <= 7


@pytest.mark.parametrize("shards", [2, 8])
def test_groups_of_equal_texts_are_whole(spark, shards):
    """Groups of up to nine rows everywhere, so most boundaries fall into one; and one too large for a shard."""
    rows = [(k, f"text {k % 200} " + "y" * 40, "", "", 0) for k in range(1500)] + [(5000 + k, "hot " + "z" * 40, "", "", 0) for k in range(700)]
    got, sizes = check_groups(spark, rows, shards)
    held = defaultdict(set)
    for r in got:
        held[r.text].add(r.shard)
    assert all(len(s) == 1 for t, s in held.items() if not t.startswith("hot"))
    hot = sorted(held["hot " + "z" * 40])
    assert hot == list(range(hot[0], hot[-1] + 1))
    mean = sum(sizes.values()) / shards
    assert max(abs(s - mean) for s in sizes.values()) <= 9 * 51


def check_groups(spark, rows, shards):
    got = sharding.histogram_shards(table(spark, rows, clash=False), shards).collect()
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, sizes
