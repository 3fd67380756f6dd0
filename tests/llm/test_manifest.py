import hashlib
import random
import zlib

import pytest
from helpers import awkward, table
from pyspark.sql import functions as F

from rillscan.llm import manifest

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(leaves, arity):
    """The root and, for each leaf, its siblings by level with its place among them."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // arity * arity:][:arity]
            paths[k].append((i % arity, run[:i % arity] + run[i % arity + 1:]))
        nodes, at = [h(nodes[i:i + arity]) for i in range(0, len(nodes), arity)], [i // arity for i in at]
    return nodes[0], paths


def fold(node, path):
    for place, others in path:
        node = h([*others[:place], node, *others[place:]])
    return node


def expected(rows, arity):
    """(doc_id, leaf, subroot, root, siblings, places) of rows (doc_id, text, lang, source, n_chars)."""
    sources = {}
    for i, t, lang, source, n in rows:
        sources.setdefault(source, []).append((i, leaf((i, source, lang, n, t))))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for s in names]
    below = [tree([d for _, d in g], arity) for g in groups]
    root, above = tree([subroot for subroot, _ in below], arity)
    out = []
    for g, (subroot, paths), top in zip(groups, below, above, strict=True):
        for (i, d), path in zip(g, paths, strict=True):
            assert fold(d, path + top) == root
            out.append((i, d, subroot, root, path + top))
    return out


def proven(spark, rows, arity=16, every=3):
    made = manifest.build(table(spark, rows), NAMES, shape=manifest.Shape(arity, every))
    got = manifest.proofs(made).withColumn("back", manifest.folded(F.col("leaf"), F.col("path"))).withColumn(
        "digest", manifest.path_digest(F.col("path"))).collect()
    want = expected(rows, arity)
    key = lambda r: (str(r[0]), *r[1:4])
    assert sorted(((r.place, r.leaf, r.subroot, r.root) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    # rows of one digest may change places; their proofs are a set
    assert sorted((r.leaf, r.digest) for r in got) == sorted((w[1], h(x for _, o in w[4] for x in o)) for w in want)
    assert all(r.back == r.root for r in got)
    return made


def test_awkward_rows(spark):
    proven(spark, awkward())
    made = manifest.build(table(spark, []), NAMES)
    assert manifest.proofs(made).count() == 0 and made.root.count() == 0


@pytest.mark.parametrize("arity, every", [(2, 1), (2, 2), (3, 2)])
def test_stored_levels(spark, arity, every):
    """Trees of many heights, whose top lies on a stored level or between two."""
    rng = random.Random(arity)
    rows = [(rng.randrange(10**6), f"text {k}", "en", source, k) for source, n in
            [(None, 1), ("", 2), ("a", 3), ("b", 4), ("c", 5), ("é", 9), ("z", 17), ("\U0001F600", 33)] for k in range(n)]
    made = proven(spark, rows, arity, every)
    assert len(made.groups.stored) == {(2, 1): 7, (2, 2): 4, (3, 2): 3}[arity, every]
    nodes = made.groups.stored[1].groupBy("tree").count().collect()
    assert {r.tree: r["count"] for r in nodes}["+z"] == -(-17 // arity ** every)


def test_one_row_and_one_source(spark):
    proven(spark, [(5, "alone", None, None, None)])
    proven(spark, [(i, "x", "en", "one", 1) for i in range(20)])
    proven(spark, [(i, "x", "en", f"s{i}", 1) for i in range(20)], 2, 2)


def test_tampering_shows(spark):
    rows = [(i, "Text" if i % 2 else "text", "en", f"s{i % 3}", 4) for i in range(40)]
    docs = table(spark, rows)
    lowered = manifest.digest(*[F.lower("text") if c == "text" else F.col(c) for c in NAMES])
    made = manifest.build(docs, NAMES, keep={"lowered": lowered}, shape=manifest.Shape(4, 1))
    got = manifest.proofs(made).select(
        "place", (manifest.folded(F.col("lowered"), F.col("path")) == F.col("root")).alias("same")).collect()
    assert {r.place: r.same for r in got} == {i: t == "text" for i, t, *_ in rows}


def test_query(spark, tmp_path):
    from rillscan.llm import queries
    rows = list({r[0]: r for r in awkward() if r[0] is not None}.values())
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle(spark, str(tmp_path)).collect()
    texts = {r[0]: r for r in rows}
    for r in got:
        i, t, lang, source, n = texts[r.doc_id]
        low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        bad = zlib.crc32(str(i).encode()) % 5 == 0 and low != t
        assert r.leaf == leaf((i, source, lang, n, t)) and r.verified == (not bad) == (r.folded_root == r.root)
