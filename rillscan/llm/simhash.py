"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints of distinct texts are grouped to distinct values.  Their 64 bits are put into
partitions of correlated bits, and a dynamic program gives each partition a threshold of its own
(-1: not probed) such that two values within the distance agree within the threshold in at least
one partition.  Every value probes the buckets of a partition; what meets there is verified.

A bucket that more than ``PAIRS`` probes touch never emits its pairs.  Its values take an exact
other way: two values differ in at most two bits if and only if one flipped bit on each side (or
none) makes them meet, so each of them is joined to the least value that shares such a variant.
That takes 65 rows a value however large the bucket.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import pieces, texts, unsigned_hex, written

BITS, SEED = 64, 42
PAIRS = 128
"""Beyond this many probes of a bucket 65 variants a value are fewer rows than its pairs."""
ONES = (1 << BITS) - 1


def signed(value: int) -> int:
    value &= ONES
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprint(text: str, shingle: int) -> int:
    """Majority bits of the XXH64 of the word shingles; 0 if there is no word."""
    words = text.encode().lower().split()  # bytes: A-Z and the ASCII blanks only
    if not words:
        return 0
    if len(words) <= shingle:
        hashed = [b" ".join(words)]
    else:
        hashed = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, hashed, repeat(SEED)), np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every row; a null text counts as empty."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                fps = [signed(fingerprint(t, shingle)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _agreement(values: DataFrame) -> tuple[int, np.ndarray]:
    """How many values there are and, for two bits, in how many both are set (64 x 64 counts)."""
    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(v)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i * BITS + j, -1)), pa.array(np.append(both[i, j], n).astype(np.int64))], ["at", "n"])

    rows = values.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for at, count in rows:  # 2,081 rows whatever the input
        if at < 0:
            n = count
        else:
            both[at // BITS, at % BITS] = both[at % BITS, at // BITS] = count
    return n, both


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in partitions of near-equal size, each grown from the bits that correlate with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS * (k + 1) // parts - BITS * k // parts
        seed = max(left, key=lambda b: (sum(corr[b, c] for c in left if c != b), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (sum(corr[b, c] for c in group), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def _probes(width: int, threshold: int) -> int:
    return {-1: 0, 0: 1, 1: 1 + width}.get(threshold, 1 + width + width * (width - 1) // 2)


def allocate(costs: list[dict[int, float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least cost whose sum plus the number of partitions is ``distance + 1``.

    A pair beyond every threshold then differs in more than ``distance`` bits in all.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t, more in cost.items():
                k = spent + t + 1
                if k <= distance + 1 and (k not in step or c + more < step[k][0]):
                    step[k] = (c + more, [*chosen, t])
        best = step
    return best[distance + 1]


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated work: rows probed plus candidates met."""
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-9, 1 - 1e-9)
    plans = []
    for parts in range(2, distance + 4):
        groups = correlated_parts(n, both, parts)
        costs = []
        for group in groups:
            q = agree[group]
            zero = float(np.prod(q))
            odds = (1 - q) / q
            one = zero * float(odds.sum())
            two = zero * float((odds.sum() ** 2 - (odds ** 2).sum()) / 2)
            near = {-1: 0.0, 0: zero, 1: zero + one, 2: zero + one + two}
            costs.append({t: _probes(len(group), t) * n + n * n / 2 * near[t] for t in range(-1, min(distance, 2) + 1)})
        cost, chosen = allocate(costs, distance)
        plans.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def links(values: DataFrame, distance: int) -> DataFrame:
    """Edges ``a, b`` between distinct values ``fp``; they join all that lie within ``distance`` (2 at most).

    Within small buckets every close pair is an edge; values of large buckets are joined through
    shared variants, which leaves the same components.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    n, both = _agreement(values)
    index = probes = None
    for k, (group, threshold) in enumerate(plan(n, both, distance)):
        mask = signed(sum(1 << b for b in group))
        flips = [0] + [signed(1 << b) for b in group] * (threshold >= 1)
        if threshold >= 2:
            flips += [signed(1 << b | 1 << c) for i, b in enumerate(group) for c in group[:i]]
        own = values.select(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value"), "fp")
        probe = own if threshold == 0 else own.select(
            "part", F.explode(F.array(*[F.col("value").bitwiseXOR(F.lit(f)) for f in flips])).alias("value"), "fp")
        index = own if index is None else index.union(own)
        probes = probe if probes is None else probes.union(probe)
    probes = probes.withColumnRenamed("fp", "other")
    met = written(probes.groupBy("part", "value").agg(F.count(F.lit(1)).alias("met")).filter("met > 1"))
    few, many = met.filter(F.col("met") <= PAIRS), met.filter(F.col("met") > PAIRS)
    pairs = (
        index.join(few.drop("met"), ["part", "value"])
        .join(probes, ["part", "value"]).filter("fp < other")
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    crowded = written(probes.join(many, ["part", "value"], "left_semi").select(F.col("other").alias("fp")).distinct())
    if distance == 2:
        variants = crowded.select("fp", F.explode(F.array(
            F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS)])).alias("variant"))
        hubs = F.min("fp").over(Window.partitionBy("variant"))
        starred = variants.select(hubs.alias("a"), F.col("fp").alias("b")).filter("a <> b")
    else:
        # both ends of a link of one bit are variants of each other
        other = crowded.select(F.col("fp").alias("a"), F.explode(F.array(
            *[F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS if distance else 0)],
            F.col("fp"))).alias("b"))
        starred = other.filter("a < b").join(crowded.withColumnRenamed("fp", "b"), "b", "left_semi")
    return pairs.union(starred.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    The component is the smallest doc_id that links of at most ``distance`` differing bits reach.
    Texts without words (null, empty, blank) have fingerprint zero and link like any other.
    Repeated rows give repeated results; a component of null ids only has a null component; an
    empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col))
    values = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = written(components(links(values, distance)))
    named = values.join(roots, values.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(named.join(least, "root").select("fp", "component_id"))
    return fps.join(classes, "fp").select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")
