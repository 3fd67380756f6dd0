"""Removal of bytes that repeat an earlier document, by sorting covered suffixes.

The suffixes of all texts are sorted as far as ``length`` bytes go, by a difference cover: a
sample of positions such that two equal strings of that length always have sampled positions at
the same distance from their starts.  The cover is drawn from the content (the least hashed
``GRAM`` bytes of each string) instead of from residues modulo 3, which samples one position in
sixteen instead of two in three and needs no second round of names.

1. Sampled positions are named by their first ``GRAM`` bytes.  Each bucket of documents sends its
   distinct names once; names of one bucket and one document cannot repeat and are out.
2. For the others the bucket sends what surrounds them, once for each distinct surrounding, with
   the least document that has it.
3. By name, the sampled suffixes and, from them, the suffixes that start up to ``length - GRAM``
   bytes before are sorted by their bytes.  Neighbours that agree in ``length`` bytes are one
   string; a bit for each start says whether a smaller document has it.
4. The bits return to the buckets, where the strings they mark are cut from the texts.

What is exchanged is the text, once (all steps read the same exchange), and packed arrays, one
for each pair of bucket and target.  A string that a third of all documents share arrives once
from each bucket.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, texts

GRAM = 20
CHUNK = 1 << 16
"""Bytes whose samples are computed at once: parts of a long text, or several short ones."""
ROWS = 1 << 13
NO_ID = (1 << 63) - 1
U = np.uint64


@dataclass(frozen=True)
class Reach:
    length: int

    @property
    def before(self) -> int:
        """Bytes by which a string may start before its sampled position."""
        return self.length - GRAM

    @property
    def width(self) -> int:
        """Bytes around a sampled position that its strings can take in."""
        return self.before + self.length


def _names(a: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each position: bytes, pairs, fours and so on put together."""
    with np.errstate(over="ignore"):
        h = a.astype(U) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
        power, parts, n = U(0xD6E8FEB86659FD93), {}, 1
        while True:
            parts[n] = (h, power)
            if 2 * n > GRAM:
                break
            h, power, n = h[:-n] * power + h[n:], power * power, 2 * n
        out, done = parts[16][0], 16
        four, p4 = parts[4]
        out = out[:len(a) - GRAM + 1] * p4 + four[done:done + len(a) - GRAM + 1]
        out ^= out >> U(32)
        out *= U(0xBF58476D1CE4E5B9)
        return out ^ (out >> U(29))


def samples(texts_: list[np.ndarray], reach: Reach) -> tuple[np.ndarray, ...]:
    """Name, position, first and last start of its strings, and text of each sampled position, in
    the order of texts and positions."""
    found, block, size = [], [], 0
    for owner, a in enumerate(texts_):
        for at in range(0, len(a) - reach.length + 1, CHUNK):
            part = a[at:at + CHUNK + reach.length - 1]
            block.append((owner, at, part))
            size += len(part)
            if size >= CHUNK:
                found.append(_of_block(block, reach))
                block, size = [], 0
    if block:
        found.append(_of_block(block, reach))
    if not found:
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _of_block(block: list[tuple[int, int, np.ndarray]], reach: Reach) -> tuple[np.ndarray, ...]:
    """Samples of some parts of texts, put one after the other for the arithmetic alone."""
    lengths = np.array([len(p) for _, _, p in block])
    names = _names(np.concatenate([p for _, _, p in block]))
    # the least hash, of equal ones the first, over the positions a string can have
    index = U(4 * CHUNK - 1)
    low = (names & ~index) | np.arange(len(names), dtype=U)
    span, n = reach.before + 1, 1
    while 2 * n <= span:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    if n < span:
        low = np.minimum(low[:len(low) - (span - n)], low[span - n:])
    # strings lie in one part
    begins = np.cumsum(lengths) - lengths
    n_starts = lengths - reach.length + 1
    part = np.repeat(np.arange(len(block)), n_starts)
    start = np.arange(len(part)) - np.repeat(np.cumsum(n_starts) - n_starts - begins, n_starts)
    pos = (low[start] & index).astype(np.int64)
    new = np.append(True, (pos[1:] != pos[:-1]) | (part[1:] != part[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos)) - 1
    shift = np.array([at for _, at, _ in block]) - begins
    of = part[first]
    return (names[pos[first]], pos[first] + shift[of], start[first] + shift[of], start[last] + shift[of],
            np.array([o for o, _, _ in block])[of])


def _bytes_of(table: pa.Table) -> list[tuple[int | None, np.ndarray]]:
    """Id and bytes of the texts of a bucket, in the order of the ids."""
    rows = [(i, np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for i, t in zip(
        table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    return rows


def _own(i: int | None) -> int:
    return NO_ID if i is None else i


def _target(names: np.ndarray, n: int) -> np.ndarray:
    return ((names >> U(32)) % U(n)).astype(np.int64)


def _repeated_here(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, sorted, and whether two documents of the bucket have them."""
    order = np.lexsort((docs, names))
    names, docs = names[order], docs[order]
    first = np.flatnonzero(np.diff(names, prepend=~names[:1])) if len(names) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(names)) - 1
    return names[first], docs[first] != docs[last] if len(names) else np.zeros(0, bool)


def _packed(bucket, targets: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """One row a target: the rows of the arrays that go there, in their order."""
    order = np.argsort(targets, kind="stable")
    cuts = np.flatnonzero(np.diff(targets[order], prepend=-1))
    ends = np.append(cuts[1:], len(order))[:len(cuts)]
    out = {"bucket": pa.array([bucket] * len(cuts), pa.int32()), "target": pa.array(targets[order][cuts].astype(np.int32), pa.int32())}
    for name, values in columns.items():
        moved = values[order]
        out[name] = pa.array([moved[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())
    return pa.table(out)


def _bucket_of(key) -> int:
    return key[0].as_py()


def _sampled(rows, reach):
    return samples([a for _, a in rows], reach)


@dataclass
class Surroundings:
    """The distinct surroundings of repeated samples of a bucket, and which sample has which."""
    names: np.ndarray
    least: np.ndarray
    low: np.ndarray
    high: np.ndarray
    around: np.ndarray
    of: np.ndarray


def _surroundings(rows, reach: Reach, chosen: np.ndarray, names, pos, first, last, owner) -> Surroundings:
    """``low`` and ``high``: least and greatest distance of a start before the sample."""
    names, pos, first, last, owner = (x[chosen] for x in (names, pos, first, last, owner))
    around = np.zeros((len(names), reach.width), np.uint8)
    offsets = np.arange(-reach.before, reach.length)
    whole = np.concatenate([a for _, a in rows]) if rows else np.zeros(0, np.uint8)
    base = np.cumsum([0, *(len(a) for _, a in rows)])
    for at in range(0, len(names), ROWS):
        part = slice(at, at + ROWS)
        spot = pos[part, None] + offsets
        inside = (spot >= first[part, None]) & (spot < last[part, None] + reach.length)
        here = np.where(inside, spot, first[part, None]) + base[owner[part], None]
        around[part] = whole[here] * inside
    low, high = (pos - last).astype(np.uint8), (pos - first).astype(np.uint8)
    docs = np.array([_own(rows[i][0]) for i in owner], np.int64)
    mark = np.fromiter((xxhash.xxh64_intdigest(r) for r in around), U, len(names)) if len(names) else np.zeros(0, U)
    order = np.lexsort((docs, high, low, mark, names))
    s = [x[order] for x in (names, mark, low, high, around)]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([x[1:] != x[:-1] for x in s[:4]], axis=0) | (s[4][1:] != s[4][:-1]).any(1)
    heads = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return Surroundings(s[0][heads], docs[order][heads], s[2][heads], s[3][heads], s[4][heads], of)


def earlier(names, least, low, high, around, reach: Reach) -> np.ndarray:
    """For each surrounding a bit for each distance of a start: a smaller document has the string."""
    bits = np.zeros(len(names), U)
    for d in range(reach.before + 1):
        rows = np.flatnonzero((low <= d) & (d <= high))
        if len(rows) < 2:
            continue
        strings = np.zeros((len(rows), -(-reach.length // 8) * 8), np.uint8)
        strings[:, :reach.length] = around[rows, reach.before - d:reach.before - d + reach.length]
        words = strings.view(">u8").astype(U)
        order = np.lexsort((*words.T[::-1], names[rows]))
        words, docs = words[order], least[rows][order]
        same = (words[1:] == words[:-1]).all(1)
        heads = np.flatnonzero(np.append(True, ~same))
        run = np.cumsum(np.append(True, ~same)) - 1
        bits[rows[order]] |= (np.minimum.reduceat(docs, heads)[run] < docs).astype(U) << U(d)
    return bits


def removed(a: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which bytes the strings at the given starts cover."""
    edge = np.zeros(len(a) + 1, np.int32)
    edge[starts] += 1  # no start occurs twice
    edge[starts + length] -= 1
    return np.cumsum(edge[:-1]) > 0


PACKED = "bucket int, target int, names binary"


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that remain) for every row.

    A byte goes if a string of ``length`` bytes covers it that also starts in a document with a
    smaller id, both as in the input.  A null text is empty; a null id is greater than all others;
    rows of one id never remove from each other; texts shorter than ``length`` stay; an empty
    table gives no rows.  Other columns are not read.  Samples of a text are taken in chunks, so a
    task holds the texts of one bucket and their repeated surroundings; buckets are as many as
    shuffle partitions.
    """
    if not GRAM < length <= GRAM + 63:
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + 63}")
    reach, n = Reach(length), partitions(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn(
        "bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n)).cast("int"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def names_of(key, table):
        found = _bytes_of(table)
        names, *_, owner = _sampled(found, reach)
        distinct = np.unique(names)
        return _packed(_bucket_of(key), _target(distinct, n), names=distinct)

    def shared_names(key, table):
        parts = [np.frombuffer(x, U) for x in table.column("names").to_pylist()]
        every = np.sort(np.concatenate(parts))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        kept = [p[np.isin(p, twice, assume_unique=True)].tobytes() for p in parts]
        return pa.table({"bucket": table.column("bucket"), "target": table.column("target"), "names": pa.array(kept, pa.binary())})

    def chosen_of(found, sampled, shared):
        """Samples whose name two documents have, here or in different buckets."""
        names, owner = sampled[0], sampled[4]
        ids = np.array([_own(i) for i, _ in found], np.int64)[owner] if len(found) else np.zeros(0, np.int64)
        distinct, here = _repeated_here(names, ids)
        return np.isin(names, np.union1d(distinct[here], shared))

    def surroundings_of(key, left, right):
        if not left.num_rows:
            return pa.table({f: pa.array([], t) for f, t in zip(
                ("bucket", "target", "names", "least", "reach", "around"), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)})
        found = _bytes_of(left)
        sampled = _sampled(found, reach)
        shared = np.concatenate([np.zeros(0, U), *(np.frombuffer(x, U) for x in right.column("names").to_pylist())])
        s = _surroundings(found, reach, chosen_of(found, sampled, shared), *sampled)
        return _packed(_bucket_of(key), _target(s.names, n), names=s.names, least=s.least,
                       reach=np.stack([s.low, s.high], 1), around=s.around)

    def bits_of(key, table):
        get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        names, reaches = get("names", U), np.concatenate(get("reach", np.uint8)).reshape(-1, 2)
        around = np.concatenate(get("around", np.uint8)).reshape(-1, reach.width)
        bits = earlier(np.concatenate(names), np.concatenate(get("least", np.int64)), reaches[:, 0], reaches[:, 1], around, reach)
        ends = np.cumsum([len(x) for x in names])
        return pa.table({
            "bucket": table.column("bucket"), "target": table.column("target"), "names": table.column("names"),
            "bits": pa.array([bits[e - len(x):e].tobytes() for x, e in zip(names, ends, strict=True)], pa.binary())})

    def cut(key, left, right):
        found = _bytes_of(left)
        sampled = _sampled(found, reach)
        right = right.sort_by("target")
        join = lambda c: np.concatenate([np.zeros(0, U), *(np.frombuffer(x, U) for x in right.column(c).to_pylist())])
        names, bits = join("names"), join("bits")
        s = _surroundings(found, reach, np.isin(sampled[0], names), *sampled)
        # back from the order of targets to the order of the surroundings
        marks = np.empty(len(s.names), U)
        marks[np.argsort(_target(s.names, n), kind="stable")] = bits
        mine = np.isin(sampled[0], names)
        pos, owner = sampled[1][mine], sampled[4][mine]
        s_of, ids = s.of, np.array([_own(i) for i, _ in found], np.int64)[owner]
        later, low, high, marks = ids > s.least[s_of], s.low[s_of], s.high[s_of], marks[s_of]
        starts, owners = [], []
        for d in range(reach.before + 1):
            hit = np.flatnonzero((low <= d) & (d <= high) & (later | ((marks >> U(d)) & U(1)).astype(bool)))
            starts.append(pos[hit] - d)
            owners.append(owner[hit])
        starts, owners = np.concatenate(starts), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        starts, cuts = starts[order], np.searchsorted(owners[order], np.arange(len(found) + 1))
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for k, (i, a) in enumerate(found):
            kept, n_removed, n_spans = a.tobytes(), 0, 0
            if cuts[k] < cuts[k + 1]:
                gone = removed(a, starts[cuts[k]:cuts[k + 1]], length)
                kept = a[~gone].tobytes()
                n_removed, n_spans = len(a) - len(kept), int(np.diff(gone, prepend=False)[gone].sum())
            for name, value in zip(out, (i, len(a), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[name].append(value)
        types = (left.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    names = rows.groupBy("bucket").applyInArrow(names_of, PACKED)
    shared = names.groupBy("target").applyInArrow(shared_names, PACKED)
    around = rows.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(
        surroundings_of, f"{PACKED}, least binary, reach binary, around binary")
    marked = around.groupBy("target").applyInArrow(bits_of, f"{PACKED}, bits binary")
    return rows.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
