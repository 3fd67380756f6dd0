"""Shards of near-equal bytes by a histogram sort.

Rows are ordered by (hash of the text, id), so equal texts are neighbours.  The driver holds only
candidate boundaries.  In each round the exact bytes and rows below all probes are counted over
all partitions, with one partial histogram a partition, and the probes of a boundary close in on
the gap that holds its target, until it meets the tolerance or no row is left inside.  Then the
rows are exchanged once, by the range they fall in.  A shard is some ranges in a row; the counts
below its ranges make the slots gapless without a sort of a whole shard.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written

PROBES = 64
GROUP_SHARE = 0.05
"""Equal texts of up to this share of a shard's bytes are never parted."""
FIRST = -(1 << 63)
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Keys:
    """Order of (hash, id) as one integer, for ids from ``low`` to ``low + span - 1``."""
    low: int
    span: int

    def split(self, key: int) -> tuple[int, int]:
        h, own = divmod(key, self.span)
        h += FIRST
        return (h, own + self.low) if h <= LAST else (LAST, LAST)

    @property
    def end(self) -> int:
        return (1 << 64) * self.span


def _gap(h: np.ndarray, own: np.ndarray, ats: np.ndarray, owns: np.ndarray) -> np.ndarray:
    """How many of the sorted keys (ats, owns) are at or below each row."""
    out = np.searchsorted(ats, h, "left")
    for at in np.intersect1d(h, ats):
        rows, keys = h == at, ats == at
        out[rows] += np.searchsorted(owns[keys], own[rows], "right")
    return out


def _arrays(keys: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k[0] for k in keys], dtype=np.int64), np.array([k[1] for k in keys], dtype=np.int64)


def _below(rows: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each of the sorted probes; a partition sends one histogram."""
    ats, owns = _arrays(probes)

    def run(batches):
        size, n = np.zeros(len(ats) + 1, np.int64), np.zeros(len(ats) + 1, np.int64)
        for b in batches:
            gap = _gap(b.column("h").to_numpy(), b.column("id").to_numpy(), ats, owns)
            np.add.at(size, gap, b.column("size").to_numpy())
            n += np.bincount(gap, minlength=len(n))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held, size[held], n[held])], ["gap", "size", "n"])

    parts = rows.select("h", "id", "size").mapInArrow(run, "gap long, size long, n long")
    cells = {g: (s, n) for g, s, n in parts.groupBy("gap").agg(F.sum("size"), F.sum("n")).collect()}
    out, total = [], (0, 0)
    for gap in range(len(probes)):
        more = cells.get(gap, (0, 0))
        total = (total[0] + more[0], total[1] + more[1])
        out.append(total)
    return out


def splitters(rows: DataFrame, order: Keys, total: tuple[int, int],
              wanted: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """``(key, rows below it)`` for each wanted (bytes below, tolerance in bytes).

    Where rows are larger than the tolerance, the boundary is the nearer side of the row that
    holds the target.  Rows of one key are never parted.
    """
    low = [(0, (0, 0))] * len(wanted)
    high = [(order.end, total)] * len(wanted)
    done: dict[int, tuple[int, int]] = {}
    while True:
        probes: set[int] = set()
        for i, (target, tolerance) in enumerate(wanted):
            if i in done:
                continue
            (a, below), (b, above) = low[i], high[i]
            near = min((low[i], high[i]), key=lambda side: abs(side[1][0] - target))
            if abs(near[1][0] - target) <= tolerance or above[1] - below[1] <= 1 or b - a <= 1:
                done[i] = (near[0], near[1][1])
            else:
                step = max(1, (b - a) // PROBES)
                probes.update(range(a + step, b, step))
        if not probes:
            return [done[i] for i in range(len(wanted))]
        keys = sorted(probes)
        below_keys = _below(rows, [order.split(k) for k in keys])
        for i, (target, _) in enumerate(wanted):
            if i not in done:
                cut = bisect.bisect_right(below_keys, target, key=lambda x: x[0])
                if cut and keys[cut - 1] > low[i][0]:
                    low[i] = (keys[cut - 1], below_keys[cut - 1])
                if cut < len(keys) and keys[cut] < high[i][0]:
                    high[i] = (keys[cut], below_keys[cut])


def whole_groups(rows: DataFrame, order: Keys, found: list[tuple[int, int]], targets: list[float],
                 most: float) -> list[tuple[int, int]]:
    """The boundaries, each that cuts a group of equal texts moved to the nearer end of it.

    A group of more than ``most`` bytes stays cut: no shard could hold it beside its share of the rest.
    """
    cut = sorted({k // order.span for k, _ in found if k % order.span})
    if not cut:
        return found
    probes = sorted({end for g in cut for end in (g * order.span, min((g + 1) * order.span, order.end - 1))})
    below = dict(zip(probes, _below(rows, [order.split(k) for k in probes]), strict=True))
    out = []
    for (key, n), target in zip(found, targets, strict=True):
        g = key // order.span
        if key % order.span:
            ends = (g * order.span, min((g + 1) * order.span, order.end - 1))
            low, high = (below[e] for e in ends)
            if high[0] - low[0] <= most:
                key, n = min(((e, below[e][1]) for e in ends), key=lambda x: abs(below[x[0]][0] - target))
        out.append((key, n))
    return out


def _range_of(h: Column, own: Column, keys: list[tuple[int, int]]) -> Column:
    ats, owns = _arrays(keys)

    @F.pandas_udf("int")
    def find(h: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series(_gap(h.to_numpy(), own.to_numpy(), ats, owns).astype(np.int32))

    return find(h, own)


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def histogram_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.001,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``size, shard, slot`` (columns of these names are replaced).

    Size is the UTF-8 bytes of the text (null: none) plus 1.  Boundaries meet ``tolerance`` of the
    mean bytes of a shard or lie beside the row that holds the target, but where they would cut a group of
    equal texts: they lie beside the group then.  Only a group of more than ``GROUP_SHARE`` of a shard is
    cut, into shards next to each other.  Rows equal in text and id share a key and are never parted.  A null id sorts as the least.
    An empty table gives no rows.
    """
    h, own, rng, place = (_free(x, docs.columns) for x in ("key_hash", "key_id", "key_range", "key_place"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    keyed = docs.withColumns({h: F.xxhash64(F.col(text_col)), own: F.col(id_col).cast("long")})
    rows = written(keyed.select(F.col(h).alias("h"), F.col(own).alias("id"), size.alias("size")))
    first, last, in_bytes, n = rows.agg(F.min("id"), F.max("id"), F.sum("size"), F.count(F.lit(1))).first()
    first, last = (first, last) if first is not None else (0, 0)
    order = Keys(first - 1 if first > FIRST else first, last - first + 2)
    rows = rows.fillna({"id": order.low})
    each = max(1, -(-partitions(docs.sparkSession) // shards))
    total = in_bytes or 0
    wanted = [(total * k / (shards * each), total / shards * (tolerance if k % each == 0 else 1 / (8 * each)))
              for k in range(1, shards * each)]
    found = splitters(rows, order, (total, n), wanted)
    main = slice(each - 1, None, each)  # between shards; the others are between ranges of one
    found[main] = whole_groups(rows, order, found[main], [t for t, _ in wanted[main]], GROUP_SHARE * total / shards)
    ends = [found[k * each - 1] for k in range(1, shards)]
    bounds = sorted(set(found))
    starts = [(0, 0), *bounds]
    shard_of = [bisect.bisect_right([e[0] for e in ends], key) if at else 0 for at, (key, _) in enumerate(starts)]
    first_row = [0, *(e[1] for e in ends)]
    offset = [below - first_row[s] for (_, below), s in zip(starts, shard_of, strict=True)]
    window = Window.partitionBy(rng).orderBy(h, own)
    at = F.col(rng) + 1
    return (
        keyed.fillna({own: order.low})
        .withColumn(rng, _range_of(F.col(h), F.col(own), [order.split(k) for k, _ in bounds]))
        .withColumn(place, F.row_number().over(window))
        .withColumns({
            "size": size,
            "shard": F.element_at(F.array(*[F.lit(s) for s in shard_of]), at),
            "slot": F.element_at(F.array(*[F.lit(o).cast("long") for o in offset]), at) + F.col(place) - 1,
        }).drop(h, own, rng, place)
    )
