"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

A bin takes at most one document of each source and of each duplicate cluster, which it remembers
in two bitmaps.  Documents, largest first, go to the bin with the least room that still suffices:
bins are kept in order of their residual, and the search goes on from the first that is large
enough, successor by successor, until one has no conflict.  Parts as large as a bin fill one each.

Rows are dealt evenly, by a hash, to blocks of about ``BLOCK`` rows, which are packed apart from
each other.  So no source or cluster, however large, makes a large group, and a block's last bins
are the only loss against one block of all.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
BINS = 1 << 24


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item and where in it the item starts, for items in the order given.

    A null source or cluster conflicts with nothing.
    """
    bit: dict[tuple[int, object], int] = {}

    def mask(kind: int, value) -> int:
        return 0 if value is None else 1 << bit.setdefault((kind, value), len(bit))

    by_room: list[tuple[int, int]] = []  # (residual, bin), ascending
    marks: list[tuple[int, int]] = []  # the bin's sources and clusters
    bins, starts = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        own, copy = mask(0, source), mask(1, cluster)
        k = bisect_left(by_room, (size, -1))
        while k < len(by_room) and (marks[by_room[k][1]][0] & own or marks[by_room[k][1]][1] & copy):
            k += 1
        if k < len(by_room):
            room, b = by_room.pop(k)
            marks[b] = (marks[b][0] | own, marks[b][1] | copy)
        else:
            room, b = capacity, len(marks)
            marks.append((own, copy))
        bins.append(b)
        starts.append(capacity - room)
        insort(by_room, (room - size, b))
    return bins, starts


def pack(docs: DataFrame, capacity: int, size: Column, source: Column, cluster: Column, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, copy, part, doc_start, length, bin, bin_start``, a row for each part of a row.

    A document longer than the capacity is cut into parts of that length and a rest; all others
    are one part.  ``copy`` counts repeated rows from 1.  A null size counts as 0, an empty
    document is a part of length 0, and a null id, source or cluster is allowed (the last two
    conflict with nothing).  An empty table gives no rows.  Each bin lies in one block.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    # repeated rows meet as a count, so that they spread over the blocks
    counted = rows.groupBy("doc_id", "size", "source", "cluster").agg(F.count(F.lit(1)).alias("copies"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    n_blocks = max(1, -(-docs.count() // BLOCK))
    dealt = each.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy", "size"), F.lit(n_blocks)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "doc_id", "copy", "source", "cluster"], ascending=[False, True, True, True, True])
        part["rest"] = part["size"] % capacity
        part["full"] = part["size"] // capacity
        part.loc[(part["rest"] == 0) & (part["full"] > 0), "rest"] = -1
        small = part[part["rest"] >= 0].sort_values("rest", ascending=False, kind="stable")
        none = lambda s: [None if pd.isna(x) else x for x in s]
        bins, starts = best_fit(small["rest"].tolist(), none(small["source"]), none(small["cluster"]), capacity)
        used = max(bins, default=-1) + 1
        small = small.assign(part=small["full"], doc_start=small["full"] * capacity, length=small["rest"], bin=bins, bin_start=starts)
        large = part.loc[part.index.repeat(part["full"])]
        large = large.assign(part=large.groupby(level=0).cumcount(), length=capacity, bin=range(used, used + len(large)), bin_start=0)
        large["doc_start"] = large["part"] * capacity
        out = pd.concat([small, large]) if len(large) else small
        out["bin"] += out["block"] * BINS
        return out[["doc_id", "copy", "part", "doc_start", "length", "bin", "bin_start"]]

    return dealt.groupBy("block").applyInPandas(
        run, f"doc_id {kind}, copy int, part long, doc_start long, length long, bin long, bin_start long")
