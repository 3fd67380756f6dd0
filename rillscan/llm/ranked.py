"""Ranked lexical search: the best documents of each query text by the Best Position Algorithm.

Documents lie in blocks, each with an index of its own: a list of its documents for each term of the
queries, by falling impact.  Texts are read once; the numbers of documents and terms that weights
need are sums over the blocks, and lists get their impacts afterwards.

For a query the lists of a block are read from their tops, some places at a time.  Each document that
shows up is looked up in all other lists at once (direct access), which gives its whole score and
marks its place in every list.  A list's best position is the end of its unbroken run of marked places, read
or looked up; no unmarked document can have more than the impact that follows it.  Once the sum of
those is strictly below the k-th score the block is done.  With plain last-read positions the
lists would be read further.  The k best are kept from block to block, so later blocks often stop at once.
A task hands on k rows for each query; those meet in the exchange by query, and Spark cuts to k before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import pieces, written
from .squeeze import restored, squeezed

BLOCK_BYTES, QUERY_BYTES = 8 << 20, 8 << 20
"""Text of the documents of a block, and of the queries that are sent to the tasks at a time."""
FIRST_STEP = 16
"""Places that are read from each list before the first test; the step doubles."""

#: Fixed values of the score.
SCALE, HALF, LENGTH_SHARE = 1_000_000_000, 12, 25

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_LETTERS = bytes(c if c in _KEPT else 0x20 for c in range(256)).lower()


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


@dataclass
class Queries:
    """A bounded block of query texts: the terms, and of each query its terms with their repeats."""
    ids: list
    vocabulary: dict[bytes, int]
    asked: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        asked = []
        for _, text in rows:
            numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in terms(text or "")]
            asked.append(np.unique(np.array(numbers, np.int64), return_counts=True))
        return Queries([i for i, _ in rows], vocabulary, asked)


def _query_blocks(items: DataFrame) -> Iterator[Queries]:
    rows, size = [], 0
    for row in items.toLocalIterator():  # one block at a time is held
        if rows and size + len(row[1] or "") > QUERY_BYTES:
            yield Queries.of(rows)
            rows, size = [], 0
        rows.append(tuple(row))
        size += len(row[1] or "")
    if rows:
        yield Queries.of(rows)


def _index(docs: DataFrame, sent) -> DataFrame:
    """A row for each block: its documents, their numbers of terms, and how often each has which query term."""
    def run(batches):
        vocabulary = sent.value.vocabulary
        for batch in batches:
            for part in pieces(batch, "text", BLOCK_BYTES):
                lengths, found, counts, sizes = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = terms(text)
                    known = [n for n in map(vocabulary.get, own) if n is not None]
                    number, count = np.unique(np.array(known, np.int64), return_counts=True)
                    lengths.append(len(own))
                    found.append(number)
                    counts.append(count)
                    sizes.append(len(number))
                found, counts, docs_of = np.concatenate(found), np.concatenate(counts), np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(found, kind="stable")  # by term, then document
                of, df = np.unique(found, return_counts=True)
                lengths = np.array(lengths, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("doc_id").to_pylist()], pa.list_(part.schema.field("doc_id").type)),
                     pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
                     pa.array([of.tolist()], pa.list_(pa.int64())), pa.array([df.tolist()], pa.list_(pa.int64())),
                     *[pa.array([squeezed(x)], pa.binary()) for x in (lengths, docs_of[order], counts[order])]],
                    ["ids", "n_docs", "n_terms", "terms", "df", "lengths", "docs", "tf"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"ids array<{id_type}>, n_docs long, n_terms long, terms array<long>, df array<long>, "
                                "lengths binary, docs binary, tf binary")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document, 100 at the mean length."""
    if LENGTH_SHARE * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        share = LENGTH_SHARE * lengths * n_docs // max(n_terms, 1)
    else:  # beyond 64 bits on the way
        share = np.array([LENGTH_SHARE * int(n) * n_docs // max(n_terms, 1) for n in lengths], np.int64)
    return 100 - LENGTH_SHARE + share


@dataclass
class Block:
    """The impact lists of a block.  ``impact``, ``docs`` lie by term and document; ``top`` has, list after list,
    the entries by falling impact, and ``place`` the place of each entry in its list."""
    start: dict[int, tuple[int, int]]
    docs: np.ndarray
    impact: np.ndarray
    top: np.ndarray
    place: np.ndarray
    size: int

    @staticmethod
    def of(row: dict, weights: np.ndarray, n_docs: int, n_terms: int) -> Block:
        number, df = np.array(row["terms"], np.int64), np.array(row["df"], np.int64)
        ends = np.cumsum(df)
        lengths = restored(row["lengths"]).astype(np.int64)
        docs, tf = restored(row["docs"]).astype(np.int64), restored(row["tf"]).astype(np.int64)
        of = np.repeat(np.arange(len(df)), df)
        m = length_part(lengths, n_docs, n_terms)[docs]
        impact = weights[number][of] * (SCALE * tf // (1000 * tf + HALF * m))
        top = np.lexsort((docs, -impact, of))
        place = np.empty(len(top), np.int64)
        place[top] = np.arange(len(top)) - (ends - df)[of]  # top keeps the lists in their order
        start = {t: (e - d, e) for t, d, e in zip(number.tolist(), df.tolist(), ends.tolist(), strict=True)}
        return Block(start, docs, impact, top, place, len(lengths))


@dataclass
class Best:
    """The k best so far: scores, and ids as they rank among equal scores."""
    k: int
    rows: list[tuple] = field(default_factory=list)

    @property
    def bar(self) -> int:
        """A document at or above it may enter: the k-th score, or 1."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: list[int], ids: list) -> None:
        self.rows += zip(scores, ids, strict=True)
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        del self.rows[self.k:]


def search_block(block: Block, asked: np.ndarray, repeats: np.ndarray, ids: list, best: Best) -> int:
    """Put the block's documents that belong there into ``best``; how many were looked up."""
    lists = [(*block.start[t], c) for t, c in zip(asked.tolist(), repeats.tolist(), strict=True) if t in block.start]
    marked = [np.zeros(end - begin, bool) for begin, end, _ in lists]
    run = [0] * len(lists)  # best positions
    seen = np.zeros(block.size, bool)
    read, step = 0, FIRST_STEP
    while True:
        reach = sum(c * int(block.impact[block.top[begin + at]])
                    for (begin, end, c), at in zip(lists, run, strict=True) if begin + at < end)
        if reach < best.bar:
            return int(seen.sum())
        met = [block.docs[block.top[begin + read:min(begin + read + step, end)]] for begin, end, _ in lists if begin + read < end]
        new = np.unique(np.concatenate(met))
        new = new[~seen[new]]
        seen[new] = True
        scores = np.zeros(len(new), np.int64)
        for (begin, end, c), mark in zip(lists, marked, strict=True):
            own = block.docs[begin:end]
            at = np.searchsorted(own, new)
            at[at == len(own)] = 0
            held = own[at] == new
            at = at[held]
            scores[held] += c * block.impact[begin + at]
            mark[block.place[begin + at]] = True
        read, step = read + step, 2 * step
        for i, mark in enumerate(marked):
            if run[i] < len(mark):
                open_at = int(np.argmin(mark[run[i]:]))
                run[i] = len(mark) if mark[run[i] + open_at] else run[i] + open_at
        good = np.flatnonzero(scores >= best.bar)
        if len(good) > best.k:  # all equal to the k-th stay, ids decide
            least = np.partition(scores[good], -best.k)[-best.k]
            good = good[scores[good] >= least]
        if len(good):
            best.add(scores[good].tolist(), [ids[d] for d in new[good].tolist()])


def _search(index: DataFrame, sent, item_type, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best of each task, for each query by its number."""
    def run(batches):
        queries, kind = sent.value, None
        best = [Best(k) for _ in queries.asked]
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block.of(row, weights, n_docs, n_terms)
                for (numbers, repeats), found in zip(queries.asked, best, strict=True):
                    search_block(block, numbers, repeats, row["ids"], found)
        rows = [(i, queries.ids[i], score, doc) for i, found in enumerate(best) for score, doc in found.rows]
        if rows:
            number, item, score, doc = map(list, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array(item, to_arrow_type(item_type)), pa.array(score, pa.int64()),
                 pa.array(doc, kind)], ["query", "item_id", "score", "doc_id"])

    id_type = index.schema["ids"].dataType.elementType
    return index.mapInArrow(
        run, f"query long, item_id {item_type.simpleString()}, score long, doc_id {id_type.simpleString()}")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` its ``k`` best documents, scores above 0 only.

    Equal scores go by ascending id, null ids last; rows that repeat an id rank one by one.  A null or empty
    text has no terms: as a document it counts for nothing and is never found, as an item it finds
    nothing.  Repeated items are answered each for itself.  Without documents or items there are no
    rows.  Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    spark, out, item_type = docs.sparkSession, None, items.schema["item_id"].dataType
    for queries in _query_blocks(items):
        sent = spark.sparkContext.broadcast(queries)
        index = written(_index(docs, sent))
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df")).collect()
        weights = np.zeros(len(queries.vocabulary), np.int64)
        for number, n in df:  # no more than the terms of this block of queries
            weights[number] = weight(n_docs, n)
        found = _search(index, sent, item_type, weights, n_docs or 0, n_terms or 0, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "item_id", "rank", "doc_id", "score"))
        sent.unpersist()
        out = ranked if out is None else out.union(ranked)
    if out is None:
        out = spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, "
                                        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return out
