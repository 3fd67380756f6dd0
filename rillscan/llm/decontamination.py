"""Benchmark decontamination by rare n-gram seeds and local alignment.

All runs of ``SEED`` words of a test item are seeds, and the rarer half of its pairs of words: one reading of the
documents counts how often each pair occurs.  A second one meets the seeds in the documents and
aligns the words around them with the item by Smith-Waterman, so edited and paraphrased copies score as
well.  A stretch that shares too few words with the item to reach the least score in any order is not
aligned, which no result depends on.  A passage without any seed is not found: at half of the best score
that takes an edit after every other word.

Test items are sent to the tasks in blocks of at most ``BLOCK`` bytes; documents are never
exchanged, and what a document yields depends on its own text and those counts alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .shared import pieces, texts
from .toxicity import LETTERS

SEED, PAIR = 3, 2
RARE = 0.5
"""Share of an item's pairs of words that are seeds: the rarest of those that occur."""
SHORT = 4
"""Items of fewer words are leaked only as they stand."""
MATCH, MISMATCH, GAP = 2, -1, -1
SHARE, LONG = 0.5, 20
"""A leak aligns with at least SHARE of the best score of its item, or that of LONG equal words."""
BLOCK = 32 << 20
LEAKS = "array<struct<item_id:bigint,score:int,share:double,first_word:int,last_word:int>>"


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split()


@dataclass
class Seeds:
    """A block of test items: word numbers, and the sorted keys of their seeds by seed length."""
    ids: list[int]
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]
    lengths: list[int]
    keys: dict[int, np.ndarray]  # sorted, distinct
    places: dict[int, list[list[tuple[int, int]]]]  # of each key: (item, offset)

    @staticmethod
    def of(items: list[tuple[int, str]], n: int = SEED) -> Seeds:
        """Seeds of ``n`` words."""
        vocabulary: dict[bytes, int] = {}
        numbered = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], dtype=np.int64) for _, t in items]
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, item in enumerate(numbered):
            size = min(n, len(item))  # an item shorter than a seed is one itself
            if size:
                for at, key in enumerate(_keys(item, size, len(vocabulary)).tolist()):
                    found.setdefault(size, {}).setdefault(key, []).append((i, at))
        keys = {n: np.array(sorted(x), dtype=np.uint64) for n, x in found.items()}
        places = {n: [found[n][k] for k in sorted(found[n])] for n in found}
        return Seeds([i for i, _ in items], numbered, vocabulary, sorted(found), keys, places)

    def with_rare_pairs(self, pairs: Seeds, counts: dict[int, int]) -> Seeds:
        """These seeds and of each item the rarest of ``pairs``; ``counts`` by their place among the keys."""
        if PAIR not in pairs.keys:
            return self
        of_item: dict[int, list[tuple[int, int]]] = {}
        for k, places in enumerate(pairs.places[PAIR]):
            for i in {i for i, _ in places}:
                if counts.get(k):
                    of_item.setdefault(i, []).append((counts[k], k))
        # a pair that occurs nowhere finds nothing: it does not take the place of one that does
        kept = {i: {k for _, k in sorted(own)[:math.ceil(RARE * len(own))]} for i, own in of_item.items()
                if len(self.items[i]) >= SHORT}
        places = [[p for p in places if k in kept.get(p[0], ())] for k, places in enumerate(pairs.places[PAIR])]
        good = [k for k, own in enumerate(places) if own]
        own_keys = dict(zip(pairs.keys[PAIR][good].tolist(), [places[k] for k in good], strict=True))
        for key, at in zip(self.keys[PAIR].tolist(), self.places[PAIR], strict=True) if PAIR in self.keys else ():
            own_keys.setdefault(key, []).extend(at)  # items of two words
        if not own_keys:
            return self
        keys = {**self.keys, PAIR: np.array(sorted(own_keys), dtype=np.uint64)}
        return Seeds(self.ids, self.items, self.vocabulary, sorted(keys), keys,
                     {**self.places, PAIR: [own_keys[k] for k in sorted(own_keys)]})

    def numbers(self, text: str) -> np.ndarray:
        """The words of a text as numbers, -1 for words of no item."""
        return np.fromiter(map(self.vocabulary.get, words(text), repeat(-1)), np.int64)

    def hits(self, text_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of seeds of n words and which seeds they are."""
        if len(text_words) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        good = text_words >= 0
        all_good = np.logical_and.reduce([good[k:len(good) - n + 1 + k] for k in range(n)])
        at = np.flatnonzero(all_good)
        if not len(at):
            return at, at
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key = key * np.uint64(len(self.vocabulary) + 1) + text_words[at + k].astype(np.uint64)
        own = self.keys[n]
        where = np.minimum(np.searchsorted(own, key), len(own) - 1)
        same = own[where] == key
        return at[same], where[same]


def _keys(item: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    key = np.zeros(len(item) - n + 1, np.uint64)
    for k in range(n):
        key = key * np.uint64(vocabulary + 1) + item[k:len(item) - n + 1 + k].astype(np.uint64)
    return key


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the first and last word of the window that it aligns."""
    m = len(window)
    steps = np.arange(m + 1) * -GAP
    score, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, first, last = 0, 0, -1
    for w in item:
        pair = np.where(window == w, MATCH, MISMATCH)
        diagonal, up = score[:-1] + pair, score[1:] + GAP
        now = np.zeros(m + 1, np.int64)
        now[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin = np.arange(m + 1)
        begin[1:] = np.where(now[1:] == 0, begin[1:], np.where(diagonal >= up, start[:-1], start[1:]))
        # gaps in the item: the best score to the left less a gap for each word between
        lifted = now + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(m + 1), 0))
        score, start = top - steps, np.where(lifted == top, begin, begin[source])
        k = int(score.argmax())
        if score[k] > best:
            best, first, last = int(score[k]), int(start[k]), k - 1
    return best, first, last


def least_score(size: int) -> float:
    """What an alignment with an item of so many words needs to be a leak."""
    return min(MATCH * size * (SHARE if size >= SHORT else 1), MATCH * LONG)


def _may_reach(item: np.ndarray, window: np.ndarray, score: float) -> bool:
    """Whether the words that both have are enough for the score, each matched once."""
    known = window[window >= 0]
    if MATCH * min(len(item), len(known)) < score:
        return False
    own, n = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(own, known), len(own) - 1)
    held = np.bincount(at[own[at] == known], minlength=len(own))
    return MATCH * int(np.minimum(n, held).sum()) >= score


def leaks_in(text: str, seeds: Seeds) -> list[dict]:
    """The items that a text leaks, each with its best alignment."""
    numbered = seeds.numbers(text)
    near: dict[int, list[int]] = {}
    for n in seeds.lengths:
        for at, k in zip(*(x.tolist() for x in seeds.hits(numbered, n)), strict=True):
            for i, offset in seeds.places[n][k]:
                near.setdefault(i, []).append(at - offset)
    out = []
    for i, diagonals in near.items():
        item = seeds.items[i]
        size, slack = len(item), len(item) // 2 + 1
        best = None
        diagonals.sort()
        low = high = diagonals[0]
        for d in [*diagonals[1:], None]:
            if d is not None and d - high <= 2 * slack:
                high = d
                continue
            begin = max(0, low - slack)
            window = numbered[begin:high + size + slack]
            if _may_reach(item, window, least_score(size)):
                score, first, last = align(item, window)
                if best is None or score > best[0]:
                    best = (score, begin + first, begin + last)
            if d is not None:
                low = high = d
        if best is not None and best[0] >= least_score(size):
            score, first, last = best
            share = score / (MATCH * size)
            out.append({"item_id": seeds.ids[i], "score": score, "share": share, "first_word": first, "last_word": last})
    return sorted(out, key=lambda x: x["item_id"])


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size, read one after the other."""
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(text_col).isNotNull()).distinct()
    for i, text in rows.toLocalIterator():
        if block and size + len(text) > BLOCK:
            yield sorted(block, key=lambda x: (x[0] is None, x))
            block, size = [], 0
        block.append((i, text))
        size += len(text)
    if block:
        yield sorted(block, key=lambda x: (x[0] is None, x))


def pair_counts(docs: DataFrame, text: Column, pairs: Seeds) -> dict[int, int]:
    """How often each pair of words of the items occurs in the documents, by its place among the keys."""
    sent = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [sent.value.hits(sent.value.numbers(t), PAIR)[1] for t in part.column("text").to_pylist()]
                pair, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    rows = docs.select(text.alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = {r.pair: r.n for r in rows.toLocalIterator()}  # no more than the pairs of a block of items
    sent.unpersist()
    return counts


def _leaks(text: Column, seeds: Seeds, spark) -> Column:
    sent = spark.sparkContext.broadcast(seeds)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.int32()), ("share", pa.float64()),
                               ("first_word", pa.int32()), ("last_word", pa.int32())]))

    @arrow_udf(LEAKS)
    def find(t: pa.Array) -> pa.Array:
        return pa.array([leaks_in(x.as_py(), sent.value) for x in t], kind)

    return find(text)


def with_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", name: str = "leaks") -> DataFrame:
    """Every row with an array of the test items that its text leaks, ordered by item id: score,
    share of the item's best score, first and last word of the passage (words are runs of
    letters and digits).

    A column of this name is replaced.  A null text leaks nothing, items without words or text are
    never leaked, repeated items count once, an item shorter than a seed is leaked only as it
    stands.  Without items, or rows, the arrays, or the table, are empty.
    """
    text = F.coalesce(text_col, F.lit(""))
    found = []
    for block in blocks(items):
        seeds, pairs = Seeds.of(block), Seeds.of(block, PAIR)
        if not seeds.lengths:
            continue
        if PAIR in pairs.keys:
            seeds = seeds.with_rare_pairs(pairs, pair_counts(docs, text, pairs))
        found.append(_leaks(text, seeds, docs.sparkSession))
    return docs.withColumn(name, F.array_sort(F.concat(*found)) if found else F.array().cast(LEAKS))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score, share, first_word, last_word``, a row for each row and item leaked."""
    return with_leaks(texts(docs, id_col, text_col), items).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
