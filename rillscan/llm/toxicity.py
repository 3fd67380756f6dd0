"""Toxicity scores: bags of subword vectors averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (UTF-8 bytes between word ends, hashed
to rows of one table), a text the mean of its words, and a softmax of two classes follows.
Vectors and softmax are trained jointly in numpy, on a bounded sample of labelled rows
(``TrainingSample``), so a misspelling that was never seen shares most of its n-grams with the
word it disguises.  Scoring is one pass over all rows, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .shared import pieces, texts

NGRAMS = range(3, 8)
ROW_BITS = 18
ROWS = 1 << ROW_BITS
WIDTH = 4
SLICE = 1 << 19
SNIPPETS = 6
"""Short parts of each clean text that are examples of their own."""
BALANCE = 0.75
"""Power of the classes' ratio by which the rarer one weighs more."""
BLANK = 32
LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else BLANK for c in range(256))


@dataclass(frozen=True)
class TrainingSample:
    """At most ``per_class`` rows of each label, those with the least hash of their id, whole."""
    per_class: int = 3000


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # ROWS x WIDTH
    weights: np.ndarray  # WIDTH x 2
    bias: np.ndarray  # 2

    def of_grams(self) -> np.ndarray:
        """Each n-gram's part of the difference of the two logits."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])


def _plain(text: str) -> bytes:
    """Lower case, everything but letters and digits blank."""
    return text.lower().encode("utf-8", "replace").translate(LETTERS)


def _grams(data: bytes) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Start of each word, and for each n the word and the row of every n-gram.

    An n-gram lies in a word and may take in the blank before or after it."""
    a = np.frombuffer(data, np.uint8)
    blank = a == BLANK
    begins = blank[:-1] & ~blank[1:]
    word = np.cumsum(begins, dtype=np.int32) - 1
    ends = np.cumsum(blank, dtype=np.int32)

    def each():
        h = a.astype(np.uint32)
        for n in range(2, NGRAMS.stop):
            h = h[:-1] * np.uint32(0x01000193) + a[n - 1:]
            if n in NGRAMS and len(h):
                inside = np.flatnonzero(ends[n - 2:len(h) + n - 2] == ends[:len(h)])
                inside = inside[~blank[inside + 1]]
                yield word[inside], (h[inside] * np.uint32(2654435761)) >> np.uint32(32 - ROW_BITS)

    return np.flatnonzero(begins), each()


def _slices(data: bytes) -> Iterator[bytes]:
    """A long text in slices that end at a blank where there is one."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data) and (cut := data.rfind(b" ", at, end)) > at:
            end = cut
        yield data[at:end]
        at = end


def _bag(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table and their weights in the text's mean, slice by slice."""
    rows, weights, n_words = np.zeros(0, np.int32), np.zeros(0), 0
    for part in _slices(data):
        starts, each = _grams(b" " + part + b" ")
        found = list(each)
        if not found or not len(starts):
            continue
        word = np.concatenate([w for w, _ in found])
        ids = np.concatenate([r for _, r in found])
        share = 1 / np.bincount(word, minlength=len(starts))[word]
        n_words += len(starts)
        rows, at = np.unique(np.concatenate([rows, ids.astype(np.int32)]), return_inverse=True)
        weights = np.bincount(at, np.concatenate([weights, share]))
    return rows, (weights / max(n_words, 1)).astype(np.float32)


def train(labelled: Iterable[tuple[str, int]], epochs: int = 12, least_steps: int = 2000,
          batch: int = 64, rate: float = 3.0, seed: int = 7) -> Model:
    """Vectors and softmax, by minibatches with per-coordinate steps (Adagrad).

    A text without toxicity has none in any part, so some short parts of it are examples too:
    they keep a few unusual words from deciding a short text.
    """
    rng = np.random.default_rng(seed)
    bags = []
    for text, y in labelled:
        data = _plain(text)
        bags.append((*_bag(data), int(y)))
        if not y:
            said = data.split()
            for _ in range(min(SNIPPETS, len(said))):
                at, n = rng.integers(len(said)), rng.integers(1, 13)
                bags.append((*_bag(b" ".join(said[at:at + n])), 0))
    vectors = rng.normal(0, 0.02, (ROWS, WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if not bags:
        return Model(vectors, weights, bias)
    rng.shuffle(bags)
    toxic = sum(b[2] for b in bags)
    weight = np.array([1.0, min(50.0, max(1.0, (len(bags) - toxic) / max(toxic, 1)) ** BALANCE)], np.float32)
    batches = []
    while bags:  # a bag is let go as its batch is made
        part = [bags.pop() for _ in range(min(batch, len(bags)))]
        ids = np.concatenate([b[0] for b in part])
        doc = np.repeat(np.arange(len(part)), [len(b[0]) for b in part])
        share = np.concatenate([b[1] for b in part])
        order = np.argsort(ids, kind="stable").astype(np.int32)
        starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        batches.append((ids[order][starts], ids, doc.astype(np.int32), share, order, starts, np.array([b[2] for b in part])))
    epochs = max(epochs, -(-least_steps // len(batches)))
    sums = [np.full(x.shape, 1e-6, np.float32) for x in (vectors, weights, bias)]

    def step(target, total, at, gradient, size):
        total[at] += gradient * gradient
        target[at] -= size * gradient / np.sqrt(total[at])

    for epoch in range(epochs):
        size = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(batches)):
            rows, ids, doc, share, order, starts, y = batches[k]
            n = len(y)
            mean = np.zeros((n, WIDTH), np.float32)
            held = vectors[ids] * share[:, None]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            if len(first):
                mean[doc[first]] = np.add.reduceat(held, first, axis=0)
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y] -= 1
            p *= (weight[y] / n)[:, None]
            if len(order):
                back = (p @ weights.T)[doc] * share[:, None]
                step(vectors, sums[0], rows, np.add.reduceat(back[order], starts, axis=0), size)
            step(weights, sums[1], slice(None), mean.T @ p, size)
            step(bias, sums[2], slice(None), p.sum(0), size)
    return Model(vectors, weights, bias)


def score(texts_: list[str], of_grams: np.ndarray, bias: float) -> np.ndarray:
    """Scores of whole texts: the mean of their words' means, slice by slice."""
    total, count = np.zeros(len(texts_)), np.zeros(len(texts_))
    held, owner, size = [], [], 0

    def flush():
        offsets = np.cumsum([0, *(len(x) + 1 for x in held)])
        starts, each = _grams(b" " + b" ".join(held) + b" ")
        if len(starts):
            parts, grams = np.zeros(len(starts)), np.zeros(len(starts))
            for word, row in each:
                parts += np.bincount(word, of_grams[row], len(starts))
                grams += np.bincount(word, minlength=len(starts))
            doc = np.asarray(owner)[np.searchsorted(offsets, starts, "right") - 1]
            np.add.at(total, doc, parts / np.maximum(grams, 1))
            np.add.at(count, doc, 1)

    for i, text in enumerate(texts_):
        for part in _slices(_plain(text)):
            held.append(part)
            owner.append(i)
            size += len(part)
            if size >= SLICE:
                flush()
                held, owner, size = [], [], 0
    if held:
        flush()
    logit = bias + total / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: TrainingSample = TrainingSample(),
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows for which ``usable`` (of the labels' id) holds.

    At most ``2 x per_class`` labels are picked, by hash of their id, and only their texts are read
    into one training task; the model is what comes back to the driver.  Rows with a null id or
    label are not used.  Without labelled rows the model knows nothing and scores 0.5.
    """
    picked = None
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)").filter(usable).distinct()
    for value in (0, 1):
        part = own.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample.per_class)
        picked = part if picked is None else picked.union(part)
    chosen = texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")

    def run(batches):
        rows = [(i, t, y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort()
        model = train((t, y) for _, t, y in rows)
        yield pa.RecordBatch.from_pydict({k: [getattr(model, k).astype(np.float32).tobytes()] for k in ("vectors", "weights", "bias")})

    got = chosen.repartition(1).mapInArrow(run, "vectors binary, weights binary, bias binary").first()
    if got is None:  # no labelled row
        return train([])
    raw = [np.frombuffer(x, np.float32) for x in got]
    return Model(raw[0].reshape(ROWS, WIDTH), raw[1].reshape(WIDTH, 2), raw[2])


def score_column(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a text column, from the text alone; null and empty texts score by the bias."""
    sent = spark.sparkContext.broadcast((model.of_grams(), float(model.bias[1] - model.bias[0])))  # 1 MB

    @arrow_udf("double")
    def find(t: pa.Array) -> pa.Array:
        parts = pieces(pa.RecordBatch.from_arrays([t], ["text"]), "text")
        found = [score(p.column("text").to_pylist(), *sent.value) for p in parts]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return find(F.coalesce(text, F.lit("")))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row.

    Repeated rows give repeated results; an empty table gives no rows; other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    return rows.select("doc_id", score_column(F.col("text"), model, docs.sparkSession).alias("score"))
