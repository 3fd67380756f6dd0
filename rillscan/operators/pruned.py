"""The best notes without meeting all of them: TF-IDF retrieval with score bounds.

Postings lie in blocks by weight, and the greatest weight of each block is known.  A query is answered in
three steps, all of them joins on keys:

1. *A bar.*  The heaviest notes of each of its words are scored in full.  The k-th of those scores is a bar that
   no note of the answer falls below.
2. *What can reach it.*  The bounds of a query's words are summed from the smallest up.  Words whose sum
   stays below the bar cannot carry a note by themselves, and their postings are not read, however
   frequent they are.  Of the other words, blocks are skipped that stay below it even if all other words
   gave their most.
3. *The answer.*  Notes met in the blocks that are left are scored in full.

Nothing that belongs to the answer is lost: bounds hold for every note, and what could tie is kept.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..sources.shared import staged
from . import retrieval
from .joins import parted, partitions

BLOCKS_PER_HALVING = 4
CLOSE = 1e-8
"""Wider than the rounding of scores."""


@dataclass(frozen=True)
class NoteIndex:
    """``postings``: ``term, block, note_ord, w, idf``, best written to a table and read from it."""
    postings: DataFrame
    notes: int
    small: int | None = None
    """Where the index is sent to the queries: the number of their partitions."""

    def before(self, queries: DataFrame) -> "NoteIndex":
        """The index as it meets these queries: sent to them if they are many and it is small."""
        n = partitions(queries)
        few = n is not None and self.postings.count() <= retrieval.SENT_POSTINGS
        return NoteIndex(self.postings, self.notes, n if few else None)

    def apart(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows of many queries as a step of their own, so that one task does not hold the tables of all steps."""
        return rows if self.small is None else parted(staged(rows), self.small, key)

    def sent(self, rows: DataFrame) -> DataFrame:
        """Rows made from the postings, no more than there are of these."""
        return rows if self.small is None else F.broadcast(rows)

    @staticmethod
    def of(notes: DataFrame) -> "NoteIndex":
        found = retrieval.postings(notes)
        block = F.floor(-BLOCKS_PER_HALVING * F.log2("w")).cast("int")
        return NoteIndex(found.withColumn("block", block), notes.count())

    def stored(self, path: str) -> "NoteIndex":
        self.postings.repartition("term").sortWithinPartitions("term", "block").write.parquet(path)
        return NoteIndex(self.postings.sparkSession.read.parquet(path), self.notes)


def _asked(queries: DataFrame, key: str, index: NoteIndex) -> DataFrame:
    """``key, term, part, most``: the share of a known word in its query's unit vector, and the most it can add."""
    words = index.postings.groupBy("term").agg(F.max("w").alias("greatest"), F.max("idf").alias("idf"))
    unknown = retrieval.idf(F.lit(0), index.notes)
    asked = parted(queries.select(key, "text"), partitions(queries), key)
    weighed = retrieval.terms(asked, key).join(index.sent(words), "term", "left").withColumn(
        "wq", F.col("n") * F.coalesce("idf", unknown))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("norm"))
    return weighed.where(F.col("idf").isNotNull()).join(norms, key).select(
        key, "term", (F.col("wq") / F.col("norm")).alias("part"),
        (F.col("wq") / F.col("norm") * F.col("greatest")).alias("most"))


def _scores(pairs: DataFrame, asked: DataFrame, key: str, index: NoteIndex) -> DataFrame:
    """Whole scores of the pairs of a query and a note."""
    of_notes = index.postings.select("note_ord", "term", "w")
    if index.small is not None:
        # the words of a query, no more than its text has, go to its pairs as a list: no row of a pair is exchanged
        listed = asked.groupBy(key).agg(F.collect_list("term").alias("terms"), F.collect_list("part").alias("parts"))
        at = F.array_position("terms", F.col("term"))
        return pairs.join(listed, key).join(index.sent(of_notes), "note_ord").where(at > 0).groupBy(key, "note_ord").agg(
            F.sum(F.get("parts", (at - 1).cast("int")) * F.col("w")).alias("score"))
    return pairs.join(index.sent(of_notes), "note_ord").join(asked.select(key, "term", "part"), [key, "term"]).groupBy(
        key, "note_ord").agg(F.sum(F.col("part") * F.col("w")).alias("score"))


def _heaviest(asked: DataFrame, key: str, index: NoteIndex, k: int) -> DataFrame:
    """For each query the k heaviest notes of each of its words."""
    top = Window.partitionBy("term").orderBy(F.desc("w"), F.desc("note_ord"))
    best = index.postings.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k)
    return asked.select(key, "term").join(index.sent(best.select("term", "note_ord")), "term").select(key, "note_ord").distinct()


def _reachable(asked: DataFrame, scored: DataFrame, key: str, index: NoteIndex, k: int) -> DataFrame:
    """``key, term, block`` of the blocks that may hold a note of the answer."""
    order = Window.partitionBy(key).orderBy(F.desc("score"))
    bars = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy(key).agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(0.0)).alias("bar"))
    words = Window.partitionBy(key).orderBy("most", "term")
    bounds = asked.select(
        "*", F.sum("most").over(words.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("most").over(Window.partitionBy(key)).alias("all")).join(bars, key).where(F.col("upto") >= F.col("bar") - CLOSE)
    blocks = index.postings.groupBy("term", "block").agg(F.max("w").alias("greatest"))
    return bounds.join(index.sent(blocks), "term").where(
        F.col("part") * F.col("greatest") + F.col("all") - F.col("most") >= F.col("bar") - CLOSE).select(key, "term", "block")


def met(queries: DataFrame, key: str, index: NoteIndex, k: int = fixed.RETRIEVED_NOTES) -> DataFrame:
    """The postings that are read for each query after the bar is known: ``key, term, note_ord``."""
    index = index.before(queries)
    asked = _asked(queries, key, index)
    scored = index.apart(_scores(_heaviest(asked, key, index, k), asked, key, index), key)
    return _reachable(asked, scored, key, index, k).join(
        index.sent(index.postings.select("term", "block", "note_ord")), ["term", "block"]).select(key, "term", "note_ord")


def best_notes(queries: DataFrame, key: str, index: NoteIndex, k: int = fixed.RETRIEVED_NOTES) -> DataFrame:
    """The rows of :func:`retrieval.best_notes`: ``key, note_ord, score, rank``, the later note first on a tie."""
    index = index.before(queries)
    asked = _asked(queries, key, index)
    pairs = index.apart(met(queries, key, index, k).select(key, "note_ord").distinct(), key)
    scored = _scores(pairs, asked, key, index).withColumn("score", F.round("score", 9)).where(F.col("score") > 0)
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("note_ord"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        key, "note_ord", "score", "rank")
