"""TF-IDF retrieval: for each query text the best notes by cosine.

Texts become term counts on the map side, and only those are exchanged.  There is one plan for
every size: plain equi joins on the term, which Spark broadcasts or splits by what it measures.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from .joins import lookup, parted, partitions

SENT_POSTINGS = 50_000
"""Postings that are sent to the queries: some MB.  More of them meet the terms by exchange."""


def terms(docs: DataFrame, key: str, body: str = "text") -> DataFrame:
    """``key, term, n``: how often each term occurs in each text."""
    words = docs.select(key, F.explode(text.tokens(F.col(body))).alias("term"))
    return words.withColumn("term", F.lower("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def term_frequency(docs: DataFrame, key: str, body: str = "text") -> DataFrame:
    """Counts divided by the length of the text.

    The length comes from the text itself, so that no window gathers a document's terms.
    """
    words = text.evaluated(docs, [key], words=text.tokens(F.col(body)))
    words = words.select(
        key, F.explode("words").alias("term"), F.size("words").alias("len")
    ).withColumn("term", F.lower("term"))
    return words.groupBy(key, "term", "len").agg(F.count("*").alias("n")).select(
        key, "term", "n", (F.col("n") / F.col("len")).alias("tf"))


def document_frequency(counted: DataFrame) -> DataFrame:
    """In how many texts each term occurs, from the rows of :func:`terms`."""
    return counted.groupBy("term").agg(F.count("*").alias("df"))


def idf(df, n):
    return F.log((n + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def postings(notes: DataFrame) -> DataFrame:
    """``term, note_ord, w, idf`` with unit note vectors.  A note is found by its text and topic."""
    n = notes.agg(F.count(F.lit(1))).scalar()
    body = F.concat_ws(" ", "text", "topic")
    counted = terms(notes.select("note_ord", body.alias("text")), "note_ord")
    df = document_frequency(counted)
    weighed = counted.join(df, "term").select(
        "note_ord", "term", idf(F.col("df"), n).alias("idf"),
        (F.col("n") * idf(F.col("df"), n)).alias("w"))
    norms = weighed.groupBy("note_ord").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "note_ord").select(
        "term", "note_ord", (F.col("w") / F.col("norm")).alias("w"), "idf")


def best_notes(queries: DataFrame, key: str, notes: DataFrame,
               k: int = fixed.RETRIEVED_NOTES) -> DataFrame:
    """``key, note_ord, score, rank`` for the ``k`` best notes with a score above 0.

    ``queries`` has ``key`` and ``text``; ``notes`` has ``note_ord, topic, text``.  Scores are
    rounded before ranking, and the later note wins a tie.  Terms and postings meet in one equi
    join; its rows are the pairs of a query and a note that share a word, once for each word.
    Large tables of queries are exchanged once, as texts by their key: terms, norms, sums and ranks of a
    query are then counted where it lies, unless the postings are too large to be sent there.
    """
    found, n = postings(notes), partitions(queries)
    if n is not None and found.count() <= SENT_POSTINGS:
        found = F.broadcast(found)
    unknown = idf(F.lit(0), notes.agg(F.count(F.lit(1))).scalar())
    asked = terms(parted(queries.select(key, "text"), n, key), key)
    known = found.select("term", "idf").distinct()
    weighed = asked.join(known, "term", "left").withColumn("wq", F.col("n") * F.coalesce("idf", unknown))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("norm"))
    sums = weighed.where(F.col("idf").isNotNull()).select(key, "term", "wq").join(
        found.select("term", "note_ord", "w"), "term").groupBy(key, "note_ord").agg(
        F.sum(F.col("wq") * F.col("w")).alias("part"))
    scored = sums.join(norms, key).withColumn(
        "score", F.round(F.col("part") / F.col("norm"), 9)).where(F.col("score") > 0)
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("note_ord"))
    return scored.withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= k).select(key, "note_ord", "score", "rank")


def retrieved(queries: DataFrame, key: str, notes: DataFrame,
              k: int = fixed.RETRIEVED_NOTES) -> DataFrame:
    """``key, kb_refs, reference_text``: topics and texts of the best notes, best first."""
    best = lookup(best_notes(queries, key, notes, k), notes, ["note_ord"], [key], "inner")
    rows = F.sort_array(F.collect_list(F.struct("rank", "topic", "text")))
    return best.groupBy(key).agg(rows.alias("rows")).select(
        key,
        F.transform("rows", lambda r: r["topic"]).alias("kb_refs"),
        F.array_join(F.transform(
            "rows", lambda r: F.concat(F.lit("- "), r["topic"], F.lit(": "), r["text"])), "\n",
        ).alias("reference_text"))
