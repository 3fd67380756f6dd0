"""Packing of paragraphs into chunks, inside one row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from . import text

LIST_CHUNKS = 1024
BLANK_LINE = rf"{text.UNICODE}\n[\s\x1c-\x1f]*\n"
"""Between paragraphs: a line that holds blanks of any kind, or nothing."""


def pack(body: Column, separator: str = BLANK_LINE) -> Column:
    """Array of chunks.  Paragraphs are joined until the next one would pass the limit.

    The joint counts as a character, also before the first paragraph of the first chunk.
    """
    paragraphs = F.filter(
        F.transform(F.split(body, separator, -1), text.strip),
        lambda p: F.length(p) > fixed.CHUNK_MIN_PARAGRAPH)

    # Finished chunks gather in short lists and these in a list of lists: adding to a list
    # copies it, so one long list would cost the square of its length.
    texts, lists = "array<string>", "array<array<string>>"
    start = F.struct(
        F.array().cast(lists).alias("full"), F.array().cast(texts).alias("last"),
        F.lit("").alias("open"))

    def finished(state):
        return F.concat(state["last"], F.array(text.strip(state["open"])))

    def add(state, p):
        over = F.length(state["open"]) + F.length(p) > fixed.CHUNK_MAX_CHARS
        ends = over & (state["open"] != "")
        turns = ends & (F.size(state["last"]) >= LIST_CHUNKS - 1)
        return F.struct(
            F.when(turns, F.concat(state["full"], F.array(finished(state))))
            .otherwise(state["full"]).alias("full"),
            F.when(turns, F.array().cast(texts)).when(ends, finished(state))
            .otherwise(state["last"]).alias("last"),
            F.when(over, p).otherwise(F.concat_ws("\n", state["open"], p)).alias("open"))

    def close(state):
        last = F.when(text.strip(state["open"]) != "", finished(state)).otherwise(state["last"])
        return F.flatten(F.concat(state["full"], F.array(last)))

    return F.aggregate(paragraphs, start, add, close)
