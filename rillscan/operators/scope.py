"""Which loops, monitors and coroutines enclose a line.

Scopes are restated as brackets and found with running sums, no loop over lines:

* a brace opens or closes a scope; an indented header opens one, and the first code line
  that is not deeper closes it;
* brackets of one file and one nesting level alternate, so a closing bracket belongs to the
  bracket just before it on its level (``lag``);
* the depth of a line is the sum of the marked brackets before it.

Rows come in already reduced to the lines that matter and are exchanged once, by file.
All windows start with the file key and reuse that exchange.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from .joins import parted, partitions
from .lines import file_key

BRACES = "braces"
INDENT = "indent"

# Rulesets that need scopes, and the kind of bracket their language has.
SCOPE_KIND = {"java": BRACES, "csharp": BRACES, "c": BRACES, "node": BRACES, "python": INDENT}


def brace_loop_header(s: Column) -> Column:
    return text.matches(s, fixed.BRACE_LOOP_PATTERN)


def sync_header(s: Column) -> Column:
    spaced = F.concat(F.lit(" "), s)
    return s.startswith(fixed.SYNC_PREFIX) | spaced.contains(fixed.SYNC_CALL)


def indent_loop_header(s: Column) -> Column:
    return text.starts(s, *fixed.INDENT_LOOP_PREFIXES)


def line_facts(kind: Column, raw: Column, s: Column) -> list[Column]:
    """Columns the scope windows read, from one line of text.  Runs before the exchange."""
    code = (kind == INDENT) & (s != "") & ~s.startswith("#")
    return [
        F.when((kind == BRACES) & text.has(raw, "{", "}"), F.regexp_replace(raw, "[^{}]", ""))
        .otherwise("").alias("marks"),
        F.when(code, text.indent_width(raw)).alias("indent"),
        F.when(kind == BRACES, brace_loop_header(s))
        .when(code, indent_loop_header(s)).otherwise(False).alias("loop_header"),
        F.when(kind == BRACES, sync_header(s)).otherwise(False).alias("sync_header"),
        F.when(code, s.startswith(fixed.ASYNC_PREFIX)).otherwise(False).alias("async_header"),
    ]


SCOPE_FACTS = ("marks", "indent", "loop_header", "sync_header", "async_header")


def matters(rows_kept: Column) -> Column:
    """Lines the windows need: the wanted ones and all that can open or close a scope."""
    return (rows_kept | (F.col("marks") != "") | F.col("indent").isNotNull()
            | F.col("loop_header") | F.col("sync_header"))


def add_scopes(lines: DataFrame, *payload: str, n: int | None = None, placed: bool = False,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ``loop_depth``, ``in_sync`` and ``in_async`` to the lines.

    ``lines`` has the file key, ``line``, the columns of :func:`line_facts` and the payload
    columns.  The result has one row for each input row.  ``n`` is the number of partitions that
    :func:`joins.partitions` gives for the files; ``placed`` says that they have been exchanged
    already.  ``keep`` tells files of one name apart.
    """
    # The one exchange.  It carries one row per line; brackets are unfolded behind it.
    # Sorting starts with a number made from the key: most comparisons end there, while names
    # share their first letters.  The names stay in the key, so equal numbers do no harm.
    key = [*file_key(lines), *keep]
    keys = ("file_hash", *key)
    files = lines if placed else lines.repartition(*key) if n is None else parted(lines, n, *key)
    files = files.withColumn("file_hash", F.xxhash64(*key))
    events = files.select(
        *keys, "line", *SCOPE_FACTS, *payload,
        F.posexplode(
            F.when(F.col("marks") == "", F.array(F.lit(" ")))
            .otherwise(F.split(F.concat(F.lit(" "), "marks"), ""))).alias("col", "mark"),
    )
    # col 0 is the line itself, the brackets follow; what only the line needs stays with it.
    on_line = F.col("col") == 0
    events = events.where(on_line | F.col("mark").isin("{", "}")).select(
        *keys, "line", "col", "mark",
        *[F.when(on_line, F.col(c)).alias(c) for c in SCOPE_FACTS[1:] + payload],
    )

    by_place = Window.partitionBy(*keys).orderBy("line", "col")
    upto = by_place.rowsBetween(Window.unboundedPreceding, 0)
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("mark") == "{", 1).when(F.col("mark") == "}", -1).otherwise(0)

    def latest(condition, window):
        return F.coalesce(F.max(F.when(condition, F.col("line"))).over(window), F.lit(0))

    height = F.sum(step).over(upto)
    opened = latest(F.col("mark") == "{", before)
    # All of these read one sorted pass; the lowest height so far needs a second look at it.
    events = events.withColumns({
        "height": height,
        # a header marks the next opening brace, on whatever line that comes
        "loop_waits": latest(F.col("loop_header"), upto) > opened,
        "sync_waits": latest(F.col("sync_header"), upto) > opened,
        "indent_before": F.last("indent", ignorenulls=True).over(before),
    }).withColumn(
        "floor", F.least(F.lit(0), F.coalesce(F.min("height").over(before), F.lit(0)))
    ).withColumns({
        "depth": F.col("height") - F.least("floor", "height"),
        "depth_before": F.col("height") - step - F.col("floor"),
    })

    # An indented line stands between the levels it closes and the one it opens: slots 3n and
    # 3n + 2 for level n, and no number for the row itself.  A code line closes the levels
    # from its own indent to that of the code line before it: deeper ones are closed already.
    # So there are never more slots than blanks in the text.
    is_header = F.col("loop_header") | F.col("async_header")
    closing = F.when(
        F.col("indent_before") >= F.col("indent"),
        F.sequence(F.col("indent").cast("long") * 3, F.col("indent_before").cast("long") * 3,
                   F.lit(3).cast("long")))
    itself = F.array(F.lit(None).cast("long"))
    none = F.array().cast("array<bigint>")
    slots = F.when(F.col("indent").isNotNull(), F.concat(
        F.coalesce(closing, none), itself,
        F.when(is_header, F.array(F.col("indent").cast("long") * 3 + 2)).otherwise(none),
    )).otherwise(itself)
    events = events.select("*", F.explode(slots).alias("slot"))

    in_text = F.col("slot").isNull()
    header = F.coalesce(F.col("slot") % 3 == 2, F.lit(False))
    brace = in_text & (F.col("mark") == "{")
    events = events.select(
        *keys, "line", "col", *payload,
        F.coalesce(F.col("slot") % 3, F.lit(1)).cast("int").alias("turn"),
        F.when(~in_text, F.expr("slot div 3"))
        .when(F.col("mark") == "{", F.col("depth"))
        .when((F.col("mark") == "}") & (F.col("depth_before") > 0), F.col("depth_before"))
        .alias("level"),
        (header | brace).alias("opens"),
        ((header & F.col("loop_header")) | (brace & F.col("loop_waits"))).alias("loop"),
        (brace & F.col("sync_waits")).alias("sync"),
        (header & F.col("async_header")).alias("async"),
    )

    by_level = Window.partitionBy(*keys, "level").orderBy("line", "col", "turn")
    has_level = F.col("level").isNotNull()

    def of_partner(column):
        return F.when(has_level & ~F.col("opens"), F.lag(column).over(by_level))

    events = events.select(
        "*",
        of_partner("opens").alias("matched"),
        of_partner("loop").alias("partner_loop"),
        of_partner("sync").alias("partner_sync"),
        of_partner("async").alias("partner_async"),
        of_partner("line").alias("partner_line"),
    )

    in_order = (Window.partitionBy(*keys).orderBy("line", "col", "turn")
                .rowsBetween(Window.unboundedPreceding, 0))

    def open_now(own, partner):
        entered = F.when(F.col("opens") & F.col(own), 1).otherwise(0)
        left = F.when(F.col("matched") & F.col(partner), 1).otherwise(0)
        return F.sum(entered - left).over(in_order)

    # Only the latest coroutine header counts: is it still open?
    entered = F.max(F.when(F.col("opens") & F.col("async"), F.col("line"))).over(in_order)
    left = F.max(
        F.when(F.col("matched") & F.col("partner_async"), F.col("partner_line"))).over(in_order)
    events = events.select(
        *keys, "line", "col", "turn", "level", *payload,
        open_now("loop", "partner_loop").cast("int").alias("loop_depth"),
        (open_now("sync", "partner_sync") > 0).alias("in_sync"),
        F.coalesce(entered > F.coalesce(left, F.lit(0)), F.lit(False)).alias("in_async"),
    )
    is_line = (F.col("col") == 0) & (F.col("turn") == 1)
    return events.where(is_line).select(
        *key, "line", *payload, "loop_depth", "in_sync", "in_async")


def annotate(lines: DataFrame, kind: str) -> DataFrame:
    """All lines (file key, ``line, raw``) of languages of one kind, with their scopes."""
    s = text.strip(F.col("raw"))
    facts = lines.select(*file_key(lines), "line", "raw", *line_facts(F.lit(kind), F.col("raw"), s))
    return add_scopes(facts, "raw", n=partitions(lines))
