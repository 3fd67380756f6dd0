"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

All of it is DataFrame operations.  A text becomes the set of its paragraph digests, and a digest
goes to one cell in each of three tables of ``width`` cells.  A cell holds a count and the
exclusive ors of the digests and of their checks.  The sketches of two versions are subtracted
cell by cell and peeled: a cell of one digest gives it away, which is taken out of its other
cells, and so on.  Where cells are left, both sketches are built again twice as wide.

Cells are rows, grouped by version pair and cell.  All groups of a pair lie in the partition of
the pair, so no round of peeling exchanges anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions
from .shared import written as staged

FOLD = 240
"""A paragraph is a line; a longer one is folded at the blanks before this many code points."""
TABLES, CHECK = 3, 7
RETRIES = 6
PER_TASK = 1 << 16
"""Digests of a task in tries after the first."""
ROUNDS = 12
"""Each round peels the cells of one table; sketches that need more are retried larger."""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """The digests of the paragraphs that are not blank; the n-th copy of one has its own digest."""
    parts = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{FOLD}}}(?=[ \n]|\z)|[^\n]{{{FOLD}}}|[^\n]+"), F.lit(0))
    hashed = F.sort_array(F.transform(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.xxhash64(p)))
    return _let(hashed, lambda all_: F.transform(
        all_, lambda d, i: F.xxhash64(d, i.cast("long") + 1 - F.array_position(all_, d))))


def width(n: Column) -> Column:
    """Cells of a table for ``n`` digests, at the first try."""
    return F.greatest(F.lit(4), F.ceil(n / 2)).cast("int")


def _cell(key: Column, table: int, w: Column) -> Column:
    return (F.lit(table) * w + F.pmod(F.xxhash64(key, F.lit(table)), w)).cast("long")


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(CHECK))


def fingerprint(keys: Column) -> Column:
    """The sketch at the first width, as text: the width, then cell:count:digests:checks of each
    cell in use.  Equal digest sets have equal fingerprints."""
    def text(w):
        # the cell and the place of the key in one long, so that a plain sort groups the cells
        coded = F.sort_array(F.flatten(F.transform(keys, lambda k, i: F.array(*[
            F.shiftleft(_cell(k, j, w), 32) + i for j in range(TABLES)]))))

        def shown(s):
            return F.when(s["n"] == 0, s["out"]).otherwise(F.concat(
                s["out"], F.lit(" "), s["cell"].cast("string"), F.lit(":"), s["n"].cast("string"), F.lit(":"),
                F.lower(F.hex(s["k"])), F.lit(":"), F.lower(F.hex(s["c"]))))

        def step(s, x):
            return _let(F.struct(F.shiftright(x, 32).alias("cell"), F.get(keys, x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("k")), lambda e: F.when(
                e["cell"] == s["cell"], F.struct(
                    s["cell"].alias("cell"), (s["n"] + 1).alias("n"), s["k"].bitwiseXOR(e["k"]).alias("k"),
                    s["c"].bitwiseXOR(_check(e["k"])).alias("c"), s["out"].alias("out"))
            ).otherwise(F.struct(
                e["cell"].alias("cell"), F.lit(1).alias("n"), e["k"].alias("k"), _check(e["k"]).alias("c"), shown(s).alias("out"))))

        start = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"),
                         F.lit(0).cast("long").alias("c"), w.cast("string").alias("out"))
        return F.aggregate(coded, start, step, shown)

    return _let(width(F.size(keys)), text)


def _summed(cells: DataFrame) -> DataFrame:
    """Entries of a cell added up; cells that hold nothing are left out.  A digest that was found
    is a row of its own (``found``, the digest in ``cell``)."""
    return (
        cells.groupBy("pair", "w", "found", "cell")
        .agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
        .filter("n <> 0 or k <> 0 or c <> 0")
    )


def _entry(found, cell, n, k, c) -> Column:
    return F.struct(F.lit(found).alias("found"), cell.alias("cell"), n.alias("n"), k.alias("k"), c.alias("c"))


def subtracted(pairs: DataFrame, times: int) -> DataFrame:
    """Cells of the sketch of ``mine`` less that of ``theirs``, ``times`` the first width wide."""
    sided = F.concat(F.transform("mine", lambda k: F.struct(F.lit(1).alias("n"), k.alias("k"))),
                     F.transform("theirs", lambda k: F.struct(F.lit(-1).alias("n"), k.alias("k"))))
    keys = pairs.select(
        "pair", (width(F.greatest(F.size("mine"), F.size("theirs"))) * times).alias("w"), F.explode(sided).alias("x"))
    n, k, w = F.col("x.n"), F.col("x.k"), F.col("w")
    return _summed(keys.select("pair", "w", F.explode(F.array(*[
        _entry(False, _cell(k, j, w), n, k, _check(k)) for j in range(TABLES)])).alias("e")).select("pair", "w", "e.*"))


def peeled(cells: DataFrame) -> DataFrame:
    """The cells after ``ROUNDS`` rounds.  A round takes up the pure cells of one table, where a
    digest has one cell only, so none is taken twice."""
    cell, n, k, c, w = (F.col(x) for x in ("cell", "n", "k", "c", "w"))
    for r in range(ROUNDS):
        table = r % TABLES
        pure = ~F.col("found") & (F.abs(n) == 1) & (F.floor(cell / w) == table) & (c == _check(k))
        taken = [_entry(False, _cell(k, j, w), -n, k, c) for j in range(TABLES) if j != table]
        cells = _summed(cells.select("pair", "w", F.explode(
            F.when(pure, F.array(*taken, _entry(True, k, n, k, c))).otherwise(
                F.array(_entry_of_row()))).alias("e")).select("pair", "w", "e.*"))
    return cells


def _entry_of_row() -> Column:
    return F.struct("found", "cell", "n", "k", "c")


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, in as many files as their size needs.

    For the rows of a try, which are short and lie in many partitions: each file costs three
    processes (``chmod``) where Hadoop's native library is missing, and a process shares all pages
    of its executor until it is another program.
    """
    return staged(df.hint("rebalance"))


def differences(pairs: DataFrame) -> DataFrame:
    """``pair, only_mine, only_theirs`` for rows ``pair, mine, theirs`` (digest arrays; the pair
    numbers differ): how many digests only one side holds, recovered from the sketches.

    Pairs that leave cells are tried again twice as wide; what the widest leaves, which no input
    is expected to, is counted from the arrays.  A later try has few pairs and deals them to as
    many tasks as their sketches need.
    """
    spark, done, times = pairs.sparkSession, None, 1
    tasks = partitions(spark)
    for _ in range(RETRIES):
        dealt = pairs.repartition(tasks, "pair")
        cells = peeled(subtracted(dealt, times))
        judged = written(cells.groupBy("pair").agg(
            F.max("w").alias("w"),
            F.count(F.when(~F.col("found"), 1)).alias("left"),
            F.count(F.when(F.col("found") & (F.col("n") > 0), 1)).alias("only_mine"),
            F.count(F.when(F.col("found") & (F.col("n") < 0), 1)).alias("only_theirs")))
        good = judged.filter("left = 0").drop("left", "w")
        done = good if done is None else done.union(good)
        failed = judged.filter("left > 0")
        cells_left = failed.agg(F.sum("w")).first()[0]
        if cells_left is None:
            return done
        # a side of a pair has 2 * w / times digests at most
        tasks = min(partitions(spark), max(2, -(-4 * cells_left // (times * PER_TASK))))
        pairs, times = written(pairs.join(failed.select("pair"), "pair", "left_semi")), 2 * times
    return done.union(pairs.select(
        "pair", F.size(F.array_except("mine", "theirs")).cast("long"), F.size(F.array_except("theirs", "mine")).cast("long")))


def with_next(docs: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Each row with ``next``: the columns of the row after it in descending key order, the first
    after the last.  Ties are ordered by a hash of the columns, a null key comes last.

    The rows are dealt out by ranges of the key; the first row of a range also goes to the range
    before it, so rows move once and no task sorts more than a range.
    """
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("at"), F.struct(*columns).alias("row"))
    ranges = partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("at", [k / ranges for k in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    ranged = docs.withColumn("range", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("at"))))
    heads = sorted(ranged.groupBy("range").agg(F.max("at")).collect())  # a row a range
    goes_to = {head: heads[(k + 1) % len(heads)][0] for k, (_, head) in enumerate(heads)}
    also = F.element_at(F.create_map(*[F.lit(x) for pair in goes_to.items() for x in pair]), F.col("at")) if heads else F.lit(None).cast("int")
    dealt = ranged.select("at", "row", F.explode(F.array_compact(F.array(
        F.struct("range", F.lit(False).alias("guest")),
        F.when(also.isNotNull(), F.struct(also.alias("range"), F.lit(True).alias("guest")))))).alias("to"))
    window = Window.partitionBy("to.range").orderBy("to.guest", F.desc("at"), F.xxhash64("row"))
    return dealt.withColumn("next", F.lead("row").over(window)).filter(~F.col("to.guest")).select("row", "next")


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``
    for every row.

    The edited text has the last third of the code points replaced by as many first ones of the
    next text in descending id order (after the last: the first).  Likeness is the share of
    digests in both among those in any, from the number of recovered digests; two texts without
    paragraphs are alike.  A null text counts as empty, a null id comes last, rows of one id are
    ordered by a hash of the text, repeated rows give repeated results, and an empty table gives
    no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("digests", digests(F.col("text")))
    pairs = with_next(rows, ["text", "digests", "doc_id"], "doc_id")
    n = F.length("row.text")
    third = F.floor(n / 3).cast("int")
    edited = pairs.select(
        "row.doc_id", n.cast("long").alias("n_chars"), F.col("row.digests").alias("own"), F.col("next.digests").alias("next"),
        F.concat(F.substring("row.text", 1, n - third), F.substring("next.text", 1, third)).alias("edited"))
    versions = staged(edited.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "own", "next", digests(F.col("edited")).alias("new")))
    found = differences(versions.select("row", F.explode(F.array(
        F.struct((F.col("row") * 2).alias("pair"), F.col("own").alias("mine"), F.col("new").alias("theirs")),
        F.struct((F.col("row") * 2 + 1).alias("pair"), F.col("own").alias("mine"), F.col("next").alias("theirs")),
    )).alias("p")).select("p.*"))
    differ = F.col("only_mine") + F.col("only_theirs")
    by_row = found.groupBy(F.shiftright("pair", 1).alias("row")).agg(
        F.sum(F.when(F.col("pair") % 2 == 0, differ)).alias("edited"), F.sum(F.when(F.col("pair") % 2 == 1, differ)).alias("next_"))

    def likeness(other, d):
        both, d = F.size("own") + F.size(other), F.coalesce(d, F.lit(0))  # without cells nothing differs
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))

    return versions.join(by_row, "row", "left").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness("new", F.col("edited")).alias("near_edited"), likeness("next", F.col("next_")).alias("near_next"))
