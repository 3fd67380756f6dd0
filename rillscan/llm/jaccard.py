"""Documents linked by the Jaccard similarity of their word shingles, with skipping by set relations.

A shingle is a 55-bit hash of its words.  Shingles are ordered by how many documents hold them (to a
twelfth), rarest first, and a set is indexed by the first ones only (prefix): two sets that link share one.
Three facts about sets save work, and none drops a link:

* *Singles.*  A shingle of one document meets nothing.  It takes a position in its set, but no row.
* *Positions.*  With a shared shingle at position i of a set of a, no more than a - i shingles from
  there on can be shared.  The index list of a shingle is cut into blocks by size and position, and
  pairs of blocks whose best entries cannot reach the threshold are skipped whole.
* *Answers of a pivot.*  Each list has a pivot, the set with the fewest rarer shingles, and every set of
  the list is compared with it.  Sets that link to it are in one component, so nothing between
  them is compared, however many they are.  For two others the answers of the pivot bound
  what they share, and what passes is not intersected again: it follows from their differences to the pivot.

Texts are read once.  Their hashes move in packed blocks: to buckets that count them, and home again,
without the singles.  A hash that several documents of a block hold moves once for the block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import partitions, pieces, texts, written
from .squeeze import packed, restored, squeezed, unpacked

BUCKET_BYTES, BLOCK_BYTES = 64 << 20, 8 << 20
"""Text whose hashes are counted in one task, and text of one block."""
HASH_BITS = 55
"""Fewer than 64, so that differences of sorted hashes fit in a byte less."""
_KNOWN_WORDS = 1 << 18
_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:  # memory stays bounded
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(text: str, shingle: int, known: dict | None = None) -> np.ndarray:
    """The sorted distinct hashes of the shingles; of the whole sequence if it is shorter, none without words."""
    known = _WordHashes() if known is None else known
    words = text.encode().lower().split()  # bytes: A-Z and the ASCII blanks only
    n = min(len(words), shingle)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.full(len(words) - n + 1 if n else 0, n, np.uint64)
    for i in range(n):
        out = _mixed(out + h[i:len(h) - n + 1 + i])
    return np.unique(out >> _U(64 - HASH_BITS))


_ROW = "key long, block long, hashes binary, docs binary, n binary, ids array<{}>, sids array<binary>"
_NAMES = ["key", "block", "hashes", "docs", "n", "ids", "sids"]


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type), pa.list_(pa.binary())]
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], _NAMES)


def _blocks(shingle: int, buckets: int):
    """From texts to packed rows: one for each bucket and one that goes home (key ``buckets + block``).

    A hash of one document of the block goes to its bucket with the document; one of several
    goes with 0 for a document, and its documents go home.
    """
    def run(batches):
        known, number = _WordHashes(), TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in pieces(batch, "text", BLOCK_BYTES):
                sets = [shingle_hashes(t, shingle, known) for t in part.column("text").to_pylist()]
                sids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                sizes = np.array([len(s) for s in sets], np.int64)
                hashes = np.concatenate(sets)
                order = np.argsort(hashes, kind="stable")
                hashes, docs = hashes[order], np.repeat(np.arange(len(sets)), sizes)[order]
                found, start, count = np.unique(hashes, return_index=True, return_counts=True)
                several = np.repeat(count > 1, count)
                owner = np.where(count > 1, 0, docs[start] + 1)
                to = (found >> _U(HASH_BITS - 32)) * _U(buckets) >> _U(32)
                cut = np.searchsorted(to, np.arange(buckets + 1))
                rows = [(b, number, packed(found[i:j]), squeezed(owner[i:j]), squeezed(count[i:j]), None, None)
                        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
                rows.append((buckets + number, number, packed(hashes[several]), squeezed(docs[several]),
                             squeezed(sizes), part.column("doc_id").to_pylist(), sids))
                yield _batch(rows, part.schema.field("doc_id").type)
                number += 1
    return run


def _counted(buckets: int):
    """The rows of a bucket, without hashes of one document and with a rank of the others: eight for each
    doubling of the documents that hold them."""
    def run(table):
        if table.column("key")[0].as_py() >= buckets:
            return table
        rows = table.to_pylist()
        each = [unpacked(r["hashes"]) for r in rows]
        counts = [restored(r["n"]) for r in rows]
        found, at = np.unique(np.concatenate(each), return_inverse=True)
        df = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        own, out = np.split(df[at], np.cumsum([len(e) for e in each])[:-1]), []
        for r, hashes, n in zip(rows, each, own, strict=True):
            kept = n > 1
            if kept.any():
                rank = np.floor(8 * np.log2(n[kept])).astype(np.int64)
                out.append((r["key"], r["block"], packed(hashes[kept]), squeezed(restored(r["docs"])[kept]),
                            squeezed(rank), None, None))
        return pa.Table.from_batches([_batch(out, table.schema.field("ids").type.value_type)])
    return run


def _prefixes(buckets: int, percent: int):
    """For each document of a block its set's name and size, the entries of its prefix and, if there
    are any, all its hashes that other documents hold."""
    def run(table):
        rows = table.to_pylist()
        home = next(r for r in rows if r["key"] >= buckets)
        sizes = restored(home["n"]).astype(np.int64)
        back = [r for r in rows if r["key"] < buckets]

        def joined(parts, dtype):
            return np.concatenate([np.zeros(0, dtype), *parts])

        hashes = joined([unpacked(r["hashes"]) for r in back], np.uint64)
        owner = joined([restored(r["docs"]).astype(np.int64) for r in back], np.int64)
        rank = joined([restored(r["n"]).astype(np.int64) for r in back], np.int64)
        shared = unpacked(home["hashes"])
        shared_docs = restored(home["docs"]).astype(np.int64)
        multi = np.flatnonzero(owner == 0)
        multi = multi[np.argsort(hashes[multi])]
        place = multi[np.searchsorted(hashes[multi], shared)]
        doc = np.concatenate([owner[owner > 0] - 1, shared_docs])
        rank = np.concatenate([rank[owner > 0], rank[place]])
        hashes = np.concatenate([hashes[owner > 0], shared])
        order = np.lexsort((hashes, rank, doc))
        doc, hashes = doc[order], hashes[order].view(np.int64)
        held = np.bincount(doc, minlength=len(sizes))
        first = np.cumsum(held) - held
        at = np.arange(len(doc)) - first[doc] + (sizes - held)[doc]  # the singles come before
        prefix = sizes - (percent * sizes + 99) // 100 + 1
        entry = at < prefix[doc]
        entries = np.bincount(doc[entry], minlength=len(sizes))
        whole = entries[doc] > 0

        def lists(values, n, kind):
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values, kind))

        return pa.table({
            "doc_id": pa.array(home["ids"], table.schema.field("ids").type.value_type),
            "sid": pa.array(home["sids"], pa.binary()), "size": pa.array(sizes),
            "hashes": lists(hashes[entry], entries, pa.int64()), "at": lists(at[entry], entries, pa.int64()),
            "held": lists(hashes[whole], np.where(entries > 0, held, 0), pa.int64())})
    return run


def indexed_sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, sid, size, hashes, at, held``: of every document the name and size of its set, its index
    entries (hash and position), and, if there are entries, all its hashes that another document holds."""
    spark = docs.sparkSession
    text_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(partitions(spark), -(-text_bytes // BUCKET_BYTES))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(_blocks(shingle, buckets), _ROW.format(id_type))
    counted = rows.groupBy("key").applyInArrow(_counted(buckets), _ROW.format(id_type))
    return counted.groupBy("block").applyInArrow(
        _prefixes(buckets, percent),
        f"doc_id {id_type}, sid binary, size long, hashes array<long>, at array<long>, held array<long>")


def _links(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return (100 + percent) * shared >= percent * (a + b)


def _may_link(a: str, a_at: str, b: str, b_at: str, percent: int) -> Column:
    """Sizes within the ratio, and enough shingles from the shared one on."""
    a, b = F.col(a), F.col(b)
    left = F.least(a - F.col(a_at), b - F.col(b_at))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & _links(left, a, b, percent)


def _blocked_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list that may link and are not in one component: ``a, b, pivot`` and their shares with the pivot.

    Entries lie in at most a few hundred blocks a list, by size and position; blocks are compared
    first.  Two blocks of the pivot's component are never compared.
    """
    blocks = entries.withColumn("block", F.struct(
        F.col("main"), F.floor(8 * F.log2("size")).alias("of_size"),
        F.floor(1600 * F.col("at") / ((100 - percent) * F.col("size") + 100)).alias("of_position")))
    found = blocks.groupBy("hash", "block").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.max(F.col("size") - F.col("at")).alias("left"),
        F.min("label").alias("label"), (F.min("label") == F.max("label")).alias("alone"))
    one, two = found.alias("x"), found.alias("y")
    pairs = one.join(two, F.expr("x.hash = y.hash AND x.block <= y.block")).where(
        ~(F.col("x.block.main") & F.col("y.block.main"))
        & ~(F.col("x.alone") & F.col("y.alone") & (F.col("x.label") == F.col("y.label")))
        & (100 * F.col("x.most") >= percent * F.col("y.least")) & (100 * F.col("y.most") >= percent * F.col("x.least"))
        & _links(F.least("x.left", "y.left"), F.col("x.least"), F.col("y.least"), percent),
    ).select("x.hash", F.col("x.block").alias("block"), F.col("y.block").alias("other"))
    left = blocks.join(pairs, ["hash", "block"]).select(
        "hash", "pivot", F.col("other").alias("block"), (F.col("block") == F.col("other")).alias("same"),
        F.col("sid").alias("a"), F.col("size").alias("a_size"), F.col("at").alias("a_at"),
        F.col("label").alias("a_label"), F.col("shared").alias("a_shared"))
    right = blocks.select(
        "hash", "block", F.col("sid").alias("b"), F.col("size").alias("b_size"), F.col("at").alias("b_at"),
        F.col("label").alias("b_label"), F.col("shared").alias("b_shared"))
    # what two sets share lies in the pivot, or in what each has beside it
    bound = F.least("a_shared", "b_shared") + F.least(
        F.col("a_size") - F.col("a_shared"), F.col("b_size") - F.col("b_shared"))
    return left.join(right, ["hash", "block"]).where(
        (F.col("a_label") != F.col("b_label")) & (~F.col("same") | (F.col("a") < F.col("b")))
        & _may_link("a_size", "a_at", "b_size", "b_at", percent)
        & _links(bound, F.col("a_size"), F.col("b_size"), percent),
    ).select("pivot", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
             (F.col("a_size") + F.col("b_size")).alias("sizes"),
             F.least("a_label", "b_label").alias("x"), F.greatest("a_label", "b_label").alias("y")).distinct()


def _derived(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Of the pairs those that link, from the differences of both to their pivot."""
    ends = pairs.select("pivot", F.col("a").alias("sid")).union(pairs.select("pivot", F.col("b").alias("sid"))).distinct()
    both = ends.join(held, "sid").join(
        held.select(F.col("sid").alias("pivot"), F.col("held").alias("of_pivot")), "pivot")
    other = written(both.select(
        "pivot", "sid", F.size("of_pivot").alias("of_pivot"),
        F.array_except("held", "of_pivot").alias("more"), F.array_except("of_pivot", "held").alias("less")))
    a = other.select("pivot", "of_pivot", F.col("sid").alias("a"), F.col("more").alias("a_more"), F.col("less").alias("a_less"))
    b = other.select("pivot", F.col("sid").alias("b"), F.col("more").alias("b_more"), F.col("less").alias("b_less"))
    shared = (F.col("of_pivot") - F.size("a_less") - F.size("b_less")
              + F.size(F.array_intersect("a_less", "b_less")) + F.size(F.array_intersect("a_more", "b_more")))
    return pairs.join(a, ["pivot", "a"]).join(b, ["pivot", "b"]).where(
        (100 + percent) * shared >= percent * F.col("sizes"))


def _roots(sets: DataFrame, percent: int) -> DataFrame:
    """``node, root`` of the sets that link to another one."""
    entries = sets.select("sid", "size", F.explode(F.arrays_zip("hashes", "at")).alias("e")).groupBy(
        F.col("e.hashes").alias("hash"), "sid").agg(F.min("size").alias("size"), F.min("e.at").alias("at"))
    entries = written(entries)
    lists = entries.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "size", "sid")).alias("p")).where("n > 1")
    listed = written(entries.join(lists, "hash").select(
        "hash", "sid", "size", "at", "n", F.col("p.sid").alias("pivot"), F.col("p.size").alias("p_size"),
        F.col("p.at").alias("p_at")).where("sid <> pivot"))
    wanted = listed.select("sid").union(listed.select("pivot")).distinct()
    held = written(sets.select("sid", "held").dropDuplicates(["sid"]).join(wanted, "sid", "left_semi"))

    # every set of a list of three or more is compared with the pivot, for the bounds
    met = listed.where((F.col("n") > 2) | _may_link("size", "at", "p_size", "p_at", percent)).select(
        "sid", "size", "pivot", "p_size").distinct()
    answers = written(
        met.join(held, "sid").join(held.select(F.col("sid").alias("pivot"), F.col("held").alias("of_pivot")), "pivot")
        .select("sid", "size", "pivot", "p_size", F.size(F.array_intersect("held", "of_pivot")).alias("shared")))
    roots = written(components(answers.where(_links(F.col("shared"), F.col("size"), F.col("p_size"), percent)).select(
        F.col("sid").alias("a"), F.col("pivot").alias("b"))))

    own = listed.where("n > 2").join(answers.select("sid", "pivot", "shared"), ["sid", "pivot"])
    own = own.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "label", F.coalesce("root", "sid")).drop("root")
    own = own.join(roots.select(F.col("node").alias("pivot"), "root"), "pivot", "left").withColumn(
        "main", F.col("label") == F.coalesce("root", "pivot")).drop("root")
    own = written(own)
    mixed = own.groupBy("hash").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("hash")
    pairs = written(_blocked_pairs(own.join(mixed, "hash", "left_semi"), percent))
    more = written(_derived(pairs, held, percent).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if more.isEmpty():
        return roots
    again = written(components(more))
    return (roots.join(again.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left")
            .select("node", F.coalesce("over", "root").alias("root"))
            .union(again.join(roots, "node", "left_anti").select("node", "root")))


def similar_documents(docs: DataFrame, shingle: int = 5, percent: int = 80,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two documents link when 100 * intersection >= ``percent`` * union of their distinct shingles of
    ``shingle`` words; a shorter text has its whole sequence as one shingle.  The component is the smallest
    doc_id that links reach, itself included.  A text without words (null, empty, blank) has
    no shingle and links with nothing.  Repeated rows give repeated results and, like all rows of equal
    sets, link; a component of null ids only is null.  An empty table gives no rows.  Other columns are
    not read.  Rows must come in the same order if they are read again, as from files.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    rows = written(indexed_sets(texts(docs, id_col, text_col), shingle, percent))
    members = rows.select("doc_id", "sid", F.col("size").alias("n_shingles"))
    roots = written(_roots(rows.where(F.size("hashes") > 0), percent))
    sets = members.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = written(sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "least", F.coalesce("root", "sid").alias("root")))
    classes = written(named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("sid", "component"))
    return members.join(classes, "sid", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
        .alias("component_id"))
