"""The knowledge base: built-in notes, indexed chunks, and the job that makes chunks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks

INDEX_SCHEMA = "source string, chunks array<struct<id:string,topic:string,text:string>>"

# Our own notes: id, topic, text.
BUILT_IN = [
    ("note.queries", "Database round trips",
     "A query inside a loop pays one network round trip per item. Fetch all items with one "
     "query, a join or a batch, and keep only the columns that are used."),
    ("note.index", "Index use in SQL",
     "A function around a column, or a LIKE pattern with a leading wildcard, keeps the database "
     "from using the index on that column. Compare the bare column."),
    ("note.strings", "Building strings",
     "Strings that cannot change are copied by every concatenation. In a loop use a builder, or "
     "gather the pieces and join them once."),
    ("note.memory", "Allocation and garbage",
     "Objects made on every pass of a loop keep the garbage collector busy. Reuse buffers, size "
     "collections once, and read large files in blocks."),
    ("note.complexity", "Nested loops",
     "Two nested loops over collections take quadratic time. Index one side in a hash table or a "
     "set, and pass over the other once."),
    ("note.threads", "Threads and pools",
     "Raw threads and pools without a bound exhaust memory under load. Use a shared executor with "
     "a bounded queue."),
    ("note.locks", "Locks and waiting",
     "Sleeping or doing slow work inside a synchronized block makes all other threads wait. Keep "
     "guarded regions short, and block on a result instead of spinning."),
    ("note.async", "Blocking calls in asynchronous code",
     "A blocking call on an event loop or in an async function stops all requests that share the "
     "thread. Await an asynchronous call, and start independent calls together."),
    ("note.connections", "Connections",
     "Opening a database connection per call or per pass costs handshakes and runs into limits. "
     "Take connections from a pool."),
    ("note.mapping", "Object mapping",
     "Eager associations load more than a query needs, lazy ones load row by row when walked. "
     "Fetch associations explicitly where they are used."),
    ("note.frontend", "Rendering in the browser",
     "Listeners and timers without cleanup leak, new functions in render defeat memoization, and "
     "long lists should render their visible part only."),
    ("note.network", "Data over the network",
     "Selecting all columns and fetching without a cache policy move data nobody reads. Name the "
     "columns, page results and let responses be cached."),
]


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *note) for i, note in enumerate(BUILT_IN)],
        "note_ord long, id string, topic string, text string")


def read_index(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``source, pos, id, topic, text``: chunks of JSON index files with one index a line, as
    :func:`write_index` writes them, or one a file (``multi_line``); what cannot be parsed gives
    no rows.  A source without a name has the name of its file."""
    files = (spark.read.schema(INDEX_SCHEMA).option("multiLine", multi_line)
             .option("ignoreMissingFiles", True).json(path))
    return files.select(
        F.coalesce("source", F.col("_metadata.file_path")).alias("source"),
        F.posexplode("chunks").alias("pos", "c")).select("source", "pos", "c.*")


def knowledge_base(notes: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """Built-in notes, then indexed chunks that have text, with defaults filled in.

    ``indexed`` has ``pos, id, topic, text`` and whatever else tells chunks apart (``source``,
    ``doc_id``).  ``note_ord`` is the key of a note: the chunks of one unnamed source follow the
    built-in notes by position; otherwise it is hashed from source, document and position.
    """
    if indexed is None:
        return notes
    own = [c for c in ("source", "doc_id") if c in indexed.columns]
    key = F.col("pos") + len(BUILT_IN)
    if own:
        # far above the built-in notes; 62 bits of a hash
        key = F.shiftrightunsigned(F.xxhash64(*own, "pos"), 2) + F.lit(1 << 20)
    extra = indexed.where(F.coalesce("text", F.lit("")) != "").select(
        key.cast("long").alias("note_ord"),
        F.coalesce("id", F.lit("pdf")).alias("id"),
        F.coalesce("topic", F.lit("reference")).alias("topic"),
        "text")
    return notes.unionByName(extra)


def chunk_documents(documents: DataFrame, separator: str = chunks.BLANK_LINE) -> DataFrame:
    """``doc_id, pos, id, topic, text`` of documents (``doc_id, text``), without a shuffle."""
    return documents.select(
        "doc_id", F.posexplode(chunks.pack(F.col("text"), separator)).alias("pos", "text")
    ).select(
        "doc_id", "pos", F.concat(F.lit("pdf."), F.col("pos").cast("string")).alias("id"),
        F.lit("reference").alias("topic"), "text")


def write_index(chunked: DataFrame, path: str) -> None:
    """Write the chunks of documents (``doc_id, pos, id, topic, text``) as :func:`read_index` reads
    them: a folder of JSON files, each one document with its chunks in order.

    The chunks of a document come from one row, so they fit one.
    """
    chunk = F.struct("pos", F.struct("id", "topic", "text").alias("c"))
    whole = chunked.groupBy("doc_id").agg(F.sort_array(F.collect_list(chunk)).alias("all"))
    whole.select(
        F.col("doc_id").cast("string").alias("source"), F.transform("all", lambda x: x["c"]).alias("chunks")
    ).write.mode("overwrite").json(path)
