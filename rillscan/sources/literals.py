"""An index of three-letter pieces of files, for rules that come later.

A rule that looks for a word can hit only in files that have all pieces of the word.  The index holds, for each piece and
block of some megabytes of files, the list of the files that have it, in folders by the hash of the piece: a new rule reads
the folders of its words' pieces, finds its candidate files there, and scans only those.  What the index cannot tell, the
scan does, so the findings are those of a scan of everything.

Lists hold hashes of the files' keys; the keys lie beside them, once for each file.  Two files of one hash would be
candidates together.
"""

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..operators import lines, scan
from ..rules import RuleSpec
from .shared import work_folder

LENGTH = 3
FOLDERS = 64
BLOCK_BYTES = 2 << 20
_UNREADABLE = ""


def _lists(length: int, block_bytes: int, unreadable: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of ``file, content``: the pieces of each block of files, with the files that have them.

    Letters are numbered within a block, so that a piece and the file it is in make one number; sorted, these are the lists.
    """
    def of_block(files, contents):
        numbers = [np.frombuffer(c.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for c in contents]
        every = np.concatenate(numbers)
        present = np.zeros(int(every.max(initial=0)) + 1, bool)
        present[every] = True
        letters = np.flatnonzero(present)
        n, base = len(files), max(1, len(letters))
        if n > 1 and base ** length * n >= 1 << 63:  # one file alone stays below: 0x110000 ** 3 < 2 ** 63
            yield from of_block(files[:n // 2], contents[:n // 2])
            yield from of_block(files[n // 2:], contents[n // 2:])
            return
        small = np.int32 if base ** length * n < 1 << 31 else np.int64
        ranked = (np.cumsum(present) - 1).astype(small)[every]
        of = np.repeat(np.arange(n, dtype=small), [len(x) for x in numbers])
        starts = max(0, len(every) - length + 1)
        code = ranked[:starts].copy()
        for k in range(1, length):
            code *= base
            code += ranked[k:k + starts]
        code *= n
        code += of[:starts]
        code = np.sort(code[of[:starts] == of[len(of) - starts:]])
        found = code[np.flatnonzero(np.diff(code, prepend=small(-1)))]
        code, at = np.divmod(found.astype(np.int64), n)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        spelled = np.stack([letters[code[first] // base ** (length - 1 - k) % base] for k in range(length)], axis=1)
        spelled = spelled.astype("<u4").tobytes().decode("utf-32-le")
        yield pa.RecordBatch.from_arrays([
            pa.array([spelled[i:i + length] for i in range(0, len(spelled), length)], pa.string()),
            pa.ListArray.from_arrays(pa.array(np.append(first, len(found)), pa.int32()), pa.array(files[at], pa.int64())),
        ], ["piece", "files"])

    def of_batches(batches):
        for batch in batches:
            files, contents = batch.column(0).to_numpy(), batch.column(1)
            empty = contents.is_null().to_numpy(zero_copy_only=False)
            if empty.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unreadable], pa.string()), pa.array([files[empty]], pa.list_(pa.int64()))], ["piece", "files"])
            told, held, size = [], [], 0
            for i in np.flatnonzero(~empty):
                told.append(i)
                held.append(contents[int(i)].as_py())
                size += len(held[-1])
                if size >= block_bytes:
                    yield from of_block(files[told], held)
                    told, held, size = [], [], 0
            if held:
                yield from of_block(files[told], held)

    return of_batches


def pieces(word: str) -> list[str]:
    if len(word) < LENGTH:
        raise ValueError(f"the index knows words of {LENGTH} letters or more")
    return sorted({word[i:i + LENGTH] for i in range(len(word) - LENGTH + 1)})


def _folder(piece):
    return F.pmod(F.xxhash64(piece), F.lit(FOLDERS)).cast("int")


class LiteralIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @staticmethod
    def write(sources: DataFrame, root: str | None = None) -> "LiteralIndex":
        """Index the files of supported languages, by default in the shared folder of the session."""
        spark = sources.sparkSession
        root = root or f"{work_folder(spark)}/literals-{uuid.uuid4().hex}"
        key = lines.file_key(sources)
        files = sources.where(lines.supported(F.col("path"))).withColumn("file", F.xxhash64(*key))
        files.select("file", *key).write.parquet(f"{root}/files")
        # a file without text may hold anything: it stays a candidate of every word
        rows = files.select("file", text.unix_newlines(F.col("content")).cast("binary").alias("content")).mapInArrow(
            _lists(LENGTH, BLOCK_BYTES, _UNREADABLE), "piece string, files array<long>")
        (rows.withColumn("folder", _folder(F.col("piece"))).hint("rebalance", "folder")
         .sortWithinPartitions("folder", "piece").write.partitionBy("folder").parquet(f"{root}/pieces"))
        return LiteralIndex(spark, root)

    def candidates(self, words: Iterable[str]) -> DataFrame:
        """Keys of the files that may hold any of the words."""
        wanted = [(word, piece, len(pieces(word))) for word in sorted(set(words)) for piece in pieces(word)]
        wanted.append((_UNREADABLE, _UNREADABLE, 1))
        asked = self.spark.createDataFrame(wanted, "word string, piece string, n int")  # a few rows for each word
        folders = [r.folder for r in asked.select(_folder(F.col("piece")).alias("folder")).distinct().collect()]
        rows = self.spark.read.parquet(f"{self.root}/pieces").where(
            F.col("folder").isin(folders) & F.col("piece").isin([p for _, p, _ in wanted]))
        found = rows.join(F.broadcast(asked), "piece").select("word", "n", F.explode("files").alias("file")).groupBy(
            "file", "word", "n").agg(F.count(F.lit(1)).alias("held")).where("held = n").select("file").distinct()
        keys = self.spark.read.parquet(f"{self.root}/files")
        return found.join(keys, "file").select(*lines.file_key(keys)).distinct()

    def scan(self, sources: DataFrame, rule: RuleSpec, words: Iterable[str]) -> DataFrame:
        """Findings of a rule, every hit of which has one of ``words`` in its line, in files that may hold one."""
        key = lines.file_key(sources)
        read = [ext for ext, rulesets in fixed.EXTENSION_RULESETS.items() if rule.ruleset in rulesets]
        files = sources.where(text.extension("path").isin(read))  # before their contents are exchanged
        return scan.scan(files.join(self.candidates(words), key, "left_semi"), [rule])
