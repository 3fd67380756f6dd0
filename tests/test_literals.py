"""The index of pieces against scans of everything."""

import pyarrow as pa
import pytest

from rillscan.functions.text import has
from rillscan.operators import scan
from rillscan.rules import RuleSpec
from rillscan.sources import literals
from rillscan.sources.literals import LiteralIndex, pieces

FILES = "repo string, path string, content string"
WORDS = ("getConnection", "été_9", "abc")
RULE = RuleSpec("own.words", "python", lambda c: has(c.s, *WORDS), "w", "f", title="t", category="MEMORY", severity="LOW")


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", "a.py", "x = getConnection()\r\ny = 1"), ("r", "b.py", "getConn\nection()"), ("r", "c.py", "in été_9 we"),
            ("r", "d.py", None), ("r", "e.py", ""), ("r", "f.py", "ab"), ("r", "g.java", "getConnection()"), ("r", "h.md", "abc"),
            ("r", "i.py", "abc"), ("s", "a.py", "# abc"), ("s", "j.py", "onnection getCon tConne Connect ctio nection")]
    rows += [("r", f"n{i}.py", f"value_{i} = other_{i * 7}(call)") for i in range(200)]
    return spark.createDataFrame(rows, FILES)


def test_same_findings_from_few_files(spark, files, tmp_path):
    index = LiteralIndex.write(files, str(tmp_path / "index"))
    read = {(r.repo, r.path) for r in index.candidates(WORDS).collect()}
    # j.py has all pieces and not the word; d.py cannot be read; a word over two lines is none
    assert read == {("r", "a.py"), ("r", "c.py"), ("r", "d.py"), ("r", "g.java"), ("r", "i.py"), ("s", "a.py"), ("s", "j.py")}
    plain, ours = scan.scan(files, [RULE]), index.scan(files, RULE, WORDS)
    assert sorted(map(str, ours.collect())) == sorted(map(str, plain.collect())) and plain.count() == 4
    assert {(r.repo, r.path) for r in index.candidates(["nowhere at all"]).collect()} == {("r", "d.py")}


def test_only_the_folders_of_the_pieces_are_read(spark, files, tmp_path):
    index = LiteralIndex.write(files, str(tmp_path / "index"))
    plan = index.candidates(["abc"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(piece" in plan or "piece" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_pieces():
    assert pieces("abcab") == ["abc", "bca", "cab"] and pieces("aaaa") == ["aaa"]
    with pytest.raises(ValueError, match="3 letters"):
        pieces("ab")


def test_commits(spark, files, tmp_path):
    at = files.selectExpr("repo", "'c1' AS commit_sha", "path", "content").unionByName(
        files.selectExpr("repo", "'c2' AS commit_sha", "path", "replace(content, 'abc', 'xyz') AS content"))
    index = LiteralIndex.write(at, str(tmp_path / "index"))
    assert sorted(map(str, index.scan(at, RULE, WORDS).collect())) == sorted(map(str, scan.scan(at, [RULE]).collect()))


def test_a_row_for_a_piece_and_block(spark, files, tmp_path):
    LiteralIndex.write(files.coalesce(2), str(tmp_path / "index"))
    held = [(p, r.path) for r in files.collect() if r.content and not r.path.endswith(".md")
            for x in [r.content.replace("\r\n", "\n")] if len(x) > 2 for p in pieces(x)]
    rows = spark.read.parquet(str(tmp_path / "index" / "pieces")).collect()
    assert sum(len(r.files) for r in rows) == len(held) + 1  # and the file without text
    assert len(rows) <= 2 * len({p for p, _ in held}) + 1 < len(held) / 3


@pytest.mark.parametrize("block_bytes", [1, 40, 1 << 30])
def test_lists_by_brute_force(block_bytes):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))  # too many letters for eight files in one number
    texts = ["abcab", "", None, "ab", "a\0b\0", "\0\0\0\0", "été_9\nété", "x\U0001f600y\U0001f600", "abcab", "aaaa", every[:70000], "ab\n"]
    if block_bytes > 40:
        texts.append(every)
    contents = [None if x is None else x.encode() for x in texts] + [b"a\xe4bc\xffd"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 100 + len(contents)), pa.int64()), pa.array(contents, pa.binary())], ["file", "content"])
    got = [(p, f) for out in literals._lists(3, block_bytes, "")(iter([batch])) for p, at in zip(*(c.to_pylist() for c in out.columns), strict=True) for f in at]
    want = {("", 102)}
    for k, c in enumerate(contents):
        x = (c or b"").decode("utf-8", "replace")
        want |= {(x[i:i + 3], 100 + k) for i in range(len(x) - 2)}
    assert len(got) == len(set(got)) and set(got) == want
