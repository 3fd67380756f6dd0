import corpus_pipeline
import pytest
from helpers import n_words, prose, table

import __spark_entry__
from rillscan.llm import decontamination, packing, queries, secrets, simhash, toxicity  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF)))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_does_what_its_operator_says(spark, stages):
    docs, calm, single, clean, safe, packed = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.scores(docs, queries.toxicity_model(docs, labels))
    assert ids(calm) == ids(scores.filter(scores.score < 0.7))
    groups = simhash.near_duplicates(calm)
    assert ids(single) == ids(groups.filter("doc_id = component_id"))
    leaked = {r.doc_id for r in decontamination.contaminated(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaked and ids(clean) == [i for i in ids(single) if i not in leaked]
    assert ids(safe) == ids(clean)
    assert not secrets.scan(safe).filter("size(base_spans) > 0").count()
    before = {r.doc_id: r for r in secrets.scan(clean).collect()}
    for r in safe.collect():
        old = before[r.doc_id]
        assert (r.text == old.text) == (not old.spans) and r.n_chars == (len(r.text) if old.spans else old.n_chars)
    words = {r.doc_id: n_words(r.text) for r in safe.collect()}
    total = {}
    for r in packed.collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == words


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in found} and "pipeline" in found


def test_awkward_tables(spark, tmp_path):
    from helpers import awkward
    folder = str(tmp_path)
    table(spark, awkward(), clash=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = table(spark, [], clash=False)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Copies go, also among rows without an id; other texts of the same id stay."""
    copy = prose(1, 80)
    rows = [(3, copy, "en", "a", 1), (3, prose(2, 80), "en", "a", 1), (3, copy, "en", "b", 1), (2, copy, "en", "a", 1),
            (None, prose(3, 80), "en", "a", 1), (None, prose(3, 80), "en", "a", 1), (None, prose(4, 80), "en", "a", 1),
            (5, None, "en", "a", None), (6, "", "en", "a", 0), (7, prose(2, 80), None, None, None)]
    got = corpus_pipeline.without_near_duplicates(spark, table(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        [(2, copy), (3, prose(2, 80)), (None, prose(3, 80)), (None, prose(4, 80)), (5, None)], key=str)
