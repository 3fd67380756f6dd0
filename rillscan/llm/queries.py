"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    extraction,
    fingerprints,
    jaccard,
    manifest,
    packing,
    ranked,
    repeats,
    secrets,
    sharding,
    simhash,
    token_counts,
    toxicity,
)
from .shared import importable


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TOXIC = 0.7
CAPACITY = 2048
"""Words of a bin."""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_versions(_table(spark, sf_dir, "documents"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents"), length=50).drop("kept")


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.histogram_shards(docs, shards=8).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, distance=2)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, ~held_out(F.col("doc_id")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity_model(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.Vocabulary.read(VOCABULARY))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(
        docs, CAPACITY, size=F.regexp_count("text", F.lit(r"\S+")), source=F.col("source"), cluster=F.xxhash64("text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
                      manifest.digest(*[lowered if c == "text" else F.col(c) for c in names]))
    rows = manifest.proofs(manifest.build(docs, names, "source", "doc_id", {"tampered": tampered}))
    rows = rows.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select(
        F.col("place").alias("doc_id"), "leaf", "subroot", "root", manifest.path_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_site_style_tree, op3_suffix_dedup, op4_histogram_shards, op5_simhash, op6_toxicity, op7_secrets,
    op8_token_counts, op9_decontamination, op10_packing, op11_jaccard,
    op12_merkle, op13_ranked_search)}


def _merkle_sql(levels: int = 8) -> str:
    """One step after the other for each level: enough for 16 ** ``levels`` rows of a source, and as many sources."""
    def leaf(text):
        return "sha256(" + " || ".join(
            f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def nodes(tree, k):  # a tree of one node stays as it is
        return f"""
        {tree}_run{k} AS (SELECT t, i // 16 AS i, list(d ORDER BY i) AS run, any_value(n) AS n FROM {tree}{k} GROUP BY t, i // 16),
        {tree}{k + 1} AS (SELECT t, i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d,
          (n + 15) // 16 AS n FROM {tree}_run{k}),"""

    def paths(rows, tree, k, after):
        left, right = "array_to_string(run[:x.i % 16], '')", "array_to_string(run[x.i % 16 + 2:], '')"
        return f"""
        {after} AS (SELECT x.* REPLACE (x.i // 16 AS i, CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof,
            CASE WHEN n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold)
          FROM {rows} x JOIN {tree}_run{k} r ON r.t = x.t AND r.i = x.i // 16),"""

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
        WITH named AS (SELECT *, coalesce('+' || source, '') AS t, {leaf('text')} AS leaf, {leaf(lowered)} AS low,
            list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc FROM documents),
        a0 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d,
          count(*) OVER (PARTITION BY t) AS n FROM named),"""
    sql += "".join(nodes("a", k) for k in range(levels))
    sql += f"""
        b0 AS (SELECT '' AS t, t AS name, row_number() OVER (ORDER BY encode(t)) - 1 AS i, d, count(*) OVER () AS n FROM a{levels}),"""
    sql += "".join(nodes("b", k) for k in range(levels))
    sql += """
        p0 AS (SELECT doc_id, leaf, t, i, '' AS proof, CASE WHEN (4294967295 - crc) % 5 = 0 THEN low ELSE leaf END AS fold FROM a0),"""
    sql += "".join(paths(f"p{k}", "a", k, f"p{k + 1}") for k in range(levels))
    sql += f"""
        q0 AS (SELECT doc_id, leaf, b.d AS subroot, b.t, b.i, proof, fold FROM p{levels} p JOIN b0 b ON b.name = p.t),"""
    sql += "".join(paths(f"q{k}", "b", k, f"q{k + 1}") for k in range(levels))
    return sql + f"""
        result AS (SELECT doc_id, leaf, subroot, b.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
          fold = b.d AS verified FROM q{levels} CROSS JOIN b{levels} b)
        SELECT * FROM result"""


SQL: dict[str, str] = {
    "op12_merkle": _merkle_sql(),
    "op13_ranked_search": r"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM documents),
        dt AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term,
                 count(*)::BIGINT AS tf FROM d GROUP BY ALL),
        per_doc AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM dt GROUP BY doc_id),
        total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM per_doc),
        q AS (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM benchmark),
        qt AS (SELECT item_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term,
                 count(*)::BIGINT AS c FROM q GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
              FROM dt CROSS JOIN total GROUP BY term, nn),
        s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
              FROM qt JOIN dt USING (term) JOIN w USING (term) JOIN per_doc USING (doc_id) CROSS JOIN total GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
              FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 20""",
    "op3_suffix_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (
          SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM b)),
        f AS (SELECT s, min(doc_id) AS first_doc FROM w GROUP BY s),
        starts AS (SELECT doc_id, i, (i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 50)::INT AS new
                   FROM w JOIN f USING (s) WHERE first_doc < doc_id),
        runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
        spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM runs GROUP BY ALL),
        gaps AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM spans),
        cut AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans,
                  string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo)
                  || substr(any_value(h), 2 * max(hi) + 1) AS kept
                FROM gaps JOIN b USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM b LEFT JOIN cut USING (doc_id)""",
}
"""Only what SQL expresses; the others are tested against brute force."""
