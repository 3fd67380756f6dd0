"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

CLASHES = ["fp", "fingerprint", "component_id", "shard", "slot", "row", "next", "pair", "bucket", "score", "leaks",
           "spans", "base_spans", "range", "at", "key_hash", "size", "block", "copy", "html", "host", "found"]


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    syllables = ["ba", "co", "di", "fu", "ge", "ho", "ji", "ka", "lu", "me", "né", "öp", "ra", "si"]
    known = ["".join(rng.choice(syllables) for _ in range(1 + k % 4)) + str(k % 7) * (k % 11 == 0) for k in range(vocabulary)]
    out = [rng.choice(known) for _ in range(words)]
    return "".join(w + ("\n" if i % 13 == 12 else " ") for i, w in enumerate(out))


def table(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES if clash else ():
        df = df.withColumn(name, F.lit("x"))
    return df


def awkward():
    """Rows of documents."""
    base = prose(1, 120)
    texts = [
        (0, base), (1, base), (2, base.replace("ba", "zu", 1)), (3, None), (4, ""), (5, "   \n\t "), (6, "word"),
        (7, "two words"), (8, "three little words"), (9, prose(2, 60) + base[100:400] + prose(3, 30)),
        (10, prose(4, 5000)), (11, "x" * 3000), (12, "é" * 70 + "\U0001F600" * 30), (13, prose(5, 80)), (14, prose(5, 80) + " end"),
        (15, prose(6, 40)), (15, prose(6, 40)), (16, "A B C d e f"), (17, "a b c D E F"), (None, prose(7, 50)),
        (None, prose(7, 50)), (18, "퟿ nbsp line"), (20, prose(8, 200)), (40, "0" * 60 + prose(9, 20)),
    ]
    return [(i, t, "en", f"src{k % 3}" if k % 5 else None, None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def n_words(text):
    """Runs without ASCII white space."""
    return len((text or "").encode().split())
