"""Secret scans: fixed patterns, and a battery of randomness tests on tokens of any kind.

All of it is DataFrame expressions.  A token is a maximal run of characters that encodings use.
Its encoding is inferred from the characters it has.  Over the alphabet of that encoding it must
look random: uniform (chi-squared), without trend (runs above and below the middle) and without
memory (serial correlation of neighbours).  As short words pass such tests by chance, what counts
as found is controlled over the whole corpus: neighbouring characters of its words give the
probability of a token as ordinary text, and how much likelier it is under its encoding, weighted
by the battery's p-values, bounds the probability that ordinary text looks so (Markov).  For each
class of lengths the Benjamini-Hochberg rule sets the bound below which at most ``rate`` of the
findings are false.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns by which secrets are told, and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
# Alphabets in the order of their codes.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("^[0-9]+$", DIGITS),
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("^[a-z0-9]+$", DIGITS + LOWER),
    ("^[A-Z0-9]+$", DIGITS + UPPER),
    ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("", UPPER + LOWER + DIGITS + "+/-_"),
)

LOOKS_RANDOM = 0.001
"""Least p-value of each test of the battery; a random token falls below one in 0.3 % of cases."""
TEXT_SWITCH = 0.08
"""In ordinary text at most this share of neighbours in a token switches between classes."""
RATE = 0.01
WORD = r"[A-Za-z0-9+/_-]{6,}"
"""What ordinary text is learned from."""
FOLDED = LOWER + DIGITS + "+/-_"
UNSEEN, BACKOFF = 0.1, 10
"""Share of characters that follow no rule, and weight of single characters against pairs."""
BIN, MOST_BIN = 4, 240
"""Bins of a quarter of a decade, down to 1e-60."""
LENGTHS = (20, 24, 32, 40, 64, 128)
SPANS = "array<struct<start:int,kind:int,end:int>>"
HITS = "array<struct<start:int,end:int,hit:string>>"


def _hits(text: Column, pattern: str) -> Column:
    """Start, end (exclusive, code points) and text of the leftmost non-overlapping matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))

    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        return F.when(x["hit"].isNull(), s).otherwise(F.struct(
            (start + F.length(x["hit"])).alias("at"),
            F.array_append(s["out"], F.struct(
                start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"))).alias("out")))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(HITS).alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(HITS))


def base_spans(text: Column) -> Column:
    """Sorted structs (start, kind, end) of the fixed kinds."""
    def spans(kind, hits):
        return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(kind).alias("kind"), h["end"].alias("end")))

    assigned = F.filter(_hits(text, ASSIGN), lambda h: F.length(F.regexp_extract(h["hit"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return F.sort_array(F.concat(spans(0, assigned), spans(1, _hits(text, ACCESS)), spans(2, _hits(text, HEX)))).cast(SPANS)


def _upper_tail(z: Column) -> Column:
    """Probability that a standard normal exceeds z (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def battery(token: Column, alphabet: Column) -> Column:
    """Least p-value of the three tests, for codes of the token's characters in the alphabet."""
    n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")

    def tests(codes):
        counts = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda d: d == c)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * k / n - n
        df = k - 1
        uniform = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        high = F.transform(codes, lambda c: (c >= k / 2).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda s, x: s + x).cast("double")
        n2 = n - n1
        runs = 1 + F.aggregate(F.zip_with(F.slice(high, 2, 1 << 30), high, lambda x, y: (x != y).cast("int")),
                               F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0)))
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        wander = F.when(var > 0, 2 * _upper_tail(F.abs(runs - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
        centre = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
        ss = F.aggregate(codes, F.lit(0.0), lambda s, c: s + (c - centre) * (c - centre))
        lag = F.aggregate(F.zip_with(F.slice(codes, 2, 1 << 30), codes, lambda x, y: (x - centre) * (y - centre)),
                          F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        memory = F.when(ss > 0, 2 * _upper_tail(F.abs(lag / ss + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
        return F.least(uniform, wander, memory)

    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return _let(F.transform(chars, lambda c: _code(alphabet, c)), tests)


def _code(alphabet: Column, c: Column) -> Column:
    return F.call_function("locate", c, alphabet) - 1


def surprise(token: Column) -> Column:
    """Quarters of a decade below 1 of a bound on the probability that text of this length
    switches so often between lower case, upper case, digits and signs (Chernoff)."""
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        token, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[+/_-]+", "-")
    n = F.length(token).cast("double") - 1
    share = F.greatest((F.length(folded) - 1) / n, F.lit(TEXT_SWITCH))
    rest = 1 - share
    bound = n * (share * F.log(share / TEXT_SWITCH) + F.when(rest > 0, rest * F.log(rest / (1 - TEXT_SWITCH))).otherwise(0.0))
    return F.least(F.lit(MOST_BIN), F.floor(bound / math.log(10) * BIN).cast("int"))


def text_model(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Negative logarithms of the probability of each first character of ordinary text, and of each
    character after each other, without case.  Every distinct word of all rows counts once, so
    repeated secrets don't pass for text; tokens that switch more than text may are left out.  At
    most one count a pair of characters reaches the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD), F.lit(0))).alias("w")).distinct()
    words = words.filter((F.length("w") < LENGTHS[0]) | (surprise(F.col("w")) <= BIN))
    chars = F.filter(F.split(F.lower("w"), ""), lambda c: c != "")
    pairs = words.select(F.explode(F.zip_with(F.slice(chars, 2, 1 << 30), chars, lambda x, y: F.concat(y, x))).alias("pair"))
    n = Counter(dict(pairs.filter("pair is not null").groupBy("pair").agg(F.count(F.lit(1))).collect()))
    k = len(FOLDED)
    before = {a: sum(n[a + b] for b in FOLDED) for a in FOLDED}
    after = {b: sum(n[a + b] for a in FOLDED) for b in FOLDED}
    single = {b: (after[b] + 1) / (sum(after.values()) + k) for b in FOLDED}

    def cost(p):
        return -math.log((1 - UNSEEN) * p + UNSEEN / k)

    return [cost(single[b]) for b in FOLDED] + [
        cost((n[a + b] + BACKOFF * single[b]) / (before[a] + BACKOFF)) for a in FOLDED for b in FOLDED]


def evidence(token: Column, alphabet: Column, least: Column, model: list[float]) -> Column:
    """Quarters of a decade by which the token is likelier as a random one of its encoding than as
    ordinary text; ``least`` is the least p-value of the battery.  The inverse of a likelihood ratio
    bounds the probability that text reaches it; encodings are equally likely beforehand, and the
    weight of the battery is 1 on average over random tokens."""
    costs = F.split(F.lit(",".join(f"{x:.6g}" for x in model)), ",").cast("array<double>")
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    codes = F.transform(chars, lambda c: F.struct(
        _code(F.lit(FOLDED), F.lower(c)).alias("c"), F.when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).otherwise(0).alias("case")))

    def follows(x, y):  # x after y
        case = (F.when(x["case"] == 0, 0.0).when(y["case"] == 0, math.log(2))
                .when(x["case"] == y["case"], -math.log(1 - TEXT_SWITCH)).otherwise(-math.log(TEXT_SWITCH)))
        return F.get(costs, (y["c"] + 1) * len(FOLDED) + x["c"]) + case

    def total(codes):
        first = F.get(codes, F.lit(0))
        return F.get(costs, first["c"]) + F.when(first["case"] > 0, math.log(2)).otherwise(0.0) + F.aggregate(
            F.zip_with(F.slice(codes, 2, 1 << 30), codes, follows), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))

    battery_ = 1 - F.pow(1 - F.least(least, F.lit(1.0)), 3)  # uniform for random tokens
    ratio = (_let(codes, total) - F.length(token) * F.log(F.length(alphabet).cast("double"))
             - math.log(len(ENCODINGS)) + F.log(1.5 * F.sqrt(F.greatest(battery_, F.lit(1e-12)))))
    return F.greatest(F.lit(0), F.least(F.lit(MOST_BIN), F.floor(ratio / math.log(10) * BIN).cast("int")))


def length_class(token: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTHS):
        out = F.when(F.length(token) >= least, F.lit(k)).otherwise(out)
    return out


def tokens(text: Column, model: list[float] | None = None) -> Column:
    """Every token with its length class, whether it looks random, and if so its evidence against
    ordinary text; without a model of the text that is the surprise of its switches."""
    def judged(h):
        t = h["hit"]
        alphabet = F.lit(ENCODINGS[-1][1])
        for pattern, letters in reversed(ENCODINGS[:-1]):
            alphabet = F.when(t.rlike(pattern), F.lit(letters)).otherwise(alphabet)

        def tested(x):
            random = x["least"] >= LOOKS_RANDOM
            found = surprise(t) if model is None else evidence(t, x["alphabet"], x["least"], model)
            return F.struct(h["start"].alias("start"), h["end"].alias("end"), length_class(t).alias("band"),
                            F.when(random, found).otherwise(0).alias("bin"), random.alias("random"))

        return _let(alphabet, lambda a: _let(F.struct(a.alias("alphabet"), battery(t, a).alias("least")), tested))

    return F.transform(_hits(text, TOKEN), judged)


def bounds(docs: DataFrame, rate: float = RATE, text_col: str = "text", model: list[float] | None = None) -> dict[int, int]:
    """For each length class the least bin that the false-discovery rule admits, from all tokens
    of all rows.  At most bins x classes rows reach the driver."""
    each = docs.select(F.explode(tokens(F.coalesce(text_col, F.lit("")), model)).alias("t")).select("t.band", "t.bin")
    counts = each.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy("band")
    ranked = counts.select(
        "band", "bin", F.sum("n").over(all_).alias("m"), F.sum("n").over(all_.orderBy(F.desc("bin"))).alias("found"))
    admitted = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BIN) * F.col("m") <= rate * F.col("found"))
    return dict(admitted.groupBy("band").agg(F.min("bin")).collect())


def all_spans(text: Column, base: Column, least: dict[int, int], model: list[float] | None = None) -> Column:
    """The base spans and the random tokens that the bounds admit and no base span touches."""
    if not least:
        return base
    admits = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])
    found = F.filter(tokens(text, model), lambda t: t["random"] & (t["bin"] >= F.element_at(admits, t["band"])))
    free = F.filter(found, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    added = F.transform(free, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return F.sort_array(F.concat(base, added)).cast(SPANS)


def scan(docs: DataFrame, rate: float = RATE, text_col: str = "text",
         base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """Every row with two more columns: spans of the fixed kinds, and all spans, both sorted
    arrays of (start, kind, end) in code points, end exclusive; ``kind`` counts ``KINDS``.

    Columns of these names are replaced.  A null text has no spans; repeated rows get the same
    spans; an empty table gives no rows.  The model of the text and the false-discovery bounds count every word and token of every row.
    """
    model = text_model(docs, text_col)
    least = bounds(docs, rate, text_col, model)
    text = F.coalesce(text_col, F.lit(""))
    return docs.withColumn(base, base_spans(text)).withColumn(spans, all_spans(text, F.col(base), least, model))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of spans that touch or overlap replaced by one mark."""
    def step(s, x):
        return F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(
                s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out")))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
