"""All rules over all files, in one pass.

Files are exchanged once, as the one row that each is, over partitions by their size.  Behind that
exchange they are split into lines, the rules of a file's language are evaluated on each line, lines that
hit a rule or bound a scope are kept, and scopes and first hits are settled.  Small tables exchange the kept
lines instead.  Rules without a scope (all of SQL and of the front end) need no exchange for it.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..functions.text import has, matches
from ..rules import CATALOGUE, Line, RuleSpec
from . import scope
from .joins import parted, partitions
from .lines import file_key, with_rulesets

RULESET_ORDER = list(fixed.SKIP_PREFIXES)
RULES_AT_ONCE = 6
_INDENTED = r"(?m)^[\x1c-\x1f[^\S\n]]*+"

# Scan order inside a file.
SCAN_ORDER = ("path", "ruleset_ord", "step", "line", "rule_ord")


def _error_rules() -> list[RuleSpec]:
    rule_id, title, category, severity = fixed.DETECTOR_ERROR
    return [
        RuleSpec(
            rule_id, ruleset,
            lambda c: c.fact("unreadable") & c.fact("first_line"),
            "The file has no text to analyse.",
            "Load the file again; the finding is about the corpus, not about the code.",
            code="", skips=(), title=title, category=category, severity=severity)
        for ruleset in RULESET_ORDER
    ]


def _families() -> list[tuple[str, ...]]:
    """Lists of rulesets that occur together.  A line carries the number of its list."""
    return list(dict.fromkeys(map(tuple, fixed.EXTENSION_RULESETS.values())))


def _family_numbers(*rulesets: str) -> list[int]:
    return [i for i, family in enumerate(_families()) if set(rulesets) & set(family)]


_SHOWN = ("title", "category", "severity", "why", "fix", "shown", "ruleset_ord", "step", "rule_ord")


def _rule_table(spark, rules: list[RuleSpec]) -> DataFrame:
    """The rules as a dimension: one row per rule, so its size is known."""
    rows = [
        (key, r.rule_id, r.title, r.category, r.severity, r.why, r.fix, r.code,
         r.min_depth, r.max_depth, r.in_sync, r.in_async, r.first_only, r.fallback,
         RULESET_ORDER.index(r.ruleset), r.step, key)
        for key, r in enumerate(rules, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "rule int, rule_id string, title string, category string, severity string, why string, "
        "fix string, shown string, min_depth int, max_depth int, needs_sync boolean, "
        "needs_async boolean, first_only boolean, fallback boolean, ruleset_ord int, "
        "step int, rule_ord int")


def _file_facts(files: DataFrame, key: list[str]) -> DataFrame:
    """Facts about whole files that rules ask for, taken before the file is split."""
    def runs(*rulesets):
        return F.col("family").isin(_family_numbers(*rulesets))

    body = F.col("content")
    java, node, python = runs("java"), runs("node"), runs("python")
    braces = runs(*[r for r, kind in scope.SCOPE_KIND.items() if kind == scope.BRACES])
    names = F.array(*[F.array(*map(F.lit, family)) for family in _families()])
    files = files.select(
        *key, (F.array_position(names, F.col("rulesets")) - 1).cast("int").alias("family"),
        text.unix_newlines(F.coalesce("content", F.lit(""))).alias("content"),
        F.col("content").isNull().alias("unreadable"),
    ).select(
        "*",
        # only a file that names both words is worth stripping of its comments
        F.when(java & has(body, "getInstance") & has(body, fixed.SYNC_PREFIX),
               text.without_comments(body)).alias("code_only"),
    )
    code = F.col("code_only")
    in_braces = matches(body, _INDENTED + r"(?:foreach|for|while|do)(?:[\s\x1c-\x1f(]|$)")
    in_indent = matches(body, _INDENTED + r"(?:for|while)[ (]")
    return files.select(
        *key, "family", "content", "unreadable",
        F.coalesce(
            has(code, "getInstance") & has(code, fixed.SYNC_PREFIX)
            & matches(code, fixed.P_JAVA_NULL_CHECK) & ~matches(code, fixed.P_JAVA_VOLATILE),
            F.lit(False)).alias("unsafe_singleton"),
        (java & matches(body, fixed.P_JAVA_CATCH_NUMBER, "NumberFormatException"))
        .alias("catches_bad_numbers"),
        (java & ~has(body, "FetchType.LAZY")).alias("no_lazy_fetch"),
        (runs("frontend") & has(body, "useEffect")
         & ~has(body, "removeEventListener", "clearInterval")).alias("effect_without_cleanup"),
        (node & (has(body, "getServerSideProps", "async function")
                 | has(F.lower("path"), "/app/"))).alias("server_code"),
        (node & has(F.lower(body), "@component", "*ngfor")).alias("angular_template"),
        # files without any header have depth 0 throughout: their brackets stay at home
        F.when(braces & (has(body, fixed.SYNC_PREFIX) | in_braces), scope.BRACES)
        .when(python & (has(body, fixed.ASYNC_PREFIX) | in_indent), scope.INDENT)
        .alias("kind"),
    )


_FACTS = ("unreadable", "unsafe_singleton", "catches_bad_numbers", "no_lazy_fetch",
          "effect_without_cleanup", "server_code", "angular_template")


def _lines(files: DataFrame, key: list[str]) -> DataFrame:
    rows = F.split("content", "\n", -1)
    front = F.col("family").isin(_family_numbers("frontend"))
    blank = F.array(F.lit(""))
    none = F.array().cast("array<string>")
    # The two lines before each line, where the front-end rules look at them.
    zipped = F.arrays_zip(
        rows.alias("raw"),
        F.when(front, F.concat(blank, rows)).otherwise(none).alias("prev"),
        F.when(front, F.concat(blank, blank, rows)).otherwise(none).alias("prev2"),
    )
    lines = files.select(*key, "family", "kind", *_FACTS,
                         F.posexplode(zipped).alias("pos", "z"))
    return text.evaluated(
        lines.where(F.col("z.raw").isNotNull()),
        [*key, "family", "kind", *_FACTS, (F.col("pos") + 1).alias("line")],
        raw=F.col("z.raw"),
        s=text.strip(F.col("z.raw")),
        near=F.when(front, F.concat("z.prev2", "z.prev", "z.raw")),
    )


def _with_hits(lines: DataFrame, rules: list[RuleSpec]) -> DataFrame:
    """Add ``hits``: keys of the rules whose predicate holds on the line, scopes aside.

    The rules are evaluated a few at a time.  Spark makes one method of each step, and the
    JVM compiles methods of a limited size only; all rules at once would run uncompiled.  For
    the same reason there is no lambda here, which would leave generated code altogether.
    """
    line = Line(
        s=F.col("s"), raw=F.col("raw"), near=F.col("near"), path=F.col("path"),
        fact=lambda name: F.col("line") == 1 if name == "first_line" else F.col(name))
    keep = lines.columns
    lines = lines.withColumn("hits", F.array().cast("array<int>"))
    for number, family in enumerate(_families()):
        keyed = [(k, r) for k, r in enumerate(rules, start=1) if r.ruleset in family]
        for at in range(0, len(keyed), RULES_AT_ONCE):
            keys = F.array(*[
                F.when(rule.predicate(line), F.lit(key)).otherwise(F.lit(0))
                for key, rule in keyed[at:at + RULES_AT_ONCE]])
            found = F.concat("hits", F.array_remove(keys, F.lit(0)))
            lines = text.evaluated(
                lines, keep,
                hits=F.when(F.col("family") == number, found).otherwise(F.col("hits")))
    return lines


def scan(sources: DataFrame, rules: list[RuleSpec] | None = None, placed: bool = False,
         keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of ``sources`` (``repo, path, content``), one row per finding.

    ``rules`` are the catalogue by default; give ``CATALOGUE + [your RuleSpec]`` to add your
    own.  Order by ``repo`` and ``SCAN_ORDER`` to get the scan order.  ``placed`` says that :func:`joins.parted`
    has exchanged the files by their key.  Columns to ``keep`` tell files of one name apart and stay with the findings.
    """
    key = [*file_key(sources), *keep]
    asked = CATALOGUE if rules is None else rules
    rulesets = {rule.ruleset for rule in asked}
    rules = list(asked) + [rule for rule in _error_rules() if rule.ruleset in rulesets]

    files = with_rulesets(sources).where(
        F.arrays_overlap("rulesets", F.array(*map(F.lit, sorted(rulesets)))))
    scoped, n = any(rule.scoped for rule in rules), partitions(sources)
    if scoped and n is not None and not placed:
        # as rows of a file each, texts take less than the lines that matter, and evaluate evenly
        files = parted(files.select(*key, "content", "ext", "rulesets"), n, *key)
    lines = _with_hits(_lines(_file_facts(files, key), key), rules)

    hit = F.size("hits") > 0
    if scoped:
        rows = lines.select(
            *key, "line", "hits", F.when(hit, F.col("s")).alias("s"),
            *scope.line_facts(F.col("kind"), F.col("raw"), F.col("s")),
        ).where(scope.matters(hit))
        rows = scope.add_scopes(rows, "hits", "s", placed=n is not None, keep=keep).where(hit)
    else:
        rows = lines.where(hit).select(
            *key, "line", "hits", "s", F.lit(0).alias("loop_depth"),
            F.lit(False).alias("in_sync"), F.lit(False).alias("in_async"))

    # what decides is joined before the window over a file's hits, what is only shown behind it
    table = _rule_table(sources.sparkSession, rules)
    found = rows.withColumn("rule", F.explode("hits")).drop("hits").join(
        F.broadcast(table.drop(*_SHOWN)), "rule"
    ).where(
        (F.col("loop_depth") >= F.col("min_depth"))
        & (F.col("max_depth").isNull() | (F.col("loop_depth") <= F.col("max_depth")))
        & (~F.col("needs_sync") | F.col("in_sync"))
        & (~F.col("needs_async") | F.col("in_async"))
    )
    if any(rule.first_only for rule in rules):
        of_rule = Window.partitionBy(*key, "rule_id")
        place = F.struct("fallback", "line")
        found = found.withColumn("first", F.min(place).over(of_rule)).where(
            ~F.col("first_only") | (place == F.col("first")))
    found = found.join(F.broadcast(table.select("rule", *_SHOWN)), "rule")

    error = F.col("rule_id") == fixed.DETECTOR_ERROR[0]
    return found.select(
        *key, "rule_id",
        F.when(error, F.concat("title", "path")).otherwise(F.col("title")).alias("title"),
        "category", "severity", "line",
        F.coalesce("shown", "s").alias("code"),
        "why", "fix", "ruleset_ord", "step", "rule_ord")
