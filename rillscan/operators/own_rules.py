"""Rules in Python, for what no expression over a line can state.

A :class:`FileRule` sees a whole file.  Spark calls the rules as a table function, joined
laterally with the rows of the files: files stay where they are, their text goes to Python in Arrow batches,
and only line numbers and code come back.  The catalogue stays in the JVM; these rules add to it.

A rule that raises does not stop the scan.  What it found in that file is dropped, and the file
gets the finding of a broken detector instead, with the error as its reason.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from . import scan
from .lines import file_key

FOUND = "rule int, line int, code string, error string"
_SHOWN_ERROR = 500


@dataclass(frozen=True)
class FileRule:
    """``analyze`` takes path and text of a file and gives (line, code) pairs; ``extensions`` in lower case, with the dot."""

    rule_id: str
    extensions: tuple[str, ...]
    analyze: Callable[[str, str], Iterable[tuple[int, str]]]
    title: str
    category: str
    severity: str
    why: str
    fix: str


def table_function(rules: list[FileRule]):
    """The rules as a table function of path, extension and text; register it to call it from SQL.

    Only the functions of the rules are sent to the tasks.
    """
    sent = tuple((rule.extensions, rule.analyze) for rule in rules)

    class Findings:
        def eval(self, path: str, extension: str, content: str):
            for number, (extensions, analyze) in enumerate(sent):
                if extension not in extensions:
                    continue
                try:
                    if content is None:
                        raise ValueError("the file has no text")
                    found = [(number, int(line), None if code is None else str(code), None)
                             for line, code in analyze(path, content)]
                except Exception as error:  # noqa: BLE001 - whatever a rule raises is its finding
                    yield number, 1, "", f"{type(error).__name__}: {error}"[:_SHOWN_ERROR]
                else:
                    yield from found

    return F.udtf(Findings, returnType=FOUND, useArrow=True)


def register(spark: SparkSession, name: str, rules: list[FileRule]) -> None:
    """For SQL: ``SELECT ... FROM files, LATERAL name(path, extension, content)``."""
    spark.udtf.register(name, table_function(rules))


def _dimension(spark: SparkSession, rules: list[FileRule]) -> DataFrame:
    """One row for each rule."""
    first = len(scan.RULESET_ORDER)
    rows = [(i, r.rule_id, r.title, r.category, r.severity, r.why, r.fix, first + i) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "rule int, rule_id string, title string, category string, severity string, why string, fix string, ruleset_ord int")


def own_findings(sources: DataFrame, rules: list[FileRule]) -> DataFrame:
    """Findings of the rules with the columns of :func:`scan.scan`; in scan order they follow the catalogue's."""
    if len({r.rule_id for r in rules}) < len(rules):
        raise ValueError("each rule needs an id of its own")
    key = file_key(sources)
    wanted = sorted({e for r in rules for e in r.extensions})
    files = sources.select(*key, text.extension("path").alias("extension"), text.unix_newlines(F.col("content")).alias("content"))
    files = files.where(F.col("extension").isin(wanted))
    found = files.lateralJoin(table_function(rules)(
        F.col("path").outer(), F.col("extension").outer(), F.col("content").outer()))
    rows = found.select(*key, "rule", "line", "code", "error").join(
        F.broadcast(_dimension(sources.sparkSession, rules)), "rule")
    rule_id, title, category, severity = fixed.DETECTOR_ERROR
    broken = F.col("error").isNotNull()

    def either(error, own):
        return F.when(broken, error).otherwise(F.col(own)).alias(own)

    return rows.select(
        *key, either(F.lit(rule_id), "rule_id"), either(F.concat(F.lit(title), "path"), "title"),
        either(F.lit(category), "category"), either(F.lit(severity), "severity"), "line", "code",
        either(F.concat(F.lit("A rule failed on this file: "), "error"), "why"),
        either(F.lit("Mend the rule; the file may be fine."), "fix"),
        "ruleset_ord", F.lit(1).alias("step"), F.lit(0).alias("rule_ord"))


def scan_with(sources: DataFrame, rules: list[FileRule], catalogue=None) -> DataFrame:
    """The scan of the catalogue and of one's own rules."""
    return scan.scan(sources, catalogue).unionByName(own_findings(sources, rules))
