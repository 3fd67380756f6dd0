"""Ticket queue: what to file, what is filed already, and the table of filed tickets.

Nothing is sent anywhere; the queue and the payloads are tables.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import severity
from .joins import lookup

TICKET = ("fingerprint", "issue_key", "url", "created_ts", "severity", "title")


@dataclass(frozen=True)
class TicketPolicy:
    project_key: str = ""
    issue_type: str = "Bug"
    min_severity: str = "CRITICAL"
    labels: list = field(default_factory=lambda: ["code-review"])
    include_code: bool = True
    summary_prefix: str = "[Code Review]"


def eligible(findings: DataFrame, policy: TicketPolicy) -> DataFrame:
    bar = severity.threshold(policy.min_severity, fixed.TICKET_DEFAULT_THRESHOLD)
    return findings.where(severity.rank(F.col("severity")) <= bar)


def queue(findings: DataFrame, tickets: DataFrame | None, policy: TicketPolicy,
          order: list[str], dry_run: bool = False) -> DataFrame:
    """Eligible findings with ``status`` (``created`` or ``skipped``) and ``issue_key``.

    A filed fingerprint is skipped and shows its key.  Live, only the first finding of a
    fingerprint (by ``order``, which must tell findings apart) is filed and the others are
    skipped; a dry run files nothing, so it lists them all.  Without a store of tickets
    (``tickets`` is None) nothing is known to be filed, and every finding is.
    """
    rows = eligible(findings, policy)
    if tickets is None:
        return rows.withColumns({
            "status": F.lit("created"), "issue_key": F.lit("(dry-run)" if dry_run else None).cast("string")})
    place = F.struct(*order)
    # One row per fingerprint, combined on the map side: a finding that occurs in a third of
    # all runs is a single row here.
    known = rows.groupBy("fingerprint").agg(F.min(place).alias("first"))
    known = known.join(tickets.select("fingerprint", "issue_key"), "fingerprint", "left")
    rows = rows.join(known, "fingerprint")  # one row a fingerprint; a hot one is split at run time
    files = F.col("issue_key").isNull()
    if not dry_run:
        files = files & (place == F.col("first"))
    return rows.withColumn(
        "status", F.when(files, "created").otherwise("skipped")
    ).withColumn(
        "issue_key", F.when(files & F.lit(dry_run), "(dry-run)").otherwise(F.col("issue_key"))
    ).drop("first")


def summary(queued: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row: eligible, created, skipped.  Filing errors belong to whoever files."""
    return queued.agg(
        F.count("*").alias("eligible"),
        F.count_if(F.col("status") == "created").alias("created"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    ).withColumn("dry_run", F.lit(dry_run))


def summary_line(policy: TicketPolicy) -> Column:
    return F.left(
        F.concat(F.lit(f"{policy.summary_prefix} "), "severity", F.lit(": "), "title", F.lit(" ("),
                 "file", F.lit(":"), F.col("line").cast("string"), F.lit(")")),
        F.lit(fixed.SUMMARY_CHARS))


def _description(policy: TicketPolicy) -> Column:
    def given(column, *parts):
        return F.when(F.coalesce(column, F.lit("")) != "", F.concat(*parts))

    code = F.left("code", F.lit(fixed.TICKET_CODE_CHARS))
    place = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("*Rule:* "), "rule_id"),
        F.concat(F.lit("*Severity:* "), "severity"),
        F.concat(F.lit("*Category:* "), "category"),
        F.concat(F.lit("*Location:* {{"), place, F.lit("}}")),
        F.concat(F.lit("*Reason:* "), "why"),
        F.concat(F.lit("*Fix:* "), "fix"),
        given(F.col("explanation"), F.lit("*Reviewer note:* "), F.col("explanation")),
        given(F.col("code"), F.lit("{code}\n"), code, F.lit("\n{code}"))
        if policy.include_code else F.lit(None),
    )


def labels(policy: TicketPolicy) -> Column:
    own = F.concat(F.lit("sev-"), F.lower("severity"))
    return F.transform(
        F.array(*map(F.lit, policy.labels), own), lambda one: F.replace(one, F.lit(" "), F.lit("-")))


def with_payload(queued: DataFrame, policy: TicketPolicy) -> DataFrame:
    """Add ``payload``: the document to file, as a struct (``to_json`` gives its text)."""
    return queued.withColumn("payload", F.struct(F.struct(
        F.struct(F.lit(policy.project_key).alias("key")).alias("project"),
        summary_line(policy).alias("summary"),
        _description(policy).alias("description"),
        F.struct(F.lit(policy.issue_type).alias("name")).alias("issuetype"),
        labels(policy).alias("labels"),
    ).alias("fields")))


def upsert(tickets: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables with one row per fingerprint: the latest, and on a tie the new one."""
    def tagged(df, is_new):
        return df.select("fingerprint", F.struct(
            "created_ts", F.lit(is_new).alias("is_new"), *[
                c for c in TICKET if c not in ("fingerprint", "created_ts")]).alias("row"))

    return (
        tagged(tickets, 0).unionByName(tagged(new, 1))
        .groupBy("fingerprint").agg(F.max("row").alias("row"))
        .select(*["fingerprint" if c == "fingerprint" else F.col(f"row.{c}") for c in TICKET])
    )
