"""The registered queries: each runs one operator or plan over the whole supplied tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import (history, lines, own_rules, policy, pruned, report, retrieval, scan, scope,
                         tickets, verdicts)
from ..operators.own_rules import FileRule
from ..rules import CATALOGUE, RuleSpec, rules_for
from ..sources import contents
from ..sources import diffs as diff_source
from ..sources import notes as note_source
from ..sources.lifecycle import LifecycleTable
from ..sources.literals import LiteralIndex
from ..sources.shared import staged, work_folder
from . import corpus, review

SHOWN = ("repo", "path", "line", "rule_id", "category", "severity", "code")
ORDER = ["path", "ruleset_ord", "step", "line", "rule_ord"]
TICKET_POLICY = tickets.TicketPolicy(
    project_key="KEY", min_severity="HIGH", labels=["code review", "nightly"])


def _scan(*rulesets):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rules = rules_for(*rulesets) if rulesets else None
        return scan.scan(corpus.sources(spark, sf), rules).select(*SHOWN)
    return query


def _of_extension(spark, sf, *extensions):
    files = corpus.sources(spark, sf)
    return files.where(text.extension(F.col("path")).isin(list(extensions)))


# --- lines and scopes ---------------------------------------------------------------------

def lines_explode(spark, sf):
    return lines.explode_lines(corpus.sources(spark, sf))


def code_lines_kept(spark, sf):
    """Lines of each ruleset that are neither blank nor a comment, counted by file."""
    files = lines.with_rulesets(corpus.sources(spark, sf))
    rows = files.select(
        "repo", "path", "rulesets", F.explode(text.split_lines(F.col("content"))).alias("raw"))
    rows = text.evaluated(rows, ["repo", "path", "rulesets"], s=text.strip(F.col("raw")))
    rows = rows.select("repo", "path", "s", F.explode("rulesets").alias("ruleset"))
    return rows.where(~lines.skipped(F.col("s"), F.col("ruleset"))).groupBy("repo", "path", "ruleset").agg(
        F.count("*").alias("n"))


def file_rulesets(spark, sf):
    return lines.with_rulesets(corpus.sources(spark, sf)).select(
        "repo", "path", "ext", F.posexplode("rulesets").alias("ord", "ruleset"))


def brace_scope(spark, sf):
    files = _of_extension(spark, sf, ".java", ".cs", ".c", ".js", ".tsx")
    rows = scope.annotate(lines.explode_lines(files), scope.BRACES)
    return rows.select("repo", "path", "line", "loop_depth", "in_sync")


def _indent(spark, sf):
    files = _of_extension(spark, sf, ".py")
    return scope.annotate(lines.explode_lines(files), scope.INDENT)


def indent_scope(spark, sf):
    return _indent(spark, sf).select("repo", "path", "line", "loop_depth")


def async_scope(spark, sf):
    return _indent(spark, sf).select("repo", "path", "line", "in_async")


# --- rules --------------------------------------------------------------------------------

def n_plus_one_by_file(spark, sf):
    rules = [r for r in CATALOGUE if r.rule_id == "java.n_plus_one"]
    found = scan.scan(corpus.sources(spark, sf), rules)
    return found.groupBy("repo", "path").agg(F.count("*").alias("n"))


def findings_by_severity(spark, sf):
    found = scan.scan(corpus.sources(spark, sf))
    return found.groupBy("repo", "severity").agg(F.count("*").alias("n"))


def first_hit_per_file(spark, sf):
    rules = [r for r in CATALOGUE if r.first_only]
    return scan.scan(corpus.sources(spark, sf), rules).select(*SHOWN)


def user_rule(spark, sf):
    """A rule of one's own next to the catalogue, with a scope and a ruleset."""
    own = RuleSpec(
        "own.return_in_loop", "python", lambda c: c.s.startswith("return"),
        "The loop ends early.", "Look at it.", min_depth=1,
        title="Return in a loop", category="ALGORITHMIC", severity="LOW")
    return scan.scan(corpus.sources(spark, sf), rules_for("python") + [own]).select(*SHOWN)


def user_udtf_rule(spark, sf):
    """Two rules in Python; one raises on some files."""
    def third_time(path, content):
        """Lines that a file has for the third time."""
        seen = {}
        for number, row in enumerate(content.split("\n"), 1):
            row = row.strip(" ")
            seen[row] = seen.get(row, 0) + 1
            if row and seen[row] == 3:
                yield number, row

    def last_line(path, content):
        rows = content.split("\n")
        if len(rows) % 7 == 0:
            raise ValueError("a multiple of seven")
        yield len(rows), rows[-1].strip(" ")

    rules = [
        FileRule("own.third_time", (".py", ".sql"), third_time, "Repeated line", "ALGORITHMIC", "LOW", "It is there twice.", "Name it."),
        FileRule("own.last_line", (".sql", ".txt"), last_line, "Last line", "MEMORY", "MEDIUM", "It is the last.", "Look at it.")]
    return own_rules.own_findings(corpus.sources(spark, sf), rules).select(*SHOWN, "title")


def literal_index_scan(spark, sf):
    """A rule added later, over the files that an index of pieces names."""
    words = ("getConnection", "newCachedThreadPool")
    rule = RuleSpec(
        "own.pool", "java", lambda c: text.has(c.s, *words), "It opens something.", "Reuse it.",
        title="Opened", category="RESOURCE", severity="LOW")
    files = corpus.sources(spark, sf)
    return LiteralIndex.write(files).scan(files, rule, words).select(*SHOWN)


def detector_errors(spark, sf):
    found = scan.scan(corpus.broken_sources(spark, sf))
    return found.where(F.col("rule_id").startswith("engine.")).select(*SHOWN, "title")


def scan_incremental(spark, sf):
    """Two heads into one store: the second scan sees the contents that the first did not have."""
    files, store = corpus.at_heads(spark, sf), contents.ContentStore.new(spark)
    store.scan(files.where(F.col("commit_sha") == corpus.HEADS[0]), "first")
    return store.scan(files, "second").select("commit_sha", *SHOWN)


# --- changes and policy -------------------------------------------------------------------

def diff_changed_lines(spark, sf):
    return diff_source.changed_lines(corpus.diffs(spark, sf))


def diff_changed_inline(spark, sf):
    """The same by a fold within each row, as streams use it."""
    rows = diff_source.changed_files(corpus.diffs(spark, sf), "repo", "push_id")
    return rows.select("repo", "push_id", "path", F.explode(diff_source.lines_of(F.col("ranges"))).alias("line"))


def changed_scope_semi(spark, sf):
    """Findings of all rulesets on the lines that any push changed.  These choose the files and cut the findings: made once."""
    changed = staged(diff_source.changed_lines(corpus.diffs(spark, sf)).select("repo", "path", "line").distinct())
    files = policy.touched_files(corpus.sources(spark, sf), changed)
    return policy.on_changed_lines(scan.scan(files, placed=True), changed).select(*SHOWN)


def changed_review_commits(spark, sf):
    """Findings on the lines changed at each of two heads, at which some files differ."""
    changed = staged(diff_source.changed_lines(corpus.heads(corpus.diffs(spark, sf), F.col("push_id"))))
    files = corpus.at_heads(spark, sf)
    rules = review.ReviewPolicy(ignore_paths=["f1/"])
    return review.review(files, changed, rules).select("commit_sha", *SHOWN)


def review_gate(spark, sf):
    """From files, pushes and answers of a model to counts and verdict of each head.  Changed lines are read by all: made once."""
    changed = staged(diff_source.changed_lines(corpus.heads(corpus.diffs(spark, sf), F.col("push_id"))).select(
        "repo", "commit_sha", "path", "line").distinct())
    at = changed
    answers = at.withColumn("raw", F.when(F.col("line") % 3 == 0, '{"confirmed": false}').when(
        F.col("line") % 3 == 1, 'Sure: {"severity": "critical"}.').otherwise("no idea"))
    runs = at.select("repo", "commit_sha").distinct()
    rules = review.ReviewPolicy(fail_on="HIGH", ignore_rules=["sql.select_star"])
    rows = review.gated(corpus.at_heads(spark, sf), changed, answers, runs, rules)
    return rows.select("repo", "commit_sha", "total", *history.COUNTS, "failed")


def policy_filters(spark, sf):
    changed = diff_source.changed_lines(corpus.diffs(spark, sf))
    kept = policy.reviewable(changed, ["f1/", "f2", "tests/"])
    return kept.groupBy("repo", "path").agg(F.count("*").alias("n"))


def confirmed_findings(spark, sf):
    rows = policy.without_rules(corpus.findings_log(spark, sf), ["click", "other"])
    return policy.without_false_positives(rows).groupBy("rule_id").agg(F.count("*").alias("n"))


# --- history ------------------------------------------------------------------------------

def _history(spark, sf):
    return corpus.runs(spark, sf), corpus.findings_log(spark, sf)


def fingerprints(spark, sf):
    return history.distinct_findings(corpus.findings_log(spark, sf))


def run_severity_counts(spark, sf):
    runs, log = _history(spark, sf)
    return history.run_summaries(runs, log).select(
        "repo", "run_id", "total", *history.COUNTS)


def run_numbers(spark, sf):
    return history.number_runs(corpus.runs(spark, sf)).select("repo", "run_id", "run_ord")


def run_deltas(spark, sf):
    runs, log = _history(spark, sf)
    return history.run_deltas(history.number_runs(runs), log).select(
        "repo", "run_id", "introduced", "fixed")


def run_history(spark, sf):
    runs, log = _history(spark, sf)
    return history.run_history(runs, log, 20).select(
        "repo", "run_id", "age", "total", "critical", "introduced", "fixed")


def fix_rate(spark, sf):
    runs, log = _history(spark, sf)
    return history.fix_rate(runs, log).withColumns({
        "percent": report.whole_percent(F.col("fix_rate")),
        "fix_rate": F.round("fix_rate", 6)})


def _lifecycle(spark, sf):
    """Three batches, by the time of their runs, into a table of intervals."""
    runs, log = _history(spark, sf)
    table, cuts = LifecycleTable.new(spark), (0, 1_704_931_200, 1_705_795_200, 1 << 40)
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        of_batch = (F.col("run_id") >= begin) & (F.col("run_id") < end)
        table.add(runs.where(of_batch), log.where(of_batch))
    return table


def lifecycle_deltas(spark, sf):
    return _lifecycle(spark, sf).deltas().select("repo", "run_id", "introduced", "fixed")


def lifecycle_fix_rate(spark, sf):
    return _lifecycle(spark, sf).fix_rate().withColumns({
        "percent": report.whole_percent(F.col("fix_rate")),
        "fix_rate": F.round("fix_rate", 6)})


def lifecycle_intervals(spark, sf):
    """Every interval, closed or open (``to_ord`` null)."""
    versions = _lifecycle(spark, sf).versions
    opened = versions.read("state").where("open_from IS NOT NULL").select(
        "repo", "fingerprint", F.col("open_from").alias("from_ord"), F.lit(None).cast("int").alias("to_ord"))
    return versions.read("closed").unionByName(opened)


def gate_verdict(spark, sf):
    runs, log = _history(spark, sf)
    return history.gate(runs, log, "HIGH").select("repo", "run_id", "failed")


def latest_runs_topn(spark, sf):
    return history.newest_runs(corpus.runs(spark, sf), 20).select("repo", "run_id", "age")


# --- tickets ------------------------------------------------------------------------------

def _queue(spark, sf, dry_run=False):
    return tickets.queue(
        corpus.findings_log(spark, sf), corpus.tickets(spark, sf), TICKET_POLICY,
        ["event_id"], dry_run)


def ticket_queue(spark, sf):
    return _queue(spark, sf).where(F.col("status") == "created").select(
        "event_id", "fingerprint", tickets.summary_line(TICKET_POLICY).alias("summary"))


def ticket_skipped(spark, sf):
    return _queue(spark, sf).where(F.col("status") == "skipped").select(
        "event_id", "fingerprint", "issue_key")


def ticket_payloads(spark, sf):
    rows = tickets.with_payload(_queue(spark, sf, dry_run=True), TICKET_POLICY)
    fields = F.col("payload.fields")
    return rows.where(F.col("status") == "created").select(
        "event_id", "issue_key", fields["project"]["key"].alias("project"),
        fields["summary"].alias("summary"), fields["description"].alias("description"),
        F.array_join(fields["labels"], ",").alias("labels"))


def ticket_upsert(spark, sf):
    new = _queue(spark, sf).where(F.col("status") == "created").select(
        "fingerprint", F.concat(F.lit("N-"), F.col("event_id").cast("string")).alias("issue_key"),
        F.lit("/new").alias("url"), F.col("run_id").alias("created_ts"), "severity", "title")
    again = corpus.tickets(spark, sf).where(F.col("created_ts") < 1_704_200_000).withColumns({
        "issue_key": F.concat(F.lit("R-"), "issue_key"), "url": F.lit("/again")})
    return tickets.upsert(corpus.tickets(spark, sf), new.unionByName(again))


def ticket_summary(spark, sf):
    return tickets.summary(_queue(spark, sf))


# --- knowledge ----------------------------------------------------------------------------

def term_frequency(spark, sf):
    found = retrieval.term_frequency(corpus.queries(spark, sf), "q_id")
    return found.select("q_id", "term", "n", F.round("tf", 6).alias("tf"))


def document_frequency(spark, sf):
    return retrieval.document_frequency(retrieval.terms(corpus.queries(spark, sf), "q_id"))


def kb_top2(spark, sf):
    queries = corpus.spread(corpus.queries(spark, sf))
    best = retrieval.best_notes(queries, "q_id", corpus.notes(spark, sf))
    return best.select("q_id", "note_ord", F.round("score", 6).alias("score"), "rank")


def kb_top2_pruned(spark, sf):
    """The same from an index with bounds."""
    queries = corpus.spread(corpus.queries(spark, sf))
    index = pruned.NoteIndex.of(corpus.notes(spark, sf)).stored(f"{work_folder(spark)}/notes-{uuid.uuid4().hex}")
    best = pruned.best_notes(queries, "q_id", index)
    return best.select("q_id", "note_ord", F.round("score", 6).alias("score"), "rank")


def kb_references(spark, sf):
    """Topics for each rule, over the built-in notes and the supplied passages."""
    indexed = corpus.notes(spark, sf).select(
        F.col("note_ord").alias("pos"), "id", "topic", "text")
    base = note_source.knowledge_base(note_source.built_in(spark), indexed)
    found = retrieval.retrieved(corpus.queries(spark, sf), "q_id", base, 3)
    return found.select("q_id", F.array_join("kb_refs", "|").alias("kb_refs"))


def knowledge_base(spark, sf):
    chunked = note_source.chunk_documents(
        corpus.table(spark, sf, "documents").select("doc_id", "text"), "\n")
    indexed = chunked.select("doc_id", "pos", F.when(F.col("pos") > 0, F.col("id")).alias("id"),
                             F.when(F.col("pos") > 1, F.col("topic")).alias("topic"), "text")
    base = note_source.knowledge_base(note_source.built_in(spark), indexed)
    return base.groupBy("topic").agg(
        F.count("*").alias("n"), F.count_if(F.col("id") == "pdf").alias("unnamed"),
        F.count_distinct("note_ord").alias("keys"))


def greedy_chunks(spark, sf):
    docs = corpus.spread(corpus.table(spark, sf, "documents").select("doc_id", "text"))
    return note_source.chunk_documents(docs, "\n")


# --- review -------------------------------------------------------------------------------

def verdict_parse(spark, sf):
    return verdicts.parse(corpus.verdicts(spark, sf)).drop("raw")


def verdict_merge(spark, sf):
    merged = verdicts.merge(
        corpus.findings_log(spark, sf), verdicts.parse(corpus.verdicts(spark, sf)), ["event_id"])
    return policy.without_false_positives(merged).select(
        "event_id", "confirmed", "severity", "explanation", "fix")


def review_cap(spark, sf):
    # read for the border and for the rows: scanned once
    found = staged(scan.scan(corpus.sources(spark, sf)).select("repo", *ORDER, "rule_id"))
    return verdicts.review_cap(found, ["repo"], ORDER).groupBy("repo", "rule_id", "reviewed").agg(
        F.count("*").alias("n"))


def context_windows(spark, sf):
    """Around the line of every finding."""
    files = corpus.sources(spark, sf)
    return verdicts.context_windows(scan.scan(files), files)


def prompt_rows(spark, sf):
    """For every finding.  Rule texts, windows and rows each read the findings: scanned once."""
    files = corpus.sources(spark, sf)
    rows = verdicts.prompts(staged(scan.scan(files)), files, note_source.built_in(spark))
    return rows.select("repo", "path", "line", "rule_id", "severity",
                       F.array_join("kb_refs", "|").alias("kb_refs"), "prompt")


# --- reports ------------------------------------------------------------------------------

def report_rows(spark, sf):
    rows = report.report_rows(corpus.findings_log(spark, sf))
    return rows.select("event_id", "rank", "file", "line", "rule_id", "severity_title", "label",
                       "tag", "code").orderBy("rank", "file", "line", "rule_id", "event_id")


def severity_badges(spark, sf):
    runs, log = _history(spark, sf)
    rows = report.severity_badges(history.run_summaries(runs, log), "repo", "run_id")
    shown = F.transform("badges", lambda b: F.concat(b["n"].cast("string"), F.lit(" "), b["severity"]))
    return rows.select("repo", "run_id", F.array_join(shown, "  ").alias("badges"))


def report_document(spark, sf):
    return _documents(spark, sf, report.PAGE_ROWS)


def report_pages(spark, sf):
    """The same over small pages: order and size hold over the pages of a run."""
    return _documents(spark, sf, 7)


def _documents(spark, sf, page_rows):
    runs, log = _history(spark, sf)
    docs = report.report_documents(log, ["repo", "run_id"], F.lit(False), page_rows, runs)
    first = F.get("findings", F.lit(0))
    return docs.select(
        "repo", "run_id", "page", "engine", "total", F.size("findings").alias("listed"),
        F.coalesce(F.element_at("by_severity", "CRITICAL"), F.lit(0)).alias("critical"),
        F.array_join(F.transform("findings", lambda f: f["event_id"].cast("string")), ",")
        .alias("listed_events"), first["severity"].alias("worst"))


def findings_json(spark, sf):
    rows = corpus.findings_log(spark, sf).select(
        "event_id", "rule_id", "severity", "file", "line", "code", "confirmed")
    return report.json_rows(rows)


def trend_series(spark, sf):
    runs, log = _history(spark, sf)
    rows = report.trend_series(history.run_history(runs, log, 20))
    return rows.select("repo", "run_id", "shown_at", "label", F.round("height", 6).alias("height"),
                       F.round("critical_share", 6).alias("critical_share"))


QUERIES = {
    "lines_explode": lines_explode,
    "code_lines_kept": code_lines_kept,
    "file_rulesets": file_rulesets,
    "brace_scope": brace_scope,
    "indent_scope": indent_scope,
    "async_scope": async_scope,
    "n_plus_one_by_file": n_plus_one_by_file,
    "scan_java": _scan("java"),
    "scan_python": _scan("python"),
    "scan_sql": _scan("sql"),
    "scan_csharp": _scan("csharp"),
    "scan_c": _scan("c"),
    "scan_frontend": _scan("frontend"),
    "scan_node": _scan("node"),
    "findings_all": _scan(),
    "findings_by_severity": findings_by_severity,
    "first_hit_per_file": first_hit_per_file,
    "user_rule": user_rule,
    "user_udtf_rule": user_udtf_rule,
    "literal_index_scan": literal_index_scan,
    "detector_errors": detector_errors,
    "scan_incremental": scan_incremental,
    "diff_changed_lines": diff_changed_lines,
    "diff_changed_inline": diff_changed_inline,
    "changed_scope_semi": changed_scope_semi,
    "changed_review_commits": changed_review_commits,
    "review_gate": review_gate,
    "policy_filters": policy_filters,
    "confirmed_findings": confirmed_findings,
    "fingerprints": fingerprints,
    "run_severity_counts": run_severity_counts,
    "run_numbers": run_numbers,
    "run_deltas": run_deltas,
    "run_history": run_history,
    "fix_rate": fix_rate,
    "lifecycle_deltas": lifecycle_deltas,
    "lifecycle_fix_rate": lifecycle_fix_rate,
    "lifecycle_intervals": lifecycle_intervals,
    "gate_verdict": gate_verdict,
    "latest_runs_topn": latest_runs_topn,
    "ticket_queue": ticket_queue,
    "ticket_skipped": ticket_skipped,
    "ticket_payloads": ticket_payloads,
    "ticket_upsert": ticket_upsert,
    "ticket_summary": ticket_summary,
    "term_frequency": term_frequency,
    "document_frequency": document_frequency,
    "kb_top2": kb_top2,
    "kb_top2_pruned": kb_top2_pruned,
    "kb_references": kb_references,
    "knowledge_base": knowledge_base,
    "greedy_chunks": greedy_chunks,
    "verdict_parse": verdict_parse,
    "verdict_merge": verdict_merge,
    "review_cap": review_cap,
    "context_windows": context_windows,
    "prompt_rows": prompt_rows,
    "report_rows": report_rows,
    "severity_badges": severity_badges,
    "report_document": report_document,
    "report_pages": report_pages,
    "findings_json": findings_json,
    "trend_series": trend_series,
}
