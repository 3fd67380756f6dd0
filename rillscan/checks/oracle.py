"""The same results in the SQL of the checking engine.

The SQL is written on its own, often by another way than the Spark code: indent scopes are
found level by level, braces by groups between openings, changed lines from the numbers the
diff text was made of.  Only the templates and the table of rule names are shared.
"""

import re

from .. import fixed
from ..plans.corpus import EXTENSIONS, TEMPLATES
from ..rules import CATALOGUE
from ..sources.notes import BUILT_IN


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


_TEMPLATES = ",\n".join(f"({_text(e)}, {_list(rows)})" for e, rows in TEMPLATES.items())



def _corpus(documents: str) -> str:
    """``before`` goes before a path, ``shift`` moves the choice of templates."""
    return f"""
tpl(ext, tpls) AS (VALUES {_TEMPLATES}),
docs AS (
  SELECT doc_id, 'repo' || (doc_id % 10) AS repo, before, shift,
         list_extract({_list(EXTENSIONS)}, (doc_id % 8 + 1)::INT) AS ext,
         string_split(replace(text, chr(10), ' '), ' ') AS words
  FROM ({documents})),
cl AS (
  SELECT repo, before || 'src/f' || doc_id || ext AS path, ext, i AS line,
         repeat('  ', ((length(w) * 5 + i - 1) % 5)::INT)
         || list_extract(tpls, ((length(w) * 7 + (i - 1) * 3 + doc_id + shift) % len(tpls) + 1)::INT) AS raw
  FROM (SELECT doc_id, before, shift, repo, ext, unnest(words) AS w,
               unnest(range(1, len(words) + 1)) AS i FROM docs)
  JOIN tpl USING (ext)),
li AS (SELECT *, trim(raw) AS s FROM cl)
"""


CORPUS = _corpus("SELECT *, '' AS before, 0 AS shift FROM documents")
# Both heads at once: files go by head and path, and every third one differs at the second head.
HEADS = _corpus("""SELECT *, head || ':' AS before, (head = 'c1' AND doc_id % 3 = 0)::INT AS shift
  FROM documents CROSS JOIN (VALUES ('c0'), ('c1')) h(head)""")
AT_HEADS = "heads AS (SELECT * REPLACE (substr(path, 4) AS path), left(path, 2) AS commit_sha FROM found)"

BRACES = """
ev AS (
  SELECT repo, path, line, 0 AS col, NULL AS mark,
         regexp_matches(s, '^(foreach|for|while|do)([ (]|$)')::INT AS hl,
         (starts_with(s, 'synchronized') OR contains(' ' || s, ' synchronized ('))::INT AS hs
  FROM li WHERE ext IN ('.java', '.cs', '.c', '.js', '.tsx')
  UNION ALL
  SELECT repo, path, line, unnest(range(1, len(marks) + 1)), unnest(marks), 0, 0
  FROM (SELECT *, regexp_extract_all(raw, '[{}]') AS marks FROM li
        WHERE ext IN ('.java', '.cs', '.c', '.js', '.tsx'))),
e1 AS (
  SELECT *, CASE mark WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END AS d,
         sum(CASE mark WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END)
           OVER (PARTITION BY path ORDER BY line, col) AS height,
         coalesce(sum((mark = '{')::INT) OVER (PARTITION BY path ORDER BY line, col
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM ev),
e2 AS (
  SELECT *, height - least(0, min(height) OVER (PARTITION BY path ORDER BY line, col)) AS depth,
         max(hl) OVER (PARTITION BY path, g ORDER BY line, col) AS wl,
         max(hs) OVER (PARTITION BY path, g ORDER BY line, col) AS ws
  FROM e1),
e3 AS (
  SELECT *, CASE mark WHEN '{' THEN depth WHEN '}' THEN nullif(
           coalesce(lag(depth) OVER (PARTITION BY path ORDER BY line, col), 0), 0) END AS lvl
  FROM e2),
e4 AS (
  SELECT *, CASE WHEN mark = '{' THEN wl WHEN lvl IS NOT NULL THEN
           -lag(wl) OVER (PARTITION BY path, lvl ORDER BY line, col) ELSE 0 END AS dl,
         CASE WHEN mark = '{' THEN ws WHEN lvl IS NOT NULL THEN
           -lag(ws) OVER (PARTITION BY path, lvl ORDER BY line, col) ELSE 0 END AS ds
  FROM e3),
e5 AS (
  SELECT repo, path, line, col,
         sum(dl) OVER (PARTITION BY path ORDER BY line, col) AS loop_depth,
         sum(ds) OVER (PARTITION BY path ORDER BY line, col) > 0 AS in_sync
  FROM e4),
brace AS (SELECT repo, path, line, loop_depth::INT AS loop_depth, in_sync FROM e5 WHERE col = 0)
"""

_LEVELS = (0, 2, 4, 6, 8)  # the indents the corpus has


def _indent() -> str:
    before = "OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last = ",\n".join(
        f"last_value(CASE WHEN code AND ind <= {v} THEN line END IGNORE NULLS) {before} AS at{v},\n"
        f"last_value(CASE WHEN code AND ind <= {v} THEN (head AND ind = {v})::INT END IGNORE NULLS) "
        f"{before} AS open{v}" for v in _LEVELS)
    depth = " + ".join(
        f"(CASE WHEN open{v} = 1 AND (NOT code OR ind > {v}) THEN 1 ELSE 0 END)" for v in _LEVELS)
    coroutine = " OR ".join(
        f"(ai = {v} AND at{v} = aj AND (NOT code OR ind > {v}))" for v in _LEVELS)
    return f"""
py AS (
  SELECT repo, path, line, s, length(raw) - length(ltrim(raw, ' ')) AS ind,
         s <> '' AND NOT starts_with(s, '#') AS code,
         regexp_matches(s, '^(for|while)[ (]') AS head, starts_with(s, 'async def ') AS co
  FROM li WHERE ext = '.py'),
py2 AS (
  SELECT *, last_value(CASE WHEN co THEN line END IGNORE NULLS) {before} AS aj,
         last_value(CASE WHEN co THEN ind END IGNORE NULLS) {before} AS ai,
         {last}
  FROM py),
indent AS (
  SELECT repo, path, line, ({depth})::INT AS loop_depth,
         coalesce({coroutine}, false) AS in_async
  FROM py2)
"""


INDENT = _indent()

ANNOTATED = """
ann AS (
  SELECT li.*, lower(s) AS low, coalesce(b.loop_depth, p.loop_depth, 0) AS dep,
         coalesce(b.in_sync, false) AS in_sync, coalesce(p.in_async, false) AS in_async
  FROM li LEFT JOIN brace b USING (path, line) LEFT JOIN indent p USING (path, line)),
facts AS (
  SELECT path,
         bool_or(contains(nc, 'getInstance')) AND bool_or(contains(nc, 'synchronized'))
           AND bool_or(regexp_matches(nc, 'if\\s*\\(\\s*\\w+\\s*==\\s*null\\s*\\)'))
           AND NOT bool_or(regexp_matches(nc, '\\bvolatile\\s+\\w')) AS dcl,
         bool_or(regexp_matches(raw, 'static\\s+\\w+\\s+getInstance')) AS has_get,
         bool_or(regexp_matches(raw, 'catch\\s*\\(\\s*NumberFormatException')) AS nfe,
         bool_or(contains(raw, 'FetchType.LAZY')) AS lazy,
         bool_or(contains(raw, 'useEffect')) AND NOT bool_or(contains(raw, 'removeEventListener'))
           AND NOT bool_or(contains(raw, 'clearInterval')) AS leak,
         bool_or(contains(raw, 'getServerSideProps')) OR bool_or(contains(raw, 'async function'))
           AS server,
         bool_or(contains(lower(raw), '@component')) OR bool_or(contains(lower(raw), '*ngfor')) AS ng
  FROM (SELECT *, regexp_replace(raw, '//.*', '') AS nc FROM li) GROUP BY path),
an AS (
  SELECT *, lower(coalesce(lag(raw, 2) OVER w, '') || coalesce(lag(raw, 1) OVER w, '') || raw)
            AS near
  FROM ann JOIN facts USING (path)
  WINDOW w AS (PARTITION BY path ORDER BY line))
"""

_JS = "ext IN ('.tsx', '.js')"
_LANG = {
    "java": ("ext = '.java'", r"s <> '' AND NOT regexp_matches(s, '^(//|\*)')"),
    "py": ("ext = '.py'", "s <> '' AND NOT starts_with(s, '#')"),
    "sql": ("ext = '.sql'", "s <> '' AND NOT starts_with(s, '--')"),
    "cs": ("ext = '.cs'", r"s <> '' AND NOT regexp_matches(s, '^(//|\*)')"),
    "c": ("ext = '.c'", r"s <> '' AND NOT regexp_matches(s, '^(//|\*|/\*)')"),
    "fe": (_JS, "s <> '' AND NOT starts_with(s, '//')"),
    "node": (_JS, r"s <> '' AND NOT regexp_matches(s, '^(//|\*)')"),
    "next": (_JS, "s <> '' AND NOT starts_with(s, '//')"),
    "ng": (_JS, "true"),
}
_RULESET = {"java": "java", "py": "python", "sql": "sql", "cs": "csharp", "c": "c",
            "fe": "frontend", "node": "node", "next": "node", "ng": "node"}

_APPEND = r"regexp_matches(s, @P_APPEND@)"

# rule -> condition on a line; "first" rules keep the first line of a file
LINE_RULES = {
    "java.n_plus_one": r"""dep > 0 AND (regexp_matches(s, @P_JAVA_QUERY@)
        OR (regexp_matches(s, @P_JAVA_REPO_CALL@) AND contains(s, 'Repository')))""",
    "java.string_concat_loop": _APPEND + """ AND dep > 0 AND (contains(s, '"') OR contains(s, 'String')
        OR contains(s, 'report') OR contains(low, 'sql'))""",
    "java.alloc_in_loop": r"""dep > 0 AND regexp_matches(s, @P_NEW@) AND NOT contains(s, 'Thread')
        AND (regexp_matches(s, @P_JAVA_NEW_ARRAY@) OR
             regexp_matches(s, @P_JAVA_NEW_COLLECTION@))""",
    "java.autoboxing_loop": r"dep > 0 AND regexp_matches(s, @P_JAVA_BOXED@)",
    "java.thread_per_item": "(contains(s, 'new Thread(') OR contains(s, 'new Thread ('))",
    "java.regex_compile_loop": r"dep > 0 AND regexp_matches(s, @P_JAVA_REGEX@)",
    "java.sleep_in_sync": "contains(s, 'Thread.sleep') AND in_sync",
    "java.busy_wait": r"""regexp_matches(s, @P_JAVA_SPIN@)
        AND (contains(s, 'isDone()') OR contains(s, 'Thread.yield'))""",
    "java.select_star": "contains(low, 'select *')",
    "py.nested_loop": "dep >= 2 AND (contains(s, '==') OR contains(s, ' in '))",
    "py.string_concat_loop": _APPEND + """ AND dep > 0
        AND (contains(s, 'str(') OR contains(s, '"') OR contains(s, ''''))""",
    "py.read_whole_file": r"""regexp_matches(s, @P_PY_READ@)
        AND NOT contains(right(string_split(s, '.read')[1], 40), 'open(')""",
    "py.sync_io_in_async": r"""in_async AND (regexp_matches(s, @P_PY_REQUESTS@)
        OR regexp_matches(s, @P_PY_SLEEP@))""",
    "py.connection_per_iter": r"dep > 0 AND regexp_matches(s, @P_PY_CONNECT@)",
    "c.alloc_in_loop": r"dep > 0 AND regexp_matches(s, @P_C_ALLOC@)",
    "c.strlen_in_condition": r"regexp_matches(s, @P_C_STRLEN@) AND regexp_matches(s, @P_C_LOOP_WORD@)",
    "c.strcat_in_loop": r"dep > 0 AND regexp_matches(s, @P_C_STRCAT@)",
    "c.io_in_loop": r"dep > 0 AND regexp_matches(s, @P_C_IO@)",
    "c.nested_loop": "dep >= 2 AND (contains(s, '==') OR contains(s, 'strcmp'))",
    "c.process_spawn_in_loop": r"dep > 0 AND regexp_matches(s, @P_C_SPAWN@)",
    "cs.ef_n_plus_one": r"""dep > 0 AND regexp_matches(s, @P_CS_QUERY@)
        AND (contains(s, '_context') OR contains(s, 'Context') OR contains(s, 'db.') OR contains(s, '_db')
             OR contains(s, 'Repository') OR contains(s, '.Set<'))""",
    "cs.linq_materialize_in_loop": r"""dep > 0 AND (contains(s, '.Where(') OR contains(s, '.Select('))
        AND regexp_matches(s, @P_CS_MATERIALIZE@)""",
    "cs.sync_over_async": r"""NOT contains(s, 'async') AND regexp_matches(s,
        @P_CS_BLOCKING@)""",
    "cs.string_concat_loop": _APPEND + """ AND dep > 0
        AND (contains(s, '"') OR contains(low, 'string') OR contains(low, 'sql'))""",
    "cs.regex_in_loop": r"dep > 0 AND regexp_matches(s, @P_CS_REGEX@)",
    "cs.alloc_in_loop": r"""dep > 0 AND regexp_matches(s, @P_NEW@)
        AND regexp_matches(s, @P_CS_NEW_COLLECTION@)""",
    "cs.count_instead_of_any": r"regexp_matches(s, @P_CS_COUNT@)",
    "sql.select_star": r"regexp_matches(low, @P_SQL_SELECT_STAR@)",
    "sql.leading_wildcard": r"regexp_matches(low, @P_SQL_WILDCARD@)",
    "sql.function_on_column": r"""(regexp_matches(low, @P_SQL_WHERE_FUNCTION@)
        OR regexp_matches(low, @P_SQL_FUNCTION_EQUALS@))""",
    "sql.cartesian_join": r"regexp_matches(low, @P_SQL_COMMA_JOIN@) AND NOT contains(low, ' join ')",
    "sql.correlated_subquery": r"regexp_matches(low, @P_SQL_SUBQUERY@)",
    "fe.missing_cleanup": "leak AND (contains(s, 'setInterval(') OR contains(s, 'addEventListener('))",
    "fe.inline_function": r"regexp_matches(s, @P_FE_INLINE@)",
    "node.sync_fs": r"regexp_matches(s, @P_NODE_SYNC_FS@)",
    "node.sync_crypto": r"regexp_matches(s, @P_NODE_SYNC_CRYPTO@)",
    "node.await_in_loop": r"""dep > 0 AND regexp_matches(s, @P_NODE_AWAIT@)
        AND NOT starts_with(s, 'for ') AND NOT contains(s, 'Promise.all')""",
    "node.json_parse_sync": """contains(s, 'JSON.parse(') AND (contains(s, 'readFileSync')
        OR (NOT contains(s, 'await') AND contains(s, '.read(')))""",
}
SECOND_PASS = {
    "cs.select_star": r"""regexp_matches(s, @P_CS_SELECT_STAR@) AND contains(s, '"')""",
    "cs.lazy_loading_proxies": "contains(s, 'UseLazyLoadingProxies')",
}
FIRST_RULES = {
    "java.connection_per_request": r"regexp_matches(raw, @P_JAVA_CONNECTION@)",
    "java.unbounded_pool": r"regexp_matches(raw, @P_JAVA_POOL@)",
    "java.dcl_no_volatile": r"""dcl AND (regexp_matches(raw, @P_JAVA_GET_INSTANCE@)
        OR (NOT has_get AND line = 1))""",
    "java.finalizer": r"regexp_matches(raw, @P_JAVA_FINALIZE@)",
    "java.synchronized_method": r"regexp_matches(raw, @P_JAVA_SYNC_METHOD@)",
    "java.exception_flow_control": r"nfe AND regexp_matches(raw, @P_JAVA_PARSE_INT@)",
    "java.eager_fetch": r"regexp_matches(raw, @P_JAVA_EAGER@)",
    "java.collection_mapping": "NOT lazy AND regexp_matches(raw, @P_JAVA_TO_MANY@)",
    "fe.list_no_virtualization": r"regexp_matches(s, @P_FE_MAP@) AND contains(near, 'return')",
    "next.fetch_no_cache": r"""server AND regexp_matches(s, @P_NEXT_FETCH@) AND NOT contains(s, 'next')
        AND NOT contains(s, 'cache') AND NOT contains(s, 'revalidate')""",
    "ng.ngfor_no_trackby": "ng AND contains(s, '*ngFor') AND NOT contains(s, 'trackBy')",
    "ng.method_in_template": r"ng AND regexp_matches(s, @P_NG_METHOD@)",
}
_RULE_TABLE = {rule[0]: rule for rule in fixed.RULES}
_ORD = list(fixed.SKIP_PREFIXES)


def _rule(rule_id: str, condition: str, order: int) -> str:
    # @P_NAME@ stands for a pattern of the fixed values
    condition = re.sub(r"@(P_\w+)@", lambda m: _text(getattr(fixed, m[1])), condition)
    prefix = rule_id.split(".")[0]
    ext, kept = _LANG[prefix]
    _, _, category, severity = _RULE_TABLE[rule_id]
    severity = _text(severity)
    code = "s"
    step = "1"
    qualify = ""
    if rule_id in SECOND_PASS:
        kept, step = "s <> '' AND NOT starts_with(s, '//')", "2"
    if rule_id in FIRST_RULES:
        qualify = "QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) = 1"
        if prefix != "fe":
            step = str(order + 2)
        if prefix == "java":
            kept = "true"
    if rule_id == "java.thread_per_item":
        severity = "CASE WHEN dep > 0 THEN 'HIGH' ELSE 'MEDIUM' END"
    if rule_id == "java.dcl_no_volatile":
        code = "CASE WHEN has_get THEN s ELSE 'getInstance()' END"
    return (f"SELECT repo, path, line, {_text(rule_id)} AS rule_id, {_text(category)} AS category, "
            f"{severity} AS severity, {code} AS code, {_ORD.index(_RULESET[prefix])} AS rs_ord, "
            f"{step} AS step, {order} AS rule_ord FROM an "
            f"WHERE {ext} AND {kept} AND {condition} {qualify}")


def _findings(*prefixes: str, only=None) -> str:
    """All rules in order; ``rule_ord`` counts within the kind of rule, as the passes do."""
    parts = []
    for rules in (LINE_RULES, SECOND_PASS, FIRST_RULES):
        for order, (rule_id, condition) in enumerate(rules.items()):
            if (not prefixes or rule_id.split(".")[0] in prefixes) and (not only or rule_id in only):
                parts.append("(" + _rule(rule_id, condition, order) + ")")
    return "found AS (" + "\nUNION ALL\n".join(parts) + ")"


_SHOWN = "repo, path, line, rule_id, category, severity, code"
_SCAN = (CORPUS, BRACES, INDENT, ANNOTATED)
_SCAN_HEADS = (HEADS, BRACES, INDENT, ANNOTATED, _findings(), AT_HEADS)


def _scan(*prefixes, only=None, select=f"SELECT {_SHOWN} FROM found") -> str:
    return _with(*_SCAN, _findings(*prefixes, only=only)) + select


# --- history ------------------------------------------------------------------------------

HISTORY = r"""
log AS (
  SELECT event_id, 'repo' || (user_id % 10) AS repo,
         (floor(epoch(ts) / 43200) * 43200)::BIGINT AS run_id, event_type AS rule_id,
         'Title of ' || event_type AS title,
         CASE event_type WHEN 'error' THEN 'IO_DB' WHEN 'view' THEN 'INFO' ELSE 'MEMORY' END AS category,
         CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH'
           WHEN 'signup' THEN 'MEDIUM' WHEN 'click' THEN 'LOW'
           ELSE CASE WHEN event_id % 3 = 0 THEN 'NOTICE' ELSE 'INFO' END END AS severity,
         'f' || (event_id % 4) || '.py' AS file, (event_id % 100 + 1)::INT AS line,
         ' c' || (event_id % 5) || '  +=' || chr(9) || '1 ' AS code,
         'because' AS why, 'do so' AS fix,
         CASE event_id % 7 WHEN 0 THEN false WHEN 1 THEN true END AS confirmed,
         CASE WHEN event_id % 7 < 2 THEN 'seen' ELSE '' END AS explanation,
         left(sha1(event_type || '|f' || (event_id % 4) || '.py|c' || (event_id % 5) || ' += 1'), 16)
           AS fingerprint
  FROM events),
runs AS (
  SELECT DISTINCT repo, run_id FROM log
  UNION ALL SELECT repo, max(run_id) + 43200 FROM log GROUP BY repo),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run_id) AS run_ord,
         row_number() OVER (PARTITION BY repo ORDER BY run_id DESC) AS age FROM runs),
seen AS (SELECT DISTINCT repo, run_id, fingerprint FROM log)
"""

_DELTAS = """
introduced AS (
  SELECT n.repo, n.run_ord, count(*) AS c FROM seen s JOIN {runs} n USING (repo, run_id)
  WHERE NOT EXISTS (SELECT 1 FROM seen q JOIN {runs} m USING (repo, run_id)
    WHERE q.repo = n.repo AND m.run_ord = n.run_ord - 1 AND q.fingerprint = s.fingerprint)
  GROUP BY ALL),
fixed AS (
  SELECT n.repo, n.run_ord + 1 AS run_ord, count(*) AS c FROM seen s JOIN {runs} n USING (repo, run_id)
  WHERE NOT EXISTS (SELECT 1 FROM seen q JOIN {runs} m USING (repo, run_id)
    WHERE q.repo = n.repo AND m.run_ord = n.run_ord + 1 AND q.fingerprint = s.fingerprint)
  GROUP BY ALL),
deltas AS (
  SELECT r.*, coalesce(i.c, 0) AS introduced, coalesce(f.c, 0) AS fixed
  FROM {runs} r LEFT JOIN introduced i USING (repo, run_ord) LEFT JOIN fixed f USING (repo, run_ord))
"""
_SHOWN_RUNS = "recent AS (SELECT * FROM numbered WHERE age <= 20)"
COUNTS = """
counts AS (
  SELECT r.repo, r.run_id, count(l.event_id) AS total,
         count(*) FILTER (l.severity = 'CRITICAL') AS critical,
         count(*) FILTER (l.severity = 'HIGH') AS high,
         count(*) FILTER (l.severity = 'MEDIUM') AS medium,
         count(*) FILTER (l.severity = 'LOW') AS low,
         count(*) FILTER (l.severity = 'INFO') AS info
  FROM runs r LEFT JOIN log l USING (repo, run_id) GROUP BY ALL)
"""

TICKETS = """
tickets AS (
  SELECT fingerprint, 'T-' || left(fingerprint, 6) AS issue_key, '/browse/' || fingerprint AS url,
         min(run_id) AS created_ts, max(severity) AS severity, max(title) AS title
  FROM log WHERE severity = 'CRITICAL' AND run_id < 1705276800 GROUP BY fingerprint),
queue AS (
  SELECT l.*, t.issue_key,
         CASE WHEN t.issue_key IS NULL AND row_number() OVER
           (PARTITION BY l.fingerprint ORDER BY event_id) = 1 THEN 'created' ELSE 'skipped' END AS status
  FROM log l LEFT JOIN tickets t USING (fingerprint) WHERE l.severity IN ('CRITICAL', 'HIGH'))
"""
_SUMMARY = ("left('[Code Review] ' || severity || ': ' || title || ' (' || file || ':' || line || ')',"
            " 250)")

# --- diffs --------------------------------------------------------------------------------

CHANGED = f"""
parts AS (
  SELECT o_orderkey AS push_id, 'repo' || (o_custkey % 10) AS repo, unnest(range(0, o_orderkey % 4 + 1)) AS i,
         o_custkey AS cust FROM orders),
files AS (
  SELECT *, 'src/f' || (cust + i * 10)
         || list_extract({_list(EXTENSIONS)}, ((cust + i * 10) % 8 + 1)::INT) AS name,
         (push_id * 13 + i * 17) % 300 + 1 AS start,
         list_extract([1, 1, 1, 7, 2], ((push_id + i) % 5 + 1)::INT) AS span
  FROM parts WHERE (push_id + i) % 7 <> 0),
changed AS (
  SELECT DISTINCT repo, push_id,
         CASE WHEN (push_id + i) % 11 = 0 THEN 'é' || chr(9) || name ELSE name END AS path,
         unnest(range(start, start + span)) AS line FROM files)
"""

# --- knowledge ----------------------------------------------------------------------------

_TOKENS = (r"list_filter(list_transform(regexp_extract_all({}, '[a-zA-Z][a-zA-Z0-9_]+'),"
           " lambda t: lower(t)), lambda t: length(t) > 2)")


def _terms(name: str, key: str, body: str, source: str) -> str:
    return (f"{name} AS (SELECT {key}, term, count(*) AS n FROM (SELECT {key}, "
            f"unnest({_TOKENS.format(body)}) AS term FROM {source}) GROUP BY ALL)")


def _retrieval(notes: str, k: int, queries="documents", key="doc_id", body="text") -> list[str]:
    return [
        notes,
        _terms("nt", "note_ord", "text || ' ' || topic", "notes"),
        _terms("qt", key, body, queries),
        "size AS (SELECT count(*) AS n FROM notes)",
        "df AS (SELECT term, count(*) AS df FROM nt GROUP BY term)",
        """nw AS (SELECT note_ord, term, nt.n * (ln((size.n + 1) / (df + 1)) + 1) AS w
             FROM nt JOIN df USING (term), size)""",
        f"""qw AS (SELECT {key}, term, qt.n * (ln((size.n + 1) / (coalesce(df, 0) + 1)) + 1) AS w
             FROM qt LEFT JOIN df USING (term), size)""",
        "nn AS (SELECT note_ord, sqrt(sum(w * w)) AS norm FROM nw GROUP BY note_ord)",
        f"qn AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM qw GROUP BY {key})",
        f"""scored AS (SELECT {key}, note_ord, round(sum(qw.w * nw.w / nn.norm) / any_value(qn.norm), 9)
             AS score FROM qw JOIN nw USING (term) JOIN nn USING (note_ord) JOIN qn USING ({key})
             GROUP BY {key}, note_ord)""",
        f"""best AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, note_ord DESC)
             AS rank FROM scored WHERE score > 0 QUALIFY rank <= {k})""",
    ]


_NOTES = """notes AS (SELECT item_id AS note_ord, 'item ' || item_id AS topic, text FROM benchmark)"""
_BUILT_IN = ", ".join(f"({i}, {_text(t)}, {_text(x)})" for i, (_, t, x) in enumerate(BUILT_IN))
_BOTH_NOTES = f"""notes AS (
  SELECT * FROM (VALUES {_BUILT_IN}) AS v(note_ord, topic, text)
  UNION ALL SELECT item_id + {len(BUILT_IN)}, 'item ' || item_id, text FROM benchmark WHERE text <> '')"""

_BUILT_IN_NOTES = f"notes AS (SELECT * FROM (VALUES {_BUILT_IN}) AS v(note_ord, topic, text))"
_RULE_WORDS = "rule_words AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_text(r.rule_id)}, {_text(r.severity)}, {_text(r.title)}, {_text(r.category)}, "
    f"{_text(r.why)})" for i, r in enumerate(CATALOGUE) if not r.fallback
) + ") AS v(rule_key, rule_id, severity, title, category, why))"
_QUERY = "title || ' ' || category || ' ' || why"

# Greedy packing by recursion over the paragraphs of all documents at once.
CHUNKS = """
paras AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)),
         lambda p: length(p) > 40) AS ps FROM documents),
walk(doc_id, i, buf, pos, done) AS (
  SELECT doc_id, 0::BIGINT, '', 0::BIGINT, NULL::VARCHAR FROM paras
  UNION ALL
  SELECT w.doc_id, w.i + 1,
         CASE WHEN w.i = len(ps) THEN '' WHEN length(buf) + length(ps[w.i + 1]) > 1200
              THEN ps[w.i + 1] ELSE buf || chr(10) || ps[w.i + 1] END,
         CASE WHEN buf <> '' AND (w.i = len(ps) OR length(buf) + length(ps[w.i + 1]) > 1200)
              THEN pos + 1 ELSE pos END,
         CASE WHEN buf <> '' AND (w.i = len(ps) OR length(buf) + length(ps[w.i + 1]) > 1200)
              THEN trim(buf, ' ' || chr(10)) END
  FROM walk w JOIN paras p ON p.doc_id = w.doc_id WHERE w.i <= len(ps)),
chunks AS (
  SELECT doc_id, (pos - 1)::INT AS pos, 'pdf.' || (pos - 1) AS id, 'reference' AS topic, done AS text
  FROM walk WHERE done IS NOT NULL)
"""


def _verdict(number: str) -> str:
    full = (f"'{{\"confirmed\": ' || CASE WHEN {number} % 2 = 0 THEN 'true' ELSE 'false' END || "
            f"', \"severity\": \"high\", \"explanation\": \" say ' || {number} || ' \", \"fix\": \"fix ' "
            f"|| {number} || '\"}}'")
    kinds = [
        full,
        f"'Well, I think:' || chr(10) || '```json' || chr(10) || {full} || chr(10) || '``` so {{it}} is'",
        f"'Here: ' || {full} || ' Done.'",
        f"'{{\"severity\": \"grave\", \"explanation\": \"n' || {number} || '\", \"fix\": \"  \"}}'",
        "'[{\"confirmed\": false}]'", "'not sure'", "'  '",
        "'{\"confirmed\": null, \"severity\": \"low\"}'",
        "'{\"confirmed\": \"false\", \"fix\": null}'",
    ]
    whens = " ".join(f"WHEN {i} THEN {kind}" for i, kind in enumerate(kinds))
    return f"CASE {number} % 10 {whens} END"


VERDICTS = f"""
raws AS (SELECT event_id, trim(coalesce({_verdict('event_id')}, '')) AS raw FROM events),
spans AS (SELECT *, regexp_extract(raw, '(?s)\\{{.*\\}}', 0) AS inner_raw FROM raws),
docs AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw::JSON
                          WHEN json_valid(inner_raw) THEN inner_raw::JSON END AS j FROM spans),
kinds AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS is_verdict FROM docs),
parsed AS (
  SELECT event_id, is_verdict,
         CASE WHEN is_verdict THEN
           CASE WHEN NOT json_exists(j, '$.confirmed') THEN true
                WHEN json_type(j, '$.confirmed') = 'NULL' THEN false
                ELSE json_extract_string(j, '$.confirmed') <> 'false' END END AS v_confirmed,
         CASE WHEN is_verdict THEN trim(coalesce(json_extract_string(j, '$.explanation'), '')) END
           AS v_explanation,
         CASE WHEN upper(json_extract_string(j, '$.severity')) IN
           ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO')
           THEN upper(json_extract_string(j, '$.severity')) END AS v_severity,
         nullif(trim(json_extract_string(j, '$.fix')), '') AS v_fix
  FROM kinds)
"""

_CAPPED = """
capped AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, rs_ord, step, line, rule_ord) <= 40
         AS reviewed FROM found)
"""
_RANK = ("CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 "
         "WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 9 END")


def _documents(page_rows: int) -> str:
    place = f"row_number() OVER (PARTITION BY repo, run_id ORDER BY {_RANK}, file, line, rule_id, event_id) - 1"
    return _with(HISTORY) + f"""
        , placed AS (SELECT *, {place} AS place FROM log),
        body AS (SELECT repo, run_id, place // {page_rows} AS page, count(*) AS listed,
                   string_agg(event_id, ',' ORDER BY place) AS listed_events, arg_min(severity, place) AS worst
                 FROM placed GROUP BY ALL),
        head AS (SELECT repo, run_id, count(event_id) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical
                 FROM runs LEFT JOIN log USING (repo, run_id) GROUP BY ALL)
        SELECT repo, run_id, coalesce(page, 0)::INT AS page, 'static' AS engine, total, coalesce(listed, 0) AS listed,
               critical, coalesce(listed_events, '') AS listed_events, worst
        FROM head LEFT JOIN body USING (repo, run_id)"""


def sql() -> dict[str, str]:
    skip = " ".join(
        f"WHEN {_text(r)} THEN " + " OR ".join(f"starts_with(s, {_text(p)})" for p in prefixes)
        for r, prefixes in fixed.SKIP_PREFIXES.items())
    rulesets = " ".join(
        f"WHEN {_text(e)} THEN {_list(r)}" for e, r in fixed.EXTENSION_RULESETS.items())
    of_file = f"CASE ext {rulesets} ELSE [] END"
    recent = _with(HISTORY, _SHOWN_RUNS, COUNTS, _DELTAS.format(runs="recent"))
    queue = _with(HISTORY, TICKETS)
    verdict_cols = "event_id, is_verdict, v_confirmed, v_explanation, v_severity, v_fix"
    out = {
        "lines_explode": _with(CORPUS) + "SELECT repo, path, line, raw FROM cl",
        "code_lines_kept": _with(CORPUS) + f"""
            SELECT repo, path, ruleset, count(*) AS n
            FROM (SELECT *, unnest({of_file}) AS ruleset FROM li)
            WHERE s <> '' AND NOT (CASE ruleset {skip} ELSE false END) GROUP BY ALL""",
        "file_rulesets": _with(CORPUS) + f"""
            SELECT repo, path, ext, ord - 1 AS ord, rs[ord] AS ruleset
            FROM (SELECT repo, path, ext, rs, unnest(range(1, len(rs) + 1)) AS ord
                  FROM (SELECT DISTINCT repo, path, ext, {of_file} AS rs FROM cl))""",
        "brace_scope": _with(CORPUS, BRACES) + "SELECT * FROM brace",
        "indent_scope": _with(CORPUS, INDENT) + "SELECT repo, path, line, loop_depth FROM indent",
        "async_scope": _with(CORPUS, INDENT) + "SELECT repo, path, line, in_async FROM indent",
        "n_plus_one_by_file": _scan(
            only=["java.n_plus_one"],
            select="SELECT repo, path, count(*) AS n FROM found GROUP BY ALL"),
        "scan_java": _scan("java"),
        "scan_python": _scan("py"),
        "scan_sql": _scan("sql"),
        "scan_csharp": _scan("cs"),
        "scan_c": _scan("c"),
        "scan_frontend": _scan("fe"),
        "scan_node": _scan("node", "next", "ng"),
        "findings_all": _scan(),
        "findings_by_severity": _scan(
            select="SELECT repo, severity, count(*) AS n FROM found GROUP BY ALL"),
        "first_hit_per_file": _scan(only=list(FIRST_RULES)),
        "user_rule": _scan("py", select=f"""
            SELECT {_SHOWN} FROM found UNION ALL
            SELECT repo, path, line, 'own.return_in_loop', 'ALGORITHMIC', 'LOW', s FROM an
            WHERE ext = '.py' AND dep > 0 AND starts_with(s, 'return')"""),
        "user_udtf_rule": _with(CORPUS) + """
            SELECT repo, path, line, 'own.third_time' AS rule_id, 'ALGORITHMIC' AS category, 'LOW' AS severity, s AS code,
                   'Repeated line' AS title
            FROM (SELECT *, row_number() OVER (PARTITION BY path, s ORDER BY line) AS nth FROM li)
            WHERE ext IN ('.py', '.sql') AND s <> '' AND nth = 3
            UNION ALL
            SELECT repo, path, CASE WHEN line % 7 = 0 THEN 1 ELSE line END,
                   CASE WHEN line % 7 = 0 THEN 'engine.detector_error' ELSE 'own.last_line' END,
                   CASE WHEN line % 7 = 0 THEN 'INFO' ELSE 'MEMORY' END, CASE WHEN line % 7 = 0 THEN 'INFO' ELSE 'MEDIUM' END,
                   CASE WHEN line % 7 = 0 THEN '' ELSE s END,
                   CASE WHEN line % 7 = 0 THEN 'Detector error on ' || path ELSE 'Last line' END
            FROM li WHERE ext IN ('.sql', '.txt') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line DESC) = 1""",
        "literal_index_scan": _with(CORPUS) + r"""
            SELECT repo, path, line, 'own.pool' AS rule_id, 'RESOURCE' AS category, 'LOW' AS severity, s AS code
            FROM li WHERE ext = '.java' AND NOT regexp_matches(s, '^(//|\*)')
              AND (contains(s, 'getConnection') OR contains(s, 'newCachedThreadPool'))""",
        "detector_errors": f"""
            SELECT repo, path, 1 AS line, 'engine.detector_error' AS rule_id, 'INFO' AS category,
                   'INFO' AS severity, '' AS code, 'Detector error on ' || path AS title
            FROM (SELECT repo, path, unnest({of_file}) AS ruleset FROM (
              SELECT 'repo' || (doc_id % 10) AS repo, lang,
                     list_extract({_list(EXTENSIONS)}, (doc_id % 8 + 1)::INT) AS ext,
                     'src/f' || doc_id || list_extract({_list(EXTENSIONS)}, (doc_id % 8 + 1)::INT) AS path
              FROM documents) WHERE lang <> 'en')""",
        "diff_changed_lines": _with(CHANGED) + "SELECT repo, push_id, path, line FROM changed",
        "changed_scope_semi": _with(*_SCAN, _findings(), CHANGED) + f"""
            SELECT {_SHOWN} FROM found f WHERE EXISTS (SELECT 1 FROM changed c
              WHERE c.repo = f.repo AND c.path = f.path AND c.line = f.line)""",
        "scan_incremental": _with(*_SCAN_HEADS) + f"SELECT commit_sha, {_SHOWN} FROM heads",
        "changed_review_commits": _with(*_SCAN_HEADS, CHANGED) + f"""
            SELECT commit_sha, {_SHOWN} FROM heads JOIN (
              SELECT DISTINCT repo, 'c' || (push_id % 2) AS commit_sha, path, line FROM changed) c
            USING (repo, commit_sha, path, line)""",
        "review_gate": _with(*_SCAN_HEADS, CHANGED) + """
            , touched AS (SELECT DISTINCT repo, 'c' || (push_id % 2) AS commit_sha, path, line FROM changed),
            kept AS (SELECT repo, commit_sha, CASE WHEN line % 3 = 1 THEN 'CRITICAL' ELSE severity END AS sev
                     FROM heads f JOIN touched USING (repo, commit_sha, path, line)
                     WHERE rule_id <> 'sql.select_star' AND line % 3 <> 0)
            SELECT r.repo, r.commit_sha, count(sev) AS total, count(*) FILTER (sev = 'CRITICAL') AS critical,
                   count(*) FILTER (sev = 'HIGH') AS high, count(*) FILTER (sev = 'MEDIUM') AS medium,
                   count(*) FILTER (sev = 'LOW') AS low, count(*) FILTER (sev = 'INFO') AS info,
                   coalesce(bool_or(sev IN ('CRITICAL', 'HIGH')), false) AS failed
            FROM (SELECT DISTINCT repo, commit_sha FROM touched) r LEFT JOIN kept USING (repo, commit_sha) GROUP BY ALL""",
        "policy_filters": _with(CHANGED) + """
            SELECT repo, path, count(*) AS n FROM changed
            WHERE NOT path LIKE '%.txt' AND NOT contains(path, 'f1/') AND NOT contains(path, 'f2')
              AND NOT contains(path, 'tests/') GROUP BY ALL""",
        "confirmed_findings": _with(HISTORY) + """
            SELECT rule_id, count(*) AS n FROM log
            WHERE rule_id <> 'click' AND confirmed IS DISTINCT FROM false GROUP BY ALL""",
        "fingerprints": _with(HISTORY) + "SELECT * FROM seen",
        "run_severity_counts": _with(HISTORY, COUNTS) + "SELECT * FROM counts",
        "run_numbers": _with(HISTORY) + "SELECT repo, run_id, run_ord FROM numbered",
        "run_deltas": _with(HISTORY, _DELTAS.format(runs="numbered"))
        + "SELECT repo, run_id, introduced, fixed FROM deltas",
        "run_history": recent + """
            SELECT repo, run_id, age, total, critical, introduced, fixed
            FROM deltas JOIN counts USING (repo, run_id)""",
        "fix_rate": _with(HISTORY) + """, fps AS (
              SELECT repo, fingerprint, max(run_id) AS last FROM seen GROUP BY ALL),
            newest AS (SELECT repo, max(run_id) AS newest, count(*) AS runs FROM runs GROUP BY repo),
            sums AS (SELECT repo, runs, count(*) AS "distinct",
                       count(*) FILTER (last = newest) AS "open",
                       count(*) FILTER (last < newest) AS resolved
                     FROM newest JOIN fps USING (repo) GROUP BY ALL)
            SELECT repo, "distinct", "open", resolved, round(resolved / "distinct", 6) AS fix_rate, runs,
                   round_even(resolved / "distinct" * 100, 0)::INT AS percent FROM sums""",
        "lifecycle_intervals": _with(HISTORY) + """,
            placed AS (SELECT n.repo, fingerprint, run_ord, run_ord - row_number() OVER (
                     PARTITION BY n.repo, fingerprint ORDER BY run_ord) AS island FROM seen JOIN numbered n USING (repo, run_id)),
            latest AS (SELECT repo, max(run_ord) AS latest FROM numbered GROUP BY repo)
            SELECT repo, fingerprint, min(run_ord)::INT AS from_ord, nullif(max(run_ord), any_value(latest))::INT AS to_ord
            FROM placed JOIN latest USING (repo) GROUP BY repo, fingerprint, island""",
        "gate_verdict": _with(HISTORY) + """
            SELECT r.repo, r.run_id, coalesce(bool_or(l.severity IN ('HIGH', 'CRITICAL')), false) AS failed
            FROM runs r LEFT JOIN log l USING (repo, run_id) GROUP BY ALL""",
        "latest_runs_topn": _with(HISTORY, _SHOWN_RUNS) + "SELECT repo, run_id, age FROM recent",
        "ticket_queue": queue + f"""
            SELECT event_id, fingerprint, {_SUMMARY} AS summary FROM queue WHERE status = 'created'""",
        "ticket_skipped": queue + """
            SELECT event_id, fingerprint, issue_key FROM queue WHERE status = 'skipped'""",
        "ticket_payloads": queue + f"""
            SELECT event_id, '(dry-run)' AS issue_key, 'KEY' AS project, {_SUMMARY} AS summary,
                   '*Rule:* ' || rule_id || chr(10) || '*Severity:* ' || severity || chr(10)
                   || '*Category:* ' || category || chr(10) || '*Location:* {{{{' || file || ':' || line
                   || '}}}}' || chr(10) || '*Reason:* because' || chr(10) || '*Fix:* do so' || chr(10)
                   || CASE WHEN explanation <> '' THEN '*Reviewer note:* ' || explanation || chr(10)
                      ELSE '' END || '{{code}}' || chr(10) || code || chr(10) || '{{code}}' AS description,
                   'code-review,nightly,sev-' || lower(severity) AS labels
            FROM queue WHERE issue_key IS NULL""",
        "ticket_upsert": queue + """
            , every AS (
              SELECT *, 0 AS is_new FROM tickets
              UNION ALL SELECT fingerprint, 'R-' || issue_key, '/again', created_ts, severity, title, 1
              FROM tickets WHERE created_ts < 1704200000
              UNION ALL SELECT fingerprint, 'N-' || event_id, '/new', run_id, severity, title, 1
              FROM queue WHERE status = 'created')
            SELECT fingerprint, issue_key, url, created_ts, severity, title FROM every
            QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY created_ts DESC, is_new DESC) = 1""",
        "ticket_summary": queue + """
            SELECT count(*) AS eligible, count(*) FILTER (status = 'created') AS created,
                   count(*) FILTER (status = 'skipped') AS skipped, false AS dry_run FROM queue""",
        "term_frequency": _with(_terms("qt", "doc_id", "text", "documents")) + """
            SELECT doc_id AS q_id, term, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS tf FROM qt""",
        "document_frequency": _with(_terms("qt", "doc_id", "text", "documents"))
        + "SELECT term, count(*) AS df FROM qt GROUP BY term",
        "kb_top2": _with(*_retrieval(_NOTES, 2))
        + "SELECT doc_id AS q_id, note_ord, round(score, 6) AS score, rank FROM best",
        "kb_references": _with(*_retrieval(_BOTH_NOTES, 3)) + """
            SELECT doc_id AS q_id, string_agg(topic, '|' ORDER BY rank) AS kb_refs
            FROM best JOIN notes USING (note_ord) GROUP BY doc_id""",
        "knowledge_base": "WITH RECURSIVE" + CHUNKS + f"""
            , base AS (
              SELECT topic, 'note' AS id FROM (VALUES {_BUILT_IN}) AS v(i, topic, text)
              UNION ALL
              SELECT 'reference', CASE WHEN pos > 0 THEN id ELSE 'pdf' END FROM chunks)
            SELECT topic, count(*) AS n, count(*) FILTER (id = 'pdf') AS unnamed, count(*) AS keys
            FROM base GROUP BY topic""",
        "greedy_chunks": "WITH RECURSIVE" + CHUNKS + "SELECT * FROM chunks",
        "verdict_parse": _with(VERDICTS) + f"SELECT {verdict_cols} FROM parsed",
        "verdict_merge": _with(HISTORY, VERDICTS) + """
            SELECT * FROM (
              SELECT event_id, coalesce(v_confirmed, confirmed) AS confirmed,
                     coalesce(v_severity, severity) AS severity,
                     coalesce(v_explanation, explanation) AS explanation, coalesce(v_fix, fix) AS fix
              FROM log LEFT JOIN (SELECT * FROM parsed WHERE is_verdict) USING (event_id))
            WHERE confirmed IS DISTINCT FROM false""",
        "review_cap": _with(*_SCAN, _findings(), _CAPPED) + """
            SELECT repo, rule_id, reviewed, count(*) AS n FROM capped GROUP BY ALL""",
        "context_windows": _with(*_SCAN, _findings()) + """
            SELECT f.repo, f.path, f.line, string_agg(
              CASE WHEN l.line = f.line THEN '>>' ELSE '  ' END || ' ' || l.line || ': ' || l.raw,
              chr(10) ORDER BY l.line) AS snippet
            FROM (SELECT DISTINCT repo, path, line FROM found) f
            JOIN cl l ON l.path = f.path AND l.line BETWEEN f.line - 6 AND f.line + 6 GROUP BY ALL""",
        "prompt_rows": _with(*_SCAN, _findings(), _RULE_WORDS, *_retrieval(
            _BUILT_IN_NOTES, 2, queries="rule_words", key="rule_key", body=_QUERY)) + """
            , refs AS (
              SELECT rule_key, string_agg(topic, '|' ORDER BY rank) AS kb_refs,
                     string_agg('- ' || topic || ': ' || text, chr(10) ORDER BY rank) AS notes_text
              FROM best JOIN notes USING (note_ord) GROUP BY rule_key),
            win AS (
              SELECT f.path, f.line, string_agg(
                CASE WHEN l.line = f.line THEN '>>' ELSE '  ' END || ' ' || l.line || ': ' || l.raw,
                chr(10) ORDER BY l.line) AS snippet
              FROM (SELECT DISTINCT path, line FROM found) f
              JOIN cl l ON l.path = f.path AND l.line BETWEEN f.line - 6 AND f.line + 6 GROUP BY ALL)
            SELECT f.repo, f.path, f.line, f.rule_id, f.severity, kb_refs,
                   'Notes:' || chr(10) || coalesce(notes_text, '') || chr(10) || chr(10) || 'Rule: '
                   || f.rule_id || ' - ' || title || chr(10) || 'File: ' || f.path
                   || ' (the line in question is marked >>)' || chr(10) || '```' || chr(10)
                   || snippet
                   || chr(10) || '```' || chr(10) || chr(10)
                   || 'Is this a real performance risk? Answer with a JSON object: confirmed, '
                   || 'severity, explanation, fix.' AS prompt
            FROM found f JOIN rule_words w ON w.rule_id = f.rule_id AND w.severity = f.severity
            LEFT JOIN refs USING (rule_key) JOIN win ON win.path = f.path AND win.line = f.line""",
        "report_document": _documents(10_000),
        "report_pages": _documents(7),
        "report_rows": _with(HISTORY) + f"""
            SELECT event_id, {_RANK} AS rank, file, line, rule_id,
                   left(severity, 1) || lower(severity[2:]) AS severity_title,
                   CASE category WHEN 'IO_DB' THEN 'I/O & Database' WHEN 'MEMORY' THEN 'Memory'
                     ELSE category END AS label,
                   CASE WHEN confirmed IS NULL THEN '' WHEN confirmed THEN 'confirmed'
                     ELSE 'possible false positive' END AS tag, code FROM log""",
        "severity_badges": _with(HISTORY, COUNTS) + """
            SELECT repo, run_id, concat_ws('  ',
              CASE WHEN critical > 0 THEN critical || ' Critical' END,
              CASE WHEN high > 0 THEN high || ' High' END,
              CASE WHEN medium > 0 THEN medium || ' Medium' END,
              CASE WHEN low > 0 THEN low || ' Low' END,
              CASE WHEN info > 0 THEN info || ' Info' END) AS badges FROM counts""",
        "findings_json": _with(HISTORY) + """
            SELECT to_json({'event_id': event_id, 'rule_id': rule_id, 'severity': severity,
              'file': file, 'line': line, 'code': code, 'confirmed': confirmed})::VARCHAR AS json
            FROM log""",
        "trend_series": recent + """
            , shown AS (SELECT * FROM deltas JOIN counts USING (repo, run_id))
            SELECT repo, run_id, strftime(make_timestamp(run_id * 1000000), '%Y-%m-%d %H:%M:%S') AS shown_at,
                   left(CASE WHEN run_id % 86400 = 0 THEN left(sha1(repo || run_id), 12)
                        ELSE run_id::VARCHAR END, 6) AS label,
                   round(total / greatest(max(total) OVER (PARTITION BY repo), 1), 6) AS height,
                   round(critical / greatest(total, 1), 6) AS critical_share FROM shown""",
    }
    out["lifecycle_deltas"], out["lifecycle_fix_rate"] = out["run_deltas"], out["fix_rate"]
    out["kb_top2_pruned"], out["diff_changed_inline"] = out["kb_top2"], out["diff_changed_lines"]
    return out
