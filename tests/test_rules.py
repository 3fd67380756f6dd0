"""A file that trips each rule and one that just does not."""

import pytest

from rillscan import fixed
from rillscan.operators import scan
from rillscan.rules import CATALOGUE, RuleSpec

# rule, extension, file that has the finding, line of the finding, file that has not
PAIRS = [
    ("java.n_plus_one", ".java", "for (K k : ks) {\n  db.execute (k);\n}", 2,
     "for (K k : ks) {\n}\ndb.execute(k);"),
    ("java.n_plus_one", ".java", "do {\n  userRepository.findByName(k);\n}", 2,
     "do {\n  users.findByName(k);\n}"),
    ("java.string_concat_loop", ".java", "while (a) {\n  report += x;\n}", 2,
     "while (a) {\n  sum += x;\n}"),
    ("java.alloc_in_loop", ".java", "for (;;) {\n  x = new byte [9];\n}", 2,
     "for (;;) {\n  Thread x = new Thread[9];\n}"),
    ("java.autoboxing_loop", ".java", "for (;;) {\n  Double d = 1;\n}", 2,
     "for (;;) {\n  double d = 1;\n}"),
    ("java.regex_compile_loop", ".java", "for (;;) {\n  Pattern.compile (a);\n}", 2,
     "Pattern.compile(a);"),
    ("java.sleep_in_sync", ".java", "synchronized (a) {\n  Thread.sleep(1);\n}", 2,
     "synchronized (a) {\n}\nThread.sleep(1);"),
    ("java.busy_wait", ".java", "while (!f.isDone()) { }", 1, "while (f.isDone()) { }"),
    ("java.select_star", ".java", 'q = "SELECT * from t";', 1, 'q = "SELECT  * from t";'),
    ("java.connection_per_request", ".java", "// DriverManager.getConnection(u)", 1,
     "DriverManager.getDriver(u)"),
    ("java.unbounded_pool", ".java", "\np = Executors.newCachedThreadPool();", 2,
     "p = Executors.newFixedThreadPool(2);"),
    ("java.dcl_no_volatile", ".java",
     "static A a; // volatile A\nstatic A getInstance() {\n if (a == null) {\n"
     "  synchronized (A.class) {\n  }}}", 2,
     "static volatile A a;\nstatic A getInstance() {\n if (a == null) {\n"
     "  synchronized (A.class) {\n  }}}"),
    ("java.dcl_no_volatile", ".java",
     "A.getInstance(); synchronized (x) { if (a ==\n null) { } }", 1,
     "/* getInstance\n */ synchronized (x) { if (a == null) { } }"),
    ("java.finalizer", ".java", "protected  void finalize() {", 1, "void finalize() {"),
    ("java.synchronized_method", ".java", "public synchronized int a() {", 1,
     "synchronized int a() {"),
    ("java.exception_flow_control", ".java",
     "a;\nInteger.parseInt(x);\n} catch (\nNumberFormatException e) {", 2,
     "Integer.parseInt(x); catch (Exception e) {"),
    ("java.eager_fetch", ".java", "@X(fetch = FetchType.EAGER)", 1, "@X(fetch = FetchType.LAZY)"),
    ("java.collection_mapping", ".java", "a\n@ManyToMany", 2, "@ManyToMany\nFetchType.LAZY"),
    ("py.nested_loop", ".py", "for a in x:\n  for b in y:\n    if a == b: z()", 3,
     "for a in x:\n  pass\nfor b in y:\n    if a == b: z()"),
    ("py.string_concat_loop", ".py", "while x:\n  s += str(x)", 2, "while x:\n  s += x"),
    ("py.read_whole_file", ".py", "d = f.read()", 1, "d = open(p).read()"),
    ("py.sync_io_in_async", ".py", "async def f():\n  requests.get(u)", 2,
     "async def f():\n  pass\nrequests.get(u)"),
    ("py.sync_io_in_async", ".py", "async def f():\n  time.sleep (1)", 2,
     "async def f():\n  async def g():\n    pass\n  time.sleep(1)"),
    ("py.connection_per_iter", ".py", "for a in b:\n  c = db.connect (a)", 2,
     "c = db.connect(a)\nfor a in b:\n  pass"),
    ("c.alloc_in_loop", ".c", "for (;;) {\n p = realloc(p, 2);\n}", 2, "p = malloc(2);"),
    ("c.strlen_in_condition", ".h", "while (i < strlen (s)) i++;", 1, "n = strlen(s);"),
    ("c.strcat_in_loop", ".cpp", "do {\n  sprintf(a, b);\n}", 2, "do {\n  snprintf(a, b);\n}"),
    ("c.io_in_loop", ".cc", "for (;;) {\n  write(1, a, b);\n}", 2, "for (;;) {\n  rewrite(a);\n}"),
    ("c.nested_loop", ".hpp", "for (;;) {\nfor (;;) {\n strcmp(a, b);\n}}", 3,
     "for (;;)\nfor (;;) {\n strcmp(a, b);\n}"),
    ("c.process_spawn_in_loop", ".c", "while (a) {\n  popen(c, m);\n}", 2, "popen(c, m);"),
    ("cs.ef_n_plus_one", ".cs", "foreach (a) {\n db.Users.Find(1);\n}", 2,
     "foreach (a) {\n dbcontext.Users.Find(1);\n}"),
    ("cs.linq_materialize_in_loop", ".cs", "foreach(a) {\n x.Select(y).ToArray();\n}", 2,
     "foreach(a) {\n x.Select(y);\n}"),
    ("cs.sync_over_async", ".cs", "t.GetAwaiter( ) . GetResult();", 1, "async t.Wait();"),
    ("cs.string_concat_loop", ".cs", "for (;;) {\n mySQL += x;\n}", 2, "for (;;) {\n n += x;\n}"),
    ("cs.regex_in_loop", ".cs", "for (;;) {\n new Regex (x);\n}", 2, "new Regex(x);"),
    ("cs.alloc_in_loop", ".cs", "for (;;) {\n a = new HashSet<int>();\n}", 2,
     "for (;;) {\n a = new Thing();\n}"),
    ("cs.count_instead_of_any", ".cs", "if (a.Count() != 0)", 1, "if (a.Count != 0)"),
    ("cs.select_star", ".cs", '* "Select\t* from t"', 1, "// \"select * from t\""),
    ("cs.lazy_loading_proxies", ".cs", "o.UseLazyLoadingProxies();", 1, "// UseLazyLoadingProxies"),
    ("sql.select_star", ".sql", "Select  *", 1, "-- select *"),
    ("sql.leading_wildcard", ".sql", "a LIKE  '%b'", 1, "a like 'b%'"),
    ("sql.function_on_column", ".sql", "where Year (a) = 1", 1, "where a = year(b)"),
    ("sql.function_on_column", ".sql", "and LOWER( a ) = 'x'", 1, "and lower(a, b) = 'x'"),
    ("sql.cartesian_join", ".sql", "from a , b", 1, "from a, b join c"),
    ("sql.correlated_subquery", ".sql", "WHERE a IN ( SELECT 1", 1, "where a in (1)\n(select 1)"),
    ("fe.missing_cleanup", ".tsx", "useEffect(f)\nsetInterval(g)", 2,
     "useEffect(f)\nsetInterval(g)\nclearInterval(h)"),
    ("fe.inline_function", ".jsx", "<a onClick={ () => b }/>", 1, "<a onClick={b}/>"),
    ("fe.list_no_virtualization", ".js", "a.map(b)\nre\nturn\na.map (b)", 4,
     "return\n1\n2\na.map(b)"),
    ("node.sync_fs", ".mjs", "existsSync(p)", 1, "// existsSync(p)"),
    ("node.sync_crypto", ".cjs", "bcrypt.genSaltSync(1)", 1, "bcrypt.hash(1)"),
    ("node.await_in_loop", ".ts", "for (a) {\n  await b();\n}", 2,
     "for (a) {\n  await Promise.all(b);\n}"),
    ("node.await_in_loop", ".ts", "while (a) {\n  for(await b) {}\n}", 2,
     "while (a) {\n  for await (b) {}\n}"),
    ("node.json_parse_sync", ".ts", "JSON.parse(f.read())", 1, "JSON.parse(await f.read())"),
    ("next.fetch_no_cache", ".ts", "async function f() {\n fetch(a)\n", 2,
     "async function f() {\n fetch(a, {cache: 1})\n"),
    ("ng.ngfor_no_trackby", ".ts", "a\n// *ngFor", 2, "*ngFor trackBy"),
    ("ng.method_in_template", ".ts", "@Component\n{{ total(1) }}", 2, "@Component\n{{ total }}"),
]


@pytest.fixture(scope="module")
def findings(spark):
    files = []
    for i, (_, ext, good, _, bad) in enumerate(PAIRS):
        files += [("r", f"{i}/hit{ext}", good), ("r", f"{i}/miss{ext}", bad)]
    rows = scan.scan(spark.createDataFrame(files, "repo string, path string, content string"))
    return rows.collect()


def test_every_rule_has_a_pair():
    assert {p[0] for p in PAIRS} | {"java.thread_per_item"} == {r[0] for r in fixed.RULES}
    assert {r.rule_id for r in CATALOGUE} == {r[0] for r in fixed.RULES}
    assert len(fixed.RULES) == 52


@pytest.mark.parametrize("number", range(len(PAIRS)), ids=lambda n: f"{PAIRS[n][0]}-{n}")
def test_pair(findings, number):
    rule, ext, _, line, _ = PAIRS[number]
    of_rule = [(r.path, r.line) for r in findings
               if r.rule_id == rule and r.path.startswith(f"{number}/")]
    assert of_rule == [(f"{number}/hit{ext}", line)]


def _scan(spark, path, content, rules=None):
    files = spark.createDataFrame([("r", path, content)], "repo string, path string, content string")
    return scan.scan(files, rules).collect()


def test_thread_severity_follows_the_loop(spark):
    rows = _scan(spark, "A.java", "new Thread(a);\nfor (;;) {\n  new Thread (b);\n}")
    got = {(r.line, r.severity, r.title) for r in rows if r.rule_id == "java.thread_per_item"}
    assert got == {(1, "MEDIUM", "Raw thread creation"),
                   (3, "HIGH", fixed.THREAD_IN_LOOP_TITLE)}


def test_fallback_line_of_a_singleton(spark):
    rows = _scan(spark, "A.java", "A.getInstance(); synchronized (x) { if (a == null) { } }")
    assert [(r.line, r.code) for r in rows if r.rule_id == "java.dcl_no_volatile"] == [
        (1, "getInstance()")]


def test_first_hits_only(spark):
    rows = _scan(spark, "a.ts", "return a.map(b)\na.map(b) // return\n*ngFor\n*ngFor\nexistsSync(a)\nexistsSync(a)")
    count = {}
    for r in rows:
        count[r.rule_id] = count.get(r.rule_id, 0) + 1
    assert count["fe.list_no_virtualization"] == count["ng.ngfor_no_trackby"] == 1
    assert count["node.sync_fs"] == 2


def test_windows_newlines_and_unicode(spark):
    rows = _scan(spark, "a.java", "for (é é) {\r\n\u00a0 out += \"é\";\u2003\r\n}\r\n")
    assert [(r.rule_id, r.line, r.code) for r in rows] == [
        ("java.string_concat_loop", 2, 'out += "é";')]


def test_other_files_and_clean_code(spark):
    assert _scan(spark, "a.txt", "select *") == []
    assert _scan(spark, ".sql", "select *") == []
    assert len(_scan(spark, "A.SQL", "select *")) == 1
    assert _scan(spark, "C.java", "int s = 0;\nfor (int v : a) { s += v; }\nreturn s;") == []


def test_scan_order_and_own_rule(spark):
    own = RuleSpec("own.todo", "sql", lambda c: c.s.contains("todo"), "w", "f",
                   title="t", category="MEMORY", severity="LOW")
    rows = _scan(spark, "a.sql", "select * -- todo\nselect *", CATALOGUE + [own])
    rows.sort(key=lambda r: tuple(r[c] for c in scan.SCAN_ORDER))
    assert [r.rule_id for r in rows] == ["sql.select_star", "own.todo", "sql.select_star"]
    with pytest.raises(ValueError):
        RuleSpec("own.todo", "sql", lambda c: c.s.contains("todo"), "w", "f")


def test_file_without_text(spark):
    rows = _scan(spark, "src/a.ts", None)
    assert [(r.rule_id, r.title, r.severity, r.line, r.code) for r in rows] == 2 * [
        ("engine.detector_error", "Detector error on src/a.ts", "INFO", 1, "")]
