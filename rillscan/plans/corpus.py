"""Tables of source code, history and diffs derived from the supplied tables.

The supplied tables hold no source code.  These functions make some, row by row and without
a shuffle, so that the work of every query grows with the tables.  The fixed templates are
our own; ``checks/oracle.py`` states the same derivation for the checking engine.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import with_fingerprint
from ..operators.joins import parted, partitions

EXTENSIONS = [".java", ".py", ".sql", ".cs", ".c", ".tsx", ".js", ".txt"]

# One list per extension; blanks at the left are added per line.
TEMPLATES = {
    ".java": [
        "for (Item item : items) {", "}", "ResultSet r = st.executeQuery(q);",
        "out += \"name\" + item;", "}", "while (!done.isDone()) {",
        "List<Long> a = new ArrayList<Long>();", "}", "Long total = 0L;",
        "new Thread(job).start();", "synchronized (lock) {", "Thread.sleep(10);",
        "}", "Pattern p = Pattern.compile(rx);", "int n = Integer.parseInt(v);",
        "// for (int i = 0; i < n; i++) { select * }", "}", "if (x == null) {",
        "Order o = orderRepository.findById(k);", "String q = \"select * from t\";",
        "}", "} catch (NumberFormatException e) {", "int[] b = new int[8];", "do {",
        "Connection c = DriverManager.getConnection(u);", "}", "@OneToMany List<Item> list;",
        "pool = Executors.newCachedThreadPool();", "public static Item getInstance() {", "}",
        "@ManyToOne(fetch = FetchType.EAGER)", "protected void finalize() {", "}",
        "public synchronized void put() {", "Item.getInstance().go();", "}",
        "// private volatile Item item;", "* note", "total = total + 1;", "while (!stop) Thread.yield();",
        "st.execute (q);",
    ],
    ".py": [
        "for a in rows:", "x = 1", "if a == b:", "out += str(a)",
        "async def pull(k):", "while n:", "data = f.read()", "time.sleep(1)",
        "", "# for x in y:", "c = db.connect(url)", "requests.get(url)",
        "if k in seen:", "for b in cols:", "return out", "text = open(p).read()",
        "def work(k):", "s += 'z'", "while(n):", "pass",
        "y = requests.post(url)", "async def push(k):", "for(z) in q:", "total = a + b",
    ],
    ".sql": [
        "SELECT * FROM t", "select a from t, u", "WHERE name LIKE '%x'", "-- select * from t",
        "where upper(name) = 'A'", "where id in (select id from u)", "", "order by a",
        "select a from t join u on t.i = u.i", "select  *", "where year(d) = 2024", "group by a",
        "from a , b", "from a , b join c on a.i = c.i", "like 'x%'", "having count(k) > 1",
        "and lower(n) = 'q'", "where exists ( select 1", "update t set a = 1", "delete from t",
        "insert into t values (1)", "select b", "limit 5", "with c as (select 1)",
    ],
    ".cs": [
        "foreach (var k in keys) {", "}", "var o = _context.Orders.First();",
        "var l = xs.Where(x => x.A).ToList();", "}", "var u = Load().Result;",
        "text += \"a\";", "var r = new Regex(rx);", "}", "var b = new List<int>();",
        "if (xs.Count() > 0) {", "var q = \"select * from t\";", "}",
        "* o.UseLazyLoadingProxies();", "while (run) {", "Save().Wait();",
        "// foreach (var z in zs) {", "}", "await Load(); var z = Load().Result; // async",
        "Repository.Any();", "}", "sqlText += part;", "db.Find(k);", "var a = new int[4];",
    ],
    ".c": [
        "for (i = 0; i < strlen(s); i++) {", "}", "p = malloc(8);", "strcat(buf, s);",
        "}", "while (n) {", "if (a == b) {", "}", "fwrite(b, 1, n, f);",
        "system(cmd);", "/* for (;;) { */", "}", "do {", "if (strcmp(a, b)) x();",
        "}", "// malloc(1)", "read(fd, b, n);", "}", "for (j = 0; j < n; j++) {", "n--;",
        "}", "sprintf(b, f, n);", "popen(cmd, m);", "q = calloc(1, 2);",
    ],
    ".tsx": [
        "useEffect(() => {", "}, []);", "setInterval(tick, 9);", "return (",
        "{rows.map(r => r.a)}", "<b onClick={() => go()} />", "window.addEventListener('a', f);",
        "// setInterval(tick, 9);", "}", "for (const k of ks) {", "const r = await load(k);",
        "}", "const x = fetch(u);", "const y = fetch(u, {cache: 'no'});", "<li *ngFor=\"let a of b\">",
        "{{ total(a) }}", "const a = 1;", "}", "await Promise.all(ps);", "while (n) {",
        "const h = bcrypt.hashSync(p, 9);", "", "let rows = xs.map (f)", "}",
    ],
    ".js": [
        "const d = readFileSync(p);", "for (const k of ks) {", "}", "const r = await q(k);",
        "const j = JSON.parse(readFileSync(p));", "ks.forEach(k => {", "});",
        "* await q(k)", "export async function go() {", "}", "const x = fetch(u);",
        "clearInterval(t);", "setInterval(f, 5);", "while (n) {", "}", "const s = scryptSync(p, q, 8);",
        "for await (const c of cs) {", "}", "await Promise.all(ps);", "// readFileSync(p)",
        "const m = JSON.parse(f.read());", "if (await ok()) {", "}", "const useEffect = 1;",
    ],
    ".txt": ["for (;;) {", "}"] + ["select *"] * 22,
}


def repo_of(number: Column) -> Column:
    return F.concat(F.lit("repo"), (number % 10).cast("string"))


def path_of(doc_id: Column) -> Column:
    return F.concat(F.lit("src/f"), doc_id.cast("string"), extension_of(doc_id))


def extension_of(doc_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (doc_id % 8 + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Give every core work when a table is one small file.  Large tables stay as read."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *key)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path, content``: each document becomes a file, each word a line."""
    docs = spread(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return _files_of(docs.withColumn("shift", F.lit(0)))


def _files_of(docs: DataFrame, *keep: str) -> DataFrame:
    """``shift`` moves the choice of templates, so the same words make other lines."""
    ext = extension_of(F.col("doc_id"))
    by_ext = F.create_map(*[
        x for name, lines in TEMPLATES.items()
        for x in (F.lit(name), F.array(*map(F.lit, lines)))])
    docs = docs.select(
        "doc_id", "text", "shift", *keep, ext.alias("ext"), F.element_at(by_ext, ext).alias("lines"))

    def line(word, i):
        pick = (F.length(word) * 7 + i * 3 + F.col("doc_id") + F.col("shift")) % F.size("lines") + 1
        return F.concat(
            F.repeat(F.lit("  "), (F.length(word) * 5 + i) % 5),
            F.element_at(F.col("lines"), pick.cast("int")))

    words = F.split(F.translate("text", "\n", " "), " ", -1)
    return docs.select(
        repo_of(F.col("doc_id")).alias("repo"), *keep,
        path_of(F.col("doc_id")).alias("path"),
        F.array_join(F.transform(words, line), "\n").alias("content"))


def broken_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, those of documents not in English without their content."""
    docs = table(spark, sf_dir, "documents")
    n = partitions(docs)
    # a path names one doc_id, so the texts meet their languages before they become files
    texts = spread(docs.select("doc_id", "text"), "doc_id") if n is None else parted(docs.select("doc_id", "text"), n, "doc_id")
    told = texts.join(parted(docs.select("doc_id", "lang"), n, "doc_id"), "doc_id")
    return _files_of(told.withColumn("shift", F.lit(0)), "lang").select(
        "repo", "path", F.when(F.col("lang") == "en", F.col("content")).alias("content"))


HEADS = ("c0", "c1")


def at_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file at each of the heads; every third one has another content at the second."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    docs = docs.withColumn("commit_sha", F.explode(F.array(*map(F.lit, HEADS))))
    moved = (F.col("commit_sha") == HEADS[1]) & (F.col("doc_id") % 3 == 0)
    return _files_of(docs.withColumn("shift", moved.cast("int")), "commit_sha")


def heads(pushes: DataFrame, number: Column) -> DataFrame:
    """Pushes, dealt to the heads in turn."""
    return pushes.withColumn("commit_sha", F.concat(F.lit("c"), (number % len(HEADS)).cast("string")))


RUN_SECONDS = 43_200


def findings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of half-day runs in ten repositories, one per event.

    Few files and codes, so that findings recur, vanish and return.
    """
    events = table(spark, sf_dir, "events")
    seconds = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), "ts")
    number = F.col("event_id")
    kind = F.col("event_type")
    rows = events.select(
        "event_id",
        repo_of(F.col("user_id")).alias("repo"),
        (F.floor(seconds / RUN_SECONDS) * RUN_SECONDS).alias("run_id"),
        kind.alias("rule_id"),
        F.concat(F.lit("Title of "), kind).alias("title"),
        F.when(kind == "error", "IO_DB").when(kind == "view", "INFO")
        .otherwise("MEMORY").alias("category"),
        F.when(kind == "error", "CRITICAL").when(kind == "purchase", "HIGH")
        .when(kind == "signup", "MEDIUM").when(kind == "click", "LOW")
        .when(number % 3 == 0, "NOTICE").otherwise("INFO").alias("severity"),
        F.concat(F.lit("f"), (number % 4).cast("string"), F.lit(".py")).alias("path"),
        (number % 100 + 1).cast("int").alias("line"),
        F.concat(F.lit(" c"), (number % 5).cast("string"), F.lit("  +=\t1 ")).alias("code"),
        F.lit("because").alias("why"),
        F.lit("do so").alias("fix"),
        F.when(number % 7 == 0, False).when(number % 7 == 1, True).alias("confirmed"),
        F.when(number % 7 < 2, "seen").otherwise("").alias("explanation"),
    )
    return with_fingerprint(rows).withColumnRenamed("path", "file")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the log, and for each repository a later one that found nothing."""
    seen = findings_log(spark, sf_dir).select("repo", "run_id").distinct()
    empty = seen.groupBy("repo").agg((F.max("run_id") + RUN_SECONDS).alias("run_id"))
    run = F.col("run_id")
    return seen.unionByName(empty).select(
        "repo", "run_id",
        (F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
         + F.make_dt_interval(secs=run.cast("decimal(18,6)"))).alias("ts"),
        F.when(run % (2 * RUN_SECONDS) == 0, F.left(
            F.sha1(F.concat("repo", run.cast("string")).cast("binary")), F.lit(12)))
        .otherwise("").alias("commit_sha"),
        F.lit("main").alias("branch"),
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets for the critical findings of the first half of January 2024."""
    log = findings_log(spark, sf_dir).where(
        (F.col("severity") == "CRITICAL") & (F.col("run_id") < 1_705_276_800))
    return log.groupBy("fingerprint").agg(
        F.min("run_id").alias("created_ts"), F.max("severity").alias("severity"),
        F.max("title").alias("title"),
    ).select(
        "fingerprint", F.concat(F.lit("T-"), F.left("fingerprint", F.lit(6))).alias("issue_key"),
        F.concat(F.lit("/browse/"), "fingerprint").alias("url"), "created_ts", "severity", "title")


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, push_id, diff_text``: one push per order, over one to four files.

    Some hunks leave their length out or have length zero, some files are deleted, some
    names are quoted, and some added lines look like a file header.
    """
    orders = spread(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    key = F.col("o_orderkey")

    def part(i):
        number = F.col("o_custkey") + i * 10
        name = path_of(number)
        quoted = (key + i) % 11 == 0
        gone = (key + i) % 7 == 0
        shape = (key + i) % 5
        start = ((key * 13 + i * 17) % 300 + 1).cast("string")
        count = F.element_at(F.array(*map(F.lit, ["", ",0", ",1", ",7", ",2"])),
                             (shape + 1).cast("int"))
        added = F.element_at(F.array(*map(F.lit, [1, 0, 1, 7, 2])), (shape + 1).cast("int"))
        head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name)
        lines = F.concat(
            F.lit("-- a/x\n-old\n"),
            F.repeat(F.lit("+++ b/src/f1.py\n"), added))
        live = F.concat(
            head, F.lit("\n+++ "),
            F.when(quoted, F.concat(F.lit('"b/\\303\\251\\t'), name, F.lit('"')))
            .otherwise(F.concat(F.lit("b/"), name)),
            F.lit("\n@@ -3,2 +"), start, count, F.lit(" @@ for (;;) {\n-"), lines,
            F.lit("\\ No newline at end of file"))
        dead = F.concat(head, F.lit("\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b"))
        return F.when(gone, dead).otherwise(live)

    numbers = F.sequence(F.lit(0).cast("bigint"), key % 4)
    return orders.select(
        repo_of(F.col("o_custkey")).alias("repo"), key.alias("push_id"),
        F.array_join(F.transform(numbers, part), "\n").alias("diff_text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as a knowledge base."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("note_ord"), F.concat(F.lit("b"), F.col("item_id").cast("string"))
        .alias("id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("topic"),
        "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("q_id"), "text")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, raw``: answers of many kinds, for the findings of the log."""
    number = F.col("event_id")
    text = number.cast("string")
    full = F.concat(
        F.lit('{"confirmed": '), F.when(number % 2 == 0, "true").otherwise("false"),
        F.lit(', "severity": "high", "explanation": " say '), text,
        F.lit(' ", "fix": "fix '), text, F.lit('"}'))
    kinds = [
        full,
        F.concat(F.lit("Well, I think:\n```json\n"), full, F.lit("\n``` so {it} is")),
        F.concat(F.lit("Here: "), full, F.lit(" Done.")),
        F.concat(F.lit('{"severity": "grave", "explanation": "n'), text, F.lit('", "fix": "  "}')),
        F.lit('[{"confirmed": false}]'),
        F.lit("not sure"),
        F.lit("  "),
        F.lit('{"confirmed": null, "severity": "low"}'),
        F.lit('{"confirmed": "false", "fix": null}'),
    ]
    chosen = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        chosen = F.when(number % 10 == i, kind).otherwise(chosen)
    return table(spark, sf_dir, "events").select("event_id", chosen.alias("raw"))
