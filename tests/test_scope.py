"""Scopes found by windows against plain loops over random files."""

import random

from rillscan.operators import lines, scope


def braces_by_definition(text):
    """A brace that opens is matched by the first later one that brings the height back below it.
    It encloses the lines that start between the two, and is a loop's if a loop's head came after
    the brace opened before it."""
    marks, heads, locks = [], [], []  # places are (line, column), heads before the first column
    height = 0
    for n, raw in enumerate(text.split("\n")):
        s = raw.strip()
        word = next((w for w in ("foreach", "for", "while", "do") if s == w or s.startswith((w + " ", w + "("))), None)
        if word:
            heads.append((n, -1))
        if s.startswith("synchronized") or " synchronized (" in f" {s}":
            locks.append((n, -1))
        for k, ch in enumerate(raw):
            if ch == "{":
                height += 1
                marks.append(((n, k), 1, height))
            elif ch == "}" and height:
                marks.append(((n, k), -1, height))
                height -= 1
    spans, before = [], (-1, -1)
    for at, step, level in marks:
        if step > 0:
            end = next((to for to, d, h in marks if to > at and d < 0 and h == level), (1 << 30, 0))
            spans.append((at, end, any(before < h < at for h in heads), any(before < h < at for h in locks)))
            before = at
    lines_ = range(text.count("\n") + 1)
    inside = [[s for s in spans if s[0] < (n, -1) < s[1]] for n in lines_]
    return [(sum(s[2] for s in own), any(s[3] for s in own)) for own in inside]


def indents_by_loop(text):
    out = []
    rows = text.split("\n")
    facts = []
    for raw in rows:
        s = raw.strip()
        facts.append((s, len(raw) - len(raw.lstrip(" ")), bool(s) and not s.startswith("#")))

    def still_open(j, i):
        return all(not code or ind > facts[j][1] for _, ind, code in facts[j + 1:i + 1])

    for i in range(len(rows)):
        loops = [j for j in range(i)
                 if facts[j][0].startswith(("for ", "while ", "for(", "while("))]
        asyncs = [j for j in range(i) if facts[j][0].startswith("async def ")]
        out.append((sum(still_open(j, i) for j in loops),
                    bool(asyncs) and still_open(asyncs[-1], i)))
    return out


BRACE_PIECES = ["for (;;) {", "while (x)", "do", "do {", "{", "}", "}}", "{}", "if (a) {", "x();",
                "foreach (a)", "forEach(a) {", "form {", "synchronized (a) {", "synchronized",
                "a = b synchronized (c)", "", "// for {", "} else {", "\tfor (a) { b(); }", "}{"]
INDENT_PIECES = ["for a in b:", "while(x):", "async def f():", "x = 1", "", "   ", "# for a", "\tx",
                 "for(a)", "fortune", "async def g():", "if a:", "def h():", "#"]


def _files(pieces, seed, count=120):
    rng = random.Random(seed)
    return {
        f"f{i}.x": "\n".join(
            " " * rng.choice([0, 0, 1, 2, 4, 8]) + rng.choice(pieces)
            for _ in range(rng.randint(1, 60)))
        for i in range(count)
    }


def _annotated(spark, files, kind, column):
    sources = spark.createDataFrame(
        [("r", p, t) for p, t in files.items()], "repo string, path string, content string")
    rows = scope.annotate(lines.explode_lines(sources), kind).collect()
    got = {(r.path, r.line): (r.loop_depth, r[column]) for r in rows}
    assert len(rows) == len(got) == sum(t.count("\n") + 1 for t in files.values())
    return got


def test_brace_scopes(spark):
    files = _files(BRACE_PIECES, 1)
    got = _annotated(spark, files, scope.BRACES, "in_sync")
    for path, body in files.items():
        for i, want in enumerate(braces_by_definition(body), start=1):
            assert got[path, i] == want, (path, i)


def test_indent_scopes(spark):
    files = _files(INDENT_PIECES, 2)
    got = _annotated(spark, files, scope.INDENT, "in_async")
    for path, body in files.items():
        for i, want in enumerate(indents_by_loop(body), start=1):
            assert got[path, i] == want, (path, i)


def test_lines_around_a_block(spark):
    body = "go();\nwhile (more())\n{\n  take();\n  if (done) { stop(); }\n}\nrest();\nsynchronized (me) {\n  wait();\n}"
    got = _annotated(spark, {"b.cs": body}, scope.BRACES, "in_sync")
    assert [got["b.cs", i][0] for i in range(1, 11)] == [0, 0, 0, 1, 1, 1, 0, 0, 0, 0]
    assert [got["b.cs", i][1] for i in range(8, 11)] == [False, True, True]
