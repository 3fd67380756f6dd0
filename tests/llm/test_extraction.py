import math
import random
import statistics
import time
from collections import Counter

import pytest
from helpers import prose

from rillscan.llm import extraction
from rillscan.llm.extraction import main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p>";if(a<b){}</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- <p>gone</p> -->
<div class="ad">Buy</div><article class="post"><h1>Head&shy;line</h1><p>One <b>bold</b>
 and&nbsp;two<br>lines &lt;3<p>Un<i>closed</i> para<ul><li>first<li>second</ul><form><input>Name<button>Go</button></form>
<blockquote>Quote</blockquote><div id="comments"><p>me too</p></div></article><aside>Side</aside>
<div class="cookie notice">We use</div><footer>&copy; us</footer>"""


def test_noise_goes_and_blocks_stay():
    assert main_text(PAGE) == "\n\n".join(
        ["Head­line", "One bold and two lines <3", "Unclosed para", "first", "second", "Quote"])


def test_awkward_markup():
    for source, text in (
            ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("a < b > c", "a < b > c"), ("<div", "<div"),
            ("<article><p>x &am y &amp</article>", "x &am y &"), ("<script>never ends <p>x", ""),
            ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("</p></div>x", "x"),
            ('<div title="a>b">in</div>out', "in\n\nout"), ("<p>" * 3000 + "deep", "deep")):
        assert main_text(source) == text, source


def test_names_within_an_article_are_a_weak_sign():
    source = """<article><div class="article-header"><h1>Head</h1></div><p class="social">On social matters</p>
      <div class="notice-board"><p>Board</p></div><div class="social"><p>Share me</p></div><ul class="menu"><li>Soup</ul>
      <section id="comments"><p>Me too</section><aside>By the way</aside></article><div class="article-header">Outside</div>"""
    assert main_text(source) == "Head\n\nOn social matters\n\nBoard"
    assert main_text("<div class='notice-board'>Notice</div><p>Text") == "Text"


SCHEMA = "page_id long, url string, html string"


def _own(seed):
    return prose(seed, 60, 4000)


def pages(host, n, first=0, skeleton="x"):
    return [(first + k, f"http://{host}/{k}", f"<body><div class=top>Welcome to us</div><div class={skeleton}><p>{_own(first + k)}</p></div>"
             "<div class=legal><p>All rights</p><p>No refunds</p></div></body>") for k in range(n)]


def _text(seed):
    return " ".join(_own(seed).split())


def test_branches_that_never_vary_go(spark):
    rows = pages("www.a.org", 40) + pages("b.org", 2, 100, "y") + pages("c.org", 1, 200) + [
        (None, None, None), (90, None, "<p>no url"), (91, "http://a.org/q", ""), (5, "http://a.org/5", pages("a.org", 6)[5][2])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as text", "'x' as host", "1 as low", "'t' as tree")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in extraction.extract(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for *_, t, n in got)
    by_url = {u: t for _, u, t, _ in got}
    assert by_url["http://www.a.org/3"] == _text(3) and by_url["http://a.org/5"] == _text(5)
    # too few pages to tell, of the host and of the skeleton
    assert by_url["http://b.org/1"] == f"Welcome to us\n\n{_text(101)}\n\nAll rights\n\nNo refunds"
    # one page, built like those of another host
    assert by_url["http://c.org/0"] == _text(200)
    assert by_url["http://a.org/q"] == "" and by_url[None] in ("", "no url")
    assert extraction.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_tree_against_names(spark, monkeypatch, sent):
    """Articles in what is named like an advert, and notices in what is named like nothing, each host with few
    pages; sentences of a small pool."""
    monkeypatch.setattr(extraction, "SENT_BYTES", sent)
    pool = [prose(9000 + i, 6, 3000).strip() for i in range(12)]
    rows = [(k, f"http://h{k % 70}.org/{k}", f"<body><div class=q7>{pool[k % 12]}</div><div class=advert><p>{_own(k)}</p></div>"
             f"<div><span>{pool[(k * 5 + 3) % 12]}</span></div></body>") for k in range(420)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: _text(k) for k in range(420)}
    assert main_text(rows[0][2]) != got[0]  # names alone say otherwise


def _by_hand(rows):
    """Importance of each element by its definition, from the pages of each tree."""
    trees = {}
    for _, url, source in rows:
        page = extraction.parse(source or "")
        for tree in (extraction._own_tree(url), extraction._page_tree(page)):
            styles, words = trees.setdefault(tree, ({}, {}))
            for path, children in {(e.path, tuple(e.children)) for e in page.elements}:
                styles.setdefault(path, Counter())[children] += 1
            for path, word in {(e.path, w) for e, t in page.blocks for w in t.split()}:
                words.setdefault(path, Counter())[word] += 1
    out = {}
    for tree, (styles, words) in trees.items():
        m = {p: max(2, sum(c.values())) for p, c in styles.items()}
        h = {p: {w: math.log(k, m[p]) for w, k in c.items()} for p, c in words.items()}
        for path, seen in styles.items():
            branch = [p for p in h if (p + ">").startswith(path + ">")]
            if not branch:
                continue
            n = sum(seen.values())
            presentation = -sum(k / n * math.log(k / n, m[path]) for k in seen.values())
            content = 1 - statistics.fmean(x for p in branch for x in h[p].values())
            share = 1 if branch == [path] else 0.9 ** len(seen)
            richest = max(1 - statistics.fmean(h[p].values()) for p in branch)
            out[tree, path] = (n, presentation, content, richest, (1 - share) * presentation + share * content)
    return out


def test_importance_by_its_definition(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        parts = "".join(rng.choice(["<p>{}</p>", "<div class=a>{}</div>", "<ul><li>{}<li>x</ul>", "<h2>{}</h2>"]).format(
            prose(rng.randrange(40), rng.randrange(1, 12), 50)) for _ in range(rng.randrange(4)))
        rows.append((k, f"http://h{k % 3}.org/", f"<body>{parts}<footer>same {k % 4}</footer></body>"))
    got = {(r.tree, r.path): (r.pages, r.presentation, r.content, r.richest, r.importance)
           for r in extraction.style_tree(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = _by_hand(rows)
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9), key


def test_supplied_pages_need_no_names(spark, monkeypatch):
    """Menus, adverts and footers of the supplied pages go by the trees alone."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: r.text for r in extraction.extract(df).collect()}
    said = extraction.verdicts(extraction.style_tree(df)).collect()
    trees = {t: extraction.Verdicts(frozenset(r.path for r in said if r.tree == t and r.noise),
                                    frozenset(r.path for r in said if r.tree == t and not r.noise)) for t in {r.tree for r in said}}
    for name in ("NOISE_TAGS", "NOISE_NAMES", "MAIN"):
        monkeypatch.setattr(extraction, name, frozenset(["head"]) if name == "NOISE_TAGS" else frozenset())
    rows = df.collect()
    assert {r.page_id: main_text(r.html or "", trees, r.url) for r in rows} == want
    assert all("&copy;" not in t and "©" not in t for t in want.values())


def test_broken_markup_is_read_once():
    began = time.process_time()
    for source in ("<a " * 350_000, "<a \">\" " * 150_000, "</script " * 120_000, "<script>" + "</script " * 120_000, "<!" * 500_000,
                   "<div>" * 200_000 + "</p></b></x>" * 50_000, "<!-- " * 200_000, "<a b='" * 200_000):
        extraction.parse(source)
    assert time.process_time() - began < 20
    assert main_text("<div>" * 300 + "deep" + "</div>" * 300 + "<p>out") == "deep\n\nout"


def test_repeated_article_paragraphs_stay(spark):
    rows = [(k, f"http://c.org/{k}", "<article><p>Same words</p></article><footer>f</footer>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in extraction.extract(df).collect()} == {"Same words"}
