"""Main text of web pages by a site style tree.

The pages of a host are merged: an element is known by its path of tags and presentation (class, id, role).
For each element of the merged tree it is counted how the pages present it (the sequence of its children)
and which words they put into it.  Words that recur on most pages that have the element, in an element whose
presentation hardly varies, are no content.  A branch is removed from every page if its importance is
low and so is that of all elements with text in it.

Most hosts have few pages, on which nothing recurs.  So pages are merged a second time, over hosts, by their
skeleton: the elements right below the body.  A host's own tree speaks first, the tree of the
skeleton second.  Where neither has seen enough pages, tags and names (menu, advert and the like) decide; they
never remove what a tree calls content.  Plain tags of an ``article`` or ``main`` element are content.

Words move as hashes, once for some pages at a time, to buckets that count them over all pages; an element's
words are in all buckets, so neither a large host nor a frequent word is a large group.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from .shared import partitions, pieces, written
from .squeeze import packed, restored, squeezed, unpacked

# Names by which elements are told.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var label".split())
RAW = frozenset("script style textarea title xmp noframes".split())
NOISE_TAGS = frozenset(
    "nav footer aside form menu dialog button select option head script style noscript template iframe svg canvas "
    "audio video object map textarea title".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer sidebar aside widget notice notices cookie cookies consent "
    "alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "comment comments commentlist reply replies respond disqus pager pagination toolbar contentinfo complementary "
    "skip".split())
MAIN = frozenset(("article", "main"))
CLOSES = {  # a start tag of the key ends an open element of the values
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody"),
}
SCOPES = frozenset("ul ol dl table article main body html div section".split())

TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())

LOW = ((200, 0.8), (30, 0.5), (5, 0.3))
"""A branch is removed below this importance, by how many pages have it: with few pages common words weigh more."""
SURE = (200, 0.85)
"""From so many pages on, and this importance, an element is content whatever its name."""
DECAY = 0.9
"""Share of the content in an element's importance, to the power of the ways it is presented; the rest is presentation."""
DEEPEST = 64
"""Elements below this depth count as their ancestor there."""
SENT_BYTES = 32 << 20
"""Verdicts up to this measured size are sent to all tasks; more are joined with the pages."""
SALTS = 64
BUCKET_BYTES = 64 << 20
"""Markup whose words are counted in one task."""
_HELD, _BITS = 1 << 20, 48

NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"""[>"']""")


@dataclass
class Element:
    key: str
    path: str
    depth: int
    noise: bool  # by tags and names
    main: bool
    plain: bool  # named only by tags since the main element
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    elements: list[Element]
    blocks: list[tuple[Element, str]]  # in page order

    @property
    def skeleton(self) -> str:
        """The elements right below the body, each once."""
        return "|".join(dict.fromkeys(k for e in self.elements if e.path in ("html", "html>body") for k in e.children if k != "body"))


def _element(parent: Element | None, name: str, rest: str) -> Element:
    named = sorted({t for m in NAMES.findall(rest) for t in re.split(r"[^a-z0-9]+", m.lower()) if t}) if rest else []
    key = ".".join([name, *named])
    if parent is not None and (not parent.children or parent.children[-1] != key):
        parent.children.append(key)
    main = name in MAIN or name not in ("html", "body") and "main" in named and "role" in rest
    inside = parent is not None and parent.main
    noise = parent is not None and parent.noise
    if not main and name not in ("html", "body"):
        if inside:  # an article's headline block or board of notices is named for more than one thing
            by_name = bool(named) and name not in TEXT_TAGS and NOISE_NAMES.issuperset(named)
        else:
            by_name = not NOISE_NAMES.isdisjoint(named)
        noise = noise or name in NOISE_TAGS or name == "header" and not inside or by_name
    depth = parent.depth + 1 if parent else 0
    path = key if parent is None else parent.path if depth > DEEPEST else f"{parent.path}>{key}"
    return Element(key, path, depth, noise, main or inside, main or inside and parent.plain and not named)


class _Source:
    """A page's markup, read once from left to right however broken it is."""

    def __init__(self, text: str):
        self.text, self.size = text, len(text)
        self.last_end = text.rfind(">")
        self.quotes = True  # until the quotes of a tag run to the end of the page

    def _end(self, at: int) -> int:
        """After the end of the tag that starts at ``at``; quoted ends do not count."""
        k = at
        while self.quotes:
            m = QUOTE_OR_END.search(self.text, k)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.end()
            else:
                k = self.text.find(m[0], m.end()) + 1
                self.quotes = k > 0
        return self.text.find(">", at) + 1

    def tags(self):
        """(start, end, name, is an end tag, attributes) of tags; comments and declarations have no name."""
        at = self.text.find("<")
        while 0 <= at < self.size:
            text = self.text
            if text.startswith("<!--", at):
                close = text.find("-->", at + 4)
                end = self.size if close < 0 else close + 3
                yield at, end, None, False, ""
            elif at > self.last_end:
                return
            elif text[at + 1:at + 2] in ("!", "?"):
                end = text.find(">", at) + 1
                yield at, end, None, False, ""
            elif m := NAME.match(text, at):
                end = self._end(m.end())
                skip = yield at, end, m[1].lower(), text[at + 1] == "/", text[m.end():end - 1]
                end = skip or end
            else:
                end = at + 1
            at = text.find("<", end)

    def after(self, name: str, at: int) -> int:
        """The end of raw text that starts at ``at``."""
        m = re.compile(rf"</{re.escape(name)}\b", re.I).search(self.text, at)
        end = self.text.find(">", m.end()) + 1 if m else 0
        return end or self.size


def parse(source: str) -> Page:
    """Elements and text blocks of a page.  Tags that are missing are supplied, markup that cannot
    be read is skipped, comments and raw text are no text."""
    root = _element(None, "html", "")
    page = Page([root], [])
    stack: list[tuple[str, Element]] = [("html", root)]
    opened: Counter[str] = Counter()
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                page.blocks.append((stack[-1][1], text))
            held.clear()

    def push(name, element):
        stack.append((name, element))
        opened[name] += 1

    def cut(k):
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def close(names, bounds=SCOPES):
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                cut(k)
                return
            if stack[k][0] in bounds:
                return

    def start(name, rest):
        """An element of a start tag; the place to go on from, if what follows is raw text."""
        if name in ("html", "body"):
            if name == "body":
                close(("head",), ())
                element = _element(stack[-1][1], name, "")
                page.elements.append(element)
                push(name, element)
            return
        close(("p",))
        if name in CLOSES:
            for _ in range(2):
                close(CLOSES[name])
        element = _element(stack[-1][1], name, rest)
        page.elements.append(element)
        if not rest.endswith("/"):
            push(name, element)

    markup, read = _Source(source), 0
    tags = markup.tags()
    found = next(tags, None)
    while found:
        at, end, name, is_end, rest = found
        held.append(source[read:at])
        read, skip = end, None
        if name in RAW and not is_end:
            flush()
            read = skip = markup.after(name, end)
        elif name == "br":
            held.append(" ")
        elif name is None or name in INLINE or name in VOID and name != "hr":
            pass
        else:
            flush()
            if name == "hr":
                pass
            elif not is_end:
                start(name, rest)
            elif name == "p":
                close(("p",))
            elif opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                cut(k)
        try:
            found = tags.send(skip)
        except StopIteration:
            found = None
    held.append(source[read:])
    flush()
    return page


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _own_tree(url: str | None) -> str:
    return "h:" + host_of(url)


def _page_tree(page: Page) -> str:
    return "s:" + xxhash.xxh64_hexdigest(page.skeleton.encode("utf-8", "surrogatepass"))


_ROW = "bucket long, elements array<struct<tree:string,path:string,is_word:boolean,hashes:binary,k:binary>>"


def _values(buckets: int):
    """Hashes of the words and of the presentations of each element, and how many pages have them, over some
    pages at a time, in a packed row for each bucket of hashes."""
    def out(texts, segments):
        hashes = hash_array(np.array(texts, dtype=object), categorize=False) >> np.uint64(64 - _BITS)
        held: dict[tuple[str, str, bool], list[np.ndarray]] = {}
        for trees, path, is_word, begin, end in segments:
            for tree in trees:
                held.setdefault((tree, path, is_word), []).append(hashes[begin:end])
        rows: dict[int, list[tuple]] = {}
        for (tree, path, is_word), parts in held.items():
            found, k = np.unique(np.concatenate(parts), return_counts=True)
            to = (found >> np.uint64(_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
            cut = np.flatnonzero(np.diff(to, prepend=to[0])).tolist()
            for i, j in zip([0, *cut], [*cut, len(found)], strict=True):
                rows.setdefault(int(to[i]), []).append((tree, path, is_word, packed(found[i:j]), squeezed(k[i:j])))
        kind = pa.struct([("tree", pa.string()), ("path", pa.string()), ("is_word", pa.bool_()), ("hashes", pa.binary()), ("k", pa.binary())])
        names = [f.name for f in kind]
        elements = [[dict(zip(names, e, strict=True)) for e in own] for own in rows.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(elements, pa.list_(kind))], ["bucket", "elements"])

    def run(batches):
        texts: list[str] = []  # words and presentations, each once for a page and element
        segments: list[tuple] = []
        for batch in batches:
            for part in pieces(batch, "html"):
                for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    page = parse(source or "")
                    trees = (_own_tree(url), _page_tree(page))
                    words: dict[str, list[str]] = {}
                    for e, text in page.blocks:
                        words.setdefault(e.path, []).append(text)
                    styles: dict[str, set[str]] = {}
                    for e in page.elements:
                        styles.setdefault(e.path, set()).add(">".join(e.children))
                    for is_word, found in ((True, words), (False, styles)):
                        for path, own in found.items():
                            begin = len(texts)
                            texts.extend(set(" ".join(own).split()) if is_word else own)
                            segments.append((trees, path, is_word, begin, len(texts)))
                    if len(texts) > _HELD:
                        yield out(texts, segments)
                        texts, segments = [], []
        if segments:
            yield out(texts, segments)
    return run


_SUMS = "tree string, path string, pages long, k_log_k double, styles long, words long, log_k double"


def _sums(table: pa.Table) -> pa.Table:
    """Of a bucket, what it adds to the sums of each element."""
    held: dict[tuple[str, str], dict[bool, list]] = {}
    for r in (e for row in table.to_pylist() for e in row["elements"]):
        held.setdefault((r["tree"], r["path"]), {True: [], False: []})[r["is_word"]].append((unpacked(r["hashes"]), restored(r["k"])))
    rows = []
    for (tree, path), parts in held.items():
        counts = {}
        for is_word, own in parts.items():
            if own:
                _, at = np.unique(np.concatenate([h for h, _ in own]), return_inverse=True)
                counts[is_word] = np.bincount(at, weights=np.concatenate([k for _, k in own]))
            else:
                counts[is_word] = np.zeros(0)
        styles, words = counts[False], counts[True]
        rows.append((tree, path, int(styles.sum()), float((styles * np.log(styles)).sum()), len(styles), len(words), float(np.log(words).sum())))
    types = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
    names = ["tree", "path", "pages", "k_log_k", "styles", "words", "log_k"]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``tree, path, pages, presentation, content, own, importance, richest`` of each element with text in its branch.

    A word that k of the m pages with an element have in it has the entropy log(k) / log(m).  ``own`` is 1 less
    its mean over the words of the element itself, ``content`` over those of its branch; ``richest`` is the
    greatest ``own`` in the branch.  ``presentation`` is the entropy of the element's child sequences, to the base
    m as well.  With l sequences ``importance`` is (1 - DECAY ** l) parts presentation and the rest content; for an
    element with text of its own alone it is the content.
    """
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    size = rows.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    buckets = max(partitions(rows.sparkSession), -(-size // BUCKET_BYTES))
    sums = rows.mapInArrow(_values(buckets), _ROW).groupBy("bucket").applyInArrow(lambda t: _sums(t), _SUMS)
    names = ("pages", "k_log_k", "styles", "words", "log_k")
    own = written(sums.groupBy("tree", "path").agg(*[F.sum(n).alias(n) for n in names]).withColumn(
        "base", F.log(F.greatest("pages", F.lit(2)))))
    entropy = F.col("log_k") / F.col("base")  # each element by its own pages
    parts = F.split("path", ">")
    above = own.where("words > 0").select(
        "tree", "words", entropy.alias("entropy"), (1 - entropy / F.col("words")).alias("own"), F.explode(F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ">"))).alias("path"))
    branch = above.groupBy("tree", "path").agg(
        F.sum("words").alias("words"), F.sum("entropy").alias("entropy"), F.max("own").alias("richest"))
    content = 1 - F.col("b.entropy") / F.col("b.words")
    presentation = (F.log("pages") - F.col("k_log_k") / F.col("pages")) / F.col("base")
    share = F.when((F.col("o.words") > 0) & (F.col("o.words") == F.col("b.words")), F.lit(1.0)).otherwise(F.pow(F.lit(DECAY), "styles"))
    return own.alias("o").join(branch.alias("b"), (F.col("o.tree") == F.col("b.tree")) & (F.col("o.path") == F.col("b.path"))).select(
        "o.tree", "o.path", "pages", presentation.alias("presentation"), content.alias("content"),
        F.when(F.col("o.words") > 0, 1 - F.col("log_k") / F.col("base") / F.col("o.words")).alias("own"), "richest",
        ((1 - share) * presentation + share * content).alias("importance"))


def verdicts(tree: DataFrame) -> DataFrame:
    """``tree, path, noise`` of the elements on which a tree can say something: branches to remove
    (``noise``), and elements that are content for sure."""
    least = F.lit(None).cast("double")
    for pages, low in reversed(LOW):
        least = F.when(F.col("pages") >= pages, low).otherwise(least)
    bound = F.greatest("importance", "richest")
    sure = (F.col("pages") >= SURE[0]) & F.coalesce(F.col("own") >= SURE[1], F.lit(False))
    whole = F.element_at(F.split(F.element_at(F.split("path", ">"), -1), r"\."), 1).isin("html", "body")
    return tree.select("tree", "path", F.when((bound < least) & ~whole, True).when(sure, False).alias("noise")).where(
        F.col("noise").isNotNull())


@dataclass(frozen=True)
class Verdicts:
    """Of one tree: paths to remove, and paths that are content."""
    noise: frozenset[str] = frozenset()
    content: frozenset[str] = frozenset()

    def of(self, path: str) -> bool | None:
        """True for a branch to remove; the first element from the root that is one decides."""
        parts = path.split(">")
        if any(">".join(parts[:n]) in self.noise for n in range(1, len(parts) + 1)):
            return True
        return False if path in self.content else None


def main_text(source: str, trees: dict[str, Verdicts] | None = None, url: str | None = None) -> str:
    """The blocks of the page that are content by the tree of its host, else by that of its skeleton, else by tags
    and names; where the page has a main element and names decide, only those in it.  Text of an article under
    plain tags is never removed by a tree, since whole pages may be copies of one another."""
    page = parse(source)
    found = [t for t in ((trees or {}).get(k) for k in (_own_tree(url), _page_tree(page))) if t]
    said: dict[str, bool | None] = {}
    for element, _ in page.blocks:
        if element.path not in said:
            said[element.path] = next((v for v in (t.of(element.path) for t in found) if v is not None), None)
    any_main = any(e.main and not e.noise for e, _ in page.blocks)
    out = []
    for element, text in page.blocks:
        noise = said[element.path]
        if noise is None or element.plain:
            noise = element.noise or any_main and not element.main
        if not noise:
            out.append(text)
    return "\n\n".join(out)


def _texts(part: pa.RecordBatch, trees) -> pa.RecordBatch:
    texts = [main_text(h or "", t, u) for h, u, t in zip(
        part.column("html").to_pylist(), part.column("url").to_pylist(), trees, strict=True)]
    return pa.RecordBatch.from_arrays(
        [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
         pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _trees(rows) -> dict[str, Verdicts]:
    return {r["tree"]: Verdicts(frozenset(r["noise"]), frozenset(r["content"])) for r in rows}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    Blocks are joined by two newlines, white space in a block is one blank, character references
    are decoded.  A null or empty page has an empty text; a null url is the host ''; repeated rows
    give repeated results (and count as pages of the trees); other columns are not read.  The trees take one
    reading of the pages, the texts another; pages are not exchanged unless there are more verdicts than can be
    sent to all tasks.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    said = written(verdicts(style_tree(rows)).groupBy("tree").agg(
        F.collect_list(F.when(F.col("noise"), F.col("path"))).alias("noise"),
        F.collect_list(F.when(~F.col("noise"), F.col("path"))).alias("content")))
    size = said.agg(F.sum(F.length("tree") + F.length(F.to_json(F.struct("noise", "content"))))).first()[0] or 0
    kind = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    if size <= SENT_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast(_trees(said.toLocalIterator()))

        def run(batches):
            for batch in batches:
                for part in pieces(batch, "html"):
                    yield _texts(part, [sent.value] * part.num_rows)

        return rows.mapInArrow(run, kind)

    def run_joined(batches):
        for batch in batches:
            for part in pieces(batch, "html"):
                trees = [_trees(x for x in (a, b) if x) for a, b in zip(
                    part.column("of_host").to_pylist(), part.column("of_skeleton").to_pylist(), strict=True)]
                yield _texts(part, trees)

    keys = rows.mapInArrow(_with_trees, "page_id {0}, url string, html string, host_tree string, skeleton_tree string".format(
        rows.schema["page_id"].dataType.simpleString()))
    for key, name in (("host_tree", "of_host"), ("skeleton_tree", "of_skeleton")):
        tree = said.select(F.col("tree").alias(key), F.struct("tree", "noise", "content").alias(name))
        keys = lookup(keys, tree, [key], ["url"], "left", SALTS)
    return keys.select("page_id", "url", "html", "of_host", "of_skeleton").mapInArrow(run_joined, kind)


def _with_trees(batches):
    for batch in batches:
        for part in pieces(batch, "html"):
            urls, pages = part.column("url").to_pylist(), part.column("html").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), part.column("html"),
                 pa.array([_own_tree(u) for u in urls], pa.string()),
                 pa.array([_page_tree(parse(h or "")) for h in pages], pa.string())],
                ["page_id", "url", "html", "host_tree", "skeleton_tree"])
