import pytest
from helpers import awkward, prose, table

from rillscan.llm import queries, token_counts
from rillscan.llm.token_counts import MARK, Trie, Vocabulary

TOY = Vocabulary({MARK: -3.0, MARK + "b": -2.0, "a": -2.5, "ba": -2.0, "co": -2.0, "c": -3.0, "o": -3.0, "bac": -3.5, MARK + "baco": -9.0, "ob": -2.0})


def best(vocabulary, text):
    """The best of all segmentations, each found by recursion."""
    if not text:
        return (0.0, 0)
    n = len(text[0].encode())
    score, tokens = best(vocabulary, text[1:])
    options = [(score + vocabulary.unknown * n, tokens - n)]
    for k in range(1, len(text) + 1):
        if text[:k] in vocabulary.scores:
            score, tokens = best(vocabulary, text[k:])
            options.append((score + vocabulary.scores[text[:k]], tokens - 1))
    return max(options)


@pytest.mark.parametrize("word", ["b", "ba", "baco", "bacoba", "cobac", "xé", "aaaa", "obobob", "b\U0001F600a"])
def test_trie_by_brute_force(word):
    trie = Trie(TOY)
    for w in ("bac", "co", word[:2], word):
        score, tokens = trie.count(w)
        want = best(TOY, MARK + w)
        assert score == pytest.approx(want[0]) and tokens == -want[1]


def test_prefixes_are_scored_once():
    trie, calls = Trie(TOY), []
    step = TOY.next
    trie.vocabulary = type("V", (), {"next": lambda self, *a: calls.append(a[1]) or step(*a)})()
    for w in ("bacoba", "bacobo", "baco"):
        trie.count(w)
    assert len(calls) == 7 + 1


def test_a_full_trie_begins_anew(spark, monkeypatch):
    docs = table(spark, awkward())
    whole = {tuple(r) for r in token_counts.token_counts(docs, TOY).collect()}
    monkeypatch.setattr(token_counts, "MOST_NODES", 50)
    small = Trie(TOY)
    for w in prose(3, 400).split():
        assert small.count(w) == small._walk(MARK + w, keep=False)
    assert len(whole) == len({r[:2] for r in awkward()})


def test_on_tables_with_a_public_vocabulary(spark):
    vocabulary = Vocabulary.read(queries.VOCABULARY)
    trie = Trie(vocabulary)
    got = token_counts.token_counts(table(spark, awkward()), vocabulary).collect()
    texts = {i: t or "" for i, t, *_ in awkward()}
    assert len(got) == len(awkward())
    for r in got:
        if r.doc_id is not None:
            words = texts[r.doc_id].split()
            assert r.n_pretokens == len(words) and r.n_tokens == sum(trie.count(w)[1] for w in words)
    assert token_counts.token_counts(table(spark, []), vocabulary).count() == 0
    assert trie.count("the")[1] == 1 and trie.count("☃☃")[1] >= 2
