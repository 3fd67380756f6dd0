"""Token counts by unigram scores over a trie of pre-tokens.

A pre-token is a run of characters between white space, with the vocabulary's word mark before
it.  The distinct pre-tokens of a task are inserted in a trie; a node stands for a prefix and
holds the best forward score of that prefix and the tokens it takes, computed once from its
ancestors however many pre-tokens share it.  The last node of a pre-token holds its count, and a
text's count is the sum over its pre-tokens.  Tries of a task are bounded by ``MOST_NODES``: a
full one is dropped and begun anew, which changes no result.

The vocabulary is a public one.  Its file gives ranks, not probabilities, so a piece of rank r has
the score ``-log(r + 3)`` (Zipf's law); a character without a piece costs ``UNKNOWN`` more than the
worst piece for each of its UTF-8 bytes, and counts as so many tokens.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pieces, texts

MARK = "▁"
UNKNOWN = 10.0
MOST_NODES = 400_000
LONG = 200
"""Longer pre-tokens are scored the same way but not kept in the trie."""


class Vocabulary:
    """Pieces and their scores; ties between segmentations go to fewer tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        # pieces from their last character backwards: character -> [score or None, further ones]
        self.endings: dict[str, list] = {}
        for piece, score in scores.items():
            further, entry = self.endings, None
            for c in reversed(piece):
                entry = further.setdefault(c, [None, {}])
                further = entry[1]
            if entry is not None:
                entry[0] = score

    def __reduce__(self):
        return Vocabulary, (self.scores,)

    @staticmethod
    def read(path: str) -> Vocabulary:
        """From the file of a sentencepiece model."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks = {
            model.id_to_piece(i): max(0.0, -model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        return Vocabulary({p: -math.log(r + 3) for p, r in ranks.items()})

    def next(self, text: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Forward score and tokens (negative) of ``text[:end]``, from those of all shorter prefixes."""
        last = len(text[end - 1].encode("utf-8", "replace"))
        score, tokens = path[end - 1]
        best = (score + self.unknown * last, tokens - last)
        further, start = self.endings, end
        while start:
            start -= 1
            entry = further.get(text[start])
            if entry is None:
                break
            piece, further = entry
            if piece is not None:
                score, tokens = path[start]
                score += piece
                if score > best[0] or score == best[0] and tokens - 1 > best[1]:
                    best = (score, tokens - 1)
        return best


class Trie:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.forward: list[tuple[float, int]] = [(0.0, 0)]
        self.terminal: dict[str, tuple[float, int]] = {}

    def count(self, word: str) -> tuple[float, int]:
        """Score and tokens of a pre-token (without its mark)."""
        found = self.terminal.get(word)
        if found is None:
            if len(self.forward) > MOST_NODES:
                self.clear()
            found = self._walk(MARK + word, keep=len(word) <= LONG)
            if len(word) <= LONG:
                self.terminal[word] = found
        return found

    def _walk(self, marked: str, keep: bool) -> tuple[float, int]:
        vocabulary, child, forward = self.vocabulary, self.child, self.forward
        path, node = [forward[0]], 0
        for at, c in enumerate(marked, 1):
            below = child.get((node, c)) if keep else None
            if below is not None:
                path.append(forward[below])
            else:
                path.append(vocabulary.next(marked, at, path))
                if keep:
                    below = child[node, c] = len(forward)
                    forward.append(path[-1])
            node = below
        score, tokens = path[-1]
        return score, -tokens


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, score`` of every row.

    Null, empty and blank texts have no tokens and the score 0; repeated rows give repeated
    results; an empty table gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file

    def run(batches):
        trie = Trie(sent.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                n_words, n_tokens, scores = [], [], []
                for text in part.column("text").to_pylist():
                    words = text.split()
                    known, total, tokens = trie.terminal, 0.0, 0
                    for w in words:
                        found = known.get(w)
                        if found is None:
                            found = trie.count(w)
                            known = trie.terminal  # another one after the trie was full
                        total += found[0]
                        tokens += found[1]
                    n_words.append(len(words))
                    n_tokens.append(tokens)
                    scores.append(total)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()),
                     pa.array(scores, pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])

    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, score double")
