"""Operator 7: word-piece lengths by a linear longest-match automaton.

A word is ``[^\\x20\\x09-\\x0D]+``. Its pieces are those of greedy longest match
from the left over a byte vocabulary, the word preceded by the byte that starts
a word. The vocabulary is a trie; a node's failure link names the node that is
left after popping the longest pieces which the node's string starts with, and
the number of those pieces is computed beforehand. Reading a word then costs one
step a byte, and no piece is ever built.

Defined cases: a null or empty text has no words and no tokens; a word
that the pieces cannot cover counts as one unknown token; of pieces that fit, the
longest is taken, so there are no ties; very long texts and words are read whole,
in time that grows with their length; repeated rows give repeated results; an
empty table returns no rows; extra columns stay, ones named like outputs are
replaced.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The byte before each word, as the vocabulary marks the start of a word.
START = b" "


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """A trie with failure links and counts of popped pieces."""

    def __init__(self, pieces: list[bytes]):
        child: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                nxt = child[node].get(b)
                if nxt is None:
                    nxt = child[node][b] = len(child)
                    child.append({})
                    ends.append(False)
                node = nxt
            ends[node] = bool(piece)
        # fail[v] is -1 where popping pieces cannot go on; the root's own is too
        fail, popped = [-1] * len(child), [0] * len(child)
        todo = deque((0, b, v) for b, v in child[0].items())
        while todo:
            u, b, v = todo.popleft()
            if ends[v]:
                fail[v], popped[v] = 0, 1
            else:
                w, n = fail[u], popped[u]
                while w >= 0 and b not in child[w]:
                    n += popped[w]
                    w = fail[w]
                if w >= 0:
                    fail[v], popped[v] = child[w][b], n
            todo.extend((v, c, x) for c, x in child[v].items())
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match; 1 if it has none."""
        child, fail, popped = self.child, self.fail, self.popped
        n = u = 0
        for b in word:
            while (nxt := child[u].get(b)) is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = nxt
        while u:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 1
        return n


def counter(pieces: list[bytes]):
    """``f(text) -> {n_words, n_tokens}`` with a memo of words."""
    count, memo = Automaton(pieces).count, {}

    def f(text: str) -> dict:
        words = text.encode("utf-8", "surrogatepass").split()
        n, get = 0, memo.get
        for w in words:
            if (k := get(w)) is None:
                k = count(START + w)
                if len(w) < 64:
                    if len(memo) >= common.MEMO_ENTRIES:
                        memo.clear()
                    memo[w] = k
            n += k
        return {"n_words": len(words), "n_tokens": n}

    return f


def count_tokens(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add ``n_words`` and ``n_tokens`` to every row, replacing such columns."""
    path = path or vocabulary_path()

    def make():
        return counter(read_vocabulary(path))

    kind = pa.struct([("n_words", pa.int64()), ("n_tokens", pa.int64())])
    f = common.text_udf(make, "struct<n_words: bigint, n_tokens: bigint>", kind)
    return common.with_fields(df, f(F.col(text)), ("n_words", "n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7``: word and token counts of every document."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_words", "n_tokens")
