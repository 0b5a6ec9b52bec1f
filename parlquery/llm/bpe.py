"""Operator 8: byte-pair encoding and decoding by tree concatenation.

A text of more than ``LEAF_TEXT`` characters is halved, wherever that cuts, down
to leaves that are encoded on their own. Pairs of neighbours are joined up the
tree: a join encodes a window around the cut anew, two stretches without white
space on either side at first, and doubles it on a side until its outermost
stretch there has the tokens that the part had before. White space parts
pieces, so from there on the parts' own tokens are those of the whole text.

A stretch is normalised and cut into pieces as the vocabulary file asks, and each
piece is merged by rank. A piece beyond ``LEAF`` symbols, which has no cut inside,
is a tree of its own: its leaves are encoded by the tokenizers library as one
parallel batch, and a join re-encodes a window of tokens around it and doubles
the window until its first and its last token are the ones that were there
before; every pair of neighbours is then one that an encoding has already
produced, which makes the whole sequence the encoding of the whole piece. A
stretch that goes through a leaf from end to end is encoded once, when it ends.

Defined cases: a null text is an empty one; an empty text has no token;
special tokens' strings in a text become their ids, as the library has it; very
long texts, with white space or without, are encoded whole; of pairs with equal
rank the leftmost is merged first; repeated rows give repeated results; columns
other than the text stay as they are, and a column named like an output is
replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of a text, and symbols of a piece, up to which it is a leaf.
LEAF_TEXT, LEAF = 8192, 512

#: Entries of a memo of words and pieces; there are two at a time.
MEMO_ENTRIES = 120_000

#: Token count, ids joined by spaces, tokens joined by spaces.
Coded = tuple[int, str, str]

#: Where a part of a text begins and ends, and the tokens of its stretches.
Part = tuple[int, int, list[Coded] | None]

#: Characters for which normalising is lower-casing alone.
_PLAIN = regex.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")
_STRETCH = regex.compile(r"[^ \t\n\r]+")
_STRETCH_BACK = regex.compile(r"(?r)[^ \t\n\r]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The encoder of one vocabulary file, with a memo of words."""

    def __init__(self, path: str, leaf: int = LEAF, leaf_text: int = LEAF_TEXT):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"]
        self.name = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name.update((i, t) for t, i in self.special.items())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.model, self.leaf, self.leaf_text, self.symbol = model, leaf, leaf_text, byte_symbols()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.direct = self.whole.model.tokenize
        self.inner = None
        self.memo: dict[str, Coded] = {}
        self.old: dict[str, Coded] = {}

    def merge(self, s: list[str]) -> list[str]:
        """Merge neighbours by rank, the leftmost of equals first."""
        rank, none = self.rank, len(self.rank)
        r = [rank.get(p, none) for p in zip(s, s[1:], strict=False)]
        while r and (least := min(r)) < none:
            i = r.index(least)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del r[i]
            if i < len(r):
                r[i] = rank.get((s[i], s[i + 1]), none)
            if i:
                r[i - 1] = rank.get((s[i - 1], s[i]), none)
        return s

    def symbols(self, piece: str) -> list[str]:
        s = [self.symbol[b] for b in piece.encode("utf-8", "surrogatepass")]
        s[-1] += self.end
        return s

    def remember(self, key: str, found: Coded) -> Coded:
        """Keep a short stretch. A full memo ages, and the one before it goes."""
        if len(key) < 64:
            if len(self.memo) >= MEMO_ENTRIES:
                self.old, self.memo = self.memo, {}
            self.memo[key] = found
        return found

    def piece(self, piece: str) -> Coded:
        """The tokens of a piece without a cut."""
        if found := self.memo.get(piece):
            return found
        if (found := self.old.get(piece)) is None:
            if len(piece) <= self.leaf // 4:  # a character has four bytes at most
                tokens = [t.value for t in self.direct("".join([self.symbol[b] for b in piece.encode("utf-8", "surrogatepass")]))]
            else:
                s = self.symbols(piece)
                tokens = self.merge(s) if len(s) <= self.leaf else self.tree(s)
            found = len(tokens), " ".join([str(self.vocab[t]) for t in tokens]), " ".join(tokens)
        return self.remember(piece, found)

    def tree(self, s: list[str]) -> list[str]:
        """Encode halves of a long piece down to leaves, then join them."""
        n = len(s)
        cuts = list(range(0, n, self.leaf))
        level = self.leaves([s[i : i + self.leaf] for i in cuts])
        while len(level) > 1:
            pairs = [self.join(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0]

    def leaves(self, parts: list[list[str]]) -> list[list[str]]:
        """Encode parts of a piece in parallel; only the last one ends a word."""
        from tokenizers import Tokenizer, models

        if self.inner is None:
            merges = [tuple(x) for x in self.model["merges"]]
            self.inner = Tokenizer(models.BPE(vocab=self.vocab, merges=merges))
        *inside, last = parts
        return [e.tokens for e in self.inner.encode_batch(["".join(p) for p in inside], add_special_tokens=False)] + [self.merge(last)]

    def size(self, token: str) -> int:
        return len(token) - len(self.end) + 1 if token.endswith(self.end) else len(token)

    def split(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            s = list(token[: -len(self.end)])
            s[-1] += self.end
            return s
        return list(token)

    def join(self, a: list[str], b: list[str]) -> list[str]:
        """One encoding from those of neighbouring parts of a piece."""
        i = j = 2
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = [x for t in (*a[len(a) - i :], *b[:j]) for x in self.split(t)]
            # a window that outgrows a leaf is rare; merging it directly stays exact
            c = self.merge(window)
            left = i == len(a) or c[0] == a[-i]
            right = j == len(b) or c[-1] == b[j - 1]
            if left and right:
                return a[: len(a) - i] + c + b[j:]
            i, j = i if left else i * 2, j if right else j * 2

    def word(self, word: str) -> Coded:
        """The tokens of a stretch without white space."""
        if (found := self.old.get(word)) is None:
            parts = [self.piece(p) for p in _PIECES.findall(word)]
            found = sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
        return self.remember(word, found)

    @staticmethod
    def together(done: list[Coded]) -> Coded:
        return sum([d[0] for d in done]), " ".join([d[1] for d in done if d[0]]), " ".join([d[2] for d in done if d[0]])

    def flat(self, text: str) -> Coded:
        """Special tokens, and between them the words that the normaliser leaves."""
        if "<|" in text and len(parts := self.cut.split(text)) > 1:
            return self.together([(1, str(self.special[p]), p) if p in self.special else self.flat(p) for p in parts])
        if _PLAIN.search(text):
            words = self.whole.normalizer.normalize_str(text).split(" ")
        else:
            words = text.lower().split()
        get, word = self.memo.get, self.word
        return self.together([get(w) or word(w) for w in words])

    def stretches(self, text: str) -> list[Coded]:
        """The tokens of each stretch of a text without blanks, tabs and line ends."""
        get, word = self.memo.get, self.word
        if "<|" not in text and not _PLAIN.search(text):
            return [get(w) or word(w) for w in text.lower().split()]
        plain = lambda x: x.isascii() and x.isprintable() and "<|" not in x
        return [get(x.lower()) or word(x.lower()) if plain(x) else self.flat(x) for x in _STRETCH.findall(text)]

    def encode(self, text: str) -> Coded:
        """Token count, the ids joined by spaces, and the decoded text."""
        n, leaf = len(text), self.leaf_text
        if n <= leaf:
            return self.flat(text)
        level = [self.part(text, a, min(n, a + leaf)) for a in range(0, n, leaf)]
        while len(level) > 1:
            pairs = [self.join_parts(text, a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[len(pairs) * 2 :]
        done = level[0][2]
        return self.flat(text) if done is None else self.together(done)

    def part(self, text: str, a: int, b: int) -> Part:
        """A leaf of a text, not encoded yet where one stretch fills it."""
        m = _STRETCH.match(text, a, b)
        return a, b, None if m and m.end() == b else self.stretches(text[a:b])

    def join_parts(self, text: str, left: Part, right: Part) -> Part:
        """One part of two neighbouring ones."""
        (a, cut, one), (_, b, two) = left, right
        if one is None and two is None:
            return a, b, None
        i = j = 1
        while True:
            # so many stretches on each side of the cut, or all of a side
            p = q = cut
            for _ in range(i):
                m = one is not None and _STRETCH_BACK.search(text, a, p)
                p = m.start() if m else a
            for _ in range(j):
                m = two is not None and _STRETCH.search(text, q, b)
                q = m.end() if m else b
            window = self.stretches(text[p:q])
            on_left = one is None or i >= len(one) or window[0] == one[-i]
            on_right = two is None or j >= len(two) or window[-1] == two[j - 1]
            if on_left and on_right:
                return a, b, (one[:-i] if one else []) + window + (two[j:] if two else [])
            i, j = i if on_left else i * 2, j if on_right else j * 2

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in self.encode(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: this vocabulary joins its tokens by a space."""
        return " ".join([self.name[i] for i in ids if i in self.name])


def encode(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add ``token_ids`` (array of int) to every row."""
    path = path or vocabulary_path()

    def make():
        return WordBpe(path).ids

    return df.withColumn("token_ids", common.text_udf(make, "array<int>", pa.list_(pa.int32()))(F.col(text)))


def decode(df: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded`` to every row; null ids decode to an empty text."""
    path = path or vocabulary_path()

    def make():
        return WordBpe(path).decode

    return df.withColumn("decoded", common.text_udf(make, "string", pa.string())(F.col(ids)))


def round_trip(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Encode and decode every text; add ``n_tokens`` and the digests of the
    ids and of the decoded text, without moving either out of the worker."""
    path = path or vocabulary_path()

    def make():
        codec = WordBpe(path)

        def digest(x: str) -> dict:
            n, ids, decoded = codec.encode(x)
            return {"n_tokens": n, "ids_sha256": common.sha256(ids), "decoded_sha256": common.sha256(decoded)}

        return digest

    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    schema = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
    return common.with_fields(df, common.text_udf(make, schema, kind)(F.col(text)), ("n_tokens", "ids_sha256", "decoded_sha256"))


def tokenized(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Replace the text by ``token_ids`` with ``n_tokens`` and the digest of the
    text that the ids decode to; each text is read once."""
    path = path or vocabulary_path()
    kind = pa.struct([("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = WordBpe(path)
        for batch in batches:
            n, ids, digests = [0], [np.zeros(0, dtype=np.int32)], []
            for x in batch:
                k, own, decoded = codec.encode(x.as_py() or "")
                n.append(k)
                ids.append(np.fromstring(own, dtype=np.int32, sep=" "))  # four bytes an id, not an object
                digests.append(common.sha256(decoded))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.StructArray.from_arrays([pa.array(n[1:], pa.int64()), lists, pa.array(digests, pa.string())], fields=list(kind))

    f = F.arrow_udf(run, "struct<n_tokens: bigint, token_ids: array<int>, decoded_sha256: string>", F.ArrowUDFType.SCALAR_ITER)
    return common.with_fields(df, f(F.col(text)), ("n_tokens", "token_ids", "decoded_sha256")).drop(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8``: every document encoded and decoded."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
