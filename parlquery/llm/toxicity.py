"""Operator 1: toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the distinct
words of a text, the beginnings of words, and how the text is made up; each
later model also gets the probabilities of the categories before it. For
training, those come from models that did not see the row (out-of-fold), so that
a later model meets the same kind of input as when it is used. Words enter a
model only where the training rows separate the category by them beyond chance,
so that a long text of ordinary words adds nothing up. Out-of-fold probabilities
of the last category also set the threshold.

The models are fitted on at most ``TRAIN_ROWS`` labelled rows, which the hash of
their ids chooses, and every text is scored whole.

Only the last of the categories is toxicity; the one before it is the label of
quality, the other one that the given labels have.

Defined cases: a null or empty text has no words and the prior's probability; a
category without labels of both kinds gets a constant probability; unlabelled
and repeated label rows are allowed, a row that lacks one of the labels is none
to learn from; ties at the sample's end go by the hash of what a row holds, a
probability equal to the threshold is toxic; very long texts are read whole;
repeated rows give repeated results; an empty table returns no rows; extra
columns stay, ones named like outputs are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the models are fitted on, at most.
TRAIN_ROWS = 5000

#: Categories in the order of the chain: label column and the value that it has.
CATEGORIES = (("junk", "quality", 0), ("toxic", "toxic", 1))

FOLDS = 4
WIDTH = 1 << 20
PREFIXES = (3, 4, 5)

#: Features that a model may use, and the significance that they need.
FEATURES = 4096
SIGNIFICANCE = 4.0

_CAPITALS = bytes(range(65, 91))
_WORD = re.compile(r"[^\W\d_]+")


def _hash(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH


def word_features(word: str) -> list[int]:
    """Of a lower-case word: itself and its beginnings."""
    return [_hash("w " + word), *(_hash(f"{k} {word[:k]}") for k in PREFIXES if len(word) >= k)]


def style_features(text: str, words: list[str], distinct: set[str]) -> list[int]:
    """How a text is made up, in coarse steps."""
    n, raw = max(1, len(text)), text.encode("utf-8", "surrogatepass")
    step = lambda x, *at: sum(x >= a for a in at)
    letters = sum(map(len, words))
    return [
        _hash(f"s length {step(len(words), 5, 20, 50, 100)}"),
        _hash(f"s letters {step(letters / n, 0.4, 0.6, 0.7, 0.75)}"),
        _hash(f"s variety {step(len(distinct) / max(1, len(words)) ** 0.8, 0.2, 0.4, 0.6, 0.9)}"),
        _hash(f"s capitals {step((len(raw) - len(raw.translate(None, _CAPITALS))) / n, 0.05, 0.1, 0.3)}"),
    ]


def features(text: str) -> np.ndarray:
    """Distinct hashed features of a text, sorted."""
    words = _WORD.findall(text.lower())
    distinct = set(words)
    found = {f for w in distinct for f in word_features(w)} | set(style_features(text, words, distinct))
    return np.array(sorted(found), dtype=np.int32)


class Linear:
    """A logistic model of chosen features and of what the chain passes on."""

    def __init__(self, chosen: np.ndarray, weight: np.ndarray, passed: np.ndarray, bias: float):
        self.chosen, self.weight, self.passed, self.bias = chosen, weight, passed, bias

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> Linear:
        n, m = len(rows), earlier.shape[1]
        pos = float(y.sum())
        nothing = np.zeros(0, dtype=np.int64)
        if not n or pos in (0.0, float(n)):
            return cls(nothing, np.zeros(0), np.zeros(m), float(np.log((pos + 0.5) / (n - pos + 0.5))))
        at = np.repeat(np.arange(n), [len(r) for r in rows])
        f = np.concatenate(rows)
        total = np.bincount(f, minlength=WIDTH).astype(float)
        hit = np.bincount(f, weights=y[at], minlength=WIDTH)
        share = pos / n
        z = (hit - total * share) / np.sqrt(np.maximum(total * share * (1 - share) * (1 - total / n), 1e-9))
        z[(total < 3) | (total >= n)] = 0
        chosen = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
        chosen = np.sort(chosen[np.abs(z[chosen]) >= SIGNIFICANCE])
        where = np.full(WIDTH, -1)
        where[chosen] = np.arange(len(chosen))
        c = where[f]
        at, c = at[c >= 0], c[c >= 0]
        w, p, b = np.zeros(len(chosen)), np.zeros(m), float(np.log(share / (1 - share)))
        sw, sp, sb = np.full(len(chosen), 1e-8), np.full(m, 1e-8), 1e-8
        for _ in range(rounds):
            s = b + earlier @ p
            s += np.bincount(at, weights=w[c], minlength=n)
            g = (1 / (1 + np.exp(-np.clip(s, -60, 60))) - y) / n
            gw = np.bincount(c, weights=g[at], minlength=len(w)) + l2 / n * w
            gp, gb = earlier.T @ g + l2 / n * p, g.sum()
            sw += gw * gw
            sp += gp * gp
            sb += gb * gb
            w -= 0.3 * gw / np.sqrt(sw)
            p -= 0.3 * gp / np.sqrt(sp)
            b -= 0.3 * gb / np.sqrt(sb)
        return cls(chosen, w, p, float(b))

    def score(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        """Probabilities of the category."""
        where = dict(zip(self.chosen.tolist(), self.weight.tolist(), strict=True))
        s = np.array([self.bias + sum(where.get(f, 0.0) for f in r.tolist()) for r in rows]) + earlier @ self.passed
        return 1 / (1 + np.exp(-np.clip(s, -60, 60)))


class Chain:
    """Models of the categories in order."""

    def __init__(self, names: tuple[str, ...], models: list[Linear], threshold: float = 0.5):
        self.names, self.models, self.threshold = names, models, threshold

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, names: tuple[str, ...]) -> Chain:
        """labels: by row and category. The folds follow the order of the rows."""
        n = len(rows)
        fold, earlier, models = np.arange(n) % FOLDS, np.zeros((n, 0)), []
        for k in range(len(names)):
            y = labels[:, k].astype(float) if n else np.zeros(0)
            models.append(Linear.fit(rows, y, earlier))
            held = np.zeros(n)
            for i in range(FOLDS):
                own, rest = np.flatnonzero(fold == i), np.flatnonzero(fold != i)
                if len(own):
                    part = Linear.fit([rows[j] for j in rest], y[rest], earlier[rest])
                    held[own] = part.score([rows[j] for j in own], earlier[own])
            earlier = np.column_stack([earlier, held])
        return cls(names, models, cls.cut(held, y) if n else 0.5)

    @staticmethod
    def cut(p: np.ndarray, y: np.ndarray) -> float:
        """The probability that parts out-of-fold rows with the fewest errors."""
        order = np.argsort(p, kind="stable")
        p, y = p[order], y[order]
        if y.sum() in (0, len(y)):
            return 0.5
        # errors if the first i rows are called clean
        wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
        best = np.flatnonzero(wrong == wrong.min())
        i = int(best[len(best) // 2])
        low, high = p[max(0, i - 1)], p[min(i, len(p) - 1)]
        return float(np.sqrt(low * high))

    def scorer(self):
        """``f(text) -> {p_<category>}``, with a memo of words."""
        weight: dict[int, np.ndarray] = {}
        for k, m in enumerate(self.models):
            for f, w in zip(m.chosen.tolist(), m.weight.tolist(), strict=True):
                weight.setdefault(f, np.zeros(len(self.models)))[k] += w
        memo: dict[str, tuple[int, ...]] = {}

        def known(word: str) -> tuple[int, ...]:
            found = tuple(f for f in word_features(word) if f in weight)
            if len(word) < 64:
                if len(memo) >= common.MEMO_ENTRIES:
                    memo.clear()
                memo[word] = found
            return found

        def f(text: str) -> dict:
            words = _WORD.findall(text.lower())
            distinct, get = set(words), memo.get
            used = {x for x in style_features(text, words, distinct) if x in weight}
            for w in distinct:
                if x := get(w, known):
                    used.update(known(w) if x is known else x)
            s = sum((weight[x] for x in sorted(used)), np.zeros(len(self.models)))
            p: list[float] = []
            for k, m in enumerate(self.models):
                v = m.bias + s[k] + float(np.dot(m.passed, p))
                p.append(float(1 / (1 + np.exp(-np.clip(v, -60, 60)))))
            return {f"p_{n}": x for n, x in zip(self.names, p, strict=True)}

        return f


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, doc_id: str = "doc_id", text: str = "text") -> Chain:
    """Fit the chain on a sample of labelled rows, ``TRAIN_ROWS`` at most."""
    names = tuple(name for name, _, _ in categories)
    known = labels.select(F.col(doc_id).alias("__id"), *[(F.col(c) == v).cast("int").alias(n) for n, c, v in categories]).dropna()
    known = known.orderBy(F.xxhash64("__id", *names), "__id").limit(TRAIN_ROWS)  # a bounded training sample
    f = common.text_udf(lambda: lambda x: features(x).tobytes(), "binary", pa.binary())
    chosen = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(F.broadcast(known), F.col("__doc") == F.col("__id"))
    # repeated ids would let the sample grow
    rows = chosen.select("__id", f(F.col("__text")).alias("f"), *names)
    found = rows.orderBy(F.xxhash64("__id", "f", *names), "__id", "f").limit(2 * TRAIN_ROWS).collect()
    found.sort(key=lambda r: (r["__id"], bytes(r["f"])))
    rows = [np.frombuffer(r["f"], dtype=np.int32) for r in found]
    return Chain.fit(rows, np.array([[r[n] for n in names] for r in found]).reshape(-1, len(names)), names)


def probabilities(df: DataFrame, chain: Chain, text: str = "text"):
    """The column of a row's probabilities, a struct."""
    shared = df.sparkSession.sparkContext.broadcast(chain)  # FEATURES weights a category, whatever the corpus

    def make():
        return shared.value.scorer()

    names = [f"p_{n}" for n in chain.names]
    kind = pa.struct([(n, pa.float64()) for n in names])
    return common.text_udf(make, "struct<" + ", ".join(f"{n}: double" for n in names) + ">", kind)(F.col(text))


def score(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Add ``p_<category>`` and ``toxic`` to every row."""
    out = common.with_fields(df, probabilities(df, chain, text), tuple(f"p_{n}" for n in chain.names))
    return out.withColumn("toxic", F.col(f"p_{chain.names[-1]}") >= chain.threshold)


def reject(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Only the rows that are not toxic, with their columns."""
    return df.filter(probabilities(df, chain, text)[f"p_{chain.names[-1]}"] < chain.threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1``: probabilities of every document."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels"))).drop("text")
