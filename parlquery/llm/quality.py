"""Operator 9: quality rules under weak supervision.

Each rule votes good (1), bad (0) or abstains (-1) on a text. Expectation-
maximisation over the counts of all vote patterns in the corpus estimates the
share of good texts and how each rule votes on good and on bad ones; the
posterior probability of a pattern replaces a demand that every rule passes.
There are at most ``3 ** len(RULES)`` patterns however large the corpus, so
their counts are what the driver sees and what is joined back.

Defined cases: a null or empty text has no words and fails the base; a posterior
equal to ``KEEP`` is kept; very long texts are read whole; an empty table returns
no rows; repeated rows are judged alike; extra columns stay, ones named like
outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"

#: Posterior from which a text is kept.
KEEP = 0.5


def _grade(value: float, good: float, bad: float) -> int:
    """1 on the good side, 0 on the bad side, -1 between."""
    if good < bad:
        return 1 if value <= good else 0 if value >= bad else -1
    return 1 if value >= good else 0 if value <= bad else -1


#: Name and vote of each rule, from the counts that ``measure`` returns.
RULES = (
    ("length", lambda m: _grade(m["n_words"], 80, 20)),
    ("word_length", lambda m: 0 if not 2.5 <= m["mean_word"] <= 12 else 1 if 3.5 <= m["mean_word"] <= 9 else -1),
    ("symbols", lambda m: _grade(m["n_symbols"] / max(1, m["n_words"]), 0.03, 0.1)),
    ("dup_lines", lambda m: _grade(m["n_dup_lines"] / max(1, m["n_lines"]), 0.1, 0.3)),
    ("repeats", lambda m: _grade(m["n_repeat_words"] / max(1, m["n_words"]), 0.2, 0.4)),
    ("variety", lambda m: _grade(m["n_distinct"] / max(1, m["n_words"]) ** 0.8, 0.5, 0.25)),
    ("capitals", lambda m: _grade(m["n_upper"] / max(1, m["word_chars"]), 0.12, 0.3)),
    ("bare_words", lambda m: _grade(m["n_bare"] / max(1, m["n_words"]), 0.1, 0.2)),
    ("letters", lambda m: _grade(m["n_marks"] / max(1, m["word_chars"]), 0.08, 0.15)),
)

_UPPER = bytes(range(65, 91))
_NO_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalpha())


def measure(text: str) -> dict:
    """The counts of a text that rules vote on."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, index = len(words), {}
    ids = [index.setdefault(w, len(index)) for w in words]
    repeated = bare = 0
    if n:
        # a word of ASCII marks and digits alone has no letter
        plain = np.array([not w.translate(None, _NO_LETTER) for w in index], dtype=bool)
        bare = int(plain[ids].sum())
    if n >= 4 and len(index) < n:
        a = np.array(ids, dtype=np.int64)
        v = len(index)
        pair = a[:-1] * v + a[1:]
        if v > 1_000_000:  # three of them would not fit in 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * v + a[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        seen = np.zeros(n - 2, dtype=bool)
        seen[order[1:][same]] = True
        seen[order[:-1][same]] = True
        cover = np.zeros(n, dtype=bool)
        for k in range(3):
            cover[k : n - 2 + k] |= seen
        repeated = int(cover.sum())
    lines, dup, seen_lines = 0, 0, set()
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            dup += line in seen_lines
            seen_lines.add(line)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, common.WHITE)))
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
        "n_lines": lines,
        "n_distinct": len(index),
        "n_upper": len(raw) - len(raw.translate(None, _UPPER)),
        "n_marks": len(raw) - len(raw.translate(None, _MARKS)),
        "n_bare": bare,
        "mean_word": word_chars / max(1, n),
    }


def pattern_of(m: dict) -> int:
    """The votes of all rules as one base-3 number."""
    code = 0
    for _, rule in RULES:
        code = code * 3 + rule(m) + 1
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """Votes by pattern and rule."""
    k = len(RULES)
    return np.stack([codes // 3 ** (k - 1 - i) % 3 - 1 for i in range(k)], axis=1)


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of good by pattern, by expectation-maximisation.

    A rule has its own vote distribution on good and on bad texts. It starts
    with texts as bad to which two rules object, which also fixes the classes:
    an assent says only that one kind of junk is absent, so it weighs less."""
    votes = votes_of(codes)
    post = np.where((votes == 0).sum(1) >= 2, 0.02, 0.98)
    weight = counts.astype(float)
    for _ in range(rounds):
        mass = np.array([(weight * (1 - post)).sum(), (weight * post).sum()]) + 1.0
        score = np.log(mass / mass.sum())[None, :].repeat(len(codes), 0)
        for r in range(votes.shape[1]):
            table = np.array([[(weight * p * (votes[:, r] == v)).sum() for v in (-1, 0, 1)] for p in (1 - post, post)])
            table = np.log((table + 1.0) / (table.sum(1, keepdims=True) + 3.0))
            # an abstention says nothing; a vote for good may not count against it
            voted = votes[:, r] >= 0
            gain = table[1] - table[0]
            gain[1], gain[2] = min(gain[1], 0), max(gain[2], 0)
            score[voted, 1] += gain[votes[voted, r] + 1]
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))
        if np.abs(new - post).max() < 1e-6:
            return new
        post = new
    return post


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The counts, ``base_failed``, ``p_good`` and ``kept`` of every row beside
    the columns to ``carry`` (all by default; without the text, what is written
    between the two passes is counts alone). Columns named like these go."""
    kind = pa.struct([(c, pa.int64()) for c in (*_COUNTS, "pattern")])
    schema = "struct<" + ", ".join(f"{c}: bigint" for c in (*_COUNTS, "pattern")) + ">"

    def make():
        def f(x: str) -> dict:
            m = measure(x)
            return {c: m[c] for c in _COUNTS} | {"pattern": pattern_of(m)}

        return f

    own = (*_COUNTS, "base_failed", "p_good", "kept")
    carried = [c for c in (df.columns if carry is None else carry) if c.lower() not in own]
    rules, key = common.fresh([*carried, *own], "rules", "pattern")
    done = common.materialize(df.select(*carried, common.text_udf(make, schema, kind)(F.col(text)).alias(rules)), "quality")
    pattern = F.col(rules)["pattern"]
    found = done.groupBy(pattern.alias(key)).count().collect()  # at most 3 ** len(RULES) rows
    codes = np.array([r[0] for r in found], dtype=np.int64)
    post = fit(codes, np.array([r[1] for r in found])) if found else np.zeros(0)
    spark = df.sparkSession
    by = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post, strict=True)], f"{key} bigint, p_good double")
    out = done.join(F.broadcast(by), pattern == F.col(key), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        out.withColumns({c: F.col(rules)[c] for c in _COUNTS})
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))
        .drop(rules, key)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9``: the rules over every document."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, carry=["doc_id"]).select("doc_id", *_COUNTS, "base_failed", "kept", "p_good")
