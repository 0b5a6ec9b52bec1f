"""Operator 2: personal data by a skip-chain conditional random field.

Four base patterns (email, ip, card, phone) give certain spans. Tokens that
hold a digit or an at sign are the nodes of a field over each document, with the
labels O, email, ip, card and phone. A token inside a base span is observed; the
others get potentials from a log-linear model of their form and of the word
before. Tokens next to each other share chain potentials. All mentions of one
key (the same mail box, the same last digits) share skip potentials: each with
the nearest observed mention of the key or, where none is observed, all with one
hub, so that a mention gets the same evidence whether the key is repeated twice
or thirty times. Loopy belief propagation runs until its messages settle, and
runs of tokens whose posterior is high enough become further spans, the parts of
one number joined to one span.

The model is fitted on the base spans of ``SAMPLE_DOCS`` documents and
``SAMPLE_NODES`` of their tokens at most, both the first by a hash of what they
hold, with corrupted copies of valid numbers as negatives. Mentions that share a
key with a base span, but are none, say nothing of either label there.

Defined cases: a null text is an empty one; a text without spans has the digest
of an empty string; very long texts and tokens are read whole, in time that grows
with their length; messages that do not settle in ``ROUNDS`` (loops of strong and
contradictory evidence) count as they then are; ties of labels go to the first of
``LABELS``; an empty table fits a model without evidence and returns no rows;
repeated rows give repeated results; extra columns stay, ones named like outputs
are replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

#: Documents that the model is fitted on at most, and tokens of them.
SAMPLE_DOCS = 2000
SAMPLE_NODES = 20_000

#: Posterior from which a token that no base span holds becomes a span.
POSTERIOR = 0.8

#: Agreements of similar tokens that are taken as seen before any evidence.
SKIP_PRIOR = 400

#: Features are hashed to so many weights a label.
WIDTH = 1 << 12

#: Last digits that mentions of one number have in common.
KEY_DIGITS = 7

#: Log potential of labels that an observed token does not have; no number of
#: others outweighs it.
CERTAIN = -1e9

#: Rounds of messages at most, after how many they are damped, and the change of
#: a message from which it is passed on.
ROUNDS, UNDAMPED, SETTLED = 1000, 100, 1e-6

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_SEED = re.compile(r"[0-9@]")
_WHITE = frozenset(" \t\n\r\x0b\x0c")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]++")
_BEFORE = regex.compile(r"(?r)[^\x20\x09-\x0D]++")
_RUN = re.compile(r"[\x20().-]{1,3}")

#: Digits that a span of a number has.
NUMBERS = {2: (12, 19), 3: (7, 15)}


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str):
    """Every local part ends at an at sign, so only those are looked at."""
    done, p = 0, text.find("@")
    while p >= 0:
        a = p
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < p and (m := _DOMAIN.match(text, p)):
            yield a, m.end()
            done = m.end()
        else:
            done = max(done, p + 1)
        p = text.find("@", done)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(rank of the kind, start, end)``, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """White-space tokens that hold a digit or an at sign, without marks around."""
    out, done = [], 0
    for m in _SEED.finditer(text):
        if m.start() < done:
            continue
        a = m.start()
        while a > done and text[a - 1] not in _WHITE:
            a -= 1
        b = done = _TOKEN.match(text, a).end()
        while a < b and not (text[a].isalnum() or text[a] == "+"):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _shape(token: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", token))


def word_before(text: str, a: int) -> str:
    """What comes before a place up to white space, without white space between."""
    m = _BEFORE.search(text, 0, a)
    return m[0].lower() if m else ""


def features(token: str, before: str) -> list[int]:
    """Hashed features of a token: its form, its checks and the word before."""
    d = digits(token)
    said = [
        "bias",
        "shape " + _shape(token),
        f"digits {min(len(d), 20)}",
        f"dots {min(token.count('.'), 5)} at {token.count('@')} plus {token[0] == '+'}",
        "before " + before,
    ]
    if 13 <= len(d) <= 19:
        said.append(f"luhn {luhn(d)}")
    parts = token.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        said.append(f"address {all(map(_small, parts))}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in said]


def digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def key(token: str) -> str | None:
    """What similar tokens have in common; None for tokens like any other."""
    if "@" in token:
        return token.lower().split("@")[0]
    d = digits(token)
    return d[-KEY_DIGITS:] if len(d) >= KEY_DIGITS else None


def observed(spans: list[tuple[int, int, int]], nodes: list[tuple[int, int]]) -> np.ndarray:
    """The label of each node that a base span touches, else -1."""
    y = np.full(len(nodes), -1)
    starts = [a for a, _ in nodes]
    for k, a, b in spans:
        i = bisect_right(starts, a) - 1
        for j in range(max(0, i), len(nodes)):
            if nodes[j][0] >= b:
                break
            if nodes[j][1] > a and y[j] < 0:
                y[j] = k + 1
    return y


def read(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray, list[str | None]]:
    """The nodes of a text, the label that is observed at each (-1: none), and
    what each has in common with others like it. The last token of a base span
    stands for all its digits. Tokens that together repeat more of an observed
    number than the last of them are one node."""
    found = tokens(text)
    seen = observed(base, found)
    names, ends, whole = [key(text[a:b]) for a, b in found], [b for _, b in found], {}
    for k, a, b in base:
        i, name = bisect_left(ends, b), key(text[a:b])
        if i < len(found) and a < found[i][0] < b and name:
            names[i] = name
        if k in NUMBERS:
            whole[name] = max(digits(text[a:b]), whole.get(name, ""), key=len)
    nodes: list[tuple[int, int]] = []
    at: list[int] = []
    for i, (a, b) in enumerate(found):
        if names[i] in whole and seen[i] < 0:
            said = digits(text[a:b])
            while nodes and seen[at[-1]] < 0 and _RUN.fullmatch(text, nodes[-1][1], a):
                said = digits(text[nodes[-1][0] : nodes[-1][1]]) + said
                if not whole[names[i]].endswith(said):
                    break
                a = nodes.pop()[0]
                at.pop()
        nodes.append((a, b))
        at.append(i)
    return nodes, seen[at] if at else seen, [names[i] for i in at]


def propagate(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posteriors by loopy sum-product message passing, until messages settle.

    unary: log potentials by node and label; edges: pairs of nodes; pair: log
    potentials by edge and the labels of its two ends. A round sends the messages
    whose senders have changed; on a graph without loops that is exact after as
    many rounds as its longest path has edges. Later rounds are damped, which
    lets loops settle."""
    belief = unary.copy()
    if len(edges):
        e = len(edges)
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
        message, at = np.zeros((2 * e, unary.shape[1])), np.arange(2 * e)
        for r in range(rounds):
            own = belief[src[at]] - message[at - e]  # the message that came back along the edge
            own = np.exp(own - own.max(1, keepdims=True))
            new = np.log(np.maximum((own[:, None, :] @ table[at])[:, 0], 1e-300))
            step = (new - new.max(1, keepdims=True) - message[at]) * (1.0 if r < UNDAMPED else 0.5)
            message[at] += step
            np.add.at(belief, dst[at], step)
            fresh = np.zeros(len(unary), dtype=bool)
            moved = np.abs(step).max(1) > SETTLED
            fresh[dst[at[moved]]] = True
            if r >= UNDAMPED:
                fresh[src[at[moved]]] = True  # a damped message has not arrived yet
            at = np.flatnonzero(fresh[src])
            if not len(at):
                break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def skips(known: list[str | None], seen: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Skip edges among nodes, and how many hubs they add behind the nodes: a
    mention and the nearest observed one of its key, or the hub of its key."""
    by: dict[str, list[int]] = {}
    for i, k in enumerate(known):
        if k:
            by.setdefault(k, []).append(i)
    out, hubs = [], 0
    for own in by.values():
        certain = [i for i in own if seen[i]]
        if not certain and len(own) > 1:
            out += [(i, len(known) + hubs) for i in own]
            hubs += 1
        elif certain:
            for i in own:
                if not seen[i]:
                    j = bisect_left(certain, i)
                    out.append((i, min(certain[max(0, j - 1) : j + 1], key=lambda x: abs(x - i))))  # noqa: B023
    return out, hubs


class SkipChain:
    """A fitted field. weight: by feature and label; chain: by two labels; skip:
    what agreement of similar tokens is worth."""

    def __init__(self, weight: np.ndarray, chain: np.ndarray, skip: float):
        self.weight, self.chain, self.skip = weight, chain, skip

    def posterior(self, text: str, nodes: list[tuple[int, int]], seen: np.ndarray, known: list[str | None]) -> np.ndarray:
        """What is thought of every node."""
        n = len(nodes)
        skip, hubs = skips(known, seen >= 0)
        unary = np.zeros((n + hubs, len(LABELS)))
        for i in range(n):
            if seen[i] < 0:
                a, b = nodes[i]
                unary[i] = self.weight[features(text[a:b], word_before(text, a))].sum(0)
            else:
                unary[i] = CERTAIN
                unary[i, seen[i]] = 0.0
        chain = [(i - 1, i) for i in range(1, n) if nodes[i][0] - nodes[i - 1][1] <= 3 and (seen[i] < 0 or seen[i - 1] < 0)]
        pair = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip * np.eye(len(LABELS))[None], len(skip), 0)])
        return propagate(unary, np.array(chain + skip, dtype=np.int64).reshape(-1, 2), pair)[:n]

    def extra(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans beside the base ones."""
        nodes, seen, known = read(text, base)
        if (seen >= 0).all():
            return []
        p = self.posterior(text, nodes, seen, known)
        label = np.where((seen < 0) & (p.max(1) >= POSTERIOR), p.argmax(1), 0)
        out: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(label).tolist():
            k, (a, b) = int(label[i]) - 1, nodes[i]
            if out and i and label[i - 1] == label[i] and k in NUMBERS and out[-1][2] == nodes[i - 1][1] and _RUN.fullmatch(text, out[-1][2], a):
                out[-1] = k, out[-1][1], b
            else:
                out.append((k, a, b))
        return [s for s in out if self.able(s[0], text[s[1] : s[2]])]

    @staticmethod
    def able(k: int, span: str) -> bool:
        """Whether a span holds what one of its kind needs, so that no part of a
        number is taken for a whole one."""
        if k in NUMBERS:
            low, high = NUMBERS[k]
            return low <= len(_DIGITS.findall(span)) <= high
        return "@" in span if k == 0 else span.count(".") >= 3


def evidence(text: str) -> list[dict]:
    """Training nodes of one text: features, label, label before, and agreement
    with the last observed node of the key. A node that shares a key with an
    observed one, but is not observed, is left out."""
    base = base_spans(text)
    nodes, seen, known = read(text, base)
    y = np.maximum(seen, 0)
    told = {k for k, v in zip(known, seen, strict=True) if k and v >= 0}
    inside = sorted((a, b) for _, a, b in base)
    out, last = [], {}
    for i, (a, b) in enumerate(nodes):
        t, k = text[a:b], known[i]
        if seen[i] < 0 and k in told:
            continue
        near = i and nodes[i][0] - nodes[i - 1][1] <= 3
        agree = -1 if k is None or seen[i] < 0 or k not in last else int(last[k] == y[i])
        if k is not None and seen[i] >= 0:
            last[k] = y[i]
        before = word_before(text, a)
        out.append({"f": features(t, before), "y": int(y[i]), "before": int(y[i - 1]) if near else -1, "agree": agree})
        at = bisect_left(inside, (a, a))
        if y[i] in (2, 3) and at < len(inside) and inside[at][1] <= b:
            wrong = t[:-1] + str((int(t[-1]) + 1) % 10) if y[i] == 3 and t[-1] in "0123456789" else t.replace(t.split(".")[0], "999", 1)
            if not base_spans(wrong):
                out.append({"f": features(wrong, before), "y": 0, "before": -1, "agree": -1})
    return out


def fit(rows: list[dict], rounds: int = 200, l2: float = 1e-3) -> SkipChain:
    """Multinomial logistic unaries, counted transitions and agreement."""
    k = len(LABELS)
    weight = np.zeros((WIDTH, k))
    weight[zlib.crc32(b"bias") % WIDTH, 0] = 1.0
    if rows:
        size = np.array([len(r["f"]) for r in rows])
        at, f = np.repeat(np.arange(len(rows)), size), np.concatenate([r["f"] for r in rows]).astype(np.int64)
        y = np.eye(k)[[r["y"] for r in rows]]
        step = np.full((WIDTH, k), 1e-8)
        for _ in range(rounds):
            s = np.zeros((len(rows), k))
            np.add.at(s, at, weight[f])
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.zeros((WIDTH, k))
            np.add.at(g, f, ((p - y) / len(rows))[at])
            g += l2 / len(rows) * weight
            step += g * g
            weight -= 0.3 * g / np.sqrt(step)
    chain = np.ones((k, k))
    for (a, b), n in Counter((r["before"], r["y"]) for r in rows if r["before"] >= 0).items():
        chain[a, b] += n
    both = chain.sum()
    chain = np.clip(np.log(chain * both / (chain.sum(1, keepdims=True) * chain.sum(0, keepdims=True))), -2, 2)
    agree = Counter(r["agree"] for r in rows)
    skip = float(np.clip(np.log((agree[1] + SKIP_PRIOR) / (agree[0] + 1)), 0.5, 6))
    return SkipChain(weight, chain, skip)


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> SkipChain:
    """Fit on the documents that come first by a hash of their ids and texts."""
    n = df.count()
    if not n:
        return fit([])
    kind = pa.list_(pa.struct([("f", pa.list_(pa.int32())), ("y", pa.int32()), ("before", pa.int32()), ("agree", pa.int32())]))
    schema = "array<struct<f: array<int>, y: int, before: int, agree: int>>"
    f = common.text_udf(lambda: evidence, schema, kind)
    place = F.shiftrightunsigned(F.xxhash64(doc_id, text), 1)
    rows = df.select(place.alias("h"), F.col(text).alias("t"))
    if n > 2 * SAMPLE_DOCS:
        # few rows beyond those that are wanted reach the sort
        rows = rows.filter(F.col("h") < int((1 << 63) * (2 * SAMPLE_DOCS / n)))
    chosen = rows.orderBy("h", "t").limit(SAMPLE_DOCS)
    nodes = chosen.select(F.explode(f("t")).alias("n")).select("n.*")
    order = F.xxhash64("f", "y", "before", "agree")
    found = nodes.orderBy(order, "y").limit(SAMPLE_NODES).collect()  # a bounded training sample
    return fit([r.asDict() for r in found])


_FIELDS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def scan(text: str, model: SkipChain) -> dict:
    base = base_spans(text)
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
    n = Counter(k for k, _, _ in base)
    every = sorted(base + model.extra(text, base))
    counts = {f"n_{name}": n[k] for k, name in enumerate(KINDS)}
    return counts | {"base_sha256": common.sha256(said(base)), "spans": said(every), "n_spans": len(every)}


def find(df: DataFrame, model: SkipChain, text: str = "text") -> DataFrame:
    """Add counts, the base digest and all spans to every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # WIDTH * 5 weights, whatever the corpus

    def make():
        field = shared.value
        return lambda x: scan(x, field)

    kind = pa.struct([(c, pa.int64() if c[0] == "n" else pa.string()) for c in _FIELDS])
    schema = "struct<" + ", ".join(f"{c}: {'bigint' if c[0] == 'n' else 'string'}" for c in _FIELDS) + ">"
    return common.with_fields(df, common.text_udf(make, schema, kind)(F.col(text)), _FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2``: personal data in every document."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return find(docs, train(docs)).select("doc_id", *_FIELDS)
