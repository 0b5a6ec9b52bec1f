"""Operator 4: secrets by assignment-aware lexing.

Three base patterns (assign, access, hex) are joined by a lexer of source and
configuration syntax. It reads every ``name = literal`` and ``name: literal``
pair of a text (quoted, back-quoted, typed, concatenated or bare), remembers what
each name is bound to, before its use or after it, follows names to the literals
they stand for, and scores what a name stands for by how sensitive the name is
and by its own form.

A bare literal reaches up to the next white space, quote, comma or bracket, and
an operator within it may bind a name of its own to the rest; what such literals
share is measured once. So are literals that many names reach. A name stands for
all parts that it is joined from, through however many names: none is cut. One
tally of parts is led from expression to expression and counts only what differs
between them, so the time is near linear in the text where each differs by little
from one that it refers to, or from an earlier one of the same names. Where many
join several long values that otherwise have nothing in common, it grows with the
square.

Defined cases: a null text is an empty one; a text without spans has the digest
of an empty string; very long texts and literals are read and scored whole; of
bindings of one name the last before a use holds, else the first after it; spans
at one start go by kind, then end; an empty table returns no rows; repeated rows
give repeated results; extra columns stay, ones named like outputs are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "literal")

#: Score from which a literal counts as a secret.
SCORE = 0.45

_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]++)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OPERATOR = re.compile(r"[=:]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+") for q in "\"'`"}
_TYPE = re.compile(r"[\x20\t]*+&?(?:'\w++[\x20\t]++)?[\w.]++(?:\[[^\]\n]{0,80}\])?[\x20\t]*+=(?![=>])[\x20\t]*+")
_PREFIX = re.compile(r"(?:[rRbBuUfFL]{1,2}|u8)(?=[\"'`])")
_MORE = re.compile(r"[\x20\t]*+\+[\x20\t]*+(?=[\"'`A-Za-z_])")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+")
_PEM = re.compile(r"-----[A-Z ]{5,60}-----|\\[nr]|\s")
_SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_REFERENCE = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.]*+)\}?+")

#: How sensitive a part of a name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 1.0, "pass": 0.8, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8, "auth": 0.7, "authorization": 0.8,
    "bearer": 0.8, "jwt": 0.8, "key": 0.6, "private": 0.5, "signing": 0.4, "encryption": 0.4, "access": 0.3, "api": 0.3,
    "client": 0.2, "session": 0.4, "webhook": 0.5, "dsn": 0.6, "salt": 0.5,
}

#: Literals that stand for one, their first characters, and characters that make
#: one up alone.
PLACEHOLDERS = frozenset(["none", "null", "nil", "true", "false", "example", "changeme", "todo", "undefined"])
PLACEHOLDER_STARTS = ("your", "${", "<", "%")
PLACEHOLDER_FILL = frozenset(["x", "*", "."])


def sensitivity(name: str) -> float:
    """From 0 to 1, by the parts of a name in snake, kebab, dot or camel case."""
    parts = [p.lower() for p in _SUBWORD.findall(name)]
    miss = 1.0
    for a, b in zip(parts, [*parts[1:], ""], strict=True):
        miss *= 1 - SENSITIVE.get(a, 0) * 0.999
        miss *= 1 - SENSITIVE.get(a + b, 0) * 0.999 * (a not in SENSITIVE)
    return 1 - miss


class Measure:
    """What the form of a literal depends on."""

    __slots__ = ("head", "key", "n", "times")

    def __init__(self, literal: str):
        self.n, self.times, self.head, self.key = len(literal), Counter(literal), literal[:10], "-----BEGIN" in literal

    @classmethod
    def suffixes(cls, text: str, starts: list[int], end: int) -> list[Measure]:
        """Of ``text[a:end]``, without white space, for each ``a`` in rising
        order; every character is counted once."""
        out, times, b = [], Counter(), end
        for a in reversed(starts):
            times.update(text[a:b])
            b, one = a, cls("")
            one.n, one.times, one.head = end - a, times.copy(), text[a : min(end, a + 10)]
            out.append(one)
        return out[::-1]

    def form(self) -> float:
        """From 0 to 1, how much a literal looks like generated material."""
        n, low, made_of = self.n, self.head.lower(), {c.lower() for c in self.times}
        if n < 6 or any(c.isspace() for c in self.times):
            return 0.0
        if (n < 10 and low in PLACEHOLDERS) or low.startswith(PLACEHOLDER_STARTS) or (len(made_of) == 1 and made_of <= PLACEHOLDER_FILL):
            return 0.0
        bits = -math.fsum(k / n * math.log2(k / n) for k in self.times.values())  # alike in any order
        kinds = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" for c in self.times})
        return min(1.0, 0.35 * (kinds > 1) + 0.15 * (kinds > 2) + 0.15 * bits)


def form(literal: str) -> float:
    """From 0 to 1, how much a literal looks like generated material; of a key
    in lines, what stands between its first and its last one."""
    return Measure(_PEM.sub("", literal) if "-----BEGIN" in literal else literal).form()


class Forms:
    """The forms of what names stand for: joined spans of one text."""

    def __init__(self, text: str, starts: dict[int, list[int]]):
        """starts: where the bare literals begin that end at a place."""
        self.text, self.starts = text, starts
        self.raw: dict[tuple[int, int], Measure] = {}
        self.clean: dict[tuple[int, int], Measure] = {}
        self.memo: dict[tuple, float] = {}
        #: by end of bare literals, from where on they have nothing to clean
        self.plain: dict[int, int] = {}

    def measure(self, span: tuple[int, int]) -> Measure:
        if span not in self.raw:
            a, b = span
            shared = self.starts.get(b, ())
            if len(shared) > 1 and a in shared:
                self.raw |= {(x, b): m for x, m in zip(shared, Measure.suffixes(self.text, shared, b), strict=True)}
            else:
                self.raw[span] = Measure(self.text[a:b])
        return self.raw[span]

    def cleaned(self, span: tuple[int, int]) -> Measure:
        """Without what only a key in lines has."""
        if span not in self.clean:
            a, b = span
            if b in self.starts and b not in self.plain:
                at = self.starts[b][0]
                self.plain[b] = max((m.end() for m in _PEM.finditer(self.text, at, b)), default=at)
            self.clean[span] = self.measure(span) if a >= self.plain.get(b, a + 1) else Measure(_PEM.sub("", self.text[a:b]))
        return self.clean[span]

    def of(self, spans: list[tuple[int, int]]) -> float:
        if (key := tuple(spans)) not in self.memo:
            tally = Tally(self, any(self.measure(s).key for s in spans))
            for s in spans:
                tally.add(s)
            self.memo[key] = tally.form(spans)
        return self.memo[key]


class Tally:
    """The measures of a changing set of spans."""

    def __init__(self, forms: Forms, keyed: bool):
        """keyed: whether some span may be of a key in lines."""
        self.forms, self.spans, self.keys = forms, Counter(), 0
        self.raw, self.clean = Measure(""), Measure("") if keyed else None

    def _count(self, span: tuple[int, int], by: int) -> None:
        m = self.forms.measure(span)
        self.keys += by * m.key
        todo = [(self.raw, m)]
        if self.clean:
            todo.append((self.clean, self.forms.cleaned(span)))
        for total, one in todo:
            total.n += by * one.n
            for c, k in one.times.items():
                total.times[c] += by * k
                if not total.times[c]:
                    del total.times[c]

    def add(self, span: tuple[int, int]) -> None:
        self.spans[span] += 1
        if self.spans[span] == 1:
            self._count(span, 1)

    def drop(self, span: tuple[int, int]) -> None:
        self.spans[span] -= 1
        if not self.spans[span]:
            del self.spans[span]
            self._count(span, -1)

    def form(self, first: list[tuple[int, int]], first_clean: list[tuple[int, int]] | None = None) -> float:
        """Of all spans; those given come first, up to ten characters at least."""
        if self.keys:
            total, heads = self.clean, (self.forms.cleaned(s).head for s in (first if first_clean is None else first_clean))
        else:
            total, heads = self.raw, (self.forms.measure(s).head for s in first)
        total.head = "".join(heads)[:10]  # a part's head is cut only where it is long enough alone
        return total.form()


def pairs(text: str):
    """``(name, parts)`` of every assignment: ``(start, end, name)`` of what is
    joined, where the name is that of a reference or None."""
    done, n, bare = 0, len(text), (0, 0, 0)

    def quoted(e: int) -> tuple[int, int, int] | None:
        """Start and end of a string's inside, and where the text goes on."""
        if m := _PREFIX.match(text, e):
            e = m.end()
        if e >= n or (q := text[e]) not in _QUOTED:
            return None
        if q != "`" and text.startswith(q * 3, e):
            end = text.find(q * 3, e + 3)
            if end >= 0:
                return e + 3, end, end + 3
        end = _QUOTED[q].match(text, e + 1).end()
        return e + 1, end, min(n, end + 1)

    for m in _OPERATOR.finditer(text):
        p = m.start()
        if p < done:
            continue
        e = p + 1
        if e < n and text[p] == ":" and text[e] == "=":
            e += 1
        elif e < n and text[e] == ">" and text[p] == "=":
            e += 1
        elif text[p] == "=" and (e < n and text[e] == "=" or p and text[p - 1] in "=!<>"):
            continue
        a = p
        while a > done and text[a - 1] in " \t":
            a -= 1
        c = a - 1
        while c > done and text[c] == "]" and text[c - 1].isdigit():
            c -= 1
            while c > done and text[c - 1].isdigit():
                c -= 1
        if a > done and text[a - 1] == "]" and c > done and text[c - 1] == "[":
            a = c - 1  # an array's size
        elif a > done and text[a - 1] in "\"'`]":
            a -= 1
            if a > done and text[a - 1] in "\"'`":
                a -= 1
        b = a
        while a > done and text[a - 1] in _NAME_CHARS:
            a -= 1
        name = text[a:b]
        done = max(done, e)
        if not any(c.isalpha() for c in name):
            continue
        while e < n and text[e] in " \t":
            e += 1
        if e >= n:
            break
        # a type between the name and its value, whose own operator is read again
        typed = _TYPE.match(text, e) if text[p] == ":" else None
        if typed and quoted(typed.end()):
            e = typed.end()
        if found := quoted(e):
            parts, stop = [(*found[:2], None)], found[2]
        elif bare[0] <= e < bare[1] or (v := _BARE.match(text, e)):
            if not bare[0] <= e < bare[1]:
                stop = v.end()
                while stop > e and text[stop - 1] in ".:":
                    stop -= 1
                bare = e, v.end(), stop
            stop = max(e, bare[2])
            # a URL's rest after its scheme is not a value
            if text.startswith("//", e):
                done = bare[1]
                continue
            # an operator inside the value may still bind a name of its own
            r = _REFERENCE.fullmatch(text, e, stop)
            parts = [(e, stop, r[1] if r else "")]
            if not r:
                yield name, parts
                continue
        else:
            continue
        while more := _MORE.match(text, stop):
            if found := quoted(more.end()):
                parts.append((*found[:2], None))
                stop = found[2]
            elif m := _NAME.match(text, more.end()):
                parts.append((m.start(), m.end(), m[0]))
                stop = m.end()
            else:
                break
        yield name, parts
        if not typed and (len(parts) > 1 or parts[0][2] is None):
            done = stop


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, rank of the kind, end)`` of the three base patterns."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def resolved(said: list[tuple[str, list]]) -> tuple[list[int], list[list[int | None]]]:
    """Which expressions come down to literals, each after those it refers to, and
    for each part of an expression the one that it refers to (None: a literal).

    Names stand for what is bound before their use, else for what is bound after.
    The text is read forward and backward in turn until nothing more is found; each
    reading goes to those alone that it can tell."""
    refs = [list(dict.fromkeys(r for _, _, r in parts if r)) for _, parts in said]
    users: dict[str, list[int]] = {}
    for k, names in enumerate(refs):
        for r in names:
            users.setdefault(r, []).append(k)
    # users before lo[r] have a binding of r after them, those from hi[r] on one before
    lo, hi = dict.fromkeys(users, 0), {r: len(u) for r, u in users.items()}
    missing = {1: [len(names) for names in refs], -1: [len(names) for names in refs]}
    ready: dict[int, list[int]] = {1: [k for k, names in enumerate(refs) if not names], -1: []}
    order: list[int] = []
    rank: list[int | None] = [None] * len(said)
    way_of = [0] * len(said)

    def tell(k: int, way: int) -> None:
        missing[way][k] -= 1
        if not missing[way][k] and rank[k] is None:
            heappush(ready[way], way * k)

    way = 1
    while ready[1] or ready[-1]:
        while ready[way]:
            k = way * heappop(ready[way])
            if rank[k] is not None:
                continue
            rank[k], way_of[k] = len(order), way
            order.append(k)
            if (name := said[k][0]) in users:
                use = users[name]
                while hi[name] and use[hi[name] - 1] > k:
                    hi[name] -= 1
                    tell(use[hi[name]], 1)
                while lo[name] < len(use) and use[lo[name]] < k:
                    tell(use[lo[name]], -1)
                    lo[name] += 1
        way = -way
    # the nearest binding that was known by then: nearer ones that were known
    # earlier hide others, so the ranks kept for a name rise
    target: list[list[int | None]] = [[None] * len(parts) for _, parts in said]
    for way in (1, -1):
        kept: dict[str, list[int]] = {}
        for k in range(len(said))[::way]:
            name, parts = said[k]
            if rank[k] is None:
                continue
            if way_of[k] == way:
                for j, (_, _, r) in enumerate(parts):
                    if r:
                        target[k][j] = order[kept[r][bisect_left(kept[r], rank[k]) - 1]]
            if name in users:
                ranks = kept.setdefault(name, [])
                while ranks and ranks[-1] > rank[k]:
                    ranks.pop()
                ranks.append(rank[k])
    return order, target


class Expressions:
    """What expressions come down to: the union of their own literals and of what
    they refer to, each literal once and in the order of the parts."""

    def __init__(self, said: list[tuple[str, list]], forms: Forms, keyed: bool):
        self.said, self.forms, self.keyed = said, forms, keyed
        order, self.target = resolved(said)
        #: by expression, the one it is only another name of, else itself
        self.same: dict[int, int] = {}
        self.own: dict[int, list[tuple[int, int]]] = {}
        self.kids: dict[int, list[int]] = {}
        for k in order:
            parts, target = said[k][1], self.target[k]
            self.same[k] = self.same[target[0]] if len(parts) == 1 and target[0] is not None else k
            self.own[k] = [(a, b) for (a, b, _), x in zip(parts, target, strict=True) if x is None]
            self.kids[k] = list(dict.fromkeys(self.same[x] for x in target if x is not None))

    def reach(self, chosen: set[int]) -> set[int]:
        """The chosen ones and all that they refer to."""
        seen, todo = set(chosen), list(chosen)
        while todo:
            more = [x for x in self.kids[todo.pop()] if x not in seen]
            seen.update(more)
            todo += more
        return seen

    def _first(self, among: set[int], measure) -> dict[int, list[tuple[int, int]]]:
        """The first spans of each, up to ten characters at least."""
        out: dict[int, list[tuple[int, int]]] = {}
        for k in self.kids:
            if k not in among:
                continue
            spans, n = {}, 0
            for (a, b, _), x in zip(self.said[k][1], self.target[k], strict=True):
                for s in [(a, b)] if x is None else out[self.same[x]]:
                    if s not in spans and (size := measure(s).n):
                        spans[s] = None
                        n += size
                if n >= 10:
                    break
            out[k] = list(spans)
        return out

    def _near(self) -> dict[int, int]:
        """For each that refers to others, one before it that is likely to differ by
        little: what it refers to; of several, the last that joins the same names,
        else the longest."""
        near: dict[int, int] = {}
        size: dict[int, int] = {}
        last: dict[tuple, int] = {}
        for k, kids in self.kids.items():
            if self.same[k] != k:
                continue
            size[k] = min(len(self.said), len(self.own[k]) + sum(size[x] for x in kids))
            if len(kids) > 1:
                alike = (self.said[k][0], *sorted({r for _, _, r in self.said[k][1] if r}))
                near[k] = last[alike] if alike in last else max(reversed(kids), key=size.__getitem__)
                last[alike] = k
            elif kids:
                near[k] = kids[0]
        return near

    def forms_of(self, wanted: set[int]) -> dict[int, float]:
        """The forms of some that ``same`` gives, by one tally that goes from each to
        the next and counts what differs."""
        out = {k: self.forms.of(self.own[k]) for k in wanted if not self.kids[k]}
        if len(out) == len(wanted):
            return out
        near, after, seen, roots = self._near(), {}, set(), []
        for k in wanted - out.keys():
            while k not in seen:
                seen.add(k)
                if k not in near:
                    roots.append(k)
                    break
                after.setdefault(near[k], []).append(k)
                k = near[k]
        among, tally = self.reach(wanted - out.keys()), Tally(self.forms, self.keyed)
        first = self._first(among, self.forms.measure)
        first_clean = self._first(among, self.forms.cleaned) if self.keyed else first
        held: Counter[int] = Counter()

        def take(k: int) -> None:
            todo = [k]
            while todo:
                held[k := todo.pop()] += 1
                if held[k] == 1:
                    for s in self.own[k]:
                        tally.add(s)
                    todo += self.kids[k]

        def leave(k: int) -> None:
            todo = [k]
            while todo:
                held[k := todo.pop()] -= 1
                if not held[k]:
                    del held[k]
                    for s in self.own[k]:
                        tally.drop(s)
                    todo += self.kids[k]

        now, todo = None, sorted(roots)
        while todo:
            k = todo.pop()
            todo += sorted(after.get(k, ()))
            if k in wanted and k not in out:
                take(k)
                if now is not None:
                    leave(now)
                now = k
                out[k] = tally.form(first[k], first_clean[k])
        return out


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """Literals that a sensitive name is bound to, directly or through others."""
    if "=" not in text and ":" not in text:
        return []
    said = list(pairs(text))
    starts: dict[int, list[int]] = {}
    for _, parts in said:
        if parts[0][2] == "":
            starts.setdefault(parts[0][1], []).append(parts[0][0])
    forms = Forms(text, starts)
    weights = [sensitivity(name) for name, _ in said]
    if max(weights, default=0) <= 0.2:
        return []
    known = Expressions(said, forms, "-----BEGIN" in text)
    form_of = known.forms_of({known.same[k] for k, w in enumerate(weights) if w > 0.2 and k in known.same})
    found: set[tuple[int, int]] = set()
    chosen: set[int] = set()
    for k, weight in enumerate(weights):
        if weight <= 0.2:
            continue
        if k in known.same:
            if weight * form_of[known.same[k]] >= SCORE:
                chosen.add(known.same[k])
            continue
        # of what stays unknown, a name alone is its own literal
        parts = said[k][1]
        spans = [(a, b) for a, b, r in parts if not r or len(parts) == 1]
        if weight * forms.of(spans) >= SCORE:
            found.update(spans)
    found.update(s for k in known.reach(chosen) for s in known.own[k])
    return sorted((a, 3, b) for a, b in found if b > a)


def scan(text: str) -> dict:
    """All spans of a text and the digest of the base ones."""
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    # what lies within a base span is none of its own
    own = [s for s in lexed_spans(text) if not (k := bisect_right(starts, s[0])) or reach[k - 1] < s[2]]
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    n = Counter(k for _, k, _ in base)
    counts = {"n_assign": n[0], "n_access": n[1], "n_hex": n[2]}
    return counts | {"base_sha256": common.sha256(said(base)), "spans": said(sorted(base + own)), "n_spans": len(base) + len(own)}


def redact(text: str) -> str:
    """The text with every span replaced by ``<secret>``."""
    spans = scan(text)["spans"]
    if not spans:
        return text
    out, at = [], 0
    for s in spans.split(","):
        _, a, b = s.rsplit(":", 2)
        if int(b) <= at:
            continue
        if int(a) >= at:
            out += [text[at : int(a)], "<secret>"]
        at = int(b)
    return "".join([*out, text[at:]])


_FIELDS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans")


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add counts, the base digest and all spans to every row."""
    kind = pa.struct([(c, pa.int64() if c[0] == "n" else pa.string()) for c in _FIELDS])
    schema = "struct<" + ", ".join(f"{c}: {'bigint' if c[0] == 'n' else 'string'}" for c in _FIELDS) + ">"
    return common.with_fields(df, common.text_udf(lambda: scan, schema, kind)(F.col(text)), _FIELDS)


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace secrets in the text column; a null text stays null."""
    masked = common.text_udf(lambda: redact, "string", pa.string())(F.col(text))
    return df.withColumn(text, F.when(F.col(text).isNotNull(), masked))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4``: secrets in every document."""
    return find(common.table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", *_FIELDS)
