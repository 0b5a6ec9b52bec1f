"""Text functions, as native expressions wherever the built-in ones can say it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model

# What tooling puts at the start of a turn, tags without search
# value, and beginnings of messages that are boilerplate.
AUTOMATED_MARKERS = (
    "<command-message>",
    "<user_action>",
    "<local-command-stdout>",
    "<local-command-caveat>",
    "<bash-input>",
    "[Request interrupted by user",
    "This session is being continued",
)
NOISE_TAGS = ("command-name", "local-command-caveat", "system-reminder")
BOILERPLATE = ("<user_instructions>", "<environment_context>", "<permissions instructions>", "# AGENTS.md instructions")

_ESCAPES = r"(?s)\x1b(?:\[[^A-Za-z]*[A-Za-z]?|\].*?(?:\x07|\x1b\\|\z))"


def quote(term: str) -> str:
    """A literal as a part of a regular expression."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def any_start(text: Column, starts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for s in starts:
        found = found | text.startswith(s)
    return found


def strip_noise_tags(text: Column) -> Column:
    """Closed noise tags go with what they hold; unclosed ones stay."""
    for tag in NOISE_TAGS:
        text = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")
    return text


def strip_control(text: Column) -> Column:
    """Terminal sequences and control characters go, a tab becomes a space."""
    text = F.translate(F.regexp_replace(text, _ESCAPES, ""), "\t", " ")
    return F.regexp_replace(text, r"[\x00-\x09\x0B-\x1F\x7F-\x9F]", "")


def classify_first_turn(text: Column) -> Column:
    """``automated`` if a turn opens with a marker, else ``interactive``."""
    head = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", "")
    return F.when(any_start(head, AUTOMATED_MARKERS), model.AUTOMATED).otherwise(model.INTERACTIVE)


def is_boilerplate(text: Column) -> Column:
    return any_start(text, BOILERPLATE)


def ascii_lower(text: Column) -> Column:
    """Fold A-Z alone, as a LIKE of the reference's storage does."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fold(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def trigrams(text: Column) -> Column:
    """Number of trigrams of a text."""
    return F.greatest(F.char_length(F.coalesce(text, F.lit(""))) - 2, F.lit(0))


def occurrences(text: Column, term: str) -> Column:
    """Overlapping, case-insensitive occurrences of a literal."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(f"(?={quote(term.lower())})")), F.lit(0))


def cap_message(text: Column) -> Column:
    most = model.MESSAGE_CHARS
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def cap_note(note: str) -> str:
    """The beginning of what an error says, without what a terminal would obey."""
    note = re.sub(_ESCAPES.replace(r"\z", r"\Z"), "", note).replace("\t", " ")
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", "", note)[: model.NOTE_CHARS]


def display_name(project: Column) -> Column:
    """Last component of a project path, or ``unknown``."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(project, F.lit("")), "/+$", ""), "/"), -1)
    return F.when(F.coalesce(last, F.lit("")) == "", "unknown").otherwise(last)


def parent_session(path: Column) -> Column:
    """The path segment before ``/subagents/``, or null."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)/subagents/", 1), F.lit(""))


def inspect_hint(session_id: Column, chunk: Column) -> Column:
    base = F.concat(F.lit("show "), session_id)
    return F.when(chunk.isNull(), base).otherwise(F.concat(base, F.lit(" --chunk "), chunk.cast("string")))


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


# Splitting by bytes goes from cut to cut, so it is a Python function; it runs
# over the texts that are too long alone.


def _boundary(data: bytes, at: int, most: int) -> int:
    """Where the piece from ``at`` ends: after the last blank line in reach,
    else after the last line, else before the character that is cut."""
    if len(data) - at <= most:
        return len(data)
    end = at + most
    while data[end] & 0xC0 == 0x80:
        end -= 1
    for mark in (b"\n\n", b"\n"):
        if (p := data.rfind(mark, at, end)) >= 0:
            return p + len(mark)
    return end


def pieces(text: str, most: int) -> list[str]:
    data, at, out = text.encode("utf-8", "surrogatepass"), 0, []
    while at < len(data):
        end = _boundary(data, at, most)
        out.append(data[at:end].decode("utf-8", "surrogatepass"))
        at = end
        while data[at : at + 1] == b"\n":
            at += 1
    return out


def split_text(text: str, most: int = model.CHUNK_BYTES) -> list[str]:
    if len(text.encode("utf-8", "surrogatepass")) <= most:
        return [text]
    return pieces(text, most)


def chunk_contents(user: str, assistant: str | None, most: int = model.CHUNK_BYTES) -> list[str]:
    """The contents of a question with its answer: together if they fit, else
    the question before each piece of the answer, else both split alone."""
    size = lambda t: len(t.encode("utf-8", "surrogatepass"))
    if assistant is None:
        return split_text(user, most)
    header = user + "\n"
    room = most - size(header)
    # a character has four bytes at most, so less room may hold none
    bodies = [assistant] if size(assistant) <= room else pieces(assistant, room) if room >= 4 else None
    return [header + b for b in bodies] if bodies is not None else split_text(user, most) + split_text(assistant, most)


def contents(user: Column, assistant: Column, most: int = model.CHUNK_BYTES) -> Column:
    """``chunk_contents`` as a column; only what does not fit reaches Python."""
    whole = F.when(assistant.isNull(), user).otherwise(F.concat(user, F.lit("\n"), assistant))
    long = F.octet_length(whole) > most

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for u, a in batches:
            yield pa.array([None if x is None else chunk_contents(x, y, most) for x, y in zip(u.to_pylist(), a.to_pylist(), strict=True)], type=pa.list_(pa.string()))

    split = F.arrow_udf(run, "array<string>", F.ArrowUDFType.SCALAR_ITER)
    return F.when(long, split(F.when(long, user), F.when(long, assistant))).otherwise(F.array(whole))


def snippet_of(text: str, terms: list[str], tokens: int = model.SNIPPET_TRIGRAMS) -> str:
    """A window of ``tokens`` trigrams with most distinct terms, of those the one
    with most hits, then the first; matches marked by ``**`` and cuts by dots."""
    low = text.lower()
    if len(low) != len(text):
        low = text
    found: list[tuple[int, int, str]] = []
    for term in {t.lower() for t in terms if t}:
        p = low.find(term)
        while p >= 0:
            found.append((p, p + len(term), term))
            p = low.find(term, p + 1)
    found.sort()
    hits = [(a, b) for a, b, _ in found]
    width = tokens + 2
    if not hits:
        return text[:width] + ("..." if len(text) > width else "")
    # windows that start at a hit, with the hits that are whole in each
    at, best, first = 0, (0, 0), 0
    for start in sorted({max(0, min(a, len(text) - width)) for a, _ in hits}):
        while found[first][0] < start:
            first += 1
        inside = []
        for a, b, term in found[first:]:
            if a >= start + width:
                break
            if b <= start + width:
                inside.append(term)
        if (score := (len(set(inside)), len(inside))) > best:
            at, best = start, score
    out, p, end = ["..."] if at else [], at, min(len(text), at + width)
    merged: list[list[int]] = []
    for a, b in hits:
        if a >= at and b <= end:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
    for a, b in merged:
        out += [text[p:a], "**", text[a:b], "**"]
        p = b
    out.append(text[p:end])
    return "".join(out) + ("..." if end < len(text) else "")


def snippet(text: Column, terms: list[str]) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else snippet_of(x, terms) for x in batch.to_pylist()], type=pa.string())

    return F.arrow_udf(run, "string", F.ArrowUDFType.SCALAR_ITER)(text)
