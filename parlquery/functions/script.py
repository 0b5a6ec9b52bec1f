"""Query strings: script boundaries, quotes and phrases. Small, so plain Python."""

from __future__ import annotations

# Ranges of code points by script.
_RANGES = (
    ("latin", 0x30, 0x39), ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A),
    ("hiragana", 0x3040, 0x309F),
    ("katakana", 0x30A0, 0x30FF), ("katakana", 0x31F0, 0x31FF), ("katakana", 0xFF66, 0xFF9D),
    ("han", 0x3005, 0x3005), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF),
)


def script_of(char: str) -> str | None:
    """The script of a character; None for all others."""
    return next((name for name, a, b in _RANGES if a <= ord(char) <= b), None)


def segment(query: str) -> str:
    """Put a space wherever one script follows another; quoted spans stay."""
    parts = query.split('"')
    for k in range(0, len(parts), 2):
        text, out, before = parts[k], [], None
        for c in text:
            now = script_of(c)
            if now and before and now != before:
                out.append(" ")
            out.append(c)
            before = now
        parts[k] = "".join(out)
    return '"'.join(parts)


def anchored(query: str) -> str:
    """The segmented query if one of its terms has three characters, else the
    query as it is."""
    cut = segment(query)
    return cut if any(len(t) >= 3 for t in cut.split()) else query


def phrases(query: str) -> list[str]:
    """Literal phrases: quoted spans and white-space terms. Operators and column
    names have no meaning; an open quote is closed at the end."""
    out = []
    for k, part in enumerate(query.split('"')):
        out += [part] if k % 2 else part.split()
    return list(dict.fromkeys(p for p in out if p.strip()))
