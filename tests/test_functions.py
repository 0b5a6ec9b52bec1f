import random

import pytest
from pyspark.sql import functions as F

from parlquery import model
from parlquery.functions import script
from parlquery.functions import text as tx
from parlquery.functions import time as tm
from parlquery.functions.vector import ByteEmbedder, batch_numbers, embed_batches, passes


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column(F.col("x")).alias("y")).first()["y"]


def many(spark, column, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r["y"] for r in df.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_control_characters(spark):
    cases = {
        "plain": "plain", "a\nb": "a\nb", "x \x1b[31mred\x1b[0m y": "x red y", "a\x1b]0;t\x07b": "ab", "a\x1b]0;t\x1b\\b": "ab",
        "a\x1b]0;t": "a", "a\x1b[31": "a", "a\tb": "a b", "a\t\tb": "a  b", "a\rb": "ab", "\x1b\x1b[31m": "", "a\x1bb": "ab", "\x1b[\n1mz": "z",
    }
    assert many(spark, tx.strip_control, list(cases)) == list(cases.values())
    every = [chr(k) for k in range(0x01, 0xA0)]
    want = [" " if c == "\t" else c if c == "\n" or " " <= c < "\x7f" else "" for c in every]
    assert many(spark, tx.strip_control, [f"a{c}b" for c in every]) == [f"a{w}b" for w in want]


def test_noise_tags(spark):
    a, b, c = tx.NOISE_TAGS
    cases = {f"x<{a}>/y</{a}>z": "xz", f"<{b}>\n\n</{b}>z": "z", f"p<{c}>1</{c}>q<{c}>2</{c}>": "pq", f"<{a}>open": f"<{a}>open", "<local-command-stdout>o</local-command-stdout>": "<local-command-stdout>o</local-command-stdout>"}
    assert many(spark, tx.strip_noise_tags, list(cases)) == list(cases.values())


def test_first_turns(spark):
    turns = [None, "", "  \n\u3000<bash-input>ls", "say <bash-input>", *tx.AUTOMATED_MARKERS]
    assert many(spark, tx.classify_first_turn, turns) == ["interactive", "interactive", "automated", "interactive"] + ["automated"] * 7


def test_iso_times(spark):
    base = 1709251200000
    cases = {
        "2024-03-01T00:00:00Z": base, "2024-03-01 00:00:00": base, "2024-03-01T00:00:00.5Z": base + 500, "2024-03-01T00:00:00.12Z": base + 120,
        "2024-03-01T00:00:00.123456Z": base + 123, "2024-03-01T09:00:00+09:00": base, "2024-03-01T09:00:00+0900": base, "2024-02-29T19:00:00-05:00": base,
        " 2024-03-01T00:00:00Z ": base, "2024-03-01T00:00:00+9": base, "2024-03-01T24:00:00Z": None, "2024-03-01T00:60:00Z": None, "2023-02-29T00:00:00Z": None,
        "2024-13-01T00:00:00Z": None, "2026": None, "": None, "2024-03-01T00:00:00Zé": None, "1969-12-31T23:59:59.999Z": -1,
    }
    assert many(spark, tm.iso_ms, list(cases)) == list(cases.values())
    assert one(spark, tm.iso_ms, None) is None
    assert [one(spark, tm.format_day, v, "bigint") for v in (None, 0, -1, base)] == ["unknown", "1970-01-01", "1969-12-31", "2024-03-01"]
    decay = [one(spark, lambda c: tm.recency_decay(c, base), v, "bigint") for v in (None, base + 5, base, base - 30 * model.DAY_MS)]
    assert decay == pytest.approx([0, 1, 1, 0.5])


def test_script_boundaries():
    cases = {
        "pandas港湾データ集計": "pandas 港湾 データ 集計", "集計する": "集計 する", "Numpyの行": "Numpy の 行", "utf8 v2 sha256": "utf8 v2 sha256",
        "潮位表": "潮位表", '"港湾データ"': '"港湾データ"', "おーい": "お ー い", 'a"x港湾"港a': 'a"x港湾"港 a', "港-a": "港-a",
    }
    assert {q: script.segment(q) for q in cases} == cases
    assert script.anchored("集計する") == "集計する" and script.anchored("text集計") == "text 集計"
    assert script.phrases('a "b c" d') == ["a", "b c", "d"] and script.phrases('"open end') == ["open end"]
    assert script.phrases("x AND role:user OR NOT y") == ["x", "AND", "role:user", "OR", "NOT", "y"] and script.phrases("  ") == []


def test_chunk_contents():
    most = model.CHUNK_BYTES
    assert tx.chunk_contents("q", None) == ["q"] and tx.chunk_contents("q", "a") == ["q\na"]
    parts = tx.chunk_contents("潮位", "line\n" * 5000)
    assert len(parts) > 1 and all(p.startswith("潮位\n") and len(p.encode()) <= most for p in parts)
    for user, answer in (("a" * 15998, "港の朝は早い"), ("a" * 15995, "波と風の記録"), ("é" * 20000, "x")):
        parts = tx.chunk_contents(user, answer)
        assert all(len(p.encode()) <= most for p in parts)
    assert all(p.startswith("a" * 15995 + "\n") for p in tx.chunk_contents("a" * 15995, "波と風の記録"))
    assert "".join(tx.chunk_contents("a" * 15998, "港の朝は早い")) == "a" * 15998 + "港の朝は早い"
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "数", "😀", "\n", "\n\n", " word"]) for _ in range(rng.randrange(1, 200)))
        parts = tx.pieces(text, 24)
        assert all(0 < len(p.encode()) <= 24 for p in parts)
        assert "".join(parts).replace("\n", "") == text.replace("\n", "")


def test_contents_as_a_column(spark):
    rows = [("q", None), ("q", "a"), (None, "a"), ("q", "w " * 20_000), ("u" * 40_000, None), ("u" * 16_000, "b")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, u string, a string")
    got = [r["c"] for r in df.select("k", tx.contents(F.col("u"), F.col("a")).alias("c")).orderBy("k").collect()]
    assert got[2] in (None, [None])
    assert [g for k, g in enumerate(got) if k != 2] == [tx.chunk_contents(*r) for k, r in enumerate(rows) if k != 2]


def test_snippets():
    s = tx.snippet_of("x" * 50 + "needle" + "y" * 50, ["needle"])
    assert "**needle**" in s and s.startswith("...") and s.endswith("...")
    assert tx.snippet_of("ab", ["zz"]) == "ab" and tx.snippet_of("aaaa", ["aa"]) == "**aaaa**"
    # two distinct terms count more than many hits of one
    text = "tide tide tide tide " + "." * 40 + " tide and port " + "." * 40
    assert tx.snippet_of(text, ["tide", "port"]) == "...**tide** and **port** " + "." * 8 + "..."


def test_notes_are_short_and_plain():
    assert tx.cap_note("\x1b[31mred\x1b[0m\tend\n\x07") == "red end" and len(tx.cap_note("x" * 500)) == model.NOTE_CHARS


def test_embed_batches_isolate_failures(spark):
    df = spark.createDataFrame([(k, "x" * 5) for k in range(300)] + [(900, "poison" + "y" * 9000)], "chunk_id bigint, content string")
    rows = embed_batches(df, ByteEmbedder(8, poison="poison")).collect()
    bad = [r for r in rows if r["error"]]
    assert len(rows) == 301 and {900} <= {r["chunk_id"] for r in bad} and len(bad) <= model.EMBED_BATCH
    assert all(r["embedding"] is not None and abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in rows if not r["error"])


def test_batches_are_the_numbered_ones(spark):
    """The batches that are embedded are those that are counted, in that order."""
    class Telling(ByteEmbedder):
        def embed(self, texts):
            return [[[float(len(t)), float(len(texts))], [0.0, 1.0]] for t in texts]

    df = spark.createDataFrame([(k, "x" * (k * 7 % 50)) for k in range(1, 400)], "chunk_id bigint, content string")
    number = {r["chunk_id"]: r["batch"] for r in batch_numbers(df).collect()}
    order = sorted(range(1, 400), key=lambda k: (k * 7 % 50, k))
    assert number == {k: i // model.EMBED_BATCH for i, k in enumerate(order)}
    rows = embed_batches(df, Telling()).collect()
    assert sorted((r["chunk_id"], r["sub_idx"]) for r in rows) == [(k, s) for k in range(1, 400) for s in (0, 1)]
    size = [sum(v == b for v in number.values()) for b in range(4)]
    assert all(r["embedding"][1] == size[number[r["chunk_id"]]] for r in rows if r["sub_idx"] == 0)


def test_forward_passes_keep_to_their_tokens(spark):
    assert list(passes([], 5)) == [] and list(passes([1, 2, 3], None)) == [(0, 3)]
    assert list(passes([1, 2, 3, 3, 9, 1], 6)) == [(0, 2), (2, 4), (4, 5), (5, 6)]
    df = spark.createDataFrame([(k, "x" * 10) for k in range(1, 30)], "chunk_id bigint, content string")
    one, many = (sorted((r["chunk_id"], r["sub_idx"]) for r in embed_batches(df, ByteEmbedder(8), token_budget=b).collect()) for b in (None, 25))
    assert one == many and len(one) == 29


def test_literals_in_patterns(spark):
    assert one(spark, lambda c: tx.occurrences(c, "aaa"), "aaaaaa", "string") == 4
    for term in ("a.b", "\\E", "(x", "$^*", "a\\Eb\\Q"):
        assert one(spark, lambda c, t=term: tx.occurrences(c, t), f"--{term}--{term}") == 2
