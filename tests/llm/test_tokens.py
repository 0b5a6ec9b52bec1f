"""Operators 7, 8 and 10 against plain versions of what they compute."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlquery.llm import bpe, token_counts, training_order
from parlquery.llm.feistel import permute

from .conftest import odd_texts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.WordBpe(bpe.vocabulary_path())


def agree(codec, tokenizer, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    n, ids, decoded = codec.encode(text)
    assert ids == " ".join(map(str, want)), text[:80]
    assert n == len(want)
    assert decoded == tokenizer.decode(want, skip_special_tokens=False), text[:80]
    assert codec.decode(want) == decoded


def test_bpe_on_odd_texts(codec, tokenizer):
    for text in odd_texts():
        agree(codec, tokenizer, text or "")


def test_bpe_on_noise(codec, tokenizer):
    rng = random.Random(9)
    every = "abcdeXYZ019 \n\t\r'’.,!?-_<|>éßüñÀ́  ​‍数据語ทड़क्षी한글\U0001f600\U0001f469\x00\x1c\x85 ſıİK½²ªº"
    for _ in range(3000):
        agree(codec, tokenizer, "".join(rng.choice(every) for _ in range(rng.randrange(50))))
    words = ["it's", "don't", "we'll", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "hello", "WORLD", "x1y2", "a.b", "  ", "\n", "'s", "naïve"]
    for _ in range(2000):
        agree(codec, tokenizer, "".join(rng.choice(words) for _ in range(rng.randrange(12))))


def test_bpe_tree_equals_whole(tokenizer):
    rng = random.Random(11)
    for leaf in (4, 7, 16):
        small = bpe.WordBpe(bpe.vocabulary_path(), leaf=leaf)
        for n in (5, 9, 33, 100, 700):
            for letters in ("ab", "abcdefghij", "the", "lo", "éa数"):
                agree(small, tokenizer, "".join(rng.choice(letters) for _ in range(n)))
    agree(bpe.WordBpe(bpe.vocabulary_path()), tokenizer, "".join(rng.choice("etaoinshrdlu") for _ in range(100_000)))


def test_text_tree_equals_whole(tokenizer):
    """Cuts anywhere: within words, special tokens and marks of a letter."""
    rng = random.Random(13)
    parts = ["a", "B", "e\u0301", "\u0301", "İ", "<|endoftext|>", "<|", "|>", "\x85", "\xa0", "\u3000", " ", "  ", "\n", "\t", "\x0b", "数据", "😀", "it's", "'s", "'", "\x1c", "ΑΣ", "x" * 30, "12", "#"]
    for leaf in (1, 3, 16):
        small = bpe.WordBpe(bpe.vocabulary_path(), leaf=8, leaf_text=leaf)
        for _ in range(500):
            agree(small, tokenizer, "".join(rng.choice(parts) for _ in range(rng.randrange(70))))


def test_long_documents_go_through_the_tree(spark, tokenizer, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("length(text) > 16000").collect()]
    codec, joins = bpe.WordBpe(bpe.vocabulary_path()), []
    inner = codec.join_parts
    monkeypatch.setattr(codec, "join_parts", lambda *x: joins.append(1) or inner(*x))
    assert texts
    for text in texts:
        joins.clear()
        agree(codec, tokenizer, text)
        assert len(joins) == -(-len(text) // bpe.LEAF_TEXT) - 1


def test_encoding_time_grows_with_the_length():
    from .conftest import doubling

    for unit in ("x", "ab1 ", "数", "'s", "<|", "<|endoftext|>"):
        assert doubling(lambda n, u=unit: bpe.WordBpe(bpe.vocabulary_path()).encode(u * n), 100_000 // len(unit)), unit


def test_bpe_query(spark, documents, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    found = bpe.query(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    for r in found:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_frames(odd, empty, tokenizer):
    rows = bpe.decode(bpe.encode(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["token_ids"] == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == tokenizer.decode(r["token_ids"], skip_special_tokens=False)
    assert bpe.round_trip(empty).count() == 0 and bpe.tokenized(empty).count() == 0
    assert bpe.tokenized(odd.withColumnRenamed("lang", "token_ids")).columns.count("token_ids") == 1


def greedy(word, pieces, most):
    n = at = 0
    while at < len(word):
        for k in range(min(most, len(word) - at), 0, -1):
            if word[at : at + k] in pieces:
                at += k
                n += 1
                break
        else:
            return 1
    return n


def test_longest_match_on_invented_vocabularies():
    rng = random.Random(2)
    for _ in range(300):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))}
        machine = token_counts.Automaton(sorted(pieces))
        for _ in range(30):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 15)))
            assert machine.count(word) == greedy(word, pieces, 6)


def test_token_count_query(spark, documents, odd, empty):
    pieces = set(token_counts.read_vocabulary(token_counts.vocabulary_path()))
    most = max(map(len, pieces))

    def brute(text):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return len(words), sum(greedy(b" " + w, pieces, most) for w in words)

    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = token_counts.query(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in found} == {k: brute(t) for k, t in texts.items()}
    for r in token_counts.count_tokens(odd).collect():
        assert (r["n_words"], r["n_tokens"]) == brute(r["text"])
    assert token_counts.count_tokens(empty).count() == 0
    assert token_counts.count_tokens(odd.withColumnRenamed("lang", "n_tokens")).columns.count("n_tokens") == 1


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        for key in (0, 1, 99):
            assert sorted(permute(np.arange(n), n, key).tolist()) == list(range(n))
    assert permute(np.arange(1000), 1000, 1).tolist() != permute(np.arange(1000), 1000, 2).tolist()


def test_training_order(spark, documents, odd, empty, tmp_path):
    coder = training_order.ByteBpe(training_order.vocabulary_path())
    for k, df in enumerate((documents, odd, odd.withColumnRenamed("lang", "slot").withColumnRenamed("n_chars", "shard"))):
        path = str(tmp_path / f"shards{k}")
        training_order.write(*training_order.slots(training_order.sequences(df)), path, shard_seq=64)
        rows = training_order.read(spark, path, shard_seq=64).collect()
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        ids, stride = 2 * training_order.SEQ_LEN, training_order.stride_of()
        assert all(len(r["record"]) == ids and r["shard"] == r["slot"] // 64 and r["byte_offset"] == r["slot"] % 64 * stride for r in rows)
        # the bytes of each slot are where it says, in the one file of its shard
        files = {int(p.parent.name.removeprefix("shard=")): p for p in (tmp_path / f"shards{k}").glob("wave=*/shard=*/part-*")}
        assert sorted(files) == list(range(-(-len(rows) // 64))) and len(list((tmp_path / f"shards{k}").glob("wave=*/shard=*/part-*"))) == len(files)
        content = {s: p.read_bytes() for s, p in files.items()}
        for r in rows:
            at = r["byte_offset"] + training_order.HEAD_BYTES
            assert content[r["shard"]][at : at + ids] == bytes(r["record"])
            assert (np.frombuffer(r["record"], "<u2")[r["n_tokens"] :] == training_order.END).all()
        by = {}
        for r in rows:
            by.setdefault((r["doc_id"], r["seq_no"]), []).append(bytes(r["record"])[: 2 * r["n_tokens"]])
        for r in df.dropDuplicates(["doc_id", "text"]).collect():
            if r["doc_id"] is None:
                continue
            ids = b"".join(v[0] for (d, _), v in sorted((x for x in by.items() if x[0][0] == r["doc_id"]), key=lambda x: x[0][1]))
            assert coder.decode(ids) == (r["text"] or "")
            assert np.frombuffer(ids, "<u2").tolist() == coder.coder.encode_ordinary(r["text"] or "")
    seqs = training_order.sequences(empty)
    training_order.write(*training_order.slots(seqs), str(tmp_path / "none"))
    assert training_order.read(spark, str(tmp_path / "none")).count() == 0 and list(training_order.resume(spark, str(tmp_path / "none"))) == []
    names = documents.limit(3).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["doc_id"] for r in training_order.sequences(names).collect()} == {None}


def test_reading_and_writing_go_on(spark, documents, tmp_path):
    """A reader starts at any slot; a killed writer's whole waves stay."""
    path = str(tmp_path / "shards")
    rows, total = training_order.slots(training_order.sequences(documents))
    training_order.write(rows, total, path, shard_seq=32)
    want = {r["slot"]: bytes(r["record"]) for r in training_order.read(spark, path, shard_seq=32).collect()}
    for slot in (0, 31, 32, 70, total - 1, total):
        assert list(training_order.resume(spark, path, slot, shard_seq=32, ahead=7)) == [(s, want[s]) for s in range(slot, total)]
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").glob("wave=[013]/shard=*/part-*")}
    (tmp_path / "shards" / "wave=2" / "_SUCCESS").unlink()
    next((tmp_path / "shards").glob("wave=2/shard=*/part-*")).unlink()
    training_order.write(rows, total, path, shard_seq=32)
    assert {p: p.stat().st_mtime_ns for p in kept} == kept
    assert {r["slot"]: bytes(r["record"]) for r in training_order.read(spark, path, shard_seq=32).collect()} == want


def test_a_task_of_the_training_order_holds_little(spark, documents):
    """Sequences leave in batches of a bounded size, and a wave computes its slots
    once: a task that does so twice has two Python workers."""
    coder = training_order.ByteBpe(training_order.vocabulary_path())
    texts = ["one two", None, "word " * 600_000, "", *["end"] * 3_000]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    found = list(training_order.cut(iter([rows, rows.slice(0, 2)]), coder, 7))
    assert max(b.num_rows for b in found) <= training_order.BATCH_SEQ
    got = pa.Table.from_batches(found).to_pylist()
    assert [r["at"] for r in got] == list(range(len(got))) and {r["part"] for r in got} == {7}
    want = [(d, coder.encode(x or "")) for d, x in enumerate(texts)] + [(0, coder.encode("one two"))]
    stride = 2 * training_order.SEQ_LEN
    assert [(r["doc_id"], r["seq_no"], r["n_tokens"], r["ids"]) for r in got] == [(d, k // stride, len(raw[k : k + stride]) // 2, raw[k : k + stride]) for d, raw in want for k in range(0, len(raw), stride)]
    slots, total = training_order.slots(training_order.sequences(documents))
    wave = training_order.in_order(slots, 1, 3, shard_seq=32)
    assert total > 3 * 32 and wave._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r["slot"] for r in wave.collect()) == list(range(32, 96))


def test_training_order_query(spark, documents):
    a, b = (sorted((r["slot"], r["doc_id"], r["seq_no"]) for r in training_order.query(spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert a == b and [x[0] for x in a] == list(range(len(a)))
