"""Operators 3 and 5 against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlquery.llm import components, nn_descent, simhash

from .conftest import frame


def smallest_reachable(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def brute_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    a = np.array(prints, dtype=np.uint64)
    links = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4) + i + 1]
    return smallest_reachable(len(a), links)


def test_fingerprints_on_odd_texts(odd):
    for r in simhash.fingerprints(odd).collect():
        assert r["fp"] % 2**64 == brute_print(r["text"])


def test_simhash_query(spark, documents):
    rows = sorted(documents.collect(), key=lambda r: r["doc_id"])
    prints = [brute_print(r["text"]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    want = {ids[k]: (f"{prints[k]:016x}", ids[c]) for k, c in enumerate(brute_components(prints))}
    found = simhash.query(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == want


def test_links_of_random_fingerprints(spark):
    """Groups of near fingerprints, chains of them, and one large bucket."""
    rng = random.Random(8)
    prints = []
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            prints.append(fp)
            for _ in range(rng.randrange(0, 6)):
                fp ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    prints += [base ^ (rng.getrandbits(20) << 22) for _ in range(900)]  # alike in two segments
    prints = sorted(set(prints))
    want = brute_components(prints)
    df = spark.createDataFrame([(k, x - 2**64 if x >> 63 else x) for k, x in enumerate(prints)], "n bigint, fp bigint")
    named = components.components(simhash.link(df))
    got = df.join(named, F.col("fp") == F.col("node"), "left").select("n", F.coalesce("component", "fp").alias("c")).collect()
    least = {}
    for r in got:
        least[r["c"]] = min(r["n"], least.get(r["c"], r["n"]))
    assert [least[r["c"]] for r in sorted(got)] == want


def test_simhash_keeps_one_of_each_group(spark, odd, empty):
    assert simhash.cluster(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    rows = odd.collect()
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    kept = kept.collect()
    prints = [brute_print(r["text"]) for r in rows]
    groups = brute_components(prints)
    best = {}
    for r, g in zip(rows, groups, strict=True):
        if r["doc_id"] is not None:
            best[g] = min(best.get(g, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept) == sorted(best.values())
    nameless = frame(spark, ["only here and nowhere else at all", "only here and nowhere else at all", "x y z"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert sorted(r["text"] for r in simhash.keep_one(nameless).collect()) == ["only here and nowhere else at all", "x y z"]
    clash = odd.withColumnRenamed("lang", "fp").withColumnRenamed("source", "component_id").withColumnRenamed("n_chars", "OWN")
    assert simhash.keep_one(clash).columns == clash.columns
    assert sorted(r["doc_id"] for r in simhash.keep_one(clash).collect()) == sorted(best.values())


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 200)] + [(300, k) for k in range(301, 900)] + [(k, 1000 + (k - 999) % 50) for k in range(1000, 1050)]
    links += [(rng.randrange(1100, 1400), rng.randrange(1100, 1400)) for _ in range(150)]
    rng.shuffle(links)
    want = smallest_reachable(1400, links)
    nodes = {x for ab in links if ab[0] != ab[1] for x in ab}
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in got} == {n: want[n] for n in nodes}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_vectors(rows):
    ok = [k for k, r in enumerate(rows) if r[2] is not None and r[1] and None not in r[1] and np.isfinite(np.array(r[1], dtype=float)).all() and np.linalg.norm(r[1]) > 0]
    links = []
    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=float), np.array(rows[b][1], dtype=float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links.append((a, b))
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, smallest_reachable(len(rows), links)


def test_embeddings_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    centres = rng.standard_normal((12, 16))
    for k in range(260):
        v = centres[k % 12] + rng.standard_normal(16) * (0.15 if k % 3 else 0.6)
        rows.append((k, [float(np.float32(x)) for x in v], k % 4))
    rows += [(300 + k, [float(np.float32(x)) for x in centres[0]], 0) for k in range(40)]  # equal vectors
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8]
    rows += [(400 + k, v, 1) for k, v in enumerate(odd)] + [(420, [1.0] * 16, None), (421, [1.0] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    n, c = brute_vectors(rows)
    found = {r["vec_id"]: r for r in nn_descent.cluster(df).collect()}
    assert len(found) == len(rows)
    ids = [r[0] for r in rows]
    share = sum(found[i]["n_links"] for i in ids) / sum(n)
    assert 0.99 <= share <= 1
    assert all(found[i]["n_links"] <= m for i, m in zip(ids, n, strict=True))
    assert all(found[i]["component_id"] == ids[g] for i, g in zip(ids, c, strict=True) if found[i]["n_links"] == n[ids.index(i)])
    assert all(found[i]["kept"] == (found[i]["component_id"] == i) for i in ids)
    assert nn_descent.cluster(df.limit(0)).count() == 0
    one = nn_descent.cluster(df.filter("vec_id = 0")).collect()
    assert [(r["n_links"], r["kept"]) for r in one] == [(0, True)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_embedding_query_finds_links(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    n, _ = brute_vectors(rows)
    found = {r["vec_id"]: r["n_links"] for r in nn_descent.query(spark, f"/root/testdata/{sf}").collect()}
    assert all(found[r[0]] <= m for r, m in zip(rows, n, strict=True))
    assert sum(found.values()) >= 0.9 * sum(n)


def test_repeated_ids_and_extra_columns(spark):
    rows = [(1, [1.0, 0.0], 0, "a"), (1, [0.0, 1.0], 0, "b"), (2, [1.0, 0.01], 0, "c"), (2, [1.0, 0.01], 0, "c"), (3, [0.01, 1.0], 0, "d"), (4, [-1.0, 0.0], 0, "e")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, n_links string")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.cluster(df).collect())
    assert found == [(1, 3, 1, True), (1, 3, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_tight_groups_next_to_each_other(spark):
    """Lists that a group fills with its own vectors do not part it from the next."""
    rng = np.random.default_rng(9)
    one, across = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    two = 0.95 * one + (1 - 0.95**2) ** 0.5 * across
    far = np.linalg.qr(np.stack([one, across, rng.normal(size=64)]).T)[0][:, 2]
    x = np.concatenate([c + rng.normal(size=(300, 64)) * (0.003 / 64) ** 0.5 for c in (one, two, far)])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x.astype("float32"))]
    n, c = brute_vectors(rows)
    assert len(set(c)) == 2 and min(n[:600]) > 500
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = sorted(nn_descent.cluster(df).collect(), key=lambda r: r["vec_id"])
    assert [r["n_links"] for r in found] == n
    assert [r["component_id"] for r in found] == list(c)


def test_search_that_finds_nothing_is_not_returned(spark, monkeypatch):
    """All pairs are compared where no search meets the audit, isolated pairs
    beside a large group included."""
    rng = np.random.default_rng(4)
    x = [v for c in rng.normal(size=(20, 32)) for v in (c, c + 0.02 * rng.normal(size=32))]
    x += list(rng.normal(size=32) + 0.02 * rng.normal(size=(100, 32)))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    n, c = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    descend = nn_descent.descend
    monkeypatch.setattr(nn_descent, "SEARCHES", 1)
    monkeypatch.setattr(nn_descent, "descend", lambda *a: descend(*a).filter("a >= 40 and b >= 40"))
    out, share = nn_descent.audited(df)
    found = sorted(out.collect(), key=lambda r: r["vec_id"])
    assert share == 1.0 and [r["n_links"] for r in found] == n and [r["component_id"] for r in found] == list(c)
