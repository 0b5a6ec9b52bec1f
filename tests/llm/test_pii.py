import hashlib
import random
import re

from parlquery.llm import pii_skipchain as pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and checksum(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def rows_agree(df, texts):
    found = df.collect()
    assert len(found) == len(texts)
    for r in found:
        want = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(said(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(said([s]) for s in want) <= set(spans)
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)


def test_whole_table(spark, documents):
    rows_agree(pii.query(spark, "/root/testdata/sf0.001"), {r["doc_id"]: r["text"] for r in documents.collect()})


def test_base_spans_on_noise():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("ab@.-+ 0129%(\n١é") for _ in range(rng.randrange(60)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute(text)


def test_time_grows_with_the_length():
    from .conftest import doubling

    field = pii.fit([])
    field.skip = 6.0
    for unit in ("@", "1.", "+1", "1 ", "a@b ", "5551234567 ", "+1-555-123-4567 and 555-123-4567 or "):
        assert doubling(lambda n, u=unit: pii.scan(u * n, field), 40_000 // len(unit)), unit
    for text in ("a" * 200_000 + "@", "9" * 200_000 + " x"):
        assert pii.scan(text, field)["spans"] == ""


def test_odd_rows(odd, empty):
    model = pii.train(odd)
    assert pii.find(odd, model).count() == odd.count()
    assert pii.find(empty, pii.train(empty)).count() == 0
    again = pii.find(odd.withColumnRenamed("lang", "spans").withColumnRenamed("n_chars", "FOUND"), model)
    assert sorted(again.columns) == sorted({*[c for c in odd.columns if c not in ("lang", "n_chars")], "FOUND", *pii._FIELDS})
    assert sorted(r["FOUND"] or 0 for r in again.collect()) == sorted(r["n_chars"] or 0 for r in odd.collect())


NUMBER = lambda rng: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
FILLER = "plain words follow here " * 5


def fitted(spark):
    """A field fitted on texts in which a bare number repeats a full one."""
    from .conftest import frame

    rng, texts = random.Random(3), []
    for _ in range(60):
        n = NUMBER(rng)
        texts.append(f"call +1-{n} today . {FILLER} again +1-{n} or {n} and later . {FILLER} room {rng.randrange(999)} at {rng.randrange(24)}:00")
    return pii.train(frame(spark, texts))


def test_mentions_get_the_label_of_their_like(spark):
    """A number that a pattern finds once is found wherever it is repeated in a
    form that no pattern has, however often, and is not where nothing is like it."""
    model, rng = fitted(spark), random.Random(4)
    for times in range(1, 31):
        n = NUMBER(rng)
        text = f"call +1-{n} today . {FILLER}" + f"or else {n} and {FILLER}" * times
        want = [(3, m.start(), m.end()) for m in re.finditer(n, text)][1:]
        assert model.extra(text, pii.base_spans(text)) == want, times
    alone = f"order {NUMBER(rng)} of room 17 at 10:00"
    assert model.extra(alone, pii.base_spans(alone)) == []


def test_parts_of_a_number_are_one_span(spark):
    model = fitted(spark)
    text = f"call +1-826-555-4081 now . {FILLER} so +1 (826) 555-4081 190.137.223.204 it is"
    number = text.rindex("+1 (826)")
    assert (3, number, number + 17) in model.extra(text, pii.base_spans(text))
    for _, a, b in model.extra(text, pii.base_spans(text)):
        assert len(re.sub("[^0-9]", "", text[a:b])) >= 7


def test_features_see_whole_tokens():
    assert pii.features("1" * 300 + "a", "x") != pii.features("1" * 300 + "-b", "x")
    assert pii.word_before("  one two(3", 10) == "two(" and pii.word_before("x", 0) == ""
    assert pii.word_before("w" * 500 + " 3", 501) == "w" * 500


def test_sample_does_not_depend_on_the_order_of_rows(spark, documents):
    a, b = pii.train(documents), pii.train(documents.orderBy("text", "doc_id").repartition(7))
    assert (a.weight == b.weight).all() and (a.chain == b.chain).all() and a.skip == b.skip


def test_marginals_of_small_loopy_fields():
    """Fields of up to eight nodes with chains, skips and hubs, against enumeration.
    Loopy propagation is no exact method: the labels it is sure of are right."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(12):
        n = int(rng.integers(3, 8))
        unary = rng.normal(size=(n, 3))
        edges = [(i - 1, i) for i in range(1, n)] + [(int(rng.integers(0, n - 2)), n - 1)]
        pair = np.stack([np.clip(rng.normal(size=(3, 3)), -1, 1) if k < n - 1 else 1.5 * np.eye(3) for k in range(n)])
        exact = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n):
            w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pair[e, y[a], y[b]] for e, (a, b) in enumerate(edges)))
            for i in range(n):
                exact[i, y[i]] += w
        exact /= exact.sum(1, keepdims=True)
        got = pii.propagate(unary, np.array(edges), pair)
        assert np.abs(got - exact).max() < 0.15
        sure = got.max(1) >= pii.POSTERIOR
        assert (got.argmax(1) == exact.argmax(1))[sure].all()


def test_skips_connect_all_mentions():
    import numpy as np

    known = ["k", None, "k", "j", "k", "j", "k"]
    edges, hubs = pii.skips(known, np.array([True, False, False, False, False, False, False]))
    assert sorted(edges) == [(2, 0), (3, 7), (4, 0), (5, 7), (6, 0)] and hubs == 1


def test_message_passing_matches_enumeration():
    """On a chain, loopy propagation is exact."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    unary, edges = rng.normal(size=(4, 5)), np.array([[0, 1], [1, 2], [2, 3]])
    pair = rng.normal(size=(3, 5, 5))
    p = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(pair[e, y[a], y[b]] for e, (a, b) in enumerate(edges)))
        for i in range(4):
            p[i, y[i]] += w
    p /= p.sum(1, keepdims=True)
    assert np.allclose(pii.propagate(unary, edges, pair, rounds=60), p, atol=1e-6)


def test_evidence_reaches_the_last_of_many_mentions():
    """One observed mention and twenty like it, with the production setting."""
    import numpy as np

    unary = np.zeros((21, 5))
    unary[0, :4] = -30
    edges = np.array([[i, i + 1] for i in range(20)])
    p = pii.propagate(unary, edges, np.array([np.eye(5) * 6] * 20))
    # the chance that a walk over twenty links ends where it began
    stay = (np.exp(6) - 1) / (np.exp(6) + 4)
    assert np.allclose(p[:, 4], [0.2 + 0.8 * stay**i for i in range(21)], atol=1e-4)
    assert p[20, 4] >= pii.POSTERIOR
