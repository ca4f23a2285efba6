"""Base spans against the plain patterns, the field against enumeration, and what it finds that was never shown to it."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from quillspar.llm import private_data as pd_

DDL = "doc_id long, text string, found string, base boolean, spans string"


def plain_base(text):
    """The contract's patterns as they are written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


@pytest.fixture(scope="module")
def model():
    return pd_.learn(pd_.lessons([], 13))


@pytest.mark.parametrize("alphabet", ["0123456789 -", "0.12+() -", "a@.b-é+1 ", "0123456789.@+-() [x]\n٣"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        assert pd_.base_spans(text) == plain_base(text), text


def test_cards_and_addresses_in_base_form():
    text = "4111 1111 1111 1111, 4111-1111-1111-1112, a.b@c.de@f.gh, 1.2.3.4.5.6.7.8, 0001.2.3.256 +49 (30) 1234567 +1 23 4"
    assert pd_.base_spans(text) == plain_base(text)
    assert [k for k, *_ in pd_.base_spans(text)].count("card") == 1


def lattice(rng):
    segments = []
    for _ in range(rng.randrange(1, 7)):
        a = rng.randrange(8)
        segments.append(pd_.Segment(a, a + rng.randrange(1, 5), rng.choice(pd_.KINDS), ()))
    segments = sorted(set(segments), key=lambda s: (s.start, s.end, s.kind))
    return segments, np.array([rng.gauss(0, 2) for _ in segments]), np.array([[rng.gauss(0, 1) if a else 0.0 for _ in range(5)] for a in range(5)])


def all_ways(segments, scores, turns):
    for n in range(len(segments) + 1):
        for some in itertools.combinations(range(len(segments)), n):
            picked = sorted(some, key=lambda i: segments[i].start)
            if any(segments[a].end > segments[b].start for a, b in itertools.pairwise(picked)):
                continue
            total = sum(scores[i] for i in picked)
            for a, b in itertools.pairwise(picked):
                if segments[a].end == segments[b].start:
                    total += turns[pd_.KINDS.index(segments[a].kind) + 1, pd_.KINDS.index(segments[b].kind) + 1]
            yield total, picked


def test_dynamic_programming_equals_enumeration():
    rng = random.Random(3)
    for _ in range(200):
        segments, scores, turns = lattice(rng)
        ways = list(all_ways(segments, scores, turns))
        made = pd_.Lattice(segments)
        assert made.best(scores, turns) == max(ways)[1]
        total, chance, _ = made.expect(scores, turns)
        weights = np.exp([w for w, _ in ways])
        assert total == pytest.approx(np.log(weights.sum()))
        for i in range(len(segments)):
            assert chance[i] == pytest.approx(sum(w for w, (_, p) in zip(weights, ways, strict=True) if i in p) / weights.sum())


def test_groups_apart_are_decided_apart(model):
    text = "call (171) 555-2028 or 171.555.2029 " * 5 + "x" * 50 + " jane dot doe at mail dot example dot com"
    found = pd_.candidates(text)
    whole = pd_.Lattice(found).best(model.scores(found), model.turns)
    assert [(found[i].kind, found[i].start, found[i].end) for i in whole] == model.find(text, [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("please call (171) 555-2028 today", [("phone", "(171) 555-2028")]),
        ("cards 4111111111111111 5500005555555559 here", [("card", "4111111111111111"), ("card", "5500005555555559")]),
        ("ring +1 (487) 555-7209 4111111111111111 now", [("card", "4111111111111111"), ("phone", "+1 (487) 555-7209")]),
        ("write to jane at example dot com soon", [("email", "jane at example dot com")]),
        ("mail jane[at]mail[dot]example[dot]com please", [("email", "jane[at]mail[dot]example[dot]com")]),
        ("host 192[.]168[.]10[.]77 is down", [("ip", "192[.]168[.]10[.]77")]),
        ("card 4111.1111.1111.1111 ok", [("card", "4111.1111.1111.1111")]),
        ("the server 2001:db8::7 answers", [("ip", "2001:db8::7")]),
        ("on 2024-01-15 and 15.01.2024 we met at noon dot and so on, 1990-2020, ISBN 978-3-16-148410-0", []),
        ("it costs 1 000 000 or 12.345.678, order 1234567812345678, at 10.30", []),
    ],
)
def test_forms_beyond_the_base(model, text, want):
    held = pd_.base_spans(text)
    assert sorted((k, text[a:b]) for k, a, b in held + model.find(text, held)) == sorted(want)


def test_held_out(model):
    rng, words = random.Random(77), "river stone garden winter letter market silver window harbour".split()
    right = wrong = missed = 0
    for _ in range(400):
        text, spans = pd_.write_in(rng, "A long walk beside the " + " ".join(rng.sample(words, 5)), words)
        held = pd_.base_spans(text)
        got = set(held) | set(model.find(text, held))
        right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_base_spans_stay_and_nothing_crosses_them(model):
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["4111 1111 1111 1111", "(171) 555-2028", "a@b.cd", "1.2.3.4", "+1 (171) 555-2028", " ", "-", "9", ", ", " at x dot com"]) for _ in range(6))
        held = pd_.base_spans(text)
        added = model.find(text, held)
        assert all(b <= c or d <= a for _, a, b in held for _, c, d in added)
        assert all(a[2] <= b[1] for a, b in itertools.pairwise(sorted(added, key=lambda s: s[1])))


def test_long_texts_take_time_in_proportion(model):
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 60_000, "a@" * 100_000, "+1" * 100_000, "1." * 60_000, "x at y " * 60_000, "(at)" * 60_000, "a.b dot " * 40_000, ":" * 200_000):
        began = time.perf_counter()
        pd_.spans_of(text, model)
        assert time.perf_counter() - began < 40, text[:8]


def test_rows(table):
    texts = ["mail a@b.cd or (171) 555-2028", None, "", "nothing here", "mail a@b.cd or (171) 555-2028", "é" * 50_000 + " 4111111111111111"]
    rows = [(i if i else None, t, "x", True, "y") for i, t in enumerate(texts)]
    docs = table(rows, DDL)
    model = pd_.train(docs, 50)
    got = {r.doc_id: r for r in pd_.digest(pd_.locate(docs, model)).collect()}
    for doc, t in zip([None, 1, 2, 3, 4, 5], texts, strict=True):
        held = plain_base(t or "")
        assert got[doc].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in held).encode()).hexdigest()
        assert [got[doc][f"n_{k}"] for k in pd_.KINDS] == [sum(h[0] == k for h in held) for k in pd_.KINDS]
        assert (got[doc].base_sha256, got[doc].spans) == pd_.digest_of(t or "", model)
    assert got[4].spans == "email:5:11,phone:15:29" and got[1].spans == "" and got[5].spans == "card:50001:50017"
    assert {r.doc_id: r.text for r in pd_.mask(docs, model).collect()}[4] == "mail <email> or <phone>"
    assert pd_.digest(pd_.locate(table([], DDL, "none"))).collect() == []


def test_training_doesnt_depend_on_partitions(spark, table):
    rows = [(i, f"row {i} mail a{i}@b.cd and more words after it", "x", True, "y") for i in range(60)]
    docs = table(rows, DDL)
    assert pd_.train(docs, 20).weights == pd_.train(docs.repartition(7), 20).weights
