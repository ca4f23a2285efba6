"""The audit against a plain count of everything, at small and odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quillspar.llm import divergence

DDL = "doc_id long, text string, lang string, source string, term string, count long, value int"


def plain(rows, least, k):
    docs = [(t or "", la or "", s or "") for _, t, la, s, *_ in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    said = [(la, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for t, la, s in docs]
    held, by_lang, by_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for la, s, words in said:
        held[la].update(set(words))
        by_lang[la].update(words)
        by_group[la, s].update(words)
    out = []
    kept = {la: {w for w, n in c.items() if n >= least} for la, c in held.items()}

    def shares(c, la):
        v, n = len(kept[la]), sum(c[w] for w in kept[la])
        return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * v) for w in kept[la]}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    for (la, s), c in by_group.items():
        mine, whole = shares(c, la), shares(by_lang[la], la)
        pairs = [(sum(f(p, q) for p, q in zip(mine.values(), shares(d, la).values(), strict=True)), o) for (lb, o), d in by_group.items() if lb == la and o != s]
        terms = [(f(mine[w], whole[w]), w) for w in kept[la] if c[w] and mine[w] > whole[w]]
        for part, found, most in (("pair", pairs, None), ("term", terms, k)):
            for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((la, s, part, item, v, rank))
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_counts(table, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "aBcdéÉß" for b in ("x", "Y", "zz", "ñ", "_q", "9w")]
    rows = []
    for i in range(120):
        la, s = rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s1", "s2", "é", None])
        text = None if rng.random() < 0.05 else " ".join(rng.choices(words, [1 + (hash((s, j)) % 7 if seed else j % 3) for j in range(len(words))], k=rng.randrange(0, 60)))
        rows += [(i, text, la, s, "own", 1, 2)] * rng.choice([1, 1, 3])
    rows.append((None, "solo", "fr", "only", None, None, None))
    rows.append((None, "1 2", "fr", "none", None, None, None))
    for least, k in ((10, 10), (2, 3)):
        assert got(divergence.audit(table(rows, DDL, f"t{least}"), k, least)) == plain(rows, least, k)


def test_many_equal_terms_are_all_opened(table, monkeypatch):
    """Bounds equal to the k-th value don't end the search: ties are won by name."""
    monkeypatch.setattr(divergence, "FIRST", 1)
    monkeypatch.setattr(divergence, "GROWTH", 2)
    names = [f"{a}{b}" for a in "zyxwvutsrqponm" for b in "abcdef"]
    rows = [(i, " ".join(names + ["common"] * 9), "en", "a", "", 0, 0) for i in range(3)] + [(i, "common rare " * 30, "en", "b", "", 0, 0) for i in range(3)]
    assert got(divergence.audit(table(rows, DDL), 10, 2)) == plain(rows, 2, 10)


def test_odd_tables(table):
    assert got(divergence.audit(table([], DDL))) == []
    alone = [(1, "one two", "en", "a", "", 0, 0), (2, None, "en", "b", "", 0, 0)]
    assert got(divergence.audit(table(alone, DDL, "u"))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    long = [(i, "Wort " * 400_000 + "Ende", "de", "a", "", 0, 0) for i in range(2)] + [(3, "wort ende", "de", "b", "", 0, 0)]
    assert got(divergence.audit(table(long, DDL, "v"), 10, 2)) == plain(long, 2, 10)
