"""The index of deletions and pieces finds what a distance to every key finds."""

import random

from quillspar.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_closest_known_equals_all_distances(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcDé") for _ in range(n))

    def bent(w):
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abx") + w[at:], w[:at] + "y" + w[at + 1 :]])
        return w

    lengths = [*range(7), 9, 12, *range(15, 28), 40, 60]
    known = [word(n) for n in lengths for _ in range(3)]
    words = [bent(rng.choice(known)) for _ in range(120)] + ["", "a", known[-1].upper()]
    out = spelling.closest_known(
        spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(-1, None)], "id int, word string"),
        spark.createDataFrame([*enumerate(known), (999, None)], "ord int, key string"),
    )
    got = {r.id: (r.suggestion, r.distance) for r in out.collect()}
    assert got.pop(-1) == (None, None) and len(got) == len(words)
    for i, w in enumerate(words):
        d, at = min((distance(w.lower(), k.lower()), at) for at, k in enumerate(known))
        assert got[i] == ((known[at], d) if d <= 3 else (None, None)), (w, got[i], known[at], d)


def test_closest_known_of_empty_tables(spark):
    words, none = spark.createDataFrame([("a",), ("a",)], "word string"), spark.createDataFrame([], "ord int, key string")
    assert [tuple(r) for r in spelling.closest_known(words, none).collect()] == [("a", None, None)] * 2
