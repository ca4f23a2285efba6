"""What the driver holds of the rows that co-training fits on."""

import numpy as np

from quillspar.llm import cotraining


def test_rows_are_held_packed():
    rng, rows, plain = np.random.RandomState(5), cotraining.Rows(), []
    for n in [0, 1, 700, *rng.randint(0, 50, 600).tolist()]:
        plain.append(np.unique(rng.randint(0, cotraining.DIM, n)))
        rows.add(cotraining.packed(np.zeros(len(plain[-1]), np.int64), plain[-1], 1)[0].as_py())
    which = rng.permutation(len(plain))
    assert all(np.array_equal(got, plain[i]) for got, i in zip(rows.features(which), which, strict=True))
    assert sum(map(len, rows.each)) < 4 * sum(map(len, plain))
    weights = rng.rand(cotraining.DIM + 1)
    assert rows.scores(weights, which).tolist() == [weights[-1] + weights[plain[i]].sum() for i in which]


def test_rows_come_to_the_driver_in_parts(spark):
    df = spark.range(500).selectExpr("md5(string(id)) AS k", "id")
    ordered = [r.id for r in cotraining.in_parts(df, "k", "id")]
    assert ordered == [r.id for r in df.orderBy("k", "id").collect()]
    assert df.repartitionByRange(cotraining.PARTS, "k").rdd.getNumPartitions() > 8
