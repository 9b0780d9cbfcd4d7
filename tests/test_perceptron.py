"""The perceptron: gradients, early stop, shards and how well it does."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector

from sievelight.operators import heads, perceptron
from sievelight.operators import metrics as mx


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(1)
    w = perceptron.Weights.start(4, 6, 3, 2)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 3, 9)

    def loss(layers):
        p = perceptron.Weights(layers, [], []).outputs(x)[1]
        penalty = perceptron.PENALTY * ((layers[0] ** 2).sum() + (layers[2] ** 2).sum()) / 2 / len(y)
        return -np.log(p[np.arange(9), y]).mean() + penalty

    before = [layer.copy() for layer in w.layers]
    w.step(x, y)
    for k, layer in enumerate(before):
        for at in list(np.ndindex(layer.shape))[:6]:
            up, down = ([b.copy() for b in before] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            # After the first step, the first moment is a tenth of the gradient.
            assert w.first[k][at] * 10 == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-5)


def ringed(spark, n, seed, noise=0.0):
    """Three rings, which no straight line parts, some labels being noise."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    angle, r = rng.uniform(0, 2 * np.pi, n), 1 + y + rng.normal(0, 0.15, n)
    x = np.stack([r * np.cos(angle), r * np.sin(angle), *rng.normal(0, 0.3, (4, n))], axis=1)
    y = np.where(rng.random(n) < noise, rng.integers(0, 3, n), y)
    return spark.createDataFrame([(int(g), v.tolist()) for g, v in zip(y, x, strict=True)], "grade int, v array<double>").repartition(4)


def f1(df):
    return mx.confusion(df, "grade", "pred").select(mx.macro_f1_of().alias("f")).first().f


def test_it_stops_early_on_noise_and_is_no_worse(spark):
    train, test = ringed(spark, 1500, 1, 0.3).cache(), ringed(spark, 600, 2).cache()
    weights, passes, score = perceptron.fit(train, 256, 400)
    assert passes < 400 and -1 < score < 0
    own = f1(perceptron.predicted(weights, test))
    v = lambda df: df.withColumn("features", array_to_vector("v"))
    model = MultilayerPerceptronClassifier(layers=[6, 256, 3], labelCol="grade", maxIter=100, seed=0).fit(v(train))
    other = model.transform(v(test)).selectExpr("grade", "int(prediction) as pred")
    assert own >= f1(other) - 0.01 and own > 0.8
    straight = f1(heads.linear_head(train, test))
    assert own > straight + 0.2


def test_shards_learn_the_same_and_repeatably(spark):
    train, test = ringed(spark, 3000, 3).cache(), ringed(spark, 500, 4).cache()
    a, passes, score = perceptron.fit(train, 128, 90, shard_rows=1000)
    b, _, _ = perceptron.fit(train.repartition(7), 128, 90, shard_rows=1000)
    assert passes <= 90 and score > -0.6 and all((x == y).all() for x, y in zip(a.layers, b.layers, strict=True))
    assert f1(perceptron.predicted(a, test)) > 0.8


def test_means_are_by_rows():
    one, two = (perceptron.Weights.start(2, 3, 3, k) for k in (1, 2))
    both = perceptron._mean([(30, one), (10, two)])
    assert np.allclose(both.layers[0], 0.75 * one.layers[0] + 0.25 * two.layers[0])


def test_odd_rows(spark):
    rows = [(0, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [1.0, 1.0]), (2, None)] * 40
    train = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, grade int, v array<double>")
    found = heads.mlp_head(train, spark.createDataFrame([(7, None), (8, [0.0, 1.0])], "id int, v array<double>"), hidden=8, iterations=200)
    assert {r.id: r.pred for r in found.collect()} == {7: None, 8: 0}
    with pytest.raises(ValueError):
        perceptron.fit(train.limit(0))
