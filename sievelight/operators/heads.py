"""Classifier heads over embeddings, by Spark ML; the perceptron is this library's own."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators import perceptron
from sievelight.operators.metrics import confusion, macro_f1_of
from sievelight.operators.probes import class_weights, concatenated, evaluate
from sievelight.sources.storage import settled


def _features(rows: DataFrame, v: str = "v") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(v)))


def _logistic(train: DataFrame, label: str, balanced: bool, family: str, iterations: int = 100):
    """Unit inverse regularisation: the penalty is 1 / n, as Spark's loss is a mean."""
    data = train.withColumn("w", class_weights(train, label) if balanced else F.lit(1.0))
    return LogisticRegression(
        family=family,
        labelCol=label,
        weightCol="w",
        regParam=1.0 / max(1, train.count()),
        standardization=False,
        maxIter=iterations,
    ).fit(data)


def linear_head(train: DataFrame, rows: DataFrame, balanced: bool = True) -> DataFrame:
    """Rows with pred of a multinomial logistic regression."""
    model = _logistic(_features(train), "grade", balanced, "multinomial")
    return model.transform(_features(rows)).withColumn("pred", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def mlp_head(train: DataFrame, rows: DataFrame, hidden: int = 256, iterations: int = 400, seed: int = 0) -> DataFrame:
    """Rows with pred of a perceptron with one hidden layer, which stops early; ``iterations`` are passes at most."""
    weights, _, _ = perceptron.fit(train, hidden, iterations, seed)
    return perceptron.predicted(weights, rows)


def ordinal_head(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with pred of two balanced logistic regressions, for at least 1 and at least 2; the second can't exceed the first."""
    out = _features(rows)
    for g in (1, 2):
        model = _logistic(_features(train).withColumn("y", (F.col("grade") >= g).cast("int")), "y", True, "binomial")
        out = model.transform(out).withColumn(
            f"p{g}", F.get(vector_to_array("probability"), F.lit(1))
        ).drop("rawPrediction", "probability", "prediction")
    low, high = F.col("p1"), F.least("p1", "p2")
    return out.withColumn("pred", F.when(high >= 0.5, 2).when(low >= 0.5, 1).otherwise(0)).drop("features", "p1", "p2")


def whitened_head(train: DataFrame, rows: DataFrame, k: int = 256) -> DataFrame:
    """Rows with pred of a logistic regression on principal components of unit variance."""
    size = len(train.select("v").first()["v"])
    model = PCA(k=min(k, size), inputCol="features", outputCol="parts").fit(_features(train))
    sd = model.transform(_features(train)).select(  # a row a component
        F.posexplode(vector_to_array("parts")).alias("k", "x")
    ).groupBy("k").agg(F.stddev_pop("x").alias("sd")).orderBy("k").collect()
    scale = F.array(*(F.lit(1.0 / max(r["sd"] or 0.0, 1e-9)) for r in sd))
    white = lambda df: model.transform(_features(df)).withColumn(
        "white", F.zip_with(vector_to_array("parts"), scale, lambda a, b: a * b)
    ).drop("features", "parts")
    fitted = _logistic(_features(white(train), "white"), "grade", True, "multinomial")
    return fitted.transform(_features(white(rows), "white")).withColumn("pred", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction", "white"
    )


def concat_head(cells: list[DataFrame], labels: DataFrame, key: str = "text_id") -> DataFrame:
    """Rows of the test split with pred of a balanced linear head on the vectors of several embedders, one after another.

    ``cells`` have key and v; ``labels`` has key, grade and split, and only texts that every
    embedder has take part.  Train and dev are fitted on.
    """
    rows = settled(concatenated(cells, key).join(labels.select(key, "grade", "split"), key))
    return linear_head(rows.filter("split <> 'test'"), rows.filter("split = 'test'"))


def compared(rows: DataFrame, axes: tuple[str, ...], hidden: int = 256, iterations: int = 400) -> DataFrame:
    """Macro-F1 on test of the direction, a linear head and a perceptron, and the gaps between them, for each axis.

    All three are fitted on train; a head is fitted for one axis at a time, and axes are few.
    """
    found = []
    for axis in axes:
        own = settled(rows.filter(F.col("axis") == axis).select("grade", "split", "v"))
        train, test = own.filter("split = 'train'"), own.filter("split = 'test'")
        linear = confusion(linear_head(train, test, balanced=False), "grade", "pred")
        deep = confusion(mlp_head(train, test, hidden, iterations), "grade", "pred")
        one = linear.select(F.lit(axis).alias("axis"), macro_f1_of().alias("f1_linear"))
        found.append(one.crossJoin(deep.select(macro_f1_of().alias("f1_mlp"))))  # one row each
    heads = reduce(lambda a, b: a.unionByName(b), found)
    out = evaluate(rows).select("axis", F.col("macro_f1").alias("f1_dom")).join(heads, "axis")
    return out.withColumns(
        {
            "mlp_minus_dom": F.col("f1_mlp") - F.col("f1_dom"),
            "mlp_minus_linear": F.col("f1_mlp") - F.col("f1_linear"),
            "linear_minus_dom": F.col("f1_linear") - F.col("f1_dom"),
        }
    )


def score_head(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with pred of a logistic regression on the projection alone."""
    one = lambda df: df.withColumn("v", F.array("score"))
    return linear_head(one(train), one(rows), balanced=False)
