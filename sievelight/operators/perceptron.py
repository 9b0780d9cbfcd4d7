"""A perceptron with one hidden layer, fitted by mini-batches on many tasks, which stops when a held-out part no longer gains.

Each pass over the rows starts all shards from the same weights; a shard takes steps on its own
mini-batches, and what the shards end with is averaged by their rows.  Held-out rows are scored on the way.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.neighbours import matrix
from sievelight.sources.storage import Scratch

#: Rows of a step at most (else a tenth of all), its rate and penalty, the held-out part, and how long and by how much it has to gain.
BATCH, RATE, PENALTY, HELD_OUT, PATIENCE, LEAST_GAIN = 200, 1e-3, 1e-4, 0.1, 10, 1e-4
#: Rows of a shard, about, and shards at most; rows are taken as they come, so a shard needn't fit in memory.
SHARD_ROWS, MOST_SHARDS = 20_000, 64


@dataclass
class Weights:
    """Both layers with the moments of their gradients and the number of steps."""

    layers: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    steps: int = 0

    @staticmethod
    def start(size: int, hidden: int, classes: int, seed: int) -> Weights:
        rng = np.random.default_rng(seed)
        bounds = (np.sqrt(6 / (size + hidden)), np.sqrt(6 / (hidden + classes)))
        shapes = ((size, hidden), (hidden,), (hidden, classes), (classes,))
        layers = [rng.uniform(-bounds[k // 2], bounds[k // 2], s) for k, s in enumerate(shapes)]
        return Weights(layers, [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes])

    def outputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden units and each class's probability."""
        w1, b1, w2, b2 = self.layers
        hidden = np.maximum(x @ w1 + b1, 0)
        z = hidden @ w2 + b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return hidden, e / e.sum(axis=1, keepdims=True)

    def predicted(self, x: np.ndarray) -> np.ndarray:
        return self.outputs(x)[1].argmax(axis=1)

    def gain(self, x: np.ndarray, y: np.ndarray) -> float:
        """The sum of the logarithms of the right classes' probabilities: a count of hits is too coarse on few rows."""
        return float(np.log(np.maximum(self.outputs(x)[1][np.arange(len(y)), y], 1e-12)).sum()) if len(y) else 0.0

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        """One step of adaptive moments on the mean loss of a mini-batch."""
        hidden, p = self.outputs(x)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        w1, _, w2, _ = self.layers
        back = (p @ w2.T) * (hidden > 0)
        gradients = [x.T @ back + PENALTY * w1 / len(y), back.sum(axis=0), hidden.T @ p + PENALTY * w2 / len(y), p.sum(axis=0)]
        self.steps += 1
        rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for w, m, v, g in zip(self.layers, self.first, self.second, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * m / (np.sqrt(v) + 1e-8)

    def passed(self, x: np.ndarray, y: np.ndarray, batch: int, rng: np.random.Generator) -> None:
        """Steps on all rows in a random order."""
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            part = order[lo : lo + batch]
            self.step(x[part], y[part])


def _mean(parts: list[tuple[int, Weights]]) -> Weights:
    """The mean by rows."""
    total = sum(n for n, _ in parts)
    mean = lambda field: [sum(n / total * layer for (n, _), layer in zip(parts, layers, strict=True)) for layers in zip(*(getattr(w, field) for _, w in parts), strict=True)]
    return Weights(mean("layers"), mean("first"), mean("second"), max(w.steps for _, w in parts))


class Patience:
    """Keeps the weights that scored best and says when there was no gain for long enough."""

    def __init__(self, patience: int = PATIENCE):
        self.patience, self.best, self.kept, self.idle, self.passes = patience, -np.inf, None, 0, 0

    def ends(self, score: float, weights: Weights) -> bool:
        self.passes += 1
        self.idle = 0 if score >= self.best + LEAST_GAIN else self.idle + 1
        if score > self.best:
            self.best, self.kept = score, weights
        return self.idle > self.patience


def _alone(start: Weights, passes: int, patience: int, batch: int, seed: int):
    """Fits on rows that one task holds, a shard at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["place", "y"])
        held = rows["held"].to_numpy()
        x, y = matrix(rows["v"]), rows["y"].to_numpy()
        now, watch = start, Patience(patience)
        for k in range(passes):
            now.passed(x[~held], y[~held], batch, np.random.default_rng([seed, k]))
            score = now.gain(x[held], y[held]) / max(1, held.sum())
            if watch.ends(score, pickle.loads(pickle.dumps(now))):
                break
        yield pd.DataFrame({"passes": [watch.passes], "score": [watch.best], "weights": [pickle.dumps(watch.kept or now)]})

    return run


def _pass(sent, batch: int, seed: list[int]):
    """What each shard makes of the weights that are sent, and how the held-out rows score with these."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = pickle.loads(sent.value)
        now, shard, n, gain, all_ = None, None, 0, 0.0, 0

        def done() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "n": [n], "gain": [gain], "held": [all_], "weights": [pickle.dumps(now)]})

        for frame in frames:
            for own, rows in frame.groupby("shard", sort=True):
                if own != shard:
                    if shard is not None:
                        yield done()
                    now, shard, n, gain, all_, turn = pickle.loads(sent.value), own, 0, 0.0, 0, 0
                held = rows["held"].to_numpy()
                x, y = matrix(rows["v"]), rows["y"].to_numpy()
                gain += start.gain(x[held], y[held])
                all_ += int(held.sum())
                now.passed(x[~held], y[~held], batch, np.random.default_rng([*seed, int(own), turn]))
                n += int((~held).sum())
                turn += 1
        if shard is not None:
            yield done()

    return run


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("shard")
    parts = [(n, pickle.loads(bytes(w))) for n, w in zip(group["n"], group["weights"], strict=True) if n]
    return pd.DataFrame({
        "n": [int(group["n"].sum())], "gain": [float(group["gain"].sum())], "held": [int(group["held"].sum())], "weights": [pickle.dumps(_mean(parts)) if parts else None]
    })


def fit(
    train: DataFrame, hidden: int = 256, passes: int = 400, seed: int = 0, patience: int = PATIENCE, vector: str = "v", label: str = "grade", classes: int = 3, shard_rows: int = SHARD_ROWS
) -> tuple[Weights, int, float]:
    """The weights that did best on a held-out tenth, how many passes were made and the mean logarithm there.

    Which rows are held out, shards and their order follow from hashes of all columns, so the same
    rows and seed give the same weights, and rows that are equal in all columns stay together.
    Rows without a vector or a label are left out.
    """
    spark = train.sparkSession
    scratch = Scratch(spark, "perceptron")
    place = F.xxhash64(*sorted(train.columns), F.lit(seed)).alias("place")
    rows = train.select(F.col(vector).alias("v"), F.col(label).cast("int").alias("y"), place).filter("v is not null and y is not null")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("place"), F.lit(1000)) < int(1000 * HELD_OUT))
    n = rows.count()
    if not n:
        raise ValueError("there is nothing to learn from")
    size = len(rows.select("v").first()["v"])
    shards = min(MOST_SHARDS, max(1, -(-n // shard_rows)))
    start, batch = Weights.start(size, hidden, classes, seed), max(1, min(BATCH, n // 10))
    if shards == 1:
        found = rows.coalesce(1).mapInPandas(_alone(start, passes, patience, batch, seed), "passes int, score double, weights binary").first()
        return pickle.loads(bytes(found["weights"])), found["passes"], found["score"]
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("place", F.lit("shard")), F.lit(shards)).cast("int"))
    rows = scratch.keep(rows.repartition(shards, "shard").sortWithinPartitions("shard", "place", "y"), "rows")
    now, watch = start, Patience(patience)
    for k in range(passes + 1):  # one more, to score the last
        sent = spark.sparkContext.broadcast(pickle.dumps(now))
        made = rows.mapInPandas(_pass(sent, batch, [seed, k]), "shard int, n long, gain double, held long, weights binary")
        few = made.groupBy(F.pmod("shard", F.lit(8)).alias("few")).applyInPandas(_joined, "n long, gain double, held long, weights binary")
        parts = sorted(few.collect(), key=lambda r: (r["n"], bytes(r["weights"] or b"")))  # eight at most
        sent.destroy()
        held = sum(r["held"] for r in parts)
        if k and watch.ends(sum(r["gain"] for r in parts) / held if held else 0.0, now):
            break
        if k < passes:
            now = _mean([(r["n"], pickle.loads(bytes(r["weights"]))) for r in parts if r["weights"] is not None])
    scratch.drop_all_but()
    return watch.kept or now, watch.passes, watch.best


def predicted(weights: Weights, rows: DataFrame, vector: str = "v", out: str = "pred") -> DataFrame:
    """Rows with the likeliest class; null where there is no vector."""
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

    @F.pandas_udf("int")
    def best(v: pd.Series) -> pd.Series:
        own = pickle.loads(sent.value)
        there = v.notna()
        found = pd.Series([None] * len(v), dtype="Int32")
        if there.any():
            found[there.to_numpy()] = own.predicted(matrix(v[there])).astype("int32")
        return found

    return rows.withColumn(out, best(F.col(vector)))
