"""Quality scores from compression with two dictionaries.

One zstandard dictionary is built from labelled good text and one from bad text: raw
content, cut evenly from all sampled documents, so that each holds every language and
kind of its label in proportion.  Every block of a text is compressed with both; the difference of the sizes, as a part of their
sum, says which dictionary knows the text better, and a logistic curve fitted on labelled
documents that neither dictionary has seen turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm.common import Scratch, clear_names, held_out, whole_text

#: Labelled documents at most of each label: half for the dictionaries, half for the curve.
SAMPLE_DOCS = 2000
#: Bytes at most that are learned from for each label.
SAMPLE_BYTES = 16_000_000
DICTIONARY_BYTES = 2 << 20
#: Cuts of a document in a dictionary.
CUT_BYTES = 200
#: A text is compressed in blocks of this many bytes, so that the dictionaries matter as much at its end.
BLOCK_BYTES = 1024
#: At lower levels the compressor's tables forget most of a large dictionary.
LEVEL = 9
THRESHOLD = 0.7


def blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def compressors(self):
        if not hasattr(self, "_both"):
            import zstandard

            out = []
            for raw in (self.good, self.bad):
                dictionary = zstandard.ZstdCompressionDict(
                    raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ) if raw else None
                if dictionary:
                    dictionary.precompute_compress(level=LEVEL)
                out.append(
                    zstandard.ZstdCompressor(
                        level=LEVEL,
                        dict_data=dictionary,
                        write_content_size=False,
                        write_checksum=False,
                        write_dict_id=False,
                    )
                )
            self._both = out
        return self._both

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_both"}

    def difference(self, text: str) -> float:
        """From -1 to 1; above 0 if the good dictionary makes the text smaller; 0 for an empty text."""
        good, bad = self.compressors()
        g = b = 0
        for part in blocks(text):
            g += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - g) / (b + g) if g else 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.difference(t) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -500, 500)))


def dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """About ``size`` bytes: as much of each text, in cuts spread evenly over the whole of a longer one."""
    share = max(CUT_BYTES, size // max(1, len(texts)))
    out = []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        cuts = max(1, share // CUT_BYTES)
        step = len(data) // cuts
        out += [data] if len(data) <= share else [data[k * step : k * step + CUT_BYTES] for k in range(cuts)]
    return b"".join(out)[:size]


def calibrate(x: np.ndarray, y: np.ndarray, good_share: float | None = None) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through labelled differences, slightly drawn to 0.

    Each label weighs as much as its share among all labelled documents, as the sample
    holds another share of it.
    """
    if not len(x):
        return 0.0, 0.0
    own = float(y.mean())
    share = own if good_share is None else good_share
    weight = np.where(y == 1, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9))
    scale = float(np.std(x)) or 1.0
    design, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 1e-2 * w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    text_column: str = "text",
    id_column: str = "doc_id",
    label_column: str = "quality",
) -> Model:
    """Learns from labelled documents that are not held out, at most ``SAMPLE_DOCS`` of each label.

    A document with both labels is left out, as are null ids and labels other than 0 and
    1.  Which documents are taken, hashes of their ids say: of each label the first in their
    order, as long as texts come to ``SAMPLE_BYTES`` at most; one that would go beyond is
    passed over.  Of rows that repeat an id the one with the least hash of its text counts.
    So the model is the same in whatever order rows arrive.  With none of a label its
    dictionary is empty.
    """
    marked = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    marked = marked.groupBy(F.col(id_column).cast("long").alias("id")).agg(
        F.min(label_column).alias("y"), F.max(label_column).alias("top")
    ).filter("y = top")
    marked = marked.select("id", "y", F.xxhash64("id").alias("h"))
    counts = {row["y"]: row["count"] for row in marked.groupBy("y").count().collect()}
    picked = [
        row for y in (0, 1) for row in marked.filter(F.col("y") == y).orderBy("h", "id").limit(SAMPLE_DOCS).collect()
    ]
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([tuple(r) for r in picked], "id long, y int, h long"))  # 2 * SAMPLE_DOCS rows at most
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), whole_text(text_column).alias("text")
    ).filter("text <> ''").join(chosen, "id")
    scratch = Scratch(spark, "quality")
    rows = scratch.keep(
        rows.groupBy("y", "h", "id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "sample"
    )
    # Sizes come first, so that no more text than is learned from ever comes to the driver.
    used, wanted = {0: 0, 1: 0}, []
    for y, h, k, size in sorted(rows.select("y", "h", "id", F.octet_length("text")).collect()):
        if used[y] + size <= SAMPLE_BYTES:
            used[y] += size
            wanted.append((y, h, k))
    wanted = F.broadcast(spark.createDataFrame(wanted, "y int, h long, id long"))
    held: dict[int, list[tuple[int, int, str]]] = {0: [], 1: []}
    for row in rows.join(wanted, ["y", "h", "id"]).collect():
        held[row["y"]].append((row["h"], row["id"], row["text"]))
    scratch.drop_all_but()
    halves = {y: (sorted(rows)[::2], sorted(rows)[1::2]) for y, rows in held.items()}
    model = Model(dictionary([t for *_, t in halves[1][0]]), dictionary([t for *_, t in halves[0][0]]), 0.0, 0.0)
    texts = [(t, y) for y in (0, 1) for *_, t in halves[y][1]]
    x = np.array([model.difference(t) for t, _ in texts], float)
    model.slope, model.intercept = calibrate(
        x, np.array([y for _, y in texts], float), counts.get(1, 0) / max(1, sum(counts.values()))
    )
    return model


def score(docs: DataFrame, model: Model, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of every row, score (0 to 1) and predicted (1 from ``THRESHOLD``).

    A null or empty text has no difference and gets the curve's value there.  If a kept
    column is called score or predicted already, the result's has underscores in front.
    """
    names = clear_names(columns, "score", "predicted", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(s, pa.float64()),
                    pa.array((s >= THRESHOLD).astype(np.int32), pa.int32()),
                ],
                names=[*batch.schema.names[:-1], *names[:2]],
            )

    results = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    schema = T.StructType([*docs.select(*columns).schema.fields, *results])
    return docs.select(*columns, whole_text(text_column).alias(names[2])).mapInArrow(run, schema)
