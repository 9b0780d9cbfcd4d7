"""Language identification by language-bitmask n-gram filters.

For each language the n-grams that are common in it, and not much more common in
another, go into a Bloom filter.  The filters of all languages are bit-sliced: a cell
holds one bit for each language, in as many words as that takes, so the conjunction of
an n-gram's cells gives all languages that contain it.  The bits counted over a text's
n-grams, corrected for each language's rate of false positives, decide.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm.common import Scratch, clear_names, give_back, held_out, small_batches, trimmed, whole_text

UNDETERMINED = "und"
GRAM = 4
PROBES = 3
#: About so many labelled documents, and characters in them, a language is learned from at most.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 4_000_000
#: About so many characters are learned from at most in all; with very many languages each gets its part.
ALL_CHARS = 256_000_000
#: An n-gram belongs to a language if it occurs this often, and at this part of its highest rate in any.
LEAST_COUNT = 3
LEAST_SHARE = 0.5
#: The most frequent n-grams of a language that are kept at most; of all languages together ALL_GRAMS.
MOST_GRAMS = 1 << 18
ALL_GRAMS = 1 << 24
#: Texts that are looked at together.
ROWS = 256
#: Characters that are held in arrays at a time.
SLICE = 1 << 18

_CASE: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    if not _CASE:
        table = np.zeros(0x110000, np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                table[k] = ord(low) if len(low) == 1 else k
        _CASE.append(table)
    return _CASE[0]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of a text, 0 for all else, and which of them are letters."""
    low = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return low, low > 0


def _hashes(symbols: np.ndarray) -> np.ndarray:
    """The hash of each run of GRAM symbols, one for each place where one begins."""
    n = max(0, len(symbols) - GRAM + 1)
    h = symbols[:n].copy()
    for k in range(1, GRAM):
        h = (h << np.uint64(16)) ^ (h >> np.uint64(43)) ^ symbols[k : n + k]
    return _mix(h)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts, the text of each, and the number of letters in each text.

    Runs of other characters count as one space; a text begins and ends with one.
    """
    low, letter = _symbols("".join(f"\x00{t}\x00" for t in texts))
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    letters = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    low, owner = low[keep].astype(np.uint64), owner[keep]
    h = _hashes(low)
    inside = owner[: len(h)] == owner[len(owner) - len(h) :]
    return h[inside], owner[: len(h)][inside], letters


def long_grams(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The n-gram hashes and letters of one text, slice by slice; together they are those of :func:`grams`.

    What a slice leaves behind, its last symbols and whether it ended with a letter, goes into the next.
    """
    tail, after_letter = np.zeros(1, np.uint64), False  # the space that a text begins with
    for start in range(0, len(text) + 1, SLICE):
        part = text[start : start + SLICE]
        low, letter = _symbols(part if start + SLICE <= len(text) else part + "\x00")
        keep = letter.copy()
        keep[:1] |= after_letter
        keep[1:] |= letter[:-1]
        symbols = np.concatenate([tail, low[keep].astype(np.uint64)])
        yield _hashes(symbols), int(letter.sum())
        tail, after_letter = symbols[max(0, len(symbols) - GRAM + 1) :], bool(letter[-1])


def slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of n-grams, the text of each, and the letters that each text has here; about SLICE characters at a time."""
    none = np.zeros(len(texts), np.int64)
    held: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if len(text) > SLICE:
            for hashes, some in long_grams(text):
                letters = none.copy()
                letters[k] = some
                yield hashes, np.full(len(hashes), k), letters
            continue
        held.append(k)
        size += len(text)
        if size >= SLICE:
            yield _together(texts, held, none)
            held, size = [], 0
    if held:
        yield _together(texts, held, none)


def _together(texts: list[str], held: list[int], none: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, part, some = grams([texts[k] for k in held])
    letters = none.copy()
    letters[held] = some
    return hashes, np.asarray(held)[part], letters


@dataclass
class Model:
    """cells has a row for each cell and a column for each 64 languages."""

    languages: list[str]
    cells: np.ndarray
    false_positive: np.ndarray

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the n-grams found in each language, all n-grams, and letters."""
        n = len(texts)
        found = np.zeros((n, len(self.languages)))
        total, letters = np.zeros(n), np.zeros(n, np.int64)
        for hashes, owner, some in slices(texts):
            letters += some
            total += np.bincount(owner, minlength=n)
            mask = lookup(self.cells, hashes)
            for k in range(len(self.languages)):
                bit = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                found[:, k] += np.bincount(owner, weights=bit, minlength=n)
        return found, total, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        found, total, letters = self.counts(texts)
        true = np.maximum(found - total[:, None] * self.false_positive, 0) / (1 - self.false_positive)
        whole = true.sum(axis=1)
        best = true.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        score = np.where(whole > 0, true.max(axis=1, initial=0) / np.maximum(whole, 1e-9), 0.0)
        names = [
            self.languages[b] if n and self.languages else UNDETERMINED for b, n in zip(best, letters, strict=True)
        ]
        return names, np.where(letters > 0, score, 0.0)


def places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    for k in range(PROBES):
        yield ((hashes + np.uint64(k) * step) >> np.uint64(11)) & np.uint64(size - 1)


def lookup(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The languages of each n-gram, as bits: a row of words each."""
    mask = np.full((len(hashes), cells.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in places(hashes, len(cells)):
        mask &= cells[at]
    return mask


def build(known: dict[str, tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Filters from each language's n-grams, their counts and the number of all its n-grams; languages are held by name."""
    languages = sorted(known)
    rates = [known[name][1] / max(1, known[name][2]) for name in languages]
    every = np.unique(np.concatenate([known[name][0] for name in languages])) if known else np.zeros(0, np.uint64)
    at = [np.searchsorted(every, known[name][0]) for name in languages]
    highest = np.zeros(len(every))
    for k, rate in zip(at, rates, strict=True):
        np.maximum.at(highest, k, rate)
    members = [every[k[rate >= LEAST_SHARE * highest[k]]] for k, rate in zip(at, rates, strict=True)]
    size = 1 << max(10, math.ceil(math.log2(8 * max([1, *map(len, members)]))))
    cells = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
    fill = np.zeros(len(languages))
    for k, own in enumerate(members):
        word, bit = k // 64, np.uint64(1 << k % 64)
        for place in places(own, size):
            np.bitwise_or.at(cells[:, word], place, bit)
        fill[k] = ((cells[:, word] & bit) > 0).mean()
    return Model(languages, cells, fill**PROBES)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each n-gram occurs in the texts of each language here, and under a null one how many do."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    waiting: dict[str, int] = defaultdict(int)

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        every, back = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        return every, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for hashes, _, _ in slices([text]):
                held[lang].append(np.unique(hashes, return_counts=True))
                waiting[lang] += len(held[lang][-1][0])
            if waiting[lang] > SLICE:
                held[lang], waiting[lang] = [merge(held[lang])], 0
    for lang, parts in held.items():
        hashes, counts = merge(parts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(hashes) + 1), pa.string()),
                pa.array([*hashes.view(np.int64).tolist(), None], pa.int64()),
                pa.array([*counts.tolist(), int(counts.sum())], pa.int64()),
            ],
            names=["lang", "gram", "n"],
        )


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id") -> Model:
    """Learns every language from a bounded sample of its documents.

    Only documents that are not held out and have a language and a text are read; which
    of them, hashes of their ids and texts say: about as many as ``SAMPLE_DOCS`` and
    ``SAMPLE_CHARS`` let a language have.  Their n-grams are counted by the executors, and
    only those that occur ``LEAST_COUNT`` times come to the driver, ``MOST_GRAMS`` of a
    language and ``ALL_GRAMS`` of all at most.  With no such document every prediction is
    undetermined.
    """
    rows = docs.filter(
        ~held_out(id_column) & F.col(id_column).isNotNull() & F.col(
            lang_column
        ).isNotNull() & F.col(text_column).isNotNull()
    )
    rows = rows.select(
        F.col(lang_column).cast("string").alias("lang"),
        F.col(text_column).cast("string").alias("text"),
        F.xxhash64(id_column, text_column).alias("h"),
    )
    scratch = Scratch(docs.sparkSession, "languages")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    sizes = scratch.keep(sizes, "sizes")
    languages = sizes.count()
    if not languages:
        scratch.drop_all_but()
        return build({})
    chars = min(SAMPLE_CHARS, max(1, ALL_CHARS // languages))
    # From 0 to 1, where h lies among all hashes; a join, as a condition for each language would grow with them.
    share = F.least(F.lit(1.0), SAMPLE_DOCS / F.col("n"), chars / F.greatest("chars", F.lit(1)))
    picked = rows.join(F.broadcast(sizes) if languages <= 100_000 else sizes, "lang").filter(
        (F.col("h") / 2.0**64 + 0.5) <= share
    )
    parts = min(4 * languages, docs.sparkSession.sparkContext.defaultParallelism)
    counted = picked.select("lang", "text", "h").repartition(parts, "lang", F.pmod("h", F.lit(4))).select("lang", "text")
    counted = counted.mapInArrow(trimmed(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = scratch.keep(counted.filter(F.col("gram").isNull() | (F.col("n") >= LEAST_COUNT)), "grams")
    most = min(MOST_GRAMS, max(1, ALL_GRAMS // languages))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counted.filter("gram is not null").withColumn("k", F.row_number().over(best)).filter(F.col("k") <= most)
    own = dict(iter(kept.select("lang", "gram", "n").toPandas().groupby("lang")))
    none = pd.DataFrame({"gram": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    found = {}
    for lang, every in counted.filter("gram is null").select("lang", "n").collect():
        some = own.get(lang, none)
        found[lang] = some["gram"].to_numpy(np.int64).view(np.uint64), some["n"].to_numpy(np.int64), every
    scratch.drop_all_but()
    return build(found)


def identify(docs: DataFrame, model: Model, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of every row, lang_pred and score (0 to 1).

    A null text, or one without letters, is undetermined with score 0.  Equal texts get
    equal results; ids, labels and row order play no part.  Where a kept column is called
    lang_pred or score already, the result's column has underscores in front; the two
    results are always the last columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """Texts alone go to Python; the other columns stay in the JVM."""
        for texts in batches:
            parts = [shared.value.predict(texts.iloc[lo : lo + ROWS].tolist()) for lo in range(0, len(texts), ROWS)]
            names = [name for part, _ in parts for name in part]
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate([s for _, s in parts] or [np.zeros(0)])})
        give_back()

    (found,) = clear_names(docs.columns, "found")
    lang, score = clear_names(columns, "lang_pred", "score")
    told = small_batches(docs).withColumn(found, predict(whole_text(text_column)))
    return told.select(*columns, F.col(f"{found}.lang_pred").alias(lang), F.col(f"{found}.score").alias(score))
