"""Words of texts as Arrow arrays: letters a-z, digits and all characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import small_batches, whole_text

#: Bytes of UTF-8 as words have them; all others become white space.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` one after another, and where each text's begin in them (one more entry than texts).

    Null has no words.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer(data.to_pybytes().translate(_BYTES) if data else b"")
    plain = pa.LargeStringArray.from_buffers(len(texts), offsets, plain, offset=texts.offset)
    plain = pc.ascii_trim_whitespace(pc.if_else(texts.is_valid(), plain, ""))
    lists = pc.ascii_split_whitespace(plain)
    empty = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    if empty.any():  # splitting nothing gives one empty word
        words = words.filter(pc.greater(pc.binary_length(words), 0))
        sizes[empty] = 0
    return words, np.concatenate([[0], np.cumsum(sizes)])


def word_lists(rows: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """id and words (array<string>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, starts = words_of(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "words"])

    kind = rows.schema[id_column].dataType.simpleString()
    picked = small_batches(rows).select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, words array<string>")


_BETWEEN = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def cut_between_words(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` bytes that no word crosses."""
    data, start = text.encode("utf-8", "surrogatepass"), 0
    while start < len(data):
        stop = _BETWEEN.search(data, start + size)
        end = stop.start() if stop else len(data)
        yield data[start:end].decode("utf-8", "surrogatepass")
        start = end


def parts(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """All texts in lists of about ``size`` bytes at most, each with its row; a longer text comes in parts between words."""
    rows, held, n = [], [], 0
    for row, text in enumerate(texts.to_pylist()):
        text = text or ""
        for part in [text] if len(text) <= size else cut_between_words(text, size):
            if held and n + len(part) > size:
                yield np.array(rows), pa.array(held, pa.large_string())
                rows, held, n = [], [], 0
            rows.append(row)
            held.append(part)
            n += len(part)
    if held:
        yield np.array(rows), pa.array(held, pa.large_string())
