"""Encoding and decoding with a byte-level BPE vocabulary, by tree concatenation.

A text is cut in halves again and again, wherever the middle falls, until its parts have
at most ``PART`` characters.  The parts are encoded on their own and then joined pair by
pair as a tree: at each join a window of the tokens around it is encoded anew and grown
until its outer tokens agree with both sides.  All neighbours in the joined list are then
as an encoder would leave them, which makes the list the encoding of the whole.

Parts of one text are encoded in one task while the text is of ordinary length; those of
a text of more than ``LONG_TEXT`` characters are dealt out over the cluster.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm.common import Scratch, clear_names, small_batches, trimmed, whole_text

END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256
#: Characters of a part that is encoded by itself.
PART = 1024
#: Texts of more characters than this are dealt out over the cluster, in pieces of at most this many.
LONG_TEXT = 1 << 15
#: Bytes of texts, or tokens, that are looked at together.
SLICE = 1 << 18
#: Tokens on each side of a join that are encoded anew at first.
WINDOW = 8
#: Beyond these characters the fast encoder's character classes are not proved equal.
_UNUSUAL = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")


class Codec:
    """Encoder and decoder of one vocabulary, by the tokenizers library's results."""

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        self.vocabulary = vocabulary
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "byte_bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={END_OF_TEXT: END_OF_TEXT_ID}
            )

    @cached_property
    def slow(self):
        """The tokenizers library's own; it is loaded where a text or a decoding needs it."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.vocabulary)
        own.no_truncation()
        own.no_padding()
        return own

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _UNUSUAL.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        if END_OF_TEXT not in text:
            return self.fast.encode_ordinary(text)
        out: list[int] = []
        for k, part in enumerate(text.split(END_OF_TEXT)):
            out += [END_OF_TEXT_ID] * bool(k) + self.fast.encode_ordinary(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' bytes as text; what is no UTF-8 is replaced, as the tokenizers library does."""
        if self.fast is not None:
            try:
                return self.fast.decode_bytes(ids).decode("utf-8", "replace")
            except KeyError:
                pass  # an id that the vocabulary doesn't have
        return self.slow.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=4)
def codec(name: str) -> Codec:
    """The codec of a public vocabulary file; ``name`` is that file's name or path."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if os.path.sep in name:
        return Codec(name)
    import public_tokenizers

    ranks = name.replace(".json", ".tiktoken")
    return Codec(public_tokenizers.path(name), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def halves(text: str, limit: int) -> list[str]:
    """Parts of at most ``limit`` characters, by cutting in the middle again and again; an empty text is one part."""
    if len(text) <= limit:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], limit) + halves(text[middle:], limit)


class Side(NamedTuple):
    """Bytes of a text and its tokens."""

    data: bytes
    ids: list[int]


def join(left: Side, right: Side, encode: Callable[[str], list[int]], lengths: list[int]) -> Side:
    """The encoding of two texts' concatenation from the encodings of both.

    ``lengths`` gives the bytes of each token.  The window starts with a few tokens on
    either side and doubles until the outer half of each side's tokens in it come out as
    they were; where a side lies in the window whole, nothing is left to agree with.  A
    window that would begin or end inside a character grows too.
    """
    data = left.data + right.data
    if not left.ids or not right.ids:
        return Side(data, left.ids + right.ids)
    size = WINDOW
    while True:
        head, tail = left.ids[-size:], right.ids[:size]
        start = len(left.data) - sum(map(lengths.__getitem__, head))
        end = len(left.data) + sum(map(lengths.__getitem__, tail))
        try:
            window = encode(data[start:end].decode())
        except UnicodeDecodeError:
            size *= 2
            continue
        before, after = -(-len(head) // 2), -(-len(tail) // 2)
        agree = len(left.ids) <= size or window[:before] == head[:before]
        if agree and (len(right.ids) <= size or window[-after:] == tail[-after:]):
            return Side(data, left.ids[: len(left.ids) - len(head)] + window + right.ids[len(tail) :])
        size *= 2


def tree(sides: list[Side], encode: Callable[[str], list[int]], lengths: list[int]) -> list[int]:
    """Joins neighbours pair by pair until one is left, and returns its tokens."""
    while len(sides) > 1:
        paired = [join(a, b, encode, lengths) for a, b in zip(sides[::2], sides[1::2], strict=False)]
        sides = paired + sides[len(sides) - len(sides) % 2 :]
    return sides[0].ids


@lru_cache(maxsize=4)
def token_lengths(name: str) -> list[int]:
    """Bytes of each token, by its id; a byte-level token has one character for each byte."""
    own = codec(name)
    if own.fast is not None:
        return [len(own.fast.decode_single_token_bytes(k)) for k in range(own.fast.n_vocab)]
    size = own.slow.get_vocab_size(with_added_tokens=True)
    return [len(own.slow.id_to_token(k) or "") for k in range(size)]


def encode_text(text: str, vocabulary: str, limit: int = PART) -> list[int]:
    """Ids of one text by way of its parts and their joins, in one process."""
    own = codec(vocabulary)
    if len(text) <= limit:
        return own.encode(text)
    sides = [Side(part.encode(), own.encode(part)) for part in halves(text, limit)]
    return tree(sides, own.encode, token_lengths(vocabulary))


def slices(sizes: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to about ``most``, one row at least."""
    total = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(total):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield start, end
        start = end


def encoded(texts: pa.Array, vocabulary: str, part: int) -> pa.ListArray:
    """The ids of texts; only one text's are held as Python numbers at a time."""
    ids = [np.asarray(encode_text(t.as_py(), vocabulary, part), np.int32) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def id_lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The lists of an Arrow column; a conversion of the column as a whole takes several times as long."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[lo:hi].tolist() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True))


def digests(column: pa.ListArray) -> list[str]:
    """SHA-256 of each list's decimal numbers, joined by commas."""
    numbers = pa.ListArray.from_arrays(
        pc.subtract(column.offsets, column.offsets[0]), pc.cast(column.flatten(), pa.string())
    )
    return [hashlib.sha256(joined.as_buffer()).hexdigest() for joined in pc.binary_join(numbers, ",")]


def _encode_rows(vocabulary: str, part: int, name: str):
    """Replaces the last column, texts, by ``name``, their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.columns[-1])):
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], encoded(rows.columns[-1], vocabulary, part)],
                    names=[*batch.schema.names[:-1], name],
                )

    return run


def _decode_rows(vocabulary: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for lo, hi in slices(pc.list_value_length(batch.columns[-1])):
                rows = batch.slice(lo, hi - lo)
                texts = pa.array(map(own.decode, id_lists(rows.columns[-1])), pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], texts], names=[*batch.schema.names[:-1], name])

    return run


_PIECE = T.StructType().add("sha", T.BinaryType()).add("piece", T.IntegerType()).add("text", T.StringType())
_ENCODED = T.StructType([*_PIECE.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _cut_rows(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, text in zip(*batch.columns, strict=True):
                sha, text = sha.as_py(), text.as_py()
                pieces = halves(text, limit)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([sha] * len(pieces), pa.binary()),
                        pa.array(range(len(pieces)), pa.int32()),
                        pa.array(pieces, pa.string()),
                    ],
                    names=_PIECE.names,
                )

    return run


def _encode_pieces(vocabulary: str, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column("text"))):
                rows = batch.slice(lo, hi - lo)
                ids = encoded(rows.column("text"), vocabulary, part)
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], names=_ENCODED.names)

    return run


def _join_pieces(vocabulary: str):
    def run(group):
        import pandas as pd

        group = group.sort_values("piece")
        sides = [Side(t.encode(), i.tolist()) for t, i in zip(group["text"], group["ids"], strict=True)]
        ids = tree(sides, codec(vocabulary).encode, token_lengths(vocabulary))
        return pd.DataFrame({"sha": [group["sha"].iloc[0]], "ids": [np.asarray(ids, np.int32)]})

    return run


def encode(
    docs: DataFrame,
    vocabulary: str,
    columns: list[str],
    text_column: str = "text",
    long_text: int = LONG_TEXT,
    part: int = PART,
) -> DataFrame:
    """``columns`` of every row and ``ids``, the token ids of its whole text.

    Null text counts as empty and has no ids.  Texts are encoded in parts of at most
    ``part`` characters, which are joined as a tree.  A text of more than ``long_text``
    characters is encoded once however many rows repeat it: its pieces are spread over
    the cluster and joined again likewise.  Ids and row order of the input play no
    part, so null and repeated ids are as good as any.  If a kept column is called
    ``ids`` already, the result's last column has underscores in front.
    """
    name, text, sha = clear_names(columns, "ids", "text", "sha")
    rows = docs.select(*columns, whole_text(text_column).alias(text))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    short = rows.filter(F.length(text) <= long_text).mapInArrow(trimmed(_encode_rows(vocabulary, part, name)), schema)
    long = rows.filter(F.length(text) > long_text).withColumn(sha, F.unhex(F.sha2(text, 256)))
    # Written, so that the texts are cut once and each piece is dealt to a task of its own.
    texts = long.groupBy(F.col(sha).alias("sha")).agg(F.first(text).alias("text"))
    scratch = Scratch(docs.sparkSession, "bpe")
    pieces = scratch.keep(texts.mapInArrow(trimmed(_cut_rows(long_text)), _PIECE), "pieces")
    tokens = pieces.repartition("sha", "piece").mapInArrow(trimmed(_encode_pieces(vocabulary, part)), _ENCODED)
    joined = scratch.keep(
        tokens.groupBy("sha").applyInPandas(_join_pieces(vocabulary), "sha binary, ids array<int>"), "joined"
    ).withColumnsRenamed({"sha": sha, "ids": name})
    scratch.drop_all_but("joined")
    return short.unionByName(long.drop(text).join(joined, sha).select(*columns, name))


def decode(encoded: DataFrame, vocabulary: str, columns: list[str], ids_column: str = "ids") -> DataFrame:
    """``columns`` of every row and ``text``, its ids decoded, special tokens included.

    If a kept column is called ``text`` already, the result's has underscores in front.
    """
    name, ids = clear_names(columns, "text", "ids")
    schema = T.StructType([*encoded.select(*columns).schema.fields, T.StructField(name, T.StringType())])
    return encoded.select(*columns, F.col(ids_column).alias(ids)).mapInArrow(_decode_rows(vocabulary, name), schema)


def _digest_rows(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for lo, hi in slices(pc.list_value_length(batch.column(1))):
                part = batch.slice(lo, hi - lo)
                ids = part.column(1)
                texts = map(own.decode, id_lists(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pc.list_value_length(ids).cast(pa.int64()),
                        pa.array(digests(ids), pa.string()),
                        pa.array((hashlib.sha256(t.encode()).hexdigest() for t in texts), pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes and decodes every document; returns doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(small_batches(docs), vocabulary, ["doc_id"]).mapInArrow(
        trimmed(_digest_rows(vocabulary)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
