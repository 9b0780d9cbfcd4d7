"""Licence scans.

One Aho-Corasick automaton finds notice phrases and identifier tags in the words of a
text.  The expression after a tag is parsed by the shunting-yard algorithm and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievelight.llm.common import clear_names, whole_text

#: The phrases of the base and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases beside the base.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "all rights reserved": "all-rights-reserved",
    "creative commons attribution": "cc-by",
}
TAG = "spdx license identifier"
#: How freely text under a licence may be used, by the beginning of its name; others count as 0.5.
FREEDOM = {
    "mit": 1.0,
    "apache": 1.0,
    "bsd": 1.0,
    "isc": 1.0,
    "cc0": 1.0,
    "unlicense": 1.0,
    "cc-by-nc": 0.2,
    "cc-by": 0.9,
    "mpl": 0.7,
    "lgpl": 0.5,
    "agpl": 0.2,
    "gpl": 0.3,
    "all-rights-reserved": 0.0,
}

_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_GAP = re.compile(b" {2,}")
#: A tag as it is written, and the bytes of a text with A-Z lower-cased.
_TAG_TEXT = "spdx-license-identifier"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}


def freedom(name: str) -> float:
    known = [k for k in FREEDOM if name.startswith(k)]
    return FREEDOM[max(known, key=len)] if known else 0.5


def postfix(expression: str) -> list[str]:
    """The expression's tokens in postfix order, operators in capitals.

    Reading ends where the text can't go on as an expression, as at a comment's end; an
    operator without a right side and unmatched parentheses are left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in _TOKEN.findall(expression):
        word = token.upper()
        if word in _BINDS:
            if not operand:
                break
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand or not re.search("[A-Za-z]", token):
                break
            out.append(token.lower())
            operand = True
    if not operand and stack and stack[-1] in _BINDS:
        stack.pop()
    return out + [x for x in reversed(stack) if x in _BINDS]


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """The licences that an expression names and the freedom that it grants; None if it names none."""
    names: set[str] = set()
    stack: list[tuple[float, str]] = []
    for token in postfix(expression):
        if token not in _BINDS:
            stack.append((freedom(token), token))
            names.add(token)
        elif len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if token == "WITH":
                names.discard(right[1])
                names.discard(left[1])
                both = f"{left[1]}-with-{right[1]}"
                names.add(both)
                stack.append((min(1.0, left[0] + 0.2), both))
            else:
                stack.append(((max if token == "OR" else min)(left[0], right[0]), ""))
    return names, stack[-1][0] if stack else None


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in [*BASE.items(), *NOTICES.items(), (TAG, "")]:
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def tag_automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word(_TAG_TEXT, len(_TAG_TEXT))
    found.make_automaton()
    return found


def expressions(text: str) -> Iterator[str]:
    """What follows each tag and its colon, to the end of the line; a tag within that is part of it."""
    data = text.encode("utf-8", "surrogatepass")
    done = 0
    for end, size in tag_automaton().iter(data.translate(_LOWER).decode("latin-1")):
        start = end + 1
        while data[start : start + 1] in (b" ", b"\t"):
            start += 1
        if end + 1 - size < done or data[start : start + 1] != b":":
            continue
        start += 1
        stops = [k for k in (data.find(b"\r", start), data.find(b"\n", start)) if k >= 0]
        done = min(stops, default=len(data))
        yield data[start:done].decode("utf-8", "replace").lstrip(" \t")


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a whole text."""
    words = _GAP.sub(b" ", text.encode("utf-8", "surrogatepass").translate(_BYTES)).strip(b" ")
    n_words = words.count(b" ") + 1 if words else 0
    line = (b" " + words + b" ").decode("latin-1")
    base, labels, places, grants = set(), set(), [], []
    tagged = False
    for end, (phrase, label) in automaton().iter(line):
        if phrase in BASE:
            places.append(end - len(phrase) - 1)
            base.add(label)
        tagged |= phrase == TAG
        if label:
            labels.add(label)
            grants.append(freedom(label))
    if tagged:
        for expression in expressions(text):
            names, grant = evaluate(expression)
            labels |= names
            grants += [grant] if grant is not None else []
    first = line.count(" ", 0, min(places) + 1) - 1 if places else None
    last = line.count(" ", 0, max(places) + 1) - 1 if places else None
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(
        grants, default=0.0
    )


RESULT = [(name, T.LongType()) for name in ("n_words", "n_base", "first_word", "last_word")] + [
    ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())
]


def scan_licences(docs: DataFrame, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of every row and what :func:`scan` finds in its whole text.

    The score is the least freedom that the licences stated in the text grant, 0 where
    none is stated.  Null text counts as empty: no words, labels or places.  Where a kept
    column has the name of a result, the result's has underscores in front.
    """
    *names, text = clear_names(columns, *(name for name, _ in RESULT), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            found = [scan(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            out = [pa.array(v, k) for v, k in zip(zip(*found, strict=True) if found else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *out], names=[*batch.schema.names[:-1], *names]
            )

    fields = [T.StructField(name, kind) for name, (_, kind) in zip(names, RESULT, strict=True)]
    schema = T.StructType([*docs.select(*columns).schema.fields, *fields])
    return docs.select(*columns, whole_text(text_column).alias(text)).mapInArrow(run, schema)
