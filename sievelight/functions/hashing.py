"""Ids, hash buckets and orders that any engine can reproduce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_id(c: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(c), 1, 16)


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def seeded(seed: int | str, *keys: Column) -> Column:
    """A key by which rows lie in a random order that the seed fixes."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)


def uniform_long(h: Column) -> Column:
    """The number of the first 15 hexadecimal digits of a hash."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def modulo(c: Column, k: int) -> Column:
    """The 256-bit number of a text's SHA-256 modulo ``k``, exactly: Horner's rule over 8-digit parts."""
    h = F.sha2(c, 256)
    part = lambda j: F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("long")
    return reduce(lambda acc, j: (acc * ((1 << 32) % k) + part(j)) % k, range(1, 8), part(0) % k)


def keep_fraction(key: Column, fraction: Column) -> Column:
    """Whether the key falls in the fraction's first thousandths; a null fraction keeps all."""
    kept = modulo(key, 1000) < F.round(fraction * 1000)
    return F.when(fraction.isNull() | (fraction >= 1), True).when(fraction <= 0, False).otherwise(kept)


def split_of(cluster: Column) -> Column:
    """test, dev or train by the cluster, so that no cluster is in two of them."""
    bucket = modulo(cluster, 5)
    return F.when(bucket == 0, "test").when(bucket == 1, "dev").otherwise("train")


def source_key(prefix: str, key: Column, longest: int = 200) -> Column:
    """The key with a prefix, or with its hash instead where that would be too long."""
    whole = F.concat(F.lit(prefix), key)
    return F.when(F.length(whole) > longest, F.concat(F.lit(prefix), sha256(key))).otherwise(whole)


def cache_key(**parts: Column) -> Column:
    """Hash of the parts as JSON with sorted keys: the address of a response."""
    return F.sha2(F.to_json(F.struct(*(parts[name].alias(name) for name in sorted(parts)))), 256)


def grade_of(token: Column) -> Column:
    """The grade at the end of a token such as MU2."""
    return F.right(token, F.lit(1)).try_cast("int")


def token_of(axis: Column, grade: Column) -> Column:
    return F.concat(axis, grade.cast("string"))
