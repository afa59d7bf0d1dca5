"""Vector functions as column expressions over arrays."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from strataq.functions.text import bound


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 if lengths differ or either is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for a zero vector or different lengths."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays.  The vector and its length are worked out once."""
    whole = lambda v: F.transform(v, lambda x: x.cast("double"))
    unit = lambda v: bound(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
    return bound(whole(a), unit)


def sign_bits(a: Column, bits: int) -> Column:
    """Bit i is set if component min(d - 1, i * d div bits) is positive; a string of 0 and 1, first bit first."""
    d = F.size(a)
    at = lambda i: F.least(d - 1, F.floor(i * d / bits).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.get(a, at(i)) > 0, "1").otherwise("0")), "")


def signature(a: Column) -> Column:
    """The first 64 components' signs as one number."""
    return F.conv(sign_bits(a, 64), 2, -10).cast("long")


def hamming_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.bit_count(a.bitwiseXOR(b)) / bits)


def vector_score(a: Column, b: Column) -> Column:
    """Four times the positive cosine, and four times the similarity of sign bits."""
    return 4 * F.greatest(F.lit(0.0), cosine(a, b)) + 4 * hamming_similarity(signature(a), signature(b))


def to_binary(vector: Sequence[float]) -> bytes:
    """Packed little-endian 32-bit floats."""
    return struct.pack(f"<{len(vector)}f", *vector)


def from_binary(packed: bytes | None) -> list[float] | None:
    """The numbers of a packed vector; bytes that are no such vector give none."""
    if packed is None or len(packed) % 4:
        return None
    return list(struct.unpack(f"<{len(packed) // 4}f", packed))


def dimensions(vector: Column) -> Column:
    """How many components there are; 0 for none."""
    return F.coalesce(F.size(vector), F.lit(0))
