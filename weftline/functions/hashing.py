"""Hashes, draws and keys as expressions: each value follows from (seed, table, field, row index, draw) alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295
#: Distinct values of a uniform draw.
STEPS = 1 << 53


def text_of(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def joined(*parts) -> Column:
    return F.concat_ws("_", *map(text_of, parts))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters' code points, as a long; the empty text gives the basis, null null."""
    codes = F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(text.isNotNull(), F.aggregate(codes, F.lit(FNV_BASIS), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32))))


def hex32(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def fnv_uuid(base: Column) -> Column:
    """36 characters from four FNV hashes of the base with suffixes _1 to _4, dashed 8-4-4-4-12."""
    digits = F.concat(*[hex32(fnv1a(F.concat(base, F.lit(f"_{k}")))) for k in range(1, 5)])
    return dashed(digits)


def dashed(digits: Column) -> Column:
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def fnv_object_id(base: Column) -> Column:
    """The first 24 hexadecimal digits of fnv_uuid()."""
    return F.substring(F.translate(fnv_uuid(base), "-", ""), 1, 24)


def hash_digits(seed, *parts) -> Column:
    """32 hexadecimal digits from two 64-bit hashes; stays in generated code."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), F.lit(str(seed)), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 16, "0") for k in (1, 2)]))


def uniform(seed, *parts, draw: int = 0) -> Column:
    """A double in [0, 1) from a 64-bit hash of seed, parts and draw."""
    return F.pmod(F.xxhash64(F.lit(str(seed)), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts], F.lit(draw)), F.lit(STEPS)) / F.lit(float(STEPS))


def fnv_uniform(*parts) -> Column:
    """A double in [0, 1) from FNV-1a of the parts joined by _; any engine can recompute it."""
    return fnv1a(joined(*parts)) / F.lit(4294967296.0)
