"""Digests, bit helpers and string hashes as columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

MASK = 0xFFFFFFFF


def blank_digest(size: int) -> Column:
    """MD5 of ``size`` zero bytes, for any block size."""
    return F.md5(F.unhex(F.repeat(F.lit("00"), size)))


def is_blank(data: Column) -> Column:
    """Whether a binary block holds only zero bytes (an empty one counts)."""
    return F.hex(data) == F.repeat(F.lit("00"), F.octet_length(data))


def halves(md5: Column) -> tuple[Column, Column]:
    """The two 64-bit halves of a 32-digit hex digest as signed longs."""
    return tuple(F.conv(F.substring(md5, s, 16), 16, -10).cast("long") for s in (1, 17))


def is_digest(col: Column) -> Column:
    return F.regexp_like(col, F.lit("^[0-9a-f]{32}$"))


def to_binary(hex_: Column) -> Column:
    return F.unhex(hex_)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex digests; -1 when their lengths differ, null for nulls."""
    n = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(halves(a), halves(b), strict=True)), F.lit(0))
    return F.when(F.length(a) != F.length(b), -1).otherwise(n)


def hamming_bits(a: Column, b: Column) -> Column:
    """Differing elements of two arrays of one length (-1 otherwise)."""
    return F.when(F.size(a) != F.size(b), -1).otherwise(F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)))


def pack_bits(bits: Column) -> Column:
    """A string of 0 and 1, most significant first, as hex digits (its length is a multiple of 4)."""
    nibbles = F.transform(F.sequence(F.lit(0), (F.length(bits) / 4).cast("int") - 1), lambda i: F.lower(F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16)))
    return F.array_join(nibbles, "")


def escape_dollar(cmd: Column) -> Column:
    return F.replace(cmd, F.lit("$"), F.lit("\\$"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def composite_digest(md5s: Column) -> Column:
    """MD5 of the joined hex digests of a file's blocks in order, the tail's (even if empty) last."""
    return F.md5(F.array_join(md5s, ""))


# --- perceptual hash -------------------------------------------------------------------------------------------------


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r + g + b) / 3).cast("int")


def perceptual_bits(matrix: Column) -> Column:
    """For each row of a matrix of numbers: 1 where a value is at least its row's mean. One string of 0 and 1."""
    row = lambda v: F.transform(v, lambda x: F.when(x >= F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / F.size(v), "1").otherwise("0"))
    return F.array_join(F.flatten(F.transform(matrix, row)), "")


def bit_similarity(a: Column, b: Column) -> Column:
    """1 - share of differing characters of two strings of one length."""
    diff = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    return 1 - diff / F.length(a)


# --- string hashes ---------------------------------------------------------------------------------------------------


def _signed(data: bytes) -> list[int]:
    return [c - 256 if c > 127 else c for c in data]


def _fold(step: Callable[[int, int], int], start: int = 0) -> Callable[[bytes], int]:
    def run(data: bytes) -> int:
        h = start
        for c in _signed(data):
            h = step(h, c) & MASK
        return h & 0x7FFFFFFF

    return run


def _rs(data: bytes) -> int:
    h, a = 0, 63689
    for c in _signed(data):
        h, a = (h * a + c) & MASK, (a * 378551) & MASK
    return h & 0x7FFFFFFF


def _pjw(h: int, c: int) -> int:
    h = ((h << 4) + c) & MASK
    top = h & 0xF0000000
    return (h ^ (top >> 24)) & ~0xF0000000 if top else h


def _ap(data: bytes) -> int:
    h = 0
    for i, c in enumerate(_signed(data)):
        h ^= ((h << 7) ^ c ^ (h >> 3)) if not i & 1 else ~((h << 11) ^ c ^ (h >> 5))
        h &= MASK
    return h & 0x7FFFFFFF


def _words16(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 2], "little") for i in range(0, len(data), 2)]


def _checksum(data: bytes) -> int:
    total = sum(_words16(data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def _table(data: bytes) -> int:
    h = 0
    for i, w in enumerate(_words16(data)):
        h ^= w << (i & 15)
    return h & MASK


#: Named 31-bit string hashes (published general-purpose functions), a 16-bit checksum and the hash table's own hash.
STRING_HASHES: dict[str, Callable[[bytes], int]] = {
    "simple": _fold(lambda h, c: h * 31 + (c & 255)),
    "rs": _rs,
    "js": _fold(lambda h, c: h ^ ((h << 5) + c + (h >> 2)), 1315423911),
    "pjw": _fold(_pjw),
    "elf": _fold(_pjw),
    "bkdr": _fold(lambda h, c: h * 131 + c),
    "sdbm": _fold(lambda h, c: c + (h << 6) + (h << 16) - h),
    "djb": _fold(lambda h, c: h + (h << 5) + c, 5381),
    "ap": _ap,
    "crc": _checksum,
    "table": _table,
}


def string_hash(name: str) -> Callable[[Column], Column]:
    """A vectorised function of a string column; null gives null."""
    fn = STRING_HASHES[name]

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fn(v.encode())).astype("Int64")

    return run


@F.pandas_udf(BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    return data.map(lambda v: None if v is None else zlib.compress(bytes(v)))


@F.pandas_udf(BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda v: None if v is None else zlib.decompress(bytes(v)))
