"""Hashes used for MinHash signatures and for change detection."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 32-bit FNV-1a and the universal hash family over the prime 2^31 - 1.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK_32 = 4294967295
MASK_31 = 2147483647
MERSENNE = 2147483647
A_STEP, A_BASE = 1103515245, 12345
B_STEP, B_BASE = 1664525, 1013904223
NUM_HASHES = 128


def _big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def fnv1a(col: Column) -> Column:
    """31-bit FNV-1a of a string, low byte first within a character."""
    def fold(state: Column, code: Column) -> Column:
        mixed = state.bitwiseXOR(code)
        return (mixed * _big(FNV_PRIME)).bitwiseAND(_big(MASK_32))

    def bytes_of(ch: Column) -> Column:
        code = F.ascii(ch).cast("bigint")
        low = code.bitwiseAND(_big(255))
        mid = F.shiftright(code, 8).bitwiseAND(_big(255))
        high = F.shiftright(code, 16).bitwiseAND(_big(255))
        return F.when(code <= 255, F.array(low)).when(code <= 65535, F.array(low, mid)).otherwise(F.array(low, mid, high))

    codes = F.flatten(F.transform(F.split(col, ""), bytes_of))
    # Splitting an empty string yields one empty character, which is no byte.
    state = F.when(col == "", _big(FNV_OFFSET)).otherwise(F.aggregate(codes, _big(FNV_OFFSET), fold))
    return state.bitwiseAND(_big(MASK_31))


def hash_family(count: int = NUM_HASHES) -> list[tuple[int, int]]:
    """Coefficients (a, b) of the hash functions, derived from their index."""
    return [(((i * A_STEP + A_BASE) & MASK_31) or 1, (i * B_STEP + B_BASE) & MASK_31) for i in range(count)]


def universal(col: Column, a: int, b: int) -> Column:
    return (col * _big(a) + _big(b)) % _big(MERSENNE)


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def short_hash(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 32)


def list_hash(values: Column) -> Column:
    """Digest of an ordered list that sits in one row."""
    return F.sha2(F.array_join(values, "|"), 256)


def member_code(col: Column) -> Column:
    """60 bits of a member's SHA-256 as a number, for order-free set digests."""
    return F.conv(F.substring(F.sha2(col, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def set_digest(col: Column) -> Column:
    """Aggregate: digest of a set of strings whatever its size or order.

    Sum and count combine map-side, so no group is ever collected.
    """
    return F.sha2(
        F.concat_ws(
            "|",
            F.count(col).cast("string"),
            F.coalesce(F.sum(member_code(col)), F.lit(0)).cast("string"),
        ),
        256,
    )
