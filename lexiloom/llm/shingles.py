"""Words, word hashes and shingle sets of whole texts, as numpy arrays inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

WIDTH = 5
ID_BITS = 24
_M64 = (1 << 64) - 1
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) for j in range(WIDTH)], dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of characters other than space and x09-x0D; null has none."""
    return text.encode("utf-8").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that any bits of the result can serve as an address."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash for each run of five words, in order; fewer words make one shingle, no words none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, WIDTH)
    acc = np.full(n - width + 1, (width * 0x9FB21C651E98DF25) & _M64, dtype=np.uint64)
    for j in range(width):
        acc += hashes[j : n - width + 1 + j] * _MULTIPLIERS[j]
    return mix(acc)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(word_hashes(words(text))))


def digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    raw = xxhash.xxh3_128_digest(items.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def hubs(postings: DataFrame) -> DataFrame:
    """(id, hub, keys) from (key, id): hub is the smallest id that shares one of id's keys, keys how
    many of id's keys lead to it.

    Ids with a common key have a common hub, and an id has far fewer hubs than keys: members of a
    group of copies mostly meet under the smallest member. Keys with one id fall away. A window
    over the key is one shuffle of (key, id) rows; no group is collected.
    """
    w = Window.partitionBy("key")
    low, high = F.min("id").over(w), F.max("id").over(w)
    shared = postings.select("id", low.alias("hub"), high.alias("high")).where("hub < high")
    return shared.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("keys"))


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A fixed 2^24-bit map of hashed ids, as packed bytes: a filter before a shuffle.

    Its size does not depend on the data; with many ids it lets more rows through, never fewer.
    """
    position = F.pmod(F.xxhash64("id"), F.lit(1 << ID_BITS))
    rows = ids.select((position + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    )
    out = np.zeros((1 << ID_BITS) // 8, dtype=np.uint8)
    for row in rows.collect():
        at = (row["k"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, position: np.ndarray) -> np.ndarray:
    return (bits[position >> 3] >> (position & 7).astype(np.uint8)) & 1 == 1
