"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines and blocks of several lines between blank ones, of any size. Their five-word
shingle sets (fewer words make one shingle) get MinHash bands tuned so that a pair at similarity 0.8
collides with at least 0.999 probability; colliding paragraphs are joined, verified by exact Jaccard
similarity, and clustered by connected components. Sets under ``LEAST`` shingles are similar to equal
ones only and need no bands.

A passage that repeats inside longer lines, or over several short ones, has no line of its own. So each
text also has anchored windows: of every ``REACH`` neighbouring shingles the smallest hash anchors the
``MIN_WORDS`` words that begin there. A passage of REACH + MIN_WORDS - 1 = 50 words holds a whole window
wherever it stands, and equal windows fall into one group by their digest.

Of each group with two occurrences apart, in one document or several, the first one stays, with what
overlaps it; the others are to be removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from lexiloom.llm import ngram_join as nj, shingles as sh
from lexiloom.session import settle

MIN_WORDS = 25
REACH = 26
#: The smallest set that can reach SIMILARITY with another one: 4 of 5 shingles.
LEAST = 4
ROWS = 3
SIMILARITY, RECALL = 0.8, 0.999


def tuned_bands(rows: int = ROWS, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The fewest bands of ``rows`` hashes with the recall asked for at the similarity given."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


BANDS = tuned_bands()
_SEEDS = sh.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


#: Bytes hashed at a time, and words after which a task hands its rows on.
PIECE, FLUSH_WORDS = 1 << 18, 1 << 18


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, n being a power of two so that few tables are kept."""
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)], dtype=np.uint64)


def hashed_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, line number of each word): words and lines of the lower-cased (A-Z) text.

    A word's hash is a difference of one running polynomial sum over the bytes, shifted to power 0, so
    it does not depend on where the sum begins. The sum runs over ``PIECE`` bytes of whole words at a
    time: what a very long text needs beside its hashes is a few bytes for each byte of it.
    """
    data = np.frombuffer(text.encode("utf-8").lower(), np.uint8)
    edge = np.flatnonzero(np.diff(_SPACES[data], prepend=True, append=True))
    start, stop = edge[::2], edge[1::2]
    hashes = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(int(np.searchsorted(stop, start[first] + PIECE, "right")), first + 1)
        low, high = start[first], stop[last - 1]
        table = max(PIECE, 1 << int(high - low).bit_length())
        run = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high] + np.uint64(1)) * _powers(_BASE, table)[: high - low], out=run[1:])
        a, z = start[first:last] - low, stop[first:last] - low
        hashes[first:last] = sh.mix((run[z] - run[a]) * _powers(_INVERSE, table)[a])
        first = last
    return hashes, np.searchsorted(np.flatnonzero(data == 10), start)


def paragraphs(lines: np.ndarray, blocks: bool = False) -> Iterator[tuple[int, int]]:
    """(first word, words) of each line, and of each block of several lines, from the line numbers of the words."""
    if not len(lines):
        return
    steps = np.diff(lines)
    cuts = [0, *(np.flatnonzero(steps) + 1).tolist(), len(lines)]
    yield from ((a, z - a) for a, z in zip(cuts, cuts[1:]))
    if blocks:
        cuts = [0, *(np.flatnonzero(steps > 1) + 1).tolist(), len(lines)]
        yield from ((a, z - a) for a, z in zip(cuts, cuts[1:]) if lines[a] != lines[z - 1])


def _distinct(items: np.ndarray) -> np.ndarray:
    items = np.sort(items)
    fresh = np.ones(len(items), bool)
    np.not_equal(items[1:], items[:-1], out=fresh[1:])
    return items[fresh]


def paragraph_set(hashes: np.ndarray, shingles: np.ndarray, first: int, n: int) -> np.ndarray:
    """The set of a paragraph, cut out of the shingle hashes of its text, or the one shingle of its few words."""
    if n < sh.WIDTH:
        return sh.shingle_hashes(hashes[first : first + n])
    return _distinct(shingles[first : first + n - sh.WIDTH + 1])


def _signed(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def anchors(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, digests) of the anchored windows of a text's shingle hashes."""
    n = len(shingle) + sh.WIDTH - MIN_WORDS
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = ((shingle[:n] >> np.uint64(24)) << np.uint64(24)) | np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFF)
    span, best, left = 1, low, min(REACH, n)
    while span * 2 <= left:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < left:
        best = np.minimum(best[: len(best) - (left - span)], best[left - span :])
    best = best[np.r_[True, best[1:] != best[:-1]]]
    # Positions beyond 2^24 words wrap; they are restored from the order of the windows.
    at = np.flatnonzero(np.isin(low, best)) if n > 0xFFFFFF else (best & np.uint64(0xFFFFFF)).astype(np.int64)
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(0, MIN_WORDS, sh.WIDTH):
        total = sh.mix(total * np.uint64(3) + shingle[at + k])
    return at, total.view(np.int64)


OCCURRENCES = "doc_id bigint, kind int, at bigint, n_words bigint, unit bigint, bands array<bigint>, n_shingles int"


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of band keys for each set of shingle hashes."""
    cuts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    items = np.concatenate(sets)
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(sets), axis=0)
    for k, seed in enumerate(_SEEDS):
        column = keys[:, k // ROWS]
        column[:] = sh.mix(column * np.uint64(3) + np.minimum.reduceat(sh.mix(items ^ seed), cuts))
    return keys.view(np.int64)


def _rows(parts: list[tuple], sets: list[np.ndarray], fresh: list[int]) -> pd.DataFrame:
    """OCCURRENCES of some documents; ``fresh`` are the rows that carry the bands and sizes of ``sets``."""
    sizes = [len(p[2]) for p in parts]
    bands = np.full(sum(sizes), None, dtype=object)
    n_shingles = np.zeros(sum(sizes), np.int32)
    if sets:
        bands[fresh] = np.fromiter(band_keys(sets), object, len(sets))
        n_shingles[fresh] = [len(s) for s in sets]
    return pd.DataFrame(
        {
            "doc_id": np.repeat([p[0] for p in parts], sizes),
            "kind": np.repeat([p[1] for p in parts], sizes),
            "at": np.concatenate([p[2] for p in parts]),
            "n_words": np.concatenate([p[3] for p in parts]),
            "unit": np.concatenate([p[4] for p in parts]),
            "bands": bands,
            "n_shingles": n_shingles,
        }
    )


def _occurrences(batches: Iterator[pd.DataFrame], blocks: bool = False) -> Iterator[pd.DataFrame]:
    """Paragraphs (kind 0; lines, or blocks as well) and anchored windows (kind 1) in one pass over the texts.

    The first of equal paragraphs in a batch carries the bands, if the set needs any. Rows leave every FLUSH_WORDS words, so
    memory follows that number and the longest text, not the batch.
    """
    for pdf in batches:
        parts, sets, fresh, banded, rows, held = [], [], [], set(), 0, 0
        for i, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
            hashes, lines = hashed_words(text or "")
            if not len(hashes):
                continue
            shingles = sh.shingle_hashes(hashes)
            places, units = list(paragraphs(lines, blocks)), []
            for a, n in places:
                own = paragraph_set(hashes, shingles, a, n)
                units.append(_signed(own.tobytes()))
                if len(own) >= LEAST and units[-1] not in banded:
                    banded.add(units[-1])
                    sets.append(own)
                    fresh.append(rows + len(units) - 1)
            parts.append((i, 0, *np.array(places).T, units))
            rows += len(units)
            at, digests = anchors(shingles)
            parts.append((i, 1, at, np.full(len(at), MIN_WORDS), digests))
            rows += len(at)
            held += len(hashes)
            if held >= FLUSH_WORDS:
                yield _rows(parts, sets, fresh)
                parts, sets, fresh, rows, held = [], [], [], 0, 0
        if parts:
            yield _rows(parts, sets, fresh)


def _colliding_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items), distinct, of the paragraphs among ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(sh.id_bitmap(ids.select("id")))

    def frame(found: dict[int, bytes]) -> pd.DataFrame:
        out = pd.DataFrame({"id": list(found), "items": pd.Series(list(found.values()), dtype=object)})
        return out.astype({"id": "int64"})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, held = {}, 0
            for text in pdf["text"]:
                hashes, lines = hashed_words(text or "")
                shingles = sh.shingle_hashes(hashes)
                for a, n in paragraphs(lines, True):
                    own = paragraph_set(hashes, shingles, a, n)
                    if len(own) >= LEAST:
                        raw = own.tobytes()
                        found[_signed(raw)] = raw
                held += len(hashes)
                if held >= FLUSH_WORDS and found:
                    yield frame(found)
                    found, held = {}, 0
            yield frame(found)

    sets = docs.select("text").mapInPandas(build, "id bigint, items binary")
    position = F.pmod(F.xxhash64("id"), F.lit(1 << sh.ID_BITS))

    @F.pandas_udf(BooleanType())
    def known(p: pd.Series) -> pd.Series:
        return pd.Series(sh.in_bitmap(shared.value, p.to_numpy()))

    return sets.where(known(position)).dropDuplicates(["id"])


def paragraph_labels(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(unit, component) of paragraphs with a near copy of other words. Equal ones are banded once.

    Sizes come with the bands, so meetings are arranged without the sets, which travel twice: to be
    told apart by id, where the meetings join them, and to the meetings.
    """
    banded = seen.where("kind = 0 AND bands IS NOT NULL").select(F.col("unit").alias("id"), "bands", F.col("n_shingles").cast("bigint").alias("n"))
    distinct = banded.select("id", "bands").dropDuplicates(["id"])
    routes = settle(sh.hubs(distinct.select(F.explode("bands").alias("key"), "id")))
    sets = _colliding_sets(docs, routes.select("id").distinct())
    sized = banded.select("id", "n").distinct()
    met = nj.meetings(routes.join(sized, "id").select("id", "hub", "n", F.lit(1).alias("copies")))
    labels = nj.class_labels(nj.compare_sets(met.join(sets, "id")))
    return labels.select(F.col("id").alias("unit"), "component")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, at, n_words, component, first_doc, last_doc, removed) per repeated passage.

    Every occurrence of a group that has two of them apart, in one document or several, has a row;
    ``removed`` is false for the first one, by doc_id and position, and those that overlap it. ``at`` is the first word, ``kind`` paragraph or window. Null
    and empty texts and null ids have no passages; rows that repeat a doc_id are one document; other
    columns are ignored. Groups are aggregated map-side and joined back, so a passage in a third of all
    documents meets in no single task: adaptive execution splits the skewed side of the join.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    seen = settle(docs.mapInPandas(partial(_occurrences, blocks=True), OCCURRENCES))
    lines = seen.where("kind = 0").join(paragraph_labels(docs, seen), "unit", "left")
    lines = lines.select("doc_id", "kind", "at", "n_words", F.coalesce("component", "unit").alias("component"))
    windows = seen.where("kind = 1").select("doc_id", "kind", "at", "n_words", F.col("unit").alias("component"))
    both = lines.unionByName(windows)
    groups = both.groupBy("kind", "component").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.min(F.struct("doc_id", "at", (-F.col("n_words")).alias("less"))).alias("first"),
        F.max("at").alias("last_at"), F.min(F.col("at") + F.col("n_words")).alias("first_end"),
    )
    # In one document two occurrences are apart if one begins where another has ended.
    repeated = groups.where("first_doc < last_doc OR last_at >= first_end")
    kept = F.expr("doc_id = first.doc_id AND at < first.at - first.less")
    return both.join(repeated, ["kind", "component"]).select(
        "doc_id", F.when(F.col("kind") == 0, "paragraph").otherwise("window").alias("kind"), "at", "n_words", "component",
        "first_doc", "last_doc", (~kept).alias("removed"),
    )
