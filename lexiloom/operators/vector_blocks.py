"""Similar pairs of one corpus: packed blocks of vectors meet each other, nothing quadratic is written.

A block holds a few million entries (term number, weight) of whole documents, each document's terms from the
rarest to the most frequent. Every two blocks meet once, in a task that reads both from the table they were
written to. There prefixes are joined as in ``pairs``: two documents reach the threshold only if they share a
term inside their prefixes, the rarest terms up to the point where the rest alone cannot reach it. As both
documents lie in the task, all their meetings do, so the bound on a pair is applied at once, what is left is
scored on whole vectors there, and only pairs of the answer leave the task.

Weights are unit vectors. For the Jensen-Shannon similarity they are roots of term shares: with h the binary
entropy and x = a / (a + b), a term adds (a + b) h(x) / 2, which is at most (a + b) sqrt(x (1 - x)) = sqrt(a b),
as h(x) <= 2 sqrt(x (1 - x)). So the similarity is at most the cosine of the roots, and a pair that reaches the
threshold reaches it there as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexiloom.session import settle

#: Entries of a block, entries from which on a corpus is cut into several blocks, and how many at least then.
BLOCK_ENTRIES, SMALL_ENTRIES, LEAST_BLOCKS = 2 << 20, 1 << 17, 8
#: Meetings that are held at once.
MEETINGS = 1 << 19
#: What rounding may take from a squared norm, and from a similarity before it is rounded to six decimals.
SQUARE_SLACK, SLACK = 1e-11, 1e-6


def numbered_terms(frequencies: DataFrame) -> DataFrame:
    """(term, df, pos): terms numbered from 0 in ascending order of (df, term). Written once."""
    held = settle(frequencies.select("term", "df"))
    ranked = settle(held.orderBy("df", "term").withColumn("at", F.monotonically_increasing_id()))
    sizes = ranked.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    # One number per sorted part travels; rows are numbered inside their part.
    before, offset = 0, F.lit(0).cast("bigint")
    if sizes:
        starts = [0] * (sizes[-1]["part"] + 1)
        for row in sizes:
            starts[row["part"]] = before
            before += row["count"]
        offset = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.shiftright("at", 33).cast("int") + 1)
    return ranked.select("term", "df", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + offset).alias("pos"))


def _leading(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of ``sizes`` entries each."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _prefixes(w: np.ndarray, pos: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many entries of each document are its prefix, and the order of all prefix entries by term."""
    ends = np.cumsum(sizes, dtype=np.int64)
    sums = np.concatenate(([0.0], np.cumsum(w * w)))
    here = np.repeat(sums[ends], sizes) - sums[:-1]
    inside = np.sqrt(np.maximum(here, 0.0) + SQUARE_SLACK) >= threshold - SLACK
    lengths = np.add.reduceat(inside, ends - sizes, dtype=np.int32)
    return lengths, np.argsort(pos[_leading(ends - sizes, lengths)], kind="stable").astype(np.int32)


def vector_blocks(entries: DataFrame, searches: list[tuple[str, float]], count: int | None = None) -> DataFrame:
    """Rows (n, ids, sizes, pos, w, share, and per search lengths and order) of whole documents; written once.

    ``entries``: (id, pos, w, share), of which w or share may be absent, and their number, if it is known. Weights
    are scaled to length 1, shares stay. Arrays travel as bytes; blocks have about ``BLOCK_ENTRIES`` entries.
    """
    kind = entries.schema["id"].dataType.simpleString()
    names = [c for c in ("w", "share") if c in entries.columns]
    arrays = ["sizes", "pos", *names, *(f"{name}_{c}" for name, _ in searches for c in ("lengths", "order"))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = [batch for batch in batches if batch.num_rows]
        if not batches:
            return
        held = pa.Table.from_batches(batches).combine_chunks()
        del batches
        ids = held["id"].chunk(0).dictionary_encode()
        code, pos = ids.indices.to_numpy(), held["pos"].to_numpy()
        order = np.lexsort((pos, code))
        code, pos = code[order], pos[order]
        if pos.max() < 1 << 31:
            pos = pos.astype(np.int32)
        sizes = np.bincount(code, minlength=len(ids.dictionary)).astype(np.int32)
        values = {c: held[c].to_numpy()[order] for c in names}
        del held, order
        if "w" in values:
            values["w"] = values["w"] / np.sqrt(np.bincount(code, values["w"] ** 2))[code]
        ends = np.cumsum(sizes, dtype=np.int64)
        task, at, k = TaskContext.get().partitionId(), 0, 0
        while at < len(sizes):
            low = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, low + BLOCK_ENTRIES * 4 // 3, "right")))
            here = slice(low, int(ends[stop - 1]))
            made = {"sizes": sizes[at:stop], "pos": pos[here]} | {c: v[here] for c, v in values.items()}
            for name, threshold in searches:
                made[f"{name}_lengths"], made[f"{name}_order"] = _prefixes(_weights(made, name), made["pos"], made["sizes"], threshold)
            row = [pa.array([(task << 32) + k]), pa.ListArray.from_arrays(pa.array([0, stop - at], pa.int32()), ids.dictionary.slice(at, stop - at))]
            yield pa.record_batch([*row, *(pa.array([made[c].tobytes()], pa.binary()) for c in arrays)], names=["n", "ids", *arrays])
            at, k = stop, k + 1

    parts = [] if count is None else [max(-(-count // BLOCK_ENTRIES), min(LEAST_BLOCKS, -(-count // SMALL_ENTRIES)), 1)]
    columns = ", ".join(f"{c} binary" for c in arrays)
    return settle(entries.select("id", "pos", *names).repartition(*parts, "id").mapInArrow(pack, f"n bigint, ids array<{kind}>, {columns}"))


def _weights(arrays: dict[str, np.ndarray], name: str) -> np.ndarray:
    """The unit vectors that a search compares."""
    return arrays["w"] if name == "w" else np.sqrt(arrays["share"])


class _Block:
    """A block's arrays, and the index of its prefixes for each search."""

    def __init__(self, stored: dict):
        self.sizes = np.frombuffer(stored["sizes"], np.int32)
        kinds = {"w": np.float64, "share": np.float64, "pos": np.int32 if len(stored["pos"]) == 4 * self.sizes.sum(dtype=np.int64) else np.int64}
        self.arrays = {c: np.frombuffer(v, kinds.get(c, np.int32)) for c, v in stored.items()}
        self.pos = self.arrays["pos"]
        self.ends = np.cumsum(self.sizes, dtype=np.int64)
        self.starts = self.ends - self.sizes
        self._held: dict[str, tuple] = {}

    def prefixes(self, name: str) -> tuple[np.ndarray, ...]:
        """(document, term, weight, rest) of the prefix entries by document, rarest first, and per document the
        length of what lies behind the prefix."""
        if name not in self._held:
            lengths = self.arrays[f"{name}_lengths"].astype(np.int64)
            own = _leading(self.starts, lengths)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            w = _weights({c: self.arrays[c][own] for c in (name,)}, name)
            sums = np.cumsum(w * w)
            ends = np.cumsum(lengths)
            before = np.concatenate(([0.0], sums))[ends - lengths]
            rest = np.sqrt(np.maximum(1.0 - sums + before[doc], 0.0) + SQUARE_SLACK)
            tail = np.ones(len(lengths))
            tail[lengths > 0] = rest[ends[lengths > 0] - 1]
            self._held[name] = doc, self.pos[own], w, rest, tail
        return self._held[name]


def _met(a: _Block, b: _Block, same: bool, name: str, threshold: float) -> Iterator[np.ndarray]:
    """Codes (document of a) * (documents of b) + (document of b) of pairs that the bound leaves, in ascending slices."""
    da, ta, wa, ra, tail_a = a.prefixes(name)
    db, tb, wb, rb, tail_b = b.prefixes(name)
    if not len(da) or not len(db):
        return
    order = b.arrays[f"{name}_order"]
    db, wb, rb, tb = db[order], wb[order], rb[order], tb[order]
    first = np.flatnonzero(np.append(True, tb[1:] != tb[:-1]))
    terms, count = tb[first], np.diff(np.append(first, len(tb)))
    # Terms of a in order, so that the search runs through memory once.
    asked = a.arrays[f"{name}_order"]
    sought = ta[asked]
    place = np.minimum(np.searchsorted(terms, sought), len(terms) - 1)
    n, low = np.zeros(len(da), np.int64), np.zeros(len(da), np.int64)
    n[asked] = np.where(terms[place] == sought, count[place], 0)
    low[asked] = first[place]
    held = n > 0
    da, wa, ra, n, low = da[held], wa[held], ra[held], n[held], low[held]
    if not len(n):
        return
    docs = len(b.sizes)
    # Slices of whole documents of a.
    last = np.flatnonzero(np.append(da[1:] != da[:-1], True)) + 1
    upto, at = np.cumsum(n)[last - 1], 0
    while at < len(last):
        begin, done = (last[at - 1], upto[at - 1]) if at else (0, 0)
        stop = max(at + 1, int(np.searchsorted(upto, done + MEETINGS, "right")))
        left, times, at = np.arange(begin, last[stop - 1]), n[begin : last[stop - 1]], stop
        right = _leading(low[left], times)
        document = db[right]
        cell = np.repeat((da[left] - da[begin]) * docs, times) + document
        part = np.repeat(wa[left], times) * wb[right]
        # The meetings of a pair side by side, in the order of their terms.
        bits = len(cell).bit_length()
        if int(da[left[-1]] - da[begin] + 1) * docs < 1 << (62 - bits):
            by = np.sort((cell << bits) + np.arange(len(cell)))
            cell, by = by >> bits, by & ((1 << bits) - 1)
        else:
            by = np.argsort(cell, kind="stable")
            cell = cell[by]
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        score, found = np.add.reduceat(part[by], heads), cell[heads] + da[begin] * docs
        final = by[np.append(heads[1:], len(by)) - 1]
        rest1, rest2 = ra[left][np.searchsorted(np.cumsum(times), final, "right")], rb[right[final]]
        x, y = found // docs, found % docs
        # Any other shared term lies behind the last one met, and behind one of the two prefixes.
        more = np.maximum(np.minimum(tail_a[x], rest1) * rest2, rest1 * np.minimum(tail_b[y], rest2))
        kept = score + more >= threshold - SLACK
        yield found[kept & (x < y)] if same else found[kept]


def _shared(a: _Block, b: _Block, pairs: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, documents, pair, entry of a, entry of b) of shared terms, for the pairs of one document of a at a time."""
    docs = len(b.sizes)
    left, right = pairs // docs, pairs % docs
    heads = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(pairs) else np.zeros(0, int)
    for low, high in zip(heads, [*heads[1:], len(pairs)]):
        start, stop = a.starts[left[low]], a.ends[left[low]]
        own = a.pos[start:stop]
        for at in range(low, high, 512):
            some = right[at : min(high, at + 512)]
            sizes = b.sizes[some].astype(np.int64)
            entry = _leading(b.starts[some], sizes)
            place = np.minimum(np.searchsorted(own, b.pos[entry]), len(own) - 1)
            hit = np.flatnonzero(own[place] == b.pos[entry])
            yield at, at + len(some), len(some), np.repeat(np.arange(len(some)), sizes)[hit], start + place[hit], entry[hit]


def _jsd_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 0.5 * (a * np.log2((a + b) / a) + b * np.log2((a + b) / b))


def scored_block_pairs(a: _Block, b: _Block, same: bool, searches: list[tuple[str, float]]) -> tuple[np.ndarray, ...]:
    """(document of a, document of b, cosine, jsd) of pairs that reach the threshold of one of the ``searches``.

    A search is ("w", threshold) by cosine, or ("share", threshold) by Jensen-Shannon similarity. The latter is
    computed where blocks hold shares.
    """
    met = [codes for search in searches for codes in _met(a, b, same, *search)]
    pairs = np.unique(np.concatenate(met)) if len(searches) > 1 and met else np.concatenate(met or [np.zeros(0, np.int64)])
    cosine, jsd = np.zeros(len(pairs)), np.zeros(len(pairs))
    for low, high, size, pair, x, y in _shared(a, b, pairs):
        if "w" in a.arrays:
            cosine[low:high] = np.bincount(pair, a.arrays["w"][x] * b.arrays["w"][y], size)
        if "share" in a.arrays:
            jsd[low:high] = np.bincount(pair, _jsd_parts(a.arrays["share"][x], b.arrays["share"][y]), size)
    kept = np.zeros(len(pairs), bool)
    for name, threshold in searches:
        kept |= (cosine if name == "w" else jsd) >= threshold - SLACK
    pairs = pairs[kept]
    return pairs // len(b.sizes), pairs % len(b.sizes), cosine[kept], jsd[kept]


def similar_block_pairs(blocks: DataFrame, searches: list[tuple[str, float]]) -> DataFrame:
    """(id1, id2, cosine, jsd), id1 < id2, of all pairs of documents that reach the threshold of a search.

    Scores are not rounded yet, so a pair may lie a millionth below.
    """
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    names = [c for c in blocks.columns if c not in ("n", "ids")]
    a, b = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in ("n", "ids", *names))) for side in "ab")
    # Two blocks meet once; which of them stands left is dealt evenly.
    even = F.xxhash64("a_n").bitwiseXOR(F.xxhash64("b_n")).bitwiseAND(F.lit(1)) == 0
    once = (F.col("a_n") == F.col("b_n")) | ((F.col("a_n") < F.col("b_n")) == even)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, number = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k] for c in batch.schema.names}
                view = lambda side: _Block({c: row[f"{side}_{c}"].as_buffer() for c in names})  # noqa: E731, B023
                n, m = row["a_n"].as_py(), row["b_n"].as_py()
                if n != number:
                    left, number = view("a"), n
                i, j, cosine, jsd = scored_block_pairs(left, left if n == m else view("b"), n == m, searches)
                ids = [row[f"{side}_ids"].values.take(pa.array(at)) for side, at in (("a", i), ("b", j))]
                yield pa.record_batch([*ids, pa.array(cosine), pa.array(jsd)], names=["id1", "id2", "cosine", "jsd"])

    met = a.hint("shuffle_replicate_nl").join(b, once).mapInArrow(run, f"id1 {kind}, id2 {kind}, cosine double, jsd double")
    return met.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "cosine", "jsd")
