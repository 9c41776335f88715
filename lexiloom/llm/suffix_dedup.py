"""Removal of repeated byte strings by longest previous factors in suffix order.

A string of ``min_bytes`` that starts at two places has the same smallest gram hash at both. Texts are cut
into runs of neighbouring windows with a common smallest hash, and only runs of one hash can hold equal
windows. Hashes that occur once fall away. Runs of a hash that are all alike are copies as a whole. What
is left, one run of each content, meets by hash in a task: its suffixes are sorted to depth ``min_bytes``
by prefix doubling, equal ones by position, and the previous and next smaller positions in that order
give each suffix its longest earlier match. Suffixes whose match reaches ``min_bytes`` are later copies;
the same arrays over falling positions give the first ones, if these are to go as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexiloom.llm.fill_in_middle import byte_slices
from lexiloom.llm.shingles import mix
from lexiloom.session import settle

MIN_BYTES = 200
GRAM = 32
PIECE = 1 << 21
MAX_RUN = 1024
TASK_BYTES = 1 << 20
HOT_RUNS = 1 << 12
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 15) - 1, base, dtype=np.uint64)], dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams from differences of one running polynomial sum, as signed longs."""
    n = len(data)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), dtype=np.uint64)])
    return mix((sums[gram:] - sums[:-gram]) * _power(pow(_BASE, -1, 1 << 64), n - gram + 1)).view(np.int64)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every ``width`` neighbours, from minima over doubling spans."""
    best, span = values, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    rest = width - span
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def window_runs(data: np.ndarray, min_bytes: int) -> Iterator[tuple[int, int, int, bool]]:
    """(first window, windows, smallest hash, whether its gram occurs twice) of each run of a text.

    Long texts are read in pieces that overlap by a window; a run longer than MAX_RUN, as in periodic
    text, is cut. Both only part windows, which still meet by their hash.
    """
    gram = min(GRAM, min_bytes)
    width = min_bytes - gram + 1
    for at in range(0, max(len(data) - min_bytes + 1, 0), PIECE):
        hashes = gram_hashes(data[at : at + PIECE + min_bytes - 1], gram)
        low = window_minima(hashes, width)
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        ends = np.r_[starts[1:], len(low)]
        for a, b, v in zip(starts.tolist(), ends.tolist(), low[starts].tolist()):
            twice = np.count_nonzero(hashes[a : b + width - 1] == v) > 1
            for c in range(a, b, MAX_RUN):
                yield at + c, min(b - c, MAX_RUN), v, twice


RUNS = "h binary, id bigint, v bigint, d bigint, p bigint, m int, twice boolean"


def _runs(rows: DataFrame, min_bytes: int) -> DataFrame:
    names = [c.split()[0] for c in RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 22):
                doc, found = [], []
                for k, text in enumerate(part["text"]):
                    raw = text.as_buffer()
                    view, data = memoryview(raw), np.frombuffer(raw, np.uint8)
                    for p, m, v, twice in window_runs(data, min_bytes):
                        digest = xxhash.xxh3_64_intdigest(view[p : p + m + min_bytes - 1])
                        found.append((v, digest, p, m, twice))
                        doc.append(k)
                if not found:
                    continue
                v, d, p, m, twice = zip(*found)
                doc = pa.array(doc)
                columns = [
                    part["h"].take(doc), part["id"].take(doc), pa.array(v, pa.int64()), pa.array(np.array(d, np.uint64).view(np.int64)),
                    pa.array(p, pa.int64()), pa.array(m, pa.int32()), pa.array(twice, pa.bool_()),
                ]
                yield pa.record_batch(columns, names=names)

    return rows.mapInArrow(run, RUNS)


def suffix_ranks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ranks) of all suffixes with ``depth`` bytes inside their string, by prefix doubling.

    ``data`` holds strings of ``sizes`` bytes from ``starts``. Ranks of a depth are numbers of distinct
    prefixes in byte order; twice the depth is a pair of ranks, the last step overlaps.
    """
    room = np.repeat(starts + sizes, sizes) - np.arange(len(data))
    span = 1
    rank = data.astype(np.int64)
    at = np.arange(len(data))
    while span < depth:
        step = min(span, depth - span)
        at = at[room[at] >= span + step]
        pairs = rank[at] * (len(data) + 256) + rank[at + step]
        rank = np.zeros(len(data), np.int64)
        rank[at] = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        span += step
    return at, rank[at]


def factor_matches(position: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether each suffix has an earlier match of full depth, from its longest-previous-factor entry.

    In suffix order, with equal suffixes by position, the previous smaller position of an entry that
    agrees with its predecessor to full depth is that predecessor; every other entry is the first of
    its kind, and neither its previous nor its next smaller position agrees to full depth.
    """
    order = np.lexsort((position, rank))
    previous = np.full(len(order), -1)
    alike = np.r_[False, rank[order[1:]] == rank[order[:-1]]] if len(order) else np.zeros(0, bool)
    previous[order[alike]] = order[np.flatnonzero(alike) - 1]
    return previous >= 0


def ranges(offsets: np.ndarray) -> list[dict]:
    """Maximal runs of ascending offsets."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) != 1)
    return [{"s": a, "e": b} for a, b in zip(offsets[np.r_[0, cut + 1]].tolist(), offsets[np.r_[cut, len(offsets) - 1]].tolist())]


MATCHES = "v bigint, d bigint, found array<struct<s:bigint,e:bigint>>"
_MATCHES = pa.schema([("v", pa.int64()), ("d", pa.int64()), ("found", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))])


def _match_runs(held: list[tuple], min_bytes: int, keep_first: bool) -> pa.RecordBatch:
    """Repeated windows of runs (v, d, place, bytes), joined in order of place."""
    held.sort(key=lambda r: r[2])
    sizes = np.array([len(r[3]) for r in held])
    starts = np.cumsum(sizes) - sizes
    at, rank = suffix_ranks(np.frombuffer(b"".join(r[3] for r in held), np.uint8), starts, sizes, min_bytes)
    gone = factor_matches(at, rank)
    if not keep_first:
        gone |= factor_matches(-at, rank)
    hit = at[gone]
    edges = np.searchsorted(hit, np.r_[starts, sizes.sum()])
    out = [{"v": r[0], "d": r[1], "found": ranges(hit[a:b] - s)} for r, a, b, s in zip(held, edges[:-1], edges[1:], starts)]
    return pa.RecordBatch.from_pylist([r for r in out if r["found"]], schema=_MATCHES)


def _matches(segments: DataFrame, min_bytes: int, keep_first: bool) -> DataFrame:
    """Suffix arrays over whole groups of v, some TASK_BYTES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("v", "d", "id", "h", "p", "run")]
            for v, d, i, h, p, b in zip(*columns):
                if size >= TASK_BYTES and v != held[-1][0]:
                    yield _match_runs(held, min_bytes, keep_first)
                    held, size = [], 0
                held.append((v, d, (i, h, p), b))
                size += len(b)
        if held:
            yield _match_runs(held, min_bytes, keep_first)

    return segments.repartition("v").sortWithinPartitions("v").mapInArrow(run, MATCHES)


def _hot_matches(segments: DataFrame, min_bytes: int, keep_first: bool) -> DataFrame:
    """The same for hashes with more than HOT_RUNS contents: windows are counted by their digests,
    which is exact, spreads over all tasks and needs no group of runs in one task."""
    kinds = "v bigint, d bigint, id bigint, h binary, p bigint, o bigint, w1 bigint, w2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "run", 1 << 18):
                which, offset, digests = [], [], []
                for k, raw in enumerate(part["run"].to_pylist()):
                    n = len(raw) - min_bytes + 1
                    which += [k] * n
                    offset += range(n)
                    digests += [xxhash.xxh3_128_digest(raw[j : j + min_bytes]) for j in range(n)]
                which, words = pa.array(which, pa.int64()), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [part[c].take(which) for c in ("v", "d", "id", "h", "p")]
                names = [c.split()[0] for c in kinds.split(", ")]
                yield pa.record_batch([*columns, pa.array(offset, pa.int64()), pa.array(words[:, 0]), pa.array(words[:, 1])], names=names)

    windows = settle(segments.mapInArrow(run, kinds))
    place = F.struct("id", "h", (F.col("p") + F.col("o")).alias("p"))
    counted = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first")).where("c > 1")
    gone = windows.join(counted, ["w1", "w2"]).where(place != F.col("first") if keep_first else F.lit(True))
    return gone.select("v", "d", F.struct(F.col("o").alias("s"), F.col("o").alias("e")).alias("r")).groupBy("v", "d").agg(F.collect_list("r").alias("found"))


def _segments(own: DataFrame, contents: DataFrame, min_bytes: int) -> DataFrame:
    """The bytes of the first run of each content; one row of each (text, id) gives them."""
    wanted = contents.select("v", "d", "first.*").groupBy("h", "id").agg(F.collect_list(F.struct("v", "d", "p", "m")).alias("runs"))
    texts = own.groupBy("h", "id").agg(F.first("text").alias("text"))
    kinds = "v bigint, d bigint, id bigint, h binary, p bigint, run binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 22):
                out = []
                for h, i, text, runs in zip(part["h"].to_pylist(), part["id"].to_pylist(), part["text"], part["runs"].to_pylist()):
                    raw = text.as_buffer().to_pybytes()
                    out += [(r["v"], r["d"], i, h, r["p"], raw[r["p"] : r["p"] + r["m"] + min_bytes - 1]) for r in runs]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in kinds.split(", ")])

    return settle(texts.join(wanted, ["h", "id"]).mapInArrow(run, kinds))


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CUT.split(", ")]
    for batch in batches:
        for part in byte_slices(batch, "text"):
            out = []
            for text, found, whole in zip(part["text"], part["found"], part["whole"].to_pylist()):
                raw = text.as_buffer().to_pybytes()
                n = len(raw)
                if whole and n >= min_bytes:
                    spans = [(0, n)]
                elif found.is_valid and len(found):
                    pairs = found.values.flatten()
                    s, e = (x.to_numpy() for x in pairs)
                    order = np.argsort(s)
                    s, e = s[order], np.maximum.accumulate(e[order] + min_bytes)
                    fresh = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                    spans = list(zip(s[fresh].tolist(), e[np.r_[fresh[1:] - 1, len(e) - 1]].tolist()))
                else:
                    spans = []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((n, sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], b"".join(kept)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.binary()])]
            yield pa.record_batch([part["doc_id"], *columns], names=names)


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = True, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for each row of ``docs`` (doc_id, text).

    Removes every byte covered by a string of ``min_bytes`` UTF-8 bytes that starts elsewhere too, in the
    same document or another; with ``keep_first`` the first occurrence stays, in order of doc_id (null
    last), text digest and position. Strings are judged on the input and never cross documents. A null
    text counts as empty; texts under ``min_bytes`` stay whole. Rows that repeat a text count as
    occurrences of it; those that repeat the doc_id as well share one fate. An empty table gives no rows,
    very long texts are read in pieces that overlap, other columns are ignored. ``kept`` is binary, as a
    cut may fall inside a character. Runs with equal 64-bit hash and 64-bit digest count as equal.
    """
    own = docs.select(
        F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).alias("h"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce("text", F.lit("")).alias("text"),
    )
    runs = settle(_runs(own.where(F.octet_length("text") >= min_bytes).select("h", "id", "text"), min_bytes))
    place = F.struct("id", "h", "p")
    found = [F.count(F.lit(1)).alias("k"), F.min("d").alias("d1"), F.max("d").alias("d2"), F.max("twice").alias("t")]
    first = [F.min(place).alias("f")] if keep_first else []
    hashes = runs.groupBy("v").agg(*found, *first).where("k > 1 or t")
    hashes = hashes.select("v", F.expr("d1 = d2 and not t").alias("alike"), *(["f"] if keep_first else []))
    # Rows of one text fold here: its runs are the same in all copies.
    met = runs.select("h", "id", "v", "d", "p", "m").join(hashes, "v")
    folded = met.groupBy("h", "p", "m", "v", "d", "alike", *(["f"] if keep_first else [])).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"))
    places = settle(folded)
    mixed = places.where("not alike")
    contents = settle(mixed.groupBy("v", "d").agg(F.sum("k").alias("k"), F.min(F.struct("id", "h", "p", "m")).alias("first")))
    crowds = contents.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_runs).select("v")
    segments = _segments(own.select("h", "id", "text"), contents, min_bytes)
    matched = _matches(segments.join(crowds, "v", "left_anti"), min_bytes, keep_first)
    matched = matched.unionByName(_hot_matches(segments.join(crowds, "v", "left_semi"), min_bytes, keep_first))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("s"), (F.col("m") - 1).cast("bigint").alias("e")))
    judged = mixed.join(contents.select("v", "d", F.col("k").alias("copies"), F.struct("first.id", "first.h", "first.p").alias("f1")), ["v", "d"])
    judged = judged.join(matched, ["v", "d"], "left")
    later = place != F.col("f1") if keep_first else F.col("copies") > 1
    judged = judged.select("h", "p", F.when(later, whole).otherwise(F.col("found")).alias("found"))
    alike = places.where("alike").where(place != F.col("f") if keep_first else F.lit(True)).select("h", "p", whole.alias("found"))
    spans = alike.unionByName(judged).select("h", "p", F.explode("found").alias("r")).select("h", F.struct((F.col("p") + F.col("r.s")).alias("s"), (F.col("p") + F.col("r.e")).alias("e")).alias("r"))
    lists = spans.groupBy("h").agg(F.collect_list("r").alias("found"))
    if keep_first:
        owners = own.groupBy("h").agg(F.min("id").alias("owner"))
        rows = own.join(owners, "h").join(lists, "h", "left").withColumn("whole", F.col("id") != F.col("owner"))
    else:
        rows = own.join(lists, "h", "left").withColumn("whole", F.lit(False))
    return rows.select("doc_id", "text", "found", "whole").mapInArrow(lambda b: _cut(b, min_bytes), CUT)
