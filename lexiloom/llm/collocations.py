"""Phrase collocations from vertically partitioned, depth-truncated suffix trees.

The suffix at each word is cut after ``DEPTH`` words or at the end of its piece. A first pass counts how
many suffixes start with which prefix (a hashed slot of language and first word). Slots are packed into
groups under a memory budget; slots beyond the budget are split by their second word, and slots that
are still beyond it by the third. A second pass hands each suffix to its group, summed up per slice of
text, so a frequent phrase travels once per slice. Every group then builds its suffix subtrees on its
own: the sorted distinct suffixes are the leaves, and the count of a node is the total of its leaves.
Nodes above a split get their parts from several groups, and these are summed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lexiloom.llm.shingles import mix
from lexiloom.session import settle

#: Characters that end a piece; tab and space part words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
DEPTH = 3
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
BUDGET = 1 << 22
LEAST_BUDGET = 1 << 15
SLICE_WORDS = 1 << 19
_TABLE = bytes(10 if b in PIECE_ENDS else 32 if b == 9 else b for b in range(256))
_K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Numbers(dict):
    """Numbers words in order of appearance: 0 ends a piece, -1 is no word."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.words)
        self.words.append(word)
        return k


class Slice:
    """Words of one language in a slice of a partition."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, text: str) -> int:
        tokens = text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        self.parts += [ids[ids >= 0], np.zeros(1, np.int32)]
        self.size += len(tokens)
        return len(tokens)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct suffixes as rows of DEPTH numbers, their counts)."""
        x = np.concatenate([*self.parts, np.zeros(2, np.int32)]).astype(np.int64)
        a, b, c = x[:-2], x[1:-1], x[2:]
        c = np.where(b == 0, 0, c)
        here, base = a > 0, len(self.numbers.words)
        if base >= 1 << 21:
            rows, counts = np.unique(np.stack([a, b, c], 1)[here], axis=0, return_counts=True)
            return rows, counts
        keys, counts = np.unique((a[here] * base + b[here]) * base + c[here], return_counts=True)
        rows = np.empty((len(keys), DEPTH), np.int64)
        keys, rows[:, 2] = np.divmod(keys, base)
        rows[:, 0], rows[:, 1] = np.divmod(keys, base)
        return rows, counts

    def hashes(self, lang: str) -> np.ndarray:
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.numbers.words), np.uint64, len(self.numbers.words))


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, Slice]]:
    """Slices of about ``limit`` words in all languages together, at each text's end."""
    open_slices: dict[str, Slice] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            size += open_slices.setdefault(lang.as_py(), Slice()).add(text.as_py())
            if size >= limit:
                yield from open_slices.items()
                open_slices, size = {}, 0
    yield from open_slices.items()


def prefix_hashes(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the first, the first two and all three words of suffixes."""
    one = mix(words[rows[:, 0]])
    two = mix(one * _K2 + words[rows[:, 1]])
    return one, two, mix(two * _K3 + words[rows[:, 2]])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Layout:
    """Which group a suffix belongs to: by its first slot, in split slots by its second, then by hash."""

    def __init__(self, one: np.ndarray, budget: int):
        self.budget, self.split_one = budget, one > budget
        self.group_one, self.groups = pack(np.where(self.split_one, 0, one), budget, 0)
        self.split_two = np.zeros(SLOTS, bool)
        self.group_two, self.pieces = np.zeros(SLOTS, np.int64), np.ones(SLOTS, np.int64)

    def refine(self, two: np.ndarray) -> None:
        self.split_two = two > self.budget
        self.pieces = np.where(self.split_two, -(-two // self.budget), 1)
        self.group_two, self.groups = pack(np.where(self.split_two, 0, two), self.budget, self.groups)
        ahead = np.cumsum(self.pieces * self.split_two) - self.pieces * self.split_two
        self.group_two = np.where(self.split_two, self.groups + ahead, self.group_two)
        self.groups += int((self.pieces * self.split_two).sum())

    def assign(self, hashes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(group, depth of the last node whose leaves may lie in several groups) of each suffix."""
        s1, s2 = _slot(hashes[0]), _slot(hashes[1])
        deep, deeper = self.split_one[s1], self.split_one[s1] & self.split_two[s2]
        group = np.where(deep, self.group_two[s2], self.group_one[s1])
        piece = (hashes[2] >> np.uint64(8)).astype(np.int64) % self.pieces[s2]
        return np.where(deeper, group + piece, group), deep.astype(np.int64) + deeper


def pack(sizes: np.ndarray, budget: int, start: int) -> tuple[np.ndarray, int]:
    """Fills groups with slots in order, a new one when the next slot would exceed the budget."""
    groups, at, room = np.zeros(len(sizes), np.int64), start, budget
    for k, size in enumerate(sizes.tolist()):
        if size > room:
            at, room = at + 1, budget
        groups[k] = at
        room -= size
    return groups, at + 1


def _slot_counts(rows: DataFrame, layout: Layout | None) -> DataFrame:
    """(lang, slot, total): suffixes by first slot or, under a layout, by second slot in split ones."""

    def run(batches):
        for lang, part in _slices(batches, SLICE_WORDS):
            leaves, counts = part.leaves()
            one, two, _ = prefix_hashes(leaves, part.hashes(lang))
            if layout is not None:
                inside = layout.split_one[_slot(one)]
                two, counts = two[inside], counts[inside]
            totals = np.bincount(_slot(one if layout is None else two), weights=counts, minlength=1).astype(np.int64)
            used = np.flatnonzero(totals)
            yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(totals[used])], names=["lang", "slot", "total"])

    found = rows.mapInArrow(run, "lang string, slot bigint, total bigint")
    return settle(found.groupBy("lang", "slot").agg(F.sum("total").alias("total")))


def _slot_array(counts: DataFrame) -> np.ndarray:
    """Totals of all slots; at most SLOTS rows reach the driver."""
    out = np.zeros(SLOTS, np.int64)
    for row in counts.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        out[row["slot"]] = row["total"]
    return out


BUNDLE = "grp bigint, lang string, words binary, leaves binary, counts binary, shared binary"


def _bundles(rows: DataFrame, layout: Layout) -> DataFrame:
    """One row per slice, language and group: its words and its distinct suffixes with counts."""

    def run(batches):
        for lang, part in _slices(batches, SLICE_WORDS):
            leaves, counts = part.leaves()
            group, shared = layout.assign(prefix_hashes(leaves, part.hashes(lang)))
            order = np.argsort(group, kind="stable")
            group, leaves, counts, shared = group[order], leaves[order], counts[order], shared[order]
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
            out, size = [], 0
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                used, local = np.unique(leaves[a:b], return_inverse=True)
                words = b"\n".join([part.numbers.words[k] for k in used.tolist()])
                local = np.ascontiguousarray(local.reshape(-1, DEPTH).T.astype(np.int32))
                # Number 0 of a bundle must stay the end of a piece.
                if len(used) and used[0] != 0:
                    words, local = b"\n" + words, local + np.int32(1)
                out.append((int(group[a]), lang, words, local.tobytes(), counts[a:b].astype(np.int64).tobytes(), shared[a:b].astype(np.int8).tobytes()))
                size += len(words) + 21 * (b - a)
                if size >= 1 << 23:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    def _batch(out):
        kinds = [pa.int64(), pa.string()] + [pa.binary()] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in BUNDLE.split(", ")])

    return rows.mapInArrow(run, BUNDLE)


NODES = "lang string, w1 string, w2 string, w3 string, total bigint"


def _subtree(lang: str, bundles: list[tuple], least: int) -> pa.RecordBatch:
    """Nodes of one group's subtrees with at least ``least`` suffixes, and parts of shared nodes."""
    numbers: dict[bytes, int] = {b"": 0}
    leaves, counts, shared = [], [], []
    for words, local, n, s in bundles:
        known = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words.split(b"\n")), np.int32)
        leaves.append(known[np.frombuffer(local, np.int32).reshape(DEPTH, -1)])
        counts.append(np.frombuffer(n, np.int64))
        shared.append(np.frombuffer(s, np.int8))
    leaf, count, part = np.concatenate(leaves, 1), np.concatenate(counts), np.concatenate(shared)
    order = np.lexsort(leaf[::-1])
    leaf, count, part = leaf[:, order], count[order], part[order]
    names = list(numbers)
    found = {k: [] for k in range(DEPTH + 1)}
    for depth in range(1, DEPTH + 1):
        path = leaf[:depth]
        starts = np.flatnonzero(np.r_[True, (path[:, 1:] != path[:, :-1]).any(0)])
        totals = np.add.reduceat(count, starts)
        spread = np.maximum.reduceat(part, starts) >= depth
        keep = (path[depth - 1, starts] > 0) & ((totals >= least) | spread)
        for d in range(DEPTH):
            found[d].append(path[d, starts[keep]] if d < depth else np.zeros(int(keep.sum()), np.int64))
        found[DEPTH].append(totals[keep])
    columns = [np.concatenate(found[d]) for d in range(DEPTH)]
    texts = [pa.array([names[k].decode("utf-8", "surrogatepass") if k else None for k in c.tolist()], pa.string()) for c in columns]
    total = np.concatenate(found[DEPTH])
    return pa.record_batch([pa.array([lang] * len(total), pa.string()), *texts, pa.array(total, pa.int64())], names=[c.split()[0] for c in NODES.split(", ")])


def phrase_counts(docs: DataFrame, least: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(nodes with at least ``least`` occurrences, words per language); see NODES."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    first = _slot_counts(rows, None)
    one = _slot_array(first)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    layout = Layout(one, max(min(budget, int(one.sum()) // tasks), LEAST_BUDGET))
    if layout.split_one.any():
        layout.refine(_slot_array(_slot_counts(rows, layout)))

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["grp"], row["lang"]) != key:
                    if held:
                        yield _subtree(key[1], held, least)
                    key, held = (row["grp"], row["lang"]), []
                held.append((row["words"], row["leaves"], row["counts"], row["shared"]))
        if held:
            yield _subtree(key[1], held, least)

    dealt = _bundles(rows, layout).repartition("grp").sortWithinPartitions("grp", "lang")
    parts = dealt.mapInArrow(run, NODES)
    nodes = parts.groupBy("lang", "w1", "w2", "w3").agg(F.sum("total").alias("total")).where(F.col("total") >= least)
    return settle(nodes), first.groupBy("lang").agg(F.sum("total").alias("n"))


def collocations(docs: DataFrame, min_count: int = 10, keep_percent: int = 50, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    ``docs`` has lang and text; a null lang counts as und. Texts lower-case A-Z, are split into pieces at
    PIECE_ENDS and into words at spaces and tabs; null and empty texts have none. Phrases of two to
    three words with ``min_count`` occurrences (overlaps included) score by their weakest cut, floor of
    10^6 a a / (l r) in exact decimals, the smaller cut on ties. A phrase goes if a longer candidate that
    holds it has at least ``keep_percent`` of its occurrences. Ties in rank go to the larger count, then
    to the phrase in byte order. Repeated rows count as often as they occur, an empty table gives no
    rows, very long texts are read whole, other columns are ignored.
    """
    nodes, sizes = phrase_counts(docs, min_count, budget)
    phrases = nodes.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "w1", "w2", "w3", F.col("total").alias("a"))
    known = phrases.select("lang", "phrase", "a")
    long = phrases.where("w2 is not null")
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), F.concat_ws(" ", *left).alias("first"), F.concat_ws(" ", *right).alias("rest"))
    both = F.when(F.col("w3").isNull(), F.array(cut(1, ["w1"], ["w2"]))).otherwise(F.array(cut(1, ["w1"], ["w2", "w3"]), cut(2, ["w1", "w2"], ["w3"])))
    cuts = long.select("lang", "phrase", "a", F.explode(both).alias("cut")).select("lang", "phrase", "a", "cut.*")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    three = phrases.where("w3 is not null")
    inner = F.array(F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3"))
    holders = three.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(holders, ["lang", "phrase"], "left").where(
        F.expr(f"longer is null or cast(100 as decimal(3,0)) * {wide('longer')} < cast({keep_percent} as decimal(3,0)) * {wide('a')}")
    )
    best = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
