"""N-gram Jaccard join by signature trees.

Documents are sets of five-word shingles; two link when 100 * intersection >= 80 * union.

1. Equal sets are folded into classes; the smallest doc_id stands for its class.
2. Every set posts its first n - ceil(0.8 n) + least(n) shingles in one global order, where least(n)
   is a tenth of n. Two linked sets share the first least(smaller) of their common shingles in both
   postings, whatever the order; the order (frequency level from a fixed-size count sketch over all
   documents, then hash) sends widespread passages to the end, where they are not posted.
3. A posted shingle routes its documents to a hub, its smallest document. A document with fewer shared
   shingles than any partner could ask of it leaves; the others may leave hubs with less than half
   of that many shingles in all, as two linked sets then still meet in another hub. So documents that
   share a passage only are not compared. Hubs of more than ``BLOCK`` documents are dealt into blocks
   by size class and hash; only blocks whose size ranges can link meet.
4. Each meeting of blocks builds signature trees: leaves hold token bitmaps and sizes, inner nodes the
   OR of their children's bitmaps and the range of their sizes. A dual traversal drops node pairs whose
   largest possible overlap is too small; surviving leaf pairs are verified on the sets themselves.
   A pair that shares several hubs counts under the smallest one only.
5. A meeting returns per document its number of links and a spanning root, never the pairs, so
   results stay linear in the documents even for large groups of near copies.

Nothing is capped: a hub of any size is split, and every document is compared through every hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lexiloom.llm import shingles as sh
from lexiloom.operators.components import connected_components
from lexiloom.session import settle

CELL_BITS = 18
SLICES = 64
BLOCK = 256
FANOUT = 8


def linked(overlap, size_a, size_b):
    """100 * intersection >= 80 * union, in whole numbers."""
    return 180 * overlap >= 80 * (size_a + size_b)


# --- sets of all documents -------------------------------------------------------------------


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per document, then the task's share of the count sketch in slices."""
    counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for pdf in batches:
        sizes, first, second = [], [], []
        for text in pdf["text"]:
            items = sh.shingle_set(text)
            if len(items):
                np.add.at(counts, (items >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
            a, b = sh.digest(items)
            sizes.append(len(items))
            first.append(a)
            second.append(b)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": sizes, "d1": first, "d2": second, "slice": None, "counts": None})
    if counts.any():
        parts = counts.astype("<i4").reshape(SLICES, -1)
        yield pd.DataFrame(
            {"doc_id": None, "n": None, "d1": None, "d2": None, "slice": range(SLICES), "counts": [p.tobytes() for p in parts]}
        )


def _add_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        for k, raw in zip(pdf["slice"], pdf["counts"]):
            part = np.frombuffer(raw, "<i4").astype(np.int64)
            sums[k] = sums[k] + part if k in sums else part
    if sums:
        yield pd.DataFrame({"slice": list(sums), "counts": [v.astype("<i8").tobytes() for v in sums.values()]})


def described(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, d1, d2) of every document, and the frequency level of each sketch cell.

    The sketch is a fixed 2^18 counters whatever the corpus; only its sums reach the driver.
    """
    both = settle(
        docs.select("doc_id", "text").mapInPandas(
            _describe, "doc_id bigint, n bigint, d1 bigint, d2 bigint, slice int, counts binary"
        )
    )
    parts = both.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice")
    levels = np.zeros((SLICES, (1 << CELL_BITS) // SLICES), dtype=np.uint8)
    for row in parts.mapInPandas(_add_slices, "slice int, counts binary").collect():
        counts = np.frombuffer(row["counts"], "<i8")
        levels[row["slice"]] = np.ceil(np.log2(counts + 1.0)).astype(np.uint8)
    return both.where("slice IS NULL").select("doc_id", "n", "d1", "d2"), levels.reshape(-1)


# --- candidates ------------------------------------------------------------------------------


def least(n):
    """How many posted shingles two linked sets have in common at least, if n is the smaller size."""
    return (n + 9) // 10


def prefix(items: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles a set posts, its first ones by frequency level, then hash."""
    n = len(items)
    keep = n - (80 * n + 99) // 100 + least(n)
    level = levels[(items >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    return items[np.argsort(level, kind="stable")[:keep]]


def routed(routes: DataFrame) -> DataFrame:
    """(id, hub, n, copies) that have to be kept of (id, hub, keys, n, copies).

    A partner of a set of size n has at least ceil(0.8 n) shingles, so the two share ``need`` of n's
    posted shingles. Each side may leave hubs with (need - 1) / 2 shingles in all: what both leave is
    less than what they share.
    """
    need = F.expr("(((80 * n + 99) DIV 100) + 9) DIV 10")
    own = Window.partitionBy("id")
    kept = routes.select(
        "*",
        need.alias("need"),
        F.sum("keys").over(own).alias("total"),
        F.sum("keys").over(own.orderBy("keys", "hub").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"),
    )
    return kept.where("total >= need AND so_far > (need - 1) DIV 2").select("id", "hub", "n", "copies")


def _postings(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, keys = [], []
            for i, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
                items = sh.shingle_set(text)
                if len(items):
                    posted = prefix(items, shared.value)
                    keys.append(posted.view(np.int64))
                    ids.append(np.full(len(posted), i, dtype=np.int64))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "id": np.concatenate(ids)})

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInPandas(post, "key bigint, id bigint")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items) of the documents whose ids are among ``ids``, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(sh.id_bitmap(ids))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[sh.in_bitmap(shared.value, pdf["position"].to_numpy())]
            sets = [sh.shingle_set(t).tobytes() for t in pdf["text"]]
            out = pd.DataFrame({"id": pdf["id"].to_numpy(), "items": pd.Series(sets, dtype=object)})
            yield out[out["items"].str.len() > 0]

    position = F.pmod(F.xxhash64("doc_id"), F.lit(1 << sh.ID_BITS)).alias("position")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text", position)
    return texts.mapInPandas(build, "id bigint, items binary")


def meetings(routes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, copies, hubs, meets) from (id, hub, n, copies): a set's hubs and the meetings it attends.

    A meeting is (hub, c1, b1, c2, b2): block b1 of size class c1 against block b2 of class c2. Hubs
    of at most ``block`` sets are one meeting. Size classes are powers of 1.26, so sets that link
    lie in the same class or in neighbouring ones.
    """
    r = routes.withColumn("c", F.floor(F.log("n") / F.log(F.lit(1.26))).cast("int"))
    per_class = r.groupBy("hub", "c").agg(F.count(F.lit(1)).alias("k"))
    blocks = per_class.groupBy("hub").agg(
        F.sum("k").alias("k"),
        F.map_from_entries(F.collect_list(F.struct("c", F.ceil(F.col("k") / block).cast("int").alias("nb")))).alias("nbs"),
    )
    r = r.join(blocks.where("k >= 2"), "hub")
    big = F.col("k") > block
    count = lambda c: F.coalesce(F.try_element_at("nbs", c), F.lit(0))
    b = F.when(big, F.pmod(F.xxhash64("id"), count(F.col("c"))).cast("int")).otherwise(0)
    r = r.select("id", "copies", "hub", "c", "nbs", big.alias("big"), b.alias("b"))

    def against(step: int):
        other = F.col("c") + step
        near = F.filter(F.transform(F.sequence(F.lit(0), count(other)), lambda j: j), lambda j: j < count(other))

        def meeting(j):
            mine, theirs = (F.col("c"), F.col("b")), (other, j)
            if step == 0:
                low, high = (F.col("c"), F.least("b", j)), (F.col("c"), F.greatest("b", j))
            else:
                low, high = (mine, theirs) if step > 0 else (theirs, mine)
            parts = [x.cast("int") for x in (*low, *high)]
            return F.struct(F.col("hub").alias("hub"), *(p.alias(a) for p, a in zip(parts, ("c1", "b1", "c2", "b2"))))

        return F.transform(near, meeting)

    zero = F.lit(0)
    alone = F.array(F.struct(F.col("hub").alias("hub"), *(zero.alias(a) for a in ("c1", "b1", "c2", "b2"))))
    r = r.select(
        "id", "copies", "hub", F.when(F.col("big"), F.concat(against(-1), against(0), against(1))).otherwise(alone).alias("meets"),
        F.when(F.col("big"), F.col("c")).otherwise(0).alias("c"), "b",
    )
    entry = F.struct("hub", "c", "b", "meets")
    return r.groupBy("id", "copies").agg(F.array_sort(F.collect_list(entry)).alias("routes")).select(
        "id", "copies",
        F.transform("routes", lambda x: x["hub"]).alias("hubs"),
        F.flatten(
            F.transform("routes", lambda x: F.transform(x["meets"], lambda m: F.struct(m.alias("m"), x["c"].alias("c"), x["b"].alias("b"))))
        ).alias("meets"),
    )


# --- signature trees -------------------------------------------------------------------------


class SignatureTree:
    """Levels of nodes over sets sorted by size: bitmap, smallest and largest size, largest excess.

    The excess of a set is its size less the bits it sets, so an overlap is at most the common
    bits plus the smaller excess.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        maps = np.zeros((len(sets), bits), dtype=bool)
        for row, items in zip(maps, sets):
            row[(items & np.uint64(bits - 1)).astype(np.int64)] = True
        excess = sizes - maps.sum(axis=1)
        packed = np.packbits(maps, axis=1).view(np.uint64)
        self.levels = [(packed, sizes, sizes, excess)]
        while len(self.levels[-1][1]) > FANOUT:
            maps_, low, high, over = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(maps_, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at))
            )


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs can hold a linked pair."""
    (ma, la, ha, ea), (mb, lb, hb, eb) = a, b
    fits = (5 * ha[i] >= 4 * lb[j]) & (5 * hb[j] >= 4 * la[i])
    out = np.zeros(len(i), dtype=bool)
    where = np.flatnonzero(fits)
    for at in range(0, len(where), 1 << 15):
        k = where[at : at + (1 << 15)]
        x, y = i[k], j[k]
        common = np.bitwise_count(ma[x] & mb[y]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(ea[x], eb[y]), np.minimum(ha[x], hb[y]))
        out[k] = linked(most, la[x], lb[y])
    return out


def _children(i: np.ndarray, j: np.ndarray, na: int, nb: int, deeper_a: bool, deeper_b: bool):
    if deeper_a:
        i, j = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(j, FANOUT)
    if deeper_b:
        i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    keep = (i < na) & (j < nb)
    return i[keep], j[keep]


def dual_traversal(a: SignatureTree, b: SignatureTree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs (i, j) that the bounds leave; i < j within one tree."""
    da, db = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[da][1])), np.arange(len(b.levels[db][1])), indexing="ij"))
    while True:
        if same:
            keep = i < j if da == 0 else i <= j
            i, j = i[keep], j[keep]
        keep = _possible(a.levels[da], b.levels[db], i, j)
        i, j = i[keep], j[keep]
        if da == db == 0 or not len(i):
            return i, j
        down_a, down_b = da >= db and da > 0, db >= da and db > 0
        da, db = da - down_a, db - down_b
        i, j = _children(i, j, len(a.levels[da][1]), len(b.levels[db][1]), down_a, down_b)


def _verified(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray):
    """The linked ones among leaf pairs, by exact overlap."""
    if not len(i):
        return i, j
    _, ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cuts = np.cumsum([0] + [len(s) for s in left] + [len(s) for s in right])
    at_right = cuts[len(left)]
    right_ids, right_cuts = ids[at_right:], cuts[len(left) : -1] - at_right
    sizes_l, sizes_r = np.diff(cuts[: len(left) + 1]), np.diff(cuts[len(left) :])
    flags = np.zeros(ids.max() + 1, dtype=np.int32)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    good = np.zeros(len(i), dtype=bool)
    for lo, hi in zip(starts, [*starts[1:], len(i)]):
        x, ys = i[lo], j[lo:hi]
        own = ids[cuts[x] : cuts[x + 1]]
        flags[own] = 1
        if len(ys) * 4 < len(right):
            overlap = np.array([flags[right_ids[right_cuts[y] : right_cuts[y] + sizes_r[y]]].sum() for y in ys])
        else:
            overlap = np.add.reduceat(flags[right_ids], right_cuts)[ys]
        flags[own] = 0
        good[lo:hi] = linked(overlap, sizes_l[x], sizes_r[ys])
    return i[good], j[good]


def compare_meeting(hub: int, left: list[tuple], right: list[tuple] | None) -> list[tuple]:
    """(id, links, root) for each linked member; a member is (id, copies, set, hubs).

    ``right`` is None for a meeting of a block with itself. Links count the copies of the other
    side; a pair with a smaller common hub is left to that hub, but still joins roots.
    """
    same = right is None
    left = sorted({m[0]: m for m in left}.values(), key=lambda m: (len(m[2]), m[2][0], m[0]))
    right = left if same else sorted({m[0]: m for m in right}.values(), key=lambda m: (len(m[2]), m[2][0], m[0]))
    if not left or not right or (same and len(left) < 2):
        return []
    sets_l, sets_r = [m[2] for m in left], [m[2] for m in right]
    largest = max(len(sets_l[-1]), len(sets_r[-1]))
    bits = 1 << int(np.clip(int(2 * largest - 1).bit_length(), 8, 12))
    tree_l = SignatureTree(sets_l, bits)
    i, j = dual_traversal(tree_l, tree_l if same else SignatureTree(sets_r, bits), same)
    i, j = _verified(sets_l, sets_r, i, j)
    ids = sorted({left[x][0] for x in set(i.tolist())} | {right[y][0] for y in set(j.tolist())})
    root, links = {k: k for k in ids}, dict.fromkeys(ids, 0)

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for x, y in zip(i.tolist(), j.tolist()):
        a, b = left[x], right[y]
        p, q = find(a[0]), find(b[0])
        if p != q:
            root[max(p, q)] = min(p, q)
        if len(a[3]) == 1 or len(b[3]) == 1 or min(a[3] & b[3]) == hub:
            links[a[0]] += b[1]
            links[b[0]] += a[1]
    return [(k, links[k], find(k)) for k in ids]


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs over rows sorted by meeting and compares each meeting as soon as it is complete."""
    key, sides = None, ([], [])

    def done():
        hub, c1, b1, c2, b2 = key
        return compare_meeting(hub, sides[0], None if (c1, b1) == (c2, b2) else sides[1])

    for pdf in batches:
        out = []
        columns = [pdf[c].tolist() for c in ("hub", "c1", "b1", "c2", "b2", "c", "b", "id", "copies", "items", "hubs")]
        for hub, c1, b1, c2, b2, c, b, i, copies, raw, hub_ids in zip(*columns):
            if (hub, c1, b1, c2, b2) != key:
                if key:
                    out += done()
                key, sides = (hub, c1, b1, c2, b2), ([], [])
            member = (i, copies, np.frombuffer(raw, np.uint64), frozenset(hub_ids))
            sides[0 if (c, b) == (c1, b1) else 1].append(member)
        if out:
            yield pd.DataFrame(out, columns=["id", "links", "root"])
    if key and (out := done()):
        yield pd.DataFrame(out, columns=["id", "links", "root"])


def compare_sets(members: DataFrame) -> DataFrame:
    """(id, links, root) per meeting from (id, copies, items, hubs, meets)."""
    rows = members.select("id", "copies", "items", "hubs", F.explode("meets").alias("e")).select("e.m.*", "e.c", "e.b", "id", "copies", "items", "hubs")
    key = ["hub", "c1", "b1", "c2", "b2"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInPandas(_meet, "id bigint, links bigint, root bigint")


def class_labels(found: DataFrame) -> DataFrame:
    """(id, links, component) of linked sets from the results of all meetings."""
    found = settle(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("id").alias("id1"), F.col("root").alias("id2")).where("id1 <> id2").distinct()
    return links.join(connected_components(edges), "id", "left").select(
        "id", "links", F.coalesce("component", "id").alias("component")
    )


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row per row of ``docs`` (doc_id, text).

    n_links counts the other documents linked with it, copies included. Null, empty and blank texts
    have no shingles and stand alone. Rows that repeat a doc_id count as copies; if their texts
    differ they share a component, being one document. A null doc_id has no component and links
    with nothing. Other columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    rows, levels = described(docs)
    real = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = classes.groupBy("rep").agg(F.max("n").alias("n"), F.sum("copies").alias("copies"))
    routes = sh.hubs(_postings(docs, levels)).join(reps.select(F.col("rep").alias("id"), "n", "copies"), "id")
    met = settle(meetings(routed(routes)))
    labels = class_labels(compare_sets(_sets(docs, met.select("id")).join(met, "id")))
    known = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "d1", "d2", "n",
        F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    found = real.join(known, ["d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = rows.where("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return found.unionByName(alone)
