"""Top-k search of many queries: packed blocks of queries against packed blocks of items.

Items and queries are packed into rows of a few hundred vectors, sparse ones as flat arrays of positions
and weights. Every query block is dealt to every item block as a row of a join on the item block's
number; a task multiplies the two and keeps the k best items of each query and group. Only these travel
to the merge, so neither pairs nor postings are ever written, and no term is a join key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexiloom.session import settle

ITEM_BLOCK = 1024
QUERY_BLOCK = 256
FOUND = "qid bigint, id {kind}, grp string, score double"


def sparse_vectors(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, pos, w) arrays from (key, idx, w) rows; a vector has as many entries as its vocabulary at most."""
    packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("e"))
    return packed.select(key, F.col("e.idx").alias("pos"), F.col("e.w").alias("w"))


def dense_vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, pos, w) of array columns; null vectors fall away."""
    whole = F.transform(F.col(vec), lambda x: x.cast("double"))
    return rows.where(F.col(vec).isNotNull()).select(key, F.sequence(F.lit(0), F.size(vec) - 1).alias("pos"), whole.alias("w"))


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors scaled to length 1; zero vectors stay zero."""
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn("w", F.transform("w", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))


def _packed(vectors: DataFrame, key: str, size: int, group: Column, prefix: str) -> tuple[DataFrame, int]:
    """Rows (block, ids, grps, sizes, pos, w) of about ``size`` vectors, flat, and the number of blocks."""
    blocks = max(1, -(-vectors.count() // size))
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = vectors.select(block.alias("block"), F.struct(F.col(key).alias("k"), group.alias("g"), "pos", "w").alias("v"))
    packed = rows.groupBy("block").agg(F.sort_array(F.collect_list("v")).alias("v"))
    flat = {
        "ids": F.col("v.k"), "grps": F.col("v.g"), "sizes": F.transform("v", lambda x: F.size(x["pos"])),
        "pos": F.flatten("v.pos"), "w": F.flatten("v.w"),
    }
    return packed.select("block", *(c.alias(prefix + n) for n, c in flat.items())), blocks


def _matrix(row: dict, prefix: str, dims: int) -> np.ndarray:
    sizes = np.asarray(row[prefix + "sizes"])
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), row[prefix + "pos"]] = row[prefix + "w"]
    return out


def best_of_block(scores: np.ndarray, groups: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, item) positions of each query's k best items of each group, above ``floor``.

    Items are in order of id, so a stable sort breaks ties by id.
    """
    queries, items = [], []
    for g in np.unique(groups):
        own = np.flatnonzero(groups == g)
        part = scores[:, own]
        order = np.argsort(-part, axis=1, kind="stable")[:, :k]
        hit = np.take_along_axis(part, order, 1) > floor
        q, at = np.nonzero(hit)
        queries.append(q)
        items.append(own[order[q, at]])
    return np.concatenate(queries), np.concatenate(items)


def block_topk(items: DataFrame, queries: DataFrame, k: int, group: str | None = None, floor: float = -np.inf) -> DataFrame:
    """(qid, id, [group,] score, rank): the k items nearest to each query by inner product, per group.

    ``items``: (id, pos, w[, group]); ``queries``: (qid, pos, w). Scores are rounded to six decimals before
    ranking, ties go to the smaller id; only scores above ``floor`` count. Exact for any number of
    queries and items; a null group is a group of its own.
    """
    # A null group is the empty string, any other follows a mark.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    kind = items.schema["id"].dataType.simpleString()
    packed, cells = _packed(items, "id", ITEM_BLOCK, grp, "i_")
    asked, _ = _packed(queries, "qid", QUERY_BLOCK, F.lit(""), "q_")
    everywhere = asked.drop("block", "q_grps").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    names = ["qid", "id", "grp", "score"]
    id_type = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch[c][n].values for c in batch.schema.names if c != "block"}
                ids, grps, qids = row["i_ids"], row["i_grps"].to_numpy(zero_copy_only=False), row["q_ids"]
                row = {c: v.to_numpy(zero_copy_only=False) for c, v in row.items() if c not in ("i_ids", "i_grps", "q_ids")}
                dims = int(max(row["i_pos"].max(initial=-1), row["q_pos"].max(initial=-1))) + 1
                scores = np.round(_matrix(row, "q_", dims) @ _matrix(row, "i_", dims).T, 6)
                q, i = best_of_block(scores, grps, k, floor)
                columns = [qids.take(pa.array(q)), ids.take(pa.array(i)).cast(id_type), pa.array(grps[i], pa.string()), pa.array(scores[q, i])]
                yield pa.record_batch([columns[0].cast(pa.int64()), *columns[1:]], names=names)

    met = packed.join(everywhere, "block").mapInArrow(run, FOUND.format(kind="string" if kind == "string" else "bigint"))
    rank = F.row_number().over(W.partitionBy("qid", "grp").orderBy(F.desc("score"), "id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k)
    if group:
        return best.select("qid", "id", F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias(group), "score", "rank")
    return best.select("qid", "id", "score", "rank")


# Products of a query's and an item's weight, or entries of two matrices, that are held at once.
MEETINGS = 1 << 21


def shared_scores(q: tuple[np.ndarray, ...], i: tuple[np.ndarray, ...]) -> np.ndarray:
    """Inner products (queries x items) of two blocks of sparse vectors, each (sizes, positions, weights).

    Positions may be any numbers. Blocks of queries with few of them become two matrices; otherwise
    every item entry meets the queries that hold its position.
    """
    (qs, qp, qw), (ns, ip, iw) = q, i
    dims = np.unique(qp)
    if len(dims) * (len(qs) + len(ns)) <= MEETINGS:
        at = np.searchsorted(dims, ip)
        held = at < len(dims)
        held[held] = dims[at[held]] == ip[held]
        left, right = np.zeros((len(qs), len(dims))), np.zeros((len(ns), len(dims)))
        left[np.repeat(np.arange(len(qs)), qs), np.searchsorted(dims, qp)] = qw
        right[np.repeat(np.arange(len(ns)), ns)[held], at[held]] = iw[held]
        return left @ right.T
    order = np.argsort(qp, kind="stable")
    query, qp, qw = np.repeat(np.arange(len(qs)), qs)[order], qp[order], qw[order]
    item = np.repeat(np.arange(len(ns)), ns)
    low, high = np.searchsorted(qp, ip, "left"), np.searchsorted(qp, ip, "right")
    ends = np.cumsum(high - low)
    scores = np.zeros(len(qs) * len(ns))
    at = 0
    while at < len(ip):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + MEETINGS, "right")))
        n = (high - low)[at:stop]
        own = np.repeat(np.arange(at, stop), n)
        met = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + low[own]
        scores += np.bincount(query[met] * len(ns) + item[own], qw[met] * iw[own], len(scores))
        at = stop
    return scores.reshape(len(qs), len(ns))


def named_vectors(rows: DataFrame, terms: DataFrame, name: str) -> DataFrame:
    """(name, pos, w) of (id, term, w) rows, scaled to length 1 over all terms; ``terms`` (term, pos) alone are kept."""
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "w"))
    packed = rows.join(terms, "term", "left").groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(entry).alias("e"))
    packed = packed.where((F.col("norm") > 0) & (F.size("e") > 0))
    return packed.select(F.col("id").alias(name), F.col("e.pos").alias("pos"), F.transform("e.w", lambda w: w / F.col("norm")).alias("w"))


def best_pairs(left: DataFrame, right: DataFrame, k: int, threshold: float) -> DataFrame:
    """(lid, rid, sim): cosine of (id, term, w) rows with positive weights, rounded to six decimals.

    Holds the pairs that share a term and either reach ``threshold`` or are among the ``k`` best of their
    left id, ties to the smaller right id. Ids are strings.
    """
    terms = settle(left.select("term").distinct().withColumn("pos", F.monotonically_increasing_id()))
    items, queries = (settle(named_vectors(rows, terms, name)) for rows, name in ((right, "id"), (left, "qid")))
    return best_of_vectors(items, queries, k, threshold)


def blocks_of(vectors: DataFrame, key: str, size: int, prefix: str) -> DataFrame:
    """Rows (ids, sizes, pos, w) of at most ``size`` vectors each, in order of id, flat; packed where they are read."""
    kind = f"{prefix}ids array<string>, {prefix}sizes array<int>, {prefix}pos array<bigint>, {prefix}w array<double>"
    names = [prefix + c for c in ("ids", "sizes", "pos", "w")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                part = part.take(pc.sort_indices(part["k"]))
                flat = [part["k"], pc.list_value_length(part["pos"]).cast(pa.int32()), pc.list_flatten(part["pos"]), pc.list_flatten(part["w"])]
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in flat], names=names)

    return vectors.select(F.col(key).alias("k"), F.col("pos").cast("array<bigint>"), "w").mapInArrow(pack, kind)


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest entries of each row stand, the first ones on ties; entries below 0 may count or not."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    found = scores >= np.maximum(np.partition(scores, -k, axis=1)[:, -k, None], 0.0)
    for row in np.flatnonzero(found.sum(axis=1) > k):
        found[row] = False
        found[row, np.argsort(-scores[row], kind="stable")[:k]] = True
    return found


def best_of_vectors(items: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """``best_pairs`` of unit vectors (id, pos, w) and (qid, pos, w), written once; positions are any numbers.

    Each block of queries meets each block of items; what a block can't rule out is ranked once more.
    """
    asked = settle(blocks_of(queries, "qid", QUERY_BLOCK, "q_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch[c][n].values for c in batch.schema.names}
                side = lambda p: tuple(row[p + c].to_numpy(zero_copy_only=False) for c in ("sizes", "pos", "w"))  # noqa: E731, B023
                scores = np.minimum(shared_scores(side("q_"), side("i_")), 1.0)
                rounded = np.where(scores > 0, np.round(scores, 6), -1.0)
                q, i = np.nonzero((rounded >= threshold) | _first(rounded, k) & (rounded >= 0))
                yield pa.record_batch([row["q_ids"].take(pa.array(q)), row["i_ids"].take(pa.array(i)), pa.array(scores[q, i])], names=["lid", "rid", "sim"])

    met = blocks_of(items, "id", ITEM_BLOCK, "i_").crossJoin(asked).mapInArrow(run, "lid string, rid string, sim double")
    met = settle(met.select("lid", "rid", F.round("sim", 6).alias("sim")))
    rank = F.row_number().over(W.partitionBy("lid").orderBy(F.desc("sim"), "rid"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    return met.where(F.col("sim") >= threshold).unionByName(best.where(F.col("sim") < threshold))
