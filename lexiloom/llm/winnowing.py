"""Document fingerprints by winnowing.

Each run of ``GRAM`` code points has a rolling hash; of every ``WINDOW`` neighbouring hashes the smallest
is kept, the rightmost on ties, with its position. Two texts that share GRAM + WINDOW - 1 = 20 code
points share a fingerprint, so a text of 40 or more has one in common with a copy that keeps a half of
it. Texts shorter than a gram have one hash, of the whole; texts of fewer grams than a window have the
smallest of all; empty texts have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lexiloom.llm.shingles import mix

GRAM = 10
WINDOW = 11
BINS = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 14) - 1, base, dtype=np.uint64)], dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """32-bit hashes of all grams: differences of one running polynomial sum, shifted to power 0."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, GRAM)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * _power(_BASE, n), dtype=np.uint64)])
        grams = (run[width:] - run[:-width]) * _power(_INVERSE, n - width + 1)
        return mix(grams + np.uint64(width)) >> np.uint64(32)


def winnow(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprint, in order of position."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = gram_hashes(points)
    if not len(h):
        return h, np.zeros(0, np.int64)
    # Smallest hash first, then the larger position, in one number.
    low = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    span, left = 1, min(WINDOW, len(h))
    best = low
    while span * 2 <= left:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < left:
        best = np.minimum(best[: len(best) - (left - span)], best[left - span :])
    picked = best[np.r_[True, best[1:] != best[:-1]]]
    return picked >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (picked & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hashes; 1 for two empty ones."""
    x, y = np.unique(a), np.unique(b)
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _hex(h: np.ndarray) -> str:
    return h.astype(">u4").tobytes().hex()


COLUMNS = "doc_id bigint, n_chars bigint, edited_sha256 string, hashes array<bigint>, positions array<bigint>, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams rows sorted by (bin, order) and pairs each with its successor in the bin."""
    before = None

    def row(doc_id, text, mine, following, theirs):
        other = edited(text, following)
        changed = winnow(other)[0]
        return (
            doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), mine[0].astype(np.int64), mine[1],
            _hex(mine[0]), _hex(changed), likeness(mine[0], changed), likeness(mine[0], theirs[0]),
        )

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for pdf in batches:
        out = []
        for b, doc_id, text, extra in zip(pdf["bin"].tolist(), pdf["doc_id"], pdf["text"], pdf["extra"].tolist()):
            marks = winnow(text)
            if before and before[0] == b and not before[4]:
                out.append(row(*before[1:4], text, marks))
            before = (b, None if pd.isna(doc_id) else int(doc_id), text, marks, extra)
        if out:
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its edited text; see COLUMNS.

    The next document follows in descending doc_id, rows with the same id in order of their text, null
    ids last; after the last comes the first. A null text counts as empty. Rows are dealt into bins of
    id ranges with about equal counts; every bin also gets the first row of the next bin, so no task
    sees more than a bin and the order needs no single task. A lone document follows itself.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marks = own.agg(F.percentile_approx("doc_id", [k / BINS for k in range(1, BINS)], 20000).alias("q")).first()["q"]
    edges = sorted(set(marks or []))
    binned = own.withColumn("bin", F.coalesce(_bin(edges), F.lit(len(edges) + 1)))
    # The first row of each bin: its largest id, then the smallest text.
    first_ids = binned.groupBy("bin").agg(F.max("doc_id").alias("top")).orderBy("bin").collect()
    if not first_ids:
        return own.sparkSession.createDataFrame([], COLUMNS)
    follows = {r["bin"]: first_ids[(k + 1) % len(first_ids)] for k, r in enumerate(first_ids)}
    pairs = own.sparkSession.createDataFrame([(b, r["bin"], r["top"]) for b, r in follows.items()], "goal int, bin int, top bigint")
    heads = binned.join(F.broadcast(pairs), ["bin"]).where(F.col("doc_id").eqNullSafe(F.col("top")))
    w = Window.partitionBy("goal").orderBy("text")
    heads = heads.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "text", F.col("goal").alias("bin"), F.lit(1).alias("extra"))
    rows = binned.select("doc_id", "text", "bin", F.lit(0).alias("extra")).unionByName(heads)
    dealt = rows.repartition("bin").sortWithinPartitions("bin", "extra", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInPandas(_neighbours, COLUMNS)


def _bin(edges: list[int]):
    """The bin of an id, ascending as ids descend: the number of edges at or above it, by halving."""
    if not edges:
        return F.when(F.col("doc_id").isNotNull(), F.lit(0))
    listed = F.array(*[F.lit(e).cast("bigint") for e in reversed(edges)])
    return F.when(F.col("doc_id").isNotNull(), F.size(F.filter(listed, lambda e: e >= F.col("doc_id"))))
