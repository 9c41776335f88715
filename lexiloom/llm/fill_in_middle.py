"""Fill-in-the-middle transformation of whole texts.

Texts stay UTF-8 bytes. A sparse exception index holds the byte positions of multibyte characters only
and the bytes they take beyond one. A binary search in it turns a byte cut into a code-point cut and
back, so stretches of ASCII cost arithmetic alone. The index spans all texts of a slice of a batch at
once: cuts are handled as arrays, and each output is put together from three slices of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES = 1 << 23
COLUMNS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class ExceptionIndex:
    """Multibyte characters of a stretch of UTF-8: byte positions, code-point positions, excess so far."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.points = self.at - self.before[:-1]

    def to_points(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each byte cut; cuts lie between characters."""
        return cuts - self.before[np.searchsorted(self.at, cuts)]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return cuts + self.before[np.searchsorted(self.points, cuts)]


def unit_counts(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, index: ExceptionIndex, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(units of each text, newline positions): lines end after a newline, the last may lack it."""
    if unit == "char":
        return index.to_points(ends) - index.to_points(starts), np.zeros(0, np.int64)
    breaks = np.flatnonzero(data == 10)
    whole = np.searchsorted(breaks, ends) - np.searchsorted(breaks, starts)
    filled = ends > starts
    open_end = np.zeros(len(ends), bool)
    open_end[filled] = data[ends[filled] - 1] != 10
    return whole + open_end, breaks


def unit_cuts(k: np.ndarray, starts: np.ndarray, ends: np.ndarray, breaks: np.ndarray, index: ExceptionIndex, unit: str) -> np.ndarray:
    """Byte positions after the first ``k`` units of each text."""
    if unit == "char":
        return index.to_bytes(index.to_points(starts) + k)
    first = np.searchsorted(breaks, starts)
    last = np.searchsorted(breaks, ends)
    known = np.concatenate([breaks + 1, [0]])
    inside = known[np.minimum(first + k - 1, len(breaks))]
    return np.where(k == 0, starts, np.where(first + k <= last, inside, ends))


def _transform(batch: pa.RecordBatch, unit: str, fim_percent: int, spm_percent: int) -> pa.RecordBatch:
    texts = pc.fill_null(batch["text"], "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, top = int(offsets[0]), int(offsets[-1])
    raw = memoryview(texts.buffers()[2])[base:top] if top > base else memoryview(b"")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = offsets[:-1] - base, offsets[1:] - base
    marked = np.zeros(len(texts), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    draws = [batch[f"h{i}"].to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5)]
    plain = marked | (ends == starts) | (draws[2] % 100 >= fim_percent)
    spm = draws[3] % 100 < spm_percent

    index = ExceptionIndex(data)
    n, breaks = unit_counts(data, ends, starts, index, unit)
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    head = unit_cuts(np.minimum(one, two), starts, ends, breaks, index, unit)
    tail = unit_cuts(np.maximum(one, two), starts, ends, breaks, index, unit)
    heads = index.to_points(head)
    prefix_chars = heads - index.to_points(starts)
    middle_chars = index.to_points(tail) - heads

    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    outputs = []
    for a, h, t, e, is_plain, is_spm in zip(starts.tolist(), head.tolist(), tail.tolist(), ends.tolist(), plain.tolist(), spm.tolist()):
        if is_plain:
            outputs.append(bytes(raw[a:e]))
        elif is_spm:
            outputs.append(b"".join((s, raw[t:e], p, raw[a:h], m, raw[h:t])))
        else:
            outputs.append(b"".join((p, raw[a:h], s, raw[t:e], m, raw[h:t])))
    forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return pa.record_batch(
        [
            batch["doc_id"], pa.array(n, pa.int64()), pa.array(forms, pa.string()),
            pa.array(prefix_chars, pa.int64(), mask=plain), pa.array(middle_chars, pa.int64(), mask=plain), pa.array(outputs, pa.string()),
        ],
        names=[c.split()[0] for c in COLUMNS.split(", ")],
    )


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each; one row is never split."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def draw(key: Column, seed: int, k: int) -> Column:
    """The k-th group of eight hex digits of sha256('seed:key') as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 8 * k - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, unit: str = "line", fim_percent: int = 100, spm_percent: int = 50, seed: int = 7) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text).

    Cuts fall between lines or, with unit="char", between code points; two draws of each doc_id choose
    them. Texts that are empty, hold a mark or lose the draw of ``fim_percent`` stay plain, with null
    sizes. A null text counts as empty, and a null doc_id draws as an empty key. Rows are handled one by
    one: repeated rows give repeated results, very long texts are cut whole, an empty table gives no
    rows, and other columns are ignored.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit is 'line' or 'char'")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *(draw(key, seed, k).alias(f"h{k}") for k in range(1, 5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                yield _transform(part, unit, fim_percent, spm_percent)

    return rows.mapInArrow(run, COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from an output and its form alone."""
    def after(mark: str) -> Column:
        return F.get(F.split(output, mark, 2), 1)

    psm = F.split(after(SUFFIX), MIDDLE, 2)
    spm = F.split(after(PREFIX), MIDDLE, 2)
    from_psm = F.concat(F.substring(F.get(F.split(output, SUFFIX, 2), 0), len(PREFIX) + 1, 1 << 30), F.get(psm, 1), F.get(psm, 0))
    suffix = F.substring(F.get(F.split(output, PREFIX, 2), 0), len(SUFFIX) + 1, 1 << 30)
    return F.when(form == "plain", output).when(form == "psm", from_psm).otherwise(F.concat(F.get(spm, 0), F.get(spm, 1), suffix))
