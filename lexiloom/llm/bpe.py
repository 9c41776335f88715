"""BPE encoding and decoding of whole texts.

Encoding is a backtracking search. An Aho-Corasick automaton over the vocabulary gives the longest
token at every byte of a piece in one pass. A token may follow another only if merging the bytes of
the two would keep them apart (the pair-compatibility test); a sequence of compatible neighbours is
the one that the merge rules produce. When no compatible token fits, the search steps back and tries
the next shorter prefix token; ends that led nowhere are marked, so each is tried once.

Decoding gathers bytes by an offset table: token i is blob[offsets[i] : offsets[i + 1]].
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.llm.fill_in_middle import byte_slices

#: Fixed value: the pattern of the byte-level pre-tokenizer that these vocabularies were made with.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and pairs remembered within a task.
MEMO = 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself, or the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Tables of one vocabulary. Inside, tokens are numbered by merge rank: bytes, then merges."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.tokens = [bytes([b]) for b in range(256)]
        number = {t: k for k, t in enumerate(self.tokens)}
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in data["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = number[raw(left)], number[raw(right)]
            token = self.tokens[pair[0]] + self.tokens[pair[1]]
            if token in number:
                raise ValueError("two merges make the same token")
            self.merged[pair] = number[token] = len(self.tokens)
            self.tokens.append(token)
            self.parts.append(pair)
        self.outer = [vocab[t] for t in self.tokens]
        self.number = number
        self.shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in self.tokens]
        size = max([*vocab.values(), *self.specials.values()]) + 1
        table = [b""] * size
        for t, i in vocab.items():
            table[i] = t
        for t, i in self.specials.items():
            table[i] = t.encode()
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.array([0, *accumulate(map(len, table))], dtype=np.int64)
        self.pattern = regex.compile(PIECES)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the joined bytes leave a boundary between ``left`` and ``right``.

        Undoes merges on both sides of the boundary from the latest to the earliest; a merge across
        it that comes before the one just undone would have been made first.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self._apart(left, right)
            if len(self.fits) >= MEMO:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        undone = len(self.tokens)
        while True:
            if self.merged.get((left, right), undone) < undone:
                return False
            if left > right or right < 256:
                if left < 256:
                    return True
                # The left side was made after the right one: open it and look at its tail.
                undone, left = left, self.parts[left][1]
            else:
                undone, right = right + 1, self.parts[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Internal numbers of the tokens of a piece."""
        whole = self.number.get(piece)
        if whole is not None:
            return [whole]
        n, lengths, fits = len(piece), self.lengths, self.fits
        longest = [0] * n
        for end, k in self.automaton.iter(piece.decode("latin-1")):
            longest[end - lengths[k] + 1] = k
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + lengths[token]
            known = fits.get((out[-1], token)) if out else True
            if not dead[end] and (known or (known is None and self.compatible(out[-1], token))):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            shorter = self.shorter[token]
            while shorter < 0:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                shorter = self.shorter[token]
            token = shorter
        return out

    def packed(self, piece: str) -> bytes:
        known = self.memo.get(piece)
        if known is None:
            known = array("i", map(self.outer.__getitem__, self.encode_piece(piece.encode("utf-8")))).tobytes()
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(piece) <= 64:
                self.memo[piece] = known
        return known

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.packed, self.pattern.findall(text)))

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids; strings of special tokens in the text become those tokens."""
        if not text:
            return np.zeros(0, dtype="<i4")
        if not self.cut:
            return np.frombuffer(self._plain(text), "<i4")
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.int32(self.specials[m[0]]).tobytes()]
            at = m.end()
        parts.append(self._plain(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
        return self.blob[where].tobytes().decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(spec: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    key = hash(spec)
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


CODED = "doc_id bigint, ids array<int>, decoded string"
SLICE_BYTES = 1 << 20


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``docs`` (doc_id, text).

    A null text counts as empty and has no ids; rows are handled one by one, so repeated rows give
    repeated results and very long texts are encoded whole. A null doc_id stays null, an empty table
    gives no rows, other columns are ignored. Each text is encoded once and decoded from its ids in the
    same pass, SLICE_BYTES of text at a time. The vocabulary file is read here and broadcast; its size
    does not depend on the data.
    """
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                ids, decoded, ends = [], [], [0]
                for text in part["text"]:
                    found = codec.encode(text.as_py())
                    ids.append(found)
                    ends.append(ends[-1] + len(found))
                    decoded.append(codec.decode(found))
                values = pa.array(np.concatenate(ids), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.record_batch([part["doc_id"], lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
        # Workers are used again by later stages, which need the memory.
        codec.memo.clear()
        codec.fits.clear()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, CODED)


def digest_columns(ids: Column, decoded: Column) -> list[Column]:
    return [
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]
