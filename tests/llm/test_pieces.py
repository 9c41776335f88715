"""Word hashes and rows of op6 do not depend on how a text or batch is cut."""

import numpy as np
import pandas as pd

from lexiloom.llm import substring_dedup as sd


def _plain(text):
    low = text.encode("utf-8").lower()
    lines, words = [], []
    for k, line in enumerate(low.split(b"\n")):
        for w in line.split():
            words.append(w)
            lines.append(k)
    return words, lines


def test_hashes_do_not_depend_on_the_piece(monkeypatch):
    text = "".join(f"Wörd{k % 97} x{'y' * (k % 41)}" + ("\n" if k % 7 == 0 else " \t") for k in range(3000)) + "z" * 900 + " end"
    whole = sd.hashed_words(text)
    words, lines = _plain(text)
    assert whole[1].tolist() == lines
    assert len(set(zip(words, whole[0].tolist()))) == len(set(words)) == len(set(whole[0].tolist()))
    for piece in (16, 64, 256):
        monkeypatch.setattr(sd, "PIECE", piece)
        cut = sd.hashed_words(text)
        assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all()
    for text in ("", " \n ", "one"):
        assert len(sd.hashed_words(text)[0]) == len(text.split())


def test_rows_do_not_depend_on_the_flush(monkeypatch):
    line = " ".join(f"w{k}" for k in range(40))
    texts = [line, None, "", line.upper() + "\n" + line[5:], "short"] * 3
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})

    def rows():
        out = pd.concat(list(sd._occurrences(iter([docs]))), ignore_index=True)
        return [(*map(int, r[:5]), None if r[5] is None else tuple(np.asarray(r[5]))) for r in out.itertuples(index=False)]

    whole = rows()
    monkeypatch.setattr(sd, "FLUSH_WORDS", 30)
    assert rows() == whole
    assert sum(r[5] is not None for r in whole) == 2
