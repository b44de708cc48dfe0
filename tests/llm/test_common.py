import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logweir.llm import common

TEXTS = st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1cé\xa0", max_size=40), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_windows_follow_the_text(texts):
    chunk = common.Chunk([t.encode() for t in texts])
    words = [t.encode().split() for t in texts]
    flat = [w for ws in words for w in ws]
    assert chunk.counts.tolist() == [len(w) for w in words]
    names = {}
    for word, number in zip(flat, chunk.hashes.tolist()):
        assert names.setdefault(word, number) == number
    assert len(set(names.values())) == len(names)
    hashes, at = chunk.windows(3)
    runs = [tuple(ws[i : i + 3]) for ws in words for i in range(len(ws) - 2)]
    assert len(runs) == len(hashes)
    seen = {}
    for run, number in zip(runs, hashes.tolist()):
        assert seen.setdefault(run, number) == number
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_piece(monkeypatch):
    text = " ".join(f"word{i % 50}" for i in range(400)).encode()
    whole = common.Chunk([text]).hashes
    monkeypatch.setattr(common, "PIECE_BYTES", 16)
    assert (common.Chunk([text]).hashes == whole).all()


def test_covered():
    assert common.covered(np.array([1, 2, 6]), 3, 8).tolist() == [
        False, True, True, True, True, False, True, True]


def test_pieces_hold_a_row_at_least():
    assert list(common.pieces([5, 50, 5, 5], 10)) == [(0, 1), (1, 2), (2, 4)]
    assert list(common.pieces([], 10)) == []
