"""Words and hashes against regular expressions."""

import numpy as np
from hypothesis import given, settings, strategies as st

import brute
from storelake.llm import words as W

TEXT = st.text(st.sampled_from(list("aAbZz09 \t\n\r\x0b\x0c.,!%é中\x1c\x85 _-[`{\x7f\x00")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_equal_the_patterns(texts):
    for table, pattern in ((W.SPACED, brute.SPACED), (W.ALNUM, brute.ALNUM)):
        got = W.words_of([None if t is None else t.encode() for t in texts], table)
        for i, t in enumerate(texts):
            own = [x.decode() for x in got.text(got.bounds[i], got.bounds[i + 1])]
            assert own == brute.words(t, pattern)


def test_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    texts = [b"alpha beta gamma " * 50, b"beta", None, b"", b"gamma delta" * 30]
    whole = W.words_of(texts)
    monkeypatch.setattr(W, "PIECE", 64)
    cut = W.words_of(texts)
    assert np.array_equal(whole.hash, cut.hash) and np.array_equal(whole.start, cut.start)
    assert np.array_equal(whole.bounds, cut.bounds)
    by_word = {}
    for h, w in zip(whole.hash.tolist(), whole.text(0, len(whole.hash))):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_shingles_keep_order():
    a = W.words_of([b"a b c d e f"]).hash
    b = W.words_of([b"b a c d e f"]).hash
    assert W.shingle_hashes(a, 5)[0] != W.shingle_hashes(b, 5)[0]
    assert len(W.shingle_hashes(a, 5)) == 2 and len(W.shingle_hashes(a, 7)) == 0
