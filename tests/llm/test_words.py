import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brineloom.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t9.|日 ", max_size=40)), max_size=8)


@settings(deadline=None, max_examples=60)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    arr = W.text_array(pa.array(texts, pa.string()))
    for inside, lower, pattern in ((W.NON_SPACE, False, r"[^\x20\x09-\x0D]+"), (W.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, want = [], []
        for c in W.chunks(arr, limit=16):
            w = W.words(c, inside, lower)
            data = (W.LOWER[c.data] if lower else c.data).tobytes()
            for i in range(c.hi - c.lo):
                got.append([data[a:b].decode() for a, b in zip(w.starts[w.ptr[i] : w.ptr[i + 1]], w.ends[w.ptr[i] : w.ptr[i + 1]])])
        for t in texts:
            t = t or ""
            want.append(re.findall(pattern, "".join(ch.lower() if ch.isascii() else ch for ch in t) if lower else t))
        assert got == want


def test_hashes_follow_the_words_and_not_their_place():
    arr = W.text_array(pa.array(["one two  one", "two", None, "", "x" * 9000 + " two"]))
    h = [W.words(c, W.NON_SPACE, False).hashes for c in W.chunks(arr)][0]
    assert h[0] == h[2] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 3


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.integers(-(2**62), 2**62), max_size=50))
def test_packing_round_trips(keys, ints):
    k = np.unique(np.array(keys, np.uint64))
    assert np.array_equal(W.unpack_sorted(W.pack_sorted(k)), k)
    assert np.array_equal(W.unpack_ints(W.pack_ints(np.array(ints, np.int64))), ints)


def test_spread():
    assert W.spread(np.array([1, 3]), 2, 6).tolist() == [False, True, True, True, True, False]


def test_memory_of_words_does_not_follow_the_batch():
    """8 MB of texts: the arrays made from them are those of one chunk."""
    texts = W.text_array(pa.array(["some words of a plain text " * 40] * 8000))
    tracemalloc.start()
    n = sum(len(W.words(c, W.ALNUM, lower=True).starts) for c in W.chunks(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8000 * 240 and peak < 40e6
