import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from gradewell.llm import blocks as B

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\x0c\r\x1c\xa0", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_match_the_pattern(texts):
    w = B.Words(pa.array(texts, pa.string()))
    for d, t in enumerate(texts):
        want = re.findall(B.WORD_SQL, t or "")
        got = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.first[d]:w.first[d + 1]], w.ends[w.first[d]:w.first[d + 1]])]
        assert got == want


def test_sliced_arrays_and_equal_words():
    a = pa.array(["x", "a b", None, "b a b", ""], pa.string()).slice(1)
    w = B.Words(a)
    assert w.counts().tolist() == [2, 0, 3, 0]
    h = w.hashes()
    assert h[1] == h[2] == h[4] and h[0] == h[3] and h[0] != h[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40, unique=True), st.integers(0, 2**40))
def test_pack_round_trip(keys, most):
    keys = np.array(sorted(keys), np.uint64)
    extra = np.arange(len(keys), dtype=np.uint64) * np.uint64(most // 41 + 1)
    got, more = B.unpack(B.pack(keys, extra), extra=True)
    assert (got == keys).all() and (more == extra).all() and (B.unpack(B.pack(keys)) == keys).all()


def test_windows_stay_inside_documents():
    w = B.Words(pa.array(["a b c d", "e", "a b c"], pa.string()))
    at = B.window_starts(w.first, 3)
    assert at.tolist() == [0, 1, 5]
    r = B.rolling(w.hashes(), 3)[at]
    assert r[0] == r[2] != r[1]
