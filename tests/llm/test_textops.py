import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slidelake.llm.textops import hash_runs, hash_spans, runs, splits, spread, window_min, words

TEXTS = st.lists(st.text(alphabet="abé \t\n\x0b\x1c\x85　.", max_size=30), max_size=6)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_split_as_the_pattern(texts):
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    starts, ends, doc = words(buf, offsets)
    got = [(int(d), buf[s:e].tobytes().decode()) for s, e, d in zip(starts, ends, doc)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]


def test_equal_spans_and_runs_hash_alike():
    text = b"abc abcdefghij abcdefghij " + b"z" * 5000 + b" " + b"z" * 5000 + b" abc"
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(buf, np.array([0, len(buf)]))
    for seed in (0, 1):
        h = hash_spans(buf, starts, ends, seed)
        assert h[0] == h[-1] and h[1] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 3
    values = np.array([1, 2, 3, 4, 5, 6, 7, 8] * 3, np.uint64)
    for n in (1, 3, 7, 20):
        got = hash_runs(values, n)
        want = [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
        assert len(set(got.tolist())) == len(set(want)) and all((got[i] == got[0]) == (want[i] == want[0]) for i in range(len(want)))


def test_small_helpers():
    values = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    assert window_min(values, 3).tolist() == [3, 1, 1, 1, 2]
    assert spread(np.array([0, 1, 0, 0, 0, 1], bool), 2, 6).tolist() == [False, True, True, False, False, True]
    begin, end = runs(np.array([1, 1, 0, 1], bool))
    assert begin.tolist() == [0, 3] and end.tolist() == [2, 4]
    assert splits(np.array([5, 5, 20, 1, 1]), 10) == [(0, 2), (2, 3), (3, 5)]
