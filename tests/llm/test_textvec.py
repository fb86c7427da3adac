import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeflow.llm import textvec as tv

TEXT = st.text(alphabet="ab C\n\t\x0b\r.é日\x1f\xa0", max_size=40)


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_shingles(texts):
    got, sets = [[] for _ in texts], []
    for chunk in tv.chunks(pa.array(texts, pa.string())):
        for i, r in enumerate(chunk.row):
            got[chunk.first + r].append(chunk.word(i))
        sets += tv.shingle_sets(chunk, 3)
    assert got == [brute(t) for t in texts]
    names = {}
    for t, s in zip(texts, sets, strict=True):
        w = brute(t)
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
        assert names.setdefault(frozenset(want), s.tobytes()) == s.tobytes()


def test_repeated_words_do_not_collide():
    words = ["to"] * 6 + ["of"] * 6 + ["to"] * 6
    (chunk,) = tv.chunks(pa.array([" ".join(words)]))
    (s,) = tv.shingle_sets(chunk, 5)
    assert len(s) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_chunks_and_slices_do_not_matter():
    texts = [f"alpha beta {i} gamma" * (i % 7) for i in range(500)]
    column = pa.array(["zz", *texts])[1:]
    whole = [s.tobytes() for c in tv.chunks(column) for s in tv.shingle_sets(c, 5)]
    single = [s.tobytes() for t in texts for c in tv.chunks(pa.array([t])) for s in tv.shingle_sets(c, 5)]
    assert whole == single
