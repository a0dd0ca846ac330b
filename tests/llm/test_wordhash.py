import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import wordhash
from quire.llm.wordhash import grams, sequence_hash, shingle_sets, words

TEXTS = st.lists(st.one_of(st.none(), st.text("aB é\t\n\x0b\xa0,日", max_size=20)), max_size=8)
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@given(TEXTS, st.booleans(), st.sampled_from([1, 5, 1 << 20]))
@settings(max_examples=300, deadline=None)
def test_words_and_places(texts, lower, block):
    old, wordhash.BLOCK = wordhash.BLOCK, block
    try:
        h, doc, a, b = words(pa.array(texts, pa.string()), lower)
    finally:
        wordhash.BLOCK = old
    flat = [(k, w.translate(LOW) if lower else w) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert doc.tolist() == [k for k, _ in flat]
    raw = b"".join((t or "").encode() for t in texts)
    assert [raw[x:y].decode() if not lower else raw[x:y].decode().translate(LOW) for x, y in zip(a, b, strict=True)] == [w for _, w in flat]
    by = {}
    for (_, w), x in zip(flat, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_a_slice_hashes_like_the_whole():
    t = pa.array(["one two", "three", None, "four five six"])
    h, _, _, _ = words(t)
    assert words(t.slice(1))[0].tolist() == h[2:].tolist()
    assert sequence_hash(h[None, :3])[0] == grams(h, 3)[0]


def test_sets():
    got = shingle_sets(pa.array(["a b c a b c", "a b", "a", "", None, "A B"]), 3, True)
    assert [len(s) for s in got] == [3, 1, 1, 0, 0, 1] and got[1][0] == got[5][0] != got[2][0]
    assert all((np.diff(s.astype(object)) > 0).all() for s in got)
