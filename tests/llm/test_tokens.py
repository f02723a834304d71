import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.tokens import fingerprints, shingles, tokenize, winnow

TOKEN = re.compile(r"[一-鿿぀-ヿ]|[^\W_一-鿿぀-ヿ]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab éЖ字句か。, \n9", max_size=40)), max_size=6))
def test_tokens_equal_a_regular_expression(texts):
    t = tokenize(texts)
    got = [[] for _ in texts]
    for d, s, e in zip(t.doc.tolist(), t.start.tolist(), t.end.tolist(), strict=True):
        got[d].append(texts[d][s:e].lower())
    assert got == [TOKEN.findall((x or "").lower()) for x in texts]
    words = [w for g in got for w in g]
    assert len(set(words)) == len(set(t.hash.tolist()))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=60), st.integers(1, 6))
def test_every_window_keeps_a_hash(values, w):
    hashes = np.array(values, np.uint64)
    owner = np.arange(len(values)) // 25
    kept = set(winnow(hashes, owner, w).tolist())
    for o in set(owner.tolist()):
        at = np.flatnonzero(owner == o)
        for i in range(max(1, len(at) - w + 1)):
            window = at[i : i + w]
            assert any(j in kept and hashes[j] == hashes[window].min() for j in window)


def test_shared_runs_share_a_fingerprint():
    run = " ".join(f"w{i}" for i in range(11))
    a, b = tokenize([f"x y {run} z"]), tokenize([f"{run} q r s"])
    assert set(fingerprints(a, 8, 4)[0]) & set(fingerprints(b, 8, 4)[0])
    assert len(shingles(tokenize(["a b"]), 3)[0]) == 0
    assert len(fingerprints(tokenize(["", None, "a"]), 8, 4)[0]) == 1
