"""Grams of coded bytes against plain loops."""

import numpy as np
import pytest

from lexforge.llm.bytesnp import Words
from lexforge.llm.lm_scoring import END, grams_of


@pytest.mark.parametrize("depth", [3, 6])
def test_grams_are_the_bytes_before_and_the_byte(depth):
    texts = [b"", b"a", b"  Two  words ", "éα x\n".encode() * 5, bytes(range(33, 256))]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    w = Words(data, off)
    want = []
    for row in range(len(texts)):
        words = [w.data[s:e].tobytes() for s, e, r in zip(w.start, w.end, w.row, strict=True) if r == row]
        coded = bytes([END] * depth) + b"".join(x + b" " for x in words) + bytes([END])
        want.append([int.from_bytes(coded[i - depth : i][::-1] + coded[i : i + 1], "big") for i in range(depth, len(coded))])
    got, bounds = grams_of(w, depth)
    assert [got[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
