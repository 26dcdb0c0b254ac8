"""The suffix sort and its hashes against plain sorting, and what happens where hashes collide."""

import numpy as np
import pytest

from parley.llm import suffix_dedup as D


def padded(text):
    return np.frombuffer(text + bytes(D._PAD), np.uint8)


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_are_sorted_in_their_groups(seed):
    rnd = np.random.default_rng(seed)
    data = padded(bytes(rnd.choice([97, 98], 600).tolist()) * (seed % 2 + 1))
    text, limit = D.Prefixes(data), 20
    sizes = np.array([1, 5, 40, 2, 64, 33])
    at = rnd.integers(0, 550, sizes.sum())
    order = D.suffix_sort(text, at, sizes, limit)
    start = 0
    for n in sizes.tolist():
        want = sorted(range(start, start + n), key=lambda i: (data[at[i] : at[i] + limit].tobytes(), i))
        assert order[start : start + n].tolist() == want
        start += n


def test_common_extension():
    rnd = np.random.default_rng(2)
    data = padded(bytes(rnd.choice([97, 98], 400).tolist()))
    x, y = rnd.integers(0, 380, 300), rnd.integers(0, 380, 300)
    got = D.common(D.Prefixes(data), x, y, 30)
    want = [next((k for k in range(30) if data[a + k] != data[b + k]), 30) for a, b in zip(x, y, strict=True)]
    assert got.tolist() == want


class Weak(D.Prefixes):
    """Calls all substrings of a length equal."""

    def hashes(self, at, length):
        return np.zeros(len(at), np.uint64)


@pytest.mark.parametrize("kind", [D.Prefixes, Weak])
def test_classes_are_right_when_hashes_collide(kind):
    rnd = np.random.default_rng(5)
    data = padded(bytes(rnd.choice([97, 98], 300).tolist()) * 2)
    sizes = np.array([30, 1, 50])
    at = rnd.integers(0, 500, sizes.sum())
    order, first = D.window_classes(kind(data), at, sizes, 12)
    windows = [data[i : i + 12].tobytes() for i in at]
    start = 0
    for n in sizes.tolist():
        own = order[start : start + n]
        assert sorted(own.tolist()) == list(range(start, start + n))
        got = [windows[i] for i in own]
        assert got == sorted(got)
        assert first[start : start + n].tolist() == [k == 0 or got[k] != got[k - 1] for k in range(n)]
        start += n
