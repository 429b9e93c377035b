"""Bit-sliced comparison and word bounds against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tests.llm import brute
from veldspan.llm import simhash
from veldspan.llm.common import joined_words


def made(sizes, seed=1):
    """Groups of fingerprints near a few centres."""
    rng = np.random.default_rng(seed)
    fps, groups = [], []
    for g, n in enumerate(sizes):
        centres = rng.integers(0, 2**64, 1 + n // 6, np.uint64)
        x = centres[rng.integers(0, len(centres), n)]
        for _ in range(3):
            x = x ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, np.uint64), np.uint64(0))
        fps.append(x)
        groups += [g] * n
    return np.concatenate(fps), np.array(groups)


@pytest.mark.parametrize("sizes", [[2, 2, 3, 2], [1, 70, 2, 5, 1, 130, 2], [300], [2] * 500, [1, 1]])
@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("words", [1, 256])
def test_pairs(sizes, radius, words, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_WORDS", words)
    fps, groups = made(sizes)
    got = [(int(i), int(j)) for a, b in simhash.within_radius(fps, groups, radius) for i, j in zip(a, b, strict=True)]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    want = np.argwhere(near & (groups[:, None] == groups[None, :]) & (np.arange(len(fps))[:, None] < np.arange(len(fps))[None, :]))
    assert sorted(got) == [tuple(x) for x in want.tolist()] and len(set(got)) == len(got)


def test_folded_stars_keep_all_links(monkeypatch):
    monkeypatch.setattr(simhash, "FOLD", 10)
    fps, groups = made([200, 3, 90], 7)
    row, root = simhash._stars(len(fps), simhash.within_radius(fps, groups, 2))
    label = dict(zip(row.tolist(), root.tolist(), strict=True))
    for g in set(groups.tolist()):
        at = np.flatnonzero(groups == g).tolist()
        want = brute.components([(i, int(fps[i])) for i in at])
        assert {i: label.get(i, i) for i in at} == want


def test_small_buckets_go_through_the_planes(spark, monkeypatch):
    """The registered query finds no link if the bit planes find none."""
    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["other"] + words[201:]
    assert 0 < (brute.fingerprint(" ".join(words)) ^ brute.fingerprint(" ".join(near))).bit_count() <= 2
    fps = np.array([brute.fingerprint(" ".join(x)) for x in (words, near)], np.uint64)
    assert len(simhash._links(np.zeros(2, np.int64), fps.view(np.int64), 2)[0]) == 1
    monkeypatch.setattr(simhash, "_within", lambda *args: iter(()))
    assert len(simhash._links(np.zeros(2, np.int64), fps.view(np.int64), 2)[0]) == 0


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    for n in (1, 2, 3, 4, 9, 10, 500):
        text = "\t ".join(f"Word{i % 37}" for i in range(n))
        assert simhash.fingerprint(text.encode()) == brute.fingerprint(text)


@pytest.mark.parametrize("text", ["", " ", "\n\t\x0b\x0c\r ", "a", " a", "a ", "a  b\n\nc ", "\x1ca\x85b é c　d"])
def test_joined_words(text):
    joined, starts, ends = joined_words(text.encode())
    words = text.encode().split()
    assert joined == b" ".join(words) and [joined[a:z] for a, z in zip(starts, ends, strict=True)] == words
