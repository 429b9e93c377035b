"""The pipeline's near-dedup against brute force on planted near copies."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np

from tests.llm import brute
from veldspan.llm import resemblance
from veldspan.workspace import Workspace


def shingles(text):
    ws = brute.WORD.findall((text or "").translate(brute.UPPER))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def planted():
    """Base texts and copies with a few words replaced, in chains and around the bound; the last texts share half of their words."""
    rng, out = random.Random(11), []
    word = lambda: f"w{rng.randrange(5000)}"
    for _ in range(12):
        text = [word() for _ in range(rng.randrange(80, 400))]
        out.append(text)
        for _ in range(rng.randrange(1, 6)):
            text = list(out[rng.randrange(len(out))] if rng.random() < 0.1 else text)
            for _ in range(rng.randrange(1, 2 + len(text) // 28)):
                text[rng.randrange(len(text))] = word()
            out.append(text)
    common = [word() for _ in range(150)]
    out += [common[: 100 + 5 * i] + [word() for _ in range(30)] for i in range(11)]
    rng.shuffle(out)
    return [(k, " ".join(t)) for k, t in enumerate(out)]


def expected(docs):
    """Keys that stay, by comparing all pairs."""
    fps, sets = {k: brute.fingerprint(t) for k, t in docs}, {k: shingles(t) for k, t in docs}
    root = {k: k for k, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, _ in docs:
        for b, _ in docs:
            if a < b and ((fps[a] ^ fps[b]).bit_count() <= 2 or similarity(sets[a], sets[b]) >= 0.8):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(k for k in root if find(k) == k)


def test_planted_near_copies_go(spark):
    data = planted()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    want = expected(data)
    by_simhash = brute.components([(k, brute.fingerprint(t)) for k, t in data])
    assert len(want) < sum(by_simhash[k] == k for k in by_simhash) - 10  # most copies are beyond two bits
    got = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want


def test_odd_rows(spark):
    data = [(3, "one two"), (2, "One  TWO"), (None, "one two"), (5, None), (4, ""), (None, "alone here"), (None, "alone here")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in resemblance.deduplicate(docs).collect()))) == ["2", "4", "None"]
    assert resemblance.deduplicate(docs.limit(0)).isEmpty()


def test_a_large_family_costs_no_pairs(spark, monkeypatch):
    """A text and copies with up to 14 words replaced: most pairs share a band, few are similar."""
    rng, compared, similar = random.Random(5), [], resemblance._similar
    base = [f"b{i}" for i in range(150)]
    texts = [(0, " ".join(base))]
    for k in range(1, 400):
        text = list(base)
        for i in rng.sample(range(150), rng.randrange(1, 15)):
            text[i] = f"e{k}x{i}"
        texts.append((k, " ".join(text)))

    def counted(pairs, sets):
        compared.append(pairs.count())
        return similar(pairs, sets)

    monkeypatch.setattr(resemblance, "_similar", counted)
    got = resemblance.deduplicate(spark.createDataFrame(texts, "doc_id long, text string"))
    want = expected(texts)
    assert 100 < len(want) < 390 and sorted(r.doc_id for r in got.collect()) == want
    assert sum(compared) < 4 * len(texts)  # of 79,800


def test_similar_sets_meet_in_the_index(spark):
    """Sets of 1 to 120 shingles, around the bound and of unequal sizes, before anything is linked."""
    rng, sets = random.Random(3), []
    for size in [*range(1, 21), 45, 80, 120]:
        whole = [rng.getrandbits(63) for _ in range(size)]
        sets.append(set(whole))
        for _ in range(12):
            kept = set(rng.sample(whole, size - rng.randrange(size // 4 + 1)))
            sets.append(kept | {rng.getrandbits(63) for _ in range(rng.randrange(size // 6 + 2))})
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    ws = Workspace(spark, "index-test")
    frame = spark.createDataFrame([(k, np.sort(np.array(list(x), "<u8")).tobytes()) for k, x in enumerate(sets)], "sid long, hashes binary")
    none = spark.createDataFrame([], "node long, component long")
    met = {tuple(r) for r in resemblance._across(resemblance._index(frame, ws), none, ws).collect()}
    assert len(near) > 300 and near <= met and len(met) < len(sets) * (len(sets) - 1) // 4
