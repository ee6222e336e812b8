"""Links among versions of one text, against all pairs."""

import random

import numpy as np
import pytest

from edgeframe.llm import dedup


def components(texts, k):
    """The smallest number of each text's component, by all pairs of whole sets."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    places = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    holds = np.zeros((len(texts), len(places)), np.float32)
    for i, s in enumerate(sets):
        holds[i, [places[x] for x in s]] = 1
    size = holds.sum(1)
    both = holds @ holds.T
    linked = (100 * both >= 80 * (size[:, None] + size - both)) & (both > 0)
    root = np.arange(len(texts))
    while True:
        after = np.where(linked, root, len(texts)).min(1)
        after = np.minimum(after, root)
        if (after == root).all():
            return root.tolist(), int(np.triu(linked, 1).sum())
        root = after


def found(spark, texts, k):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs, k).collect()}
    return [got[i] for i in range(len(texts))]


def versions(rng, base, n, edits, words=10**9):
    """Copies of base in each of which some words are exchanged; few ``words`` make edits meet."""
    out = []
    for _ in range(n):
        copy = list(base)
        for p in rng.sample(range(len(copy)), edits if isinstance(edits, int) else rng.randint(*edits)):
            copy[p] = f"x{rng.randrange(words)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_without_a_centre(spark, seed):
    """No text is nearest to all others: every version is three edits away from one that is not there."""
    rng = random.Random(seed)
    texts = [t for f in range(30) for t in versions(rng, [f"f{f}w{i}" for i in range(200)], 20, 3)]
    want, links = components(texts, 4)
    assert links > 300 and found(spark, texts, 4) == want


def test_one_family_at_the_border(spark):
    """600 versions around the threshold, with chains of links away from the fullest version."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = versions(rng, base, 300, (2, 7)) + versions(rng, base, 150, (4, 8), 3)
    for _ in range(150):  # versions of versions
        texts += versions(rng, rng.choice(texts).split(), 1, (1, 5))
    want, links = components(texts, 4)
    assert links > 1000 and 1 < len(set(want)) < 500 and found(spark, texts, 4) == want


def test_cut_versions(spark):
    """Versions that only lack words: their differences from the hub are shingles lacked, none added."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(160)]
    texts = [" ".join(base[rng.randrange(25) : 160 - rng.randrange(25)]) for _ in range(200)]
    want, links = components(texts, 5)
    assert links > 100 and found(spark, texts, 5) == want


def test_families_that_share_text(spark):
    """A long passage that all hold brings families into the same buckets without linking them."""
    rng = random.Random(7)
    shared = [f"s{i}" for i in range(120)]
    texts = [t for f in range(12) for t in versions(rng, [*shared, *(f"f{f}w{i}" for i in range(60))], 15, (0, 5))]
    want, links = components(texts, 4)
    assert links > 100 and found(spark, texts, 4) == want
