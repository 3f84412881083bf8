import random
import re

import numpy as np
import pytest

from tests_llm_odd import ODD
from tidemark.llm import near_dedup
from tidemark.llm.near_dedup import Shingler, drop_near, linked, near_groups, sub_bands

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Component by row number, all pairs compared."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                of[max(root(i), root(j))] = min(root(i), root(j))
    return [len(s) for s in sets], [root(i) for i in range(len(rows))]


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randint(3, 150))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_against_brute_force(read, block):
    rows = corpus(3, 260) + [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    sizes, roots = brute(rows)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    got = {r.doc_id: r for r in near_groups(read(rows), block=block).collect()}
    assert len(got) == len(rows)
    for (i, _), n, r in zip(rows, sizes, roots):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, least[r], i == least[r])


def test_rows_that_stay(read):
    df = read([(3, "a b c d e f"), (2, "A b c d e f"), (2, None), (9, None), (None, "a b c d e f")])
    kept = drop_near(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(2, "A b c d e f")] and kept.count() == 3
    assert near_groups(read([])).count() == 0


def test_sub_bands_meet_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    hits = []
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        y = np.unique(np.r_[x[:300], rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
        a, b = sub_bands(x, 12, 2), sub_bands(y, 12, 2)
        hits.append((a == b).mean())
    assert np.mean(hits) == pytest.approx((300 / 450) ** 2, abs=0.03)
    assert linked(np.array([3]), 4, 3, 75)[0] and not linked(np.array([2]), 3, 3, 75)[0]
    assert len(Shingler()("a b c")) == 1 and len(Shingler()(" \n")) == 0


def test_pairs_of_a_block_as_one_matrix():
    """Pairs that share a sub-band of the second collection, and none before the i-th of the first."""
    rng = np.random.default_rng(7)
    one, other = rng.integers(0, 4, (30, 6)), rng.integers(0, 4, (40, 6))
    for i in range(3):
        found = near_dedup.shared_pairs(one, other, i, 3)
        for x, a in enumerate(one):
            for y, b in enumerate(other):
                assert found[x, y] == ((a[3:] == b[3:]).any() and not (a[:i] == b[:i]).any())
    assert near_dedup._constants(48, 2) is near_dedup._constants(48, 2)  # made once, not for each text
