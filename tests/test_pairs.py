"""Queries over pairs: values against brute force, and plans in which no pair meets a join or a shuffle."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_whole import events

from tidemark import workload
from tidemark.operators import pairs


def text_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_events(entities=80, each=12, tokens=("view", "click", "signup", "purchase"), seed=0):
    rng = np.random.default_rng(seed)
    return [(int(d), u, str(rng.choice(tokens)), int(o)) for u in range(entities) for d, o in rng.integers(0, 7, (each, 2))]


@pytest.mark.parametrize("listed", [0.0, math.inf])
@pytest.mark.parametrize("measure", ["least", "dot", "adamic"])
def test_overlaps_listed_and_multiplied(monkeypatch, listed, measure):
    """All cells of two blocks of several strips, from names that are partly shared; rows without shared names are left out."""
    monkeypatch.setattr(pairs, "DENSE", listed)
    monkeypatch.setattr(pairs, "LISTED", 5000)
    rng = np.random.default_rng(1)
    full, made = [], []
    for n, start in ((600, 0), (2500, 3)):
        x = rng.integers(1, 6, (n, 12)) * (rng.random((n, 12)) < 0.3)
        row, at = np.nonzero(x)
        made.append(pairs.Block(np.arange(n), np.append(0, np.cumsum((x > 0).sum(1))), at, x[row, at].astype(float), [f"n{k}" for k in range(start, start + 12)]))
        full.append(np.hstack([np.zeros((n, start)), x, np.zeros((n, 3 - start))]))
    a, b = (pairs.Block.unpack(m.pack()) for m in made)
    weight = rng.random(12)
    got = np.full((600, 2500), 0.0)
    for x, y, values in pairs.overlaps(a, b, measure, lambda x, y, v: v[0] > 0, weight):
        assert (got[x, y] == 0).all()
        got[x, y] = values[-1]
    p, q = full
    if measure == "adamic":
        p, q = (p > 0) * np.append(weight, np.zeros(3)), (q > 0) * 1.0
    want = sum(np.minimum(p[:, k, None], q[:, k]) for k in range(15)) if measure == "least" else p @ q.T
    assert np.allclose(got, want)


def test_planes_meet_once():
    for n, line in (pairs.PLANE, pairs.NARROW):
        assert Counter((i - j) % n for i in line for j in line if i != j) == {d: 1 for d in range(1, n)}


def test_weighted_jaccard_by_blocks(spark, tmp_path):
    """Without a join; features that are null count nowhere, as in the SQL of the query."""
    rows = some_events() + [(1, u, "view", "null") for u in range(0, 80, 3) for _ in range(9)] + [(1, None, "view", 1), (2, 500, "view", "null")]
    rows = [(d, u, t, o) for d, u, t, o in rows]
    of = defaultdict(Counter)
    for _, u, t, o in rows:
        if o != "null" and u is not None:
            of[u][t, o % 4] += 1
    want = {}
    for a in of:
        for b in of:
            if a < b and (j := sum((of[a] & of[b]).values()) / sum((of[a] | of[b]).values())) >= 0.5:
                want[a, b] = math.floor(j * 1e6 + 0.5) / 1e6
    df = workload.QUERIES["weighted_jaccard_exact"](spark, events(spark, tmp_path, rows))
    got = {(r.e1, r.e2): r.jaccard for r in df.collect()}
    assert got == want and len(got) > 20 and "Join" not in text_of(df)


def test_mutual_nearest_by_blocks(spark, tmp_path):
    """Without a join; many entities are equal, so that ids break ties; tokens that are null count nowhere."""
    rows = some_events(120, 4, ("view", "click")) + [(1, u, None, 1) for u in range(0, 120, 5) for _ in range(6)]
    of = defaultdict(Counter)
    for _, u, t, _ in rows:
        if t is not None:
            of[u][t] += 1
    norm = {u: math.sqrt(sum(w * w for w in c.values())) for u, c in of.items()}
    best = {}
    for a in of:
        near = sorted((-round(dot / (norm[a] * norm[b]), 9), b) for b in of if b != a and (dot := sum(w * of[b][t] for t, w in of[a].items())))
        best[a] = {b: -c for c, b in near[:10]}
    want = {(a, b): round(c, 6) for a in best for b, c in best[a].items() if a < b and a in best[b]}
    df = workload.QUERIES["mutual_ten_nearest"](spark, events(spark, tmp_path, rows))
    got = {(r.e1, r.e2): r.cos for r in df.collect()}
    assert got.keys() == want.keys() and len(got) > 50 and "Join" not in text_of(df)
    assert all(got[p] == pytest.approx(c, abs=1.5e-6) for p, c in want.items())


def test_adamic_adar_by_blocks(spark, tmp_path):
    """Pairs meet in no join; writes of no known entity count among an object's."""
    rows = [(1, u, "signup", o) for o in range(6) for u in range(o, 300, o + 1)] + [(1, None, "purchase", 0), (1, 7, "signup", "null")]
    of = defaultdict(set)
    for _, u, _, o in rows:
        of[o].add(u)
    common = defaultdict(list)
    for o in range(6):
        for a in of[o] - {None}:
            for b in of[o] - {None}:
                if a < b:
                    common[a, b].append(1 / math.log(len(of[o]) + 1))
    want = {p: (len(v), sum(v)) for p, v in common.items() if len(v) >= 3}
    df = workload.QUERIES["adamic_adar_support"](spark, events(spark, tmp_path, rows))
    got = {(r.e1, r.e2): (r.common, r.adamic_adar) for r in df.collect()}
    assert got.keys() == want.keys() and len(got) > 500
    assert all(got[p][0] == n and abs(got[p][1] - x) < 1e-6 for p, (n, x) in want.items())
    assert text_of(df).count("Join") == 1


@pytest.mark.parametrize("many", [0.0, math.inf])
def test_weighted_minhash_by_blocks(monkeypatch, many):
    """Candidates one by one and all pairs of a block give the pairs that share a band and half their weight."""
    import pyarrow as pa

    from tidemark.operators import served

    monkeypatch.setattr(served, "MANY", many)
    of = defaultdict(Counter)
    for _, u, t, o in some_events(90, 14):
        of[u][f"{t}/{o % 4}"] += 1
    keys, made = {}, []
    for part in (range(0, 50), range(50, 90)):
        rows = [(u, f, w) for u in part for f, w in of[u].items()]
        made.append(served._banded(pa.table(dict(zip(("id", "f", "w"), map(list, zip(*rows)))))))
        keys |= dict(zip(made[-1].ids.tolist(), served.band_keys(made[-1])))
    found = {}
    monkeypatch.setattr(served.pairs, "block_pairs", lambda packed, plane, work, schema: work)
    monkeypatch.setattr(served.pairs, "blocks", lambda *_: None)
    monkeypatch.setattr(served, "_sets", lambda *_: None)
    work = served.weighted_minhash_pairs(None, None)
    a, b = (pairs.Block.unpack(m.pack()) for m in made)
    for x, y in ((a, a), (a, b), (b, b)):
        for got in work(x, y):
            found |= {(p, q): j for p, q, j in zip(*(got[c].tolist() for c in ("e1", "e2", "jaccard")))}
    want = {}
    for p in of:
        for q in of:
            j = sum((of[p] & of[q]).values()) / sum((of[p] | of[q]).values())
            if p < q and j >= 0.5 and (keys[p] == keys[q]).any():
                want[p, q] = math.floor(j * 1e6 + 0.5) / 1e6
    assert found == want and len(want) > 20


def test_weighted_minhash_shuffles_no_pairs(spark, tmp_path):
    df = workload.QUERIES["weighted_minhash_pairs"](spark, events(spark, tmp_path, some_events()))
    assert "Join" not in text_of(df) and df.count() > 5


def test_nearest_vectors_by_blocks(spark, tmp_path):
    """Without a join; with equal vectors, null components and, last of all, a vector of nulls only."""
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (400, 4)).astype(float)
    x[(x == 0).all(1)] = 1
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows[7] = (7, [None, 2.0, 1.0, None])
    x[7] = (0, 2, 1, 0)
    rows += [(400, [None] * 4), (401, None), (402, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    norm = np.sqrt((x * x).sum(1))
    cos = (x @ x.T) / (norm[:, None] * norm)
    df = workload.QUERIES["knn_cosine"](spark, str(tmp_path))
    got = {(r.q, r.k): (r.c, r.cosine) for r in df.collect()}
    asked = [q for q in range(400) if q in {q for q, _ in got}]
    assert set(range(0, 400, 50)) <= set(asked)
    for q in asked:
        near = sorted((-round(cos[q, c], 9), c) for c in range(400) if c != q)[:3]
        for k, (v, c) in enumerate(near):
            assert got[q, k + 1][0] == c and abs(got[q, k + 1][1] + v) < 2e-6
    assert [got[400, k] for k in (1, 2, 3)] == [(0, None), (1, None), (2, None)]
    assert "Join" not in text_of(df)


def test_nearest_of_every_vector(spark, small):
    ids = {r.vec_id for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id").collect()}
    got = Counter(r.q for r in workload.QUERIES["knn_cosine"](spark, small).collect())
    assert got == dict.fromkeys(ids, 3) and "% 50" not in workload.ORACLES["knn_cosine"]
