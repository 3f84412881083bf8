import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_odd import ODD
from tidemark.llm import topk, toxicity, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k_against_brute_force(read):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.1, 6).astype(float).round(2).tolist()) for i in range(400)]
    rows[50] = (50, [0.9] * 6)
    rows += [(400, None), (None, [0.1] * 6), (401, [float("nan")] * 6), (402, [None] * 6), (403, [float("inf")] * 6), (50, rows[50][1]), (404, [1.0, 1.0]), (405, [])]
    valid = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for options in ({}, {"block": 64, "batch": 3}):
        got = topk.top_k(read(rows, VECTORS), F.col("vec_id") % 50 == 0, **options).collect()
        by = {}
        for r in got:
            by.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
        for q in (0, 100, 350):
            x = dict(valid)[q]
            scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in valid if i != q)[:5]
            assert sorted(by[q]) == [(k + 1, s, i) for k, (s, i) in enumerate(scores)]
        assert len(by[50]) == 10 and sum(v == 50 for _, _, v in by[50]) == 2  # two rows ask, each finds the other
    assert topk.top_k(read([], VECTORS), F.lit(True)).count() == 0
    assert topk.top_k(read([(1, [0.5]), (2, [0.25])], VECTORS), F.lit(True)).count() == 2


@pytest.mark.parametrize("spread", ["sphere", "falling"])
def test_bounds_stop_early_and_right(spread):
    """Most queries end before the last list, after less than the whole product, with all ties of the k-th."""
    rng = np.random.default_rng(2)
    rows = rng.normal(0, 1, (4000, 64)) * (np.linspace(1, 0.02, 64) if spread == "falling" else 1)
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
    rows[100:110] = rows[0]  # ties
    own, seen = np.arange(0, 4000, 80), []
    for (places, scores), i in zip(topk.top_of_block(rows[own], rows, own, 5, seen=seen), own):
        every = rows @ rows[i]
        every[i] = np.iinfo(np.int64).min
        assert sorted(places) == np.flatnonzero(every >= np.sort(every)[-5]).tolist() and (every[places] == scores).all()
    read, early, resolved = map(np.array, zip(*seen))
    assert early.mean() > 0.9 and (read / rows.size).mean() < 0.75 and np.median(resolved) <= 5 * topk.LEFT


def test_first_lists_leave_few_to_read_by_query():
    """Many queries at once, in single and double precision, few rows and ties; few places are left for later rounds."""
    rng = np.random.default_rng(5)
    for n, d, scale in ((6000, 64, 256), (3, 64, 256), (70, 1, 9), (900, 7, 2), (900, 16, 1 << 19)):
        rows = rng.normal(0, 1, (n, d))
        rows = np.floor(scale * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
        own = np.arange(n)[:: max(1, n // 50)]
        for (places, scores), i in zip(topk.top_of_block(rows[own], rows, own, 5), own):
            every = np.delete(rows @ rows[i], i)
            least = np.sort(every)[-min(5, n - 1)]
            assert sorted(scores) == sorted(every[every >= least]) and i not in places
        if n == 6000:
            begun = topk.Lists(rows, np.float32, topk.DEPTH, 1 << 22).begun(rows[own], own, 5, 44)
            assert np.median([len(b[1]) for b in begun]) < n / 10


def test_scores_beyond_a_long_are_its_ends():
    rows = np.array([[2**62, 5], [-(2**63), 1], [3, 2**61]])
    [(places, scores)] = topk.top_of_block(rows[:1], rows, np.array([0]), 2)
    assert dict(zip(places.tolist(), scores.tolist())) == {1: -(2**63), 2: 2**63 - 1}


def test_huge_components_stay_exact():
    rows = np.array([[1 << 30, 3], [1 << 30, 5], [-1, 1]])
    [(places, scores)] = topk.top_of_block(rows[:1], rows, np.array([0]), 1)
    assert places.tolist() == [1] and scores.tolist() == [(1 << 60) + 15]


def test_toxicity_learns_pairs():
    """Neither of two words alone is toxic, both are: a sum of weights can't say so."""
    rng = random.Random(0)
    texts, labels = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([f"w{rng.randrange(5)}x"] + ["insult"] * a + ["group"] * b))
        labels.append(int(a and b))
    index = np.unique(np.concatenate([toxicity.terms(t) for t in texts]))
    place = {int(t): k for k, t in enumerate(index)}
    found = [np.array(sorted(place[int(t)] for t in toxicity.terms(x))) for x in texts]
    model = toxicity.train(found[:900], np.array(labels[:900]), index, steps=200)
    right = (model.scores([f.tolist() for f in found[900:]]) >= 0.3) == np.array(labels[900:])
    assert right.mean() > 0.98
    alone = toxicity.Model(model.bias, index, model.weight, np.zeros_like(model.factors))
    assert ((alone.scores([f.tolist() for f in found[900:]]) >= 0.3) == np.array(labels[900:])).mean() < right.mean()


def test_toxicity_fits_pairs_as_in_production(read):
    """The same through fit(), with its choice of terms and its factors and steps; judged on held-out rows."""
    assert (toxicity.FACTORS, toxicity.STEPS) == (8, 250)
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((k, " ".join([f"w{rng.randrange(5)}x"] + ["insult"] * a + ["group"] * b)))
        labels.append((k, 1, int(a and b)))
    docs, labelled = read(rows), read(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labelled)
    assert model.factors.shape[1] == 8
    apart = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(apart) > 300 and np.mean([(r.score >= toxicity.THRESHOLD) == labels[r.doc_id][2] for r in apart]) > 0.98


def test_scores_are_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = toxicity.Model(-0.3, np.arange(9, dtype=np.uint32), rng.normal(size=9), rng.normal(size=(9, 4)))
    found = [[], [2], [0, 1], [1, 3, 4, 8], list(range(9))]
    for own, got in zip(found, model.scores(found)):
        logit = model.bias + sum(model.weight[i] for i in own) + sum(model.factors[i] @ model.factors[j] for i in own for j in own if i < j)
        assert got == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-12)


def test_all_terms_beyond_chance_are_kept(spark):
    """No cap on terms: each of 1000 terms of toxic texts alone is one."""
    rows = [(k, int(k < 40), [t for t in range(1000) if k < 40] if k < 40 else [5000]) for k in range(200)]
    assert len(toxicity.chosen_terms(spark.createDataFrame(rows, "d long, y int, terms array<int>"))) == 1001


def test_toxicity_decisions(spark, read):
    rng = random.Random(3)
    words = [f"calm{k}" for k in "abcdefgh"]
    rows = [(i, " ".join(rng.choices(words, k=12) + (["vilewordsone"] if i % 5 == 0 else []))) for i in range(400)] + [(1000 + k, t) for k, (_, t) in enumerate(ODD)] + [(None, "vilewordsone")]
    labels = read([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (3, 0, None), (7, 0, 2)], "doc_id long, quality int, toxic int")
    got = toxicity.decided(read(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert r.predicted == int(r.doc_id < 1000 and r.doc_id % 5 == 0)
    kept = toxicity.drop_toxic(read(rows), labels)
    assert kept.columns == read(rows).columns and kept.count() == sum(not r.predicted for r in got)
    none = read([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.decided(read(rows[:5]), none).collect()} <= {0, 1} and toxicity.decided(read([]), labels).count() == 0


PAGES = "page_id long, url string, html string, header string, payload string"


def test_archive_round_trip(spark, read, tmp_path):
    big, small = "<p>é" * 400, "x" * 50
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, small), (4, "u", small), (5, "u", None), (6, "u", ""), (2, "again", big), (None, "n", big)]
    path = str(tmp_path / "archive")
    warc.write_archive(read(rows, PAGES), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    records = warc.read_records(spark, path)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.parsed(records).collect())
    n = len(big.encode())
    assert [g for g in got if g[0] not in (0, 2)] == [(1, n, "revisit", 2), (3, 50, "response", None), (4, 50, "response", None), (5, 0, "response", None), (6, 0, "response", None)]
    assert sorted(g[2] for g in got if g[0] == 2) == ["response", "revisit"] and [g[2] for g in got if g[0] == 0] == ["revisit"]
    whole = [bytes(r.record) for r in warc.record_bytes(records).collect()]
    assert sum(big.encode() in w for w in whole) == 1 and all(w.startswith(b"WARC/1.1\r\n") and w.endswith(b"\r\n\r\n") for w in whole)
    assert not any(b"\r\nX: y" in w for w in whole)
    empty = str(tmp_path / "empty")
    warc.write_archive(read([], PAGES), empty)
    assert warc.parsed(warc.read_records(spark, empty)).count() == 0


def test_damaged_payload_is_refused(spark, read, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(read([(1, "u", "text")], PAGES), path)
    wrong = spark.read.parquet(f"{path}/payloads").select("sha256", F.lit(b"other").alias("payload"))
    wrong.write.parquet(f"{path}/wrong")
    import shutil

    shutil.rmtree(f"{path}/payloads")
    shutil.move(f"{path}/wrong", f"{path}/payloads")
    with pytest.raises(Exception, match="missing or damaged"):
        warc.read_records(spark, path).collect()
