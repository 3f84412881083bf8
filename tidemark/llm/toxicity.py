"""Toxicity by a factorization machine over hashed terms.

A term is a word, or the start of one, hashed to `BITS` bits; a document has the set of its terms. Terms whose
share differs between toxic and other documents by more than chance would give are kept, all of them, and

    logit = bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

is fitted to the labels: the second sum has what two terms mean together beyond what each adds, such as an
insult and the mention of a group. Fitting sees `SAMPLE` labelled rows at most, those of the smallest hash of
their id, and its model has a row of `FACTORS` + 1 numbers for each kept term of those; scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, free_name, tidy

BITS = 30
SAMPLE = 24_000
FACTORS = 8
CHI2 = 15.0
THRESHOLD = 0.3
STEPS = 250
_STARTS = (4, 5)
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_KNOWN = 150_000


def _hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) >> (64 - BITS)


@lru_cache(maxsize=1 << 15)
def _terms(word: bytes) -> tuple[int, ...]:
    return (_hash(b"w" + word), *(_hash(b"s" + word[:n]) for n in _STARTS if len(word) > n))


def words(text: str | None) -> set[bytes]:
    """Distinct words in lower case (A-Z only): what is between characters of ASCII that aren't letters."""
    return set((text or "").encode(errors="replace").translate(_WORDS).split())


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms in order."""
    return np.array(sorted({t for w in words(text) for t in _terms(w)}), np.uint32)


@dataclass
class Model:
    bias: float
    index: np.ndarray  # hashed terms in order
    weight: np.ndarray
    factors: np.ndarray  # len(index) x FACTORS

    def scores(self, found: list[list[int]]) -> np.ndarray:
        """Probabilities of documents given by the places of their terms in `index`."""
        size = [len(f) for f in found]
        flat = np.array([i for f in found for i in f], np.int64)
        row = np.repeat(np.arange(len(found)), size)
        total = np.bincount(row, self.weight[flat], len(found)) + self.bias
        for f in range(self.factors.shape[1]):
            v = self.factors[flat, f]
            total += 0.5 * (np.bincount(row, v, len(found)) ** 2 - np.bincount(row, v * v, len(found)))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def chosen_terms(rows: DataFrame, least: float = CHI2) -> np.ndarray:
    """Of term sets (d, y, terms) the terms that go with a class, by the chi-squared statistic of their counts;
    counted in the cluster, so that the driver gets a number for each term above `least`."""
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < n1 < n:
        return np.empty(0, np.uint32)
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("y").alias("c1")).where("c >= 2")
    expected = F.col("c") * (n1 / n)
    spread = expected * (1 - n1 / n) * (1 - F.col("c") / n)
    off = F.greatest(F.abs(F.col("c1") - expected) - 0.5, F.lit(0.0))
    best = counts.select("term", (off * off / F.greatest(spread, F.lit(1e-9))).alias("chi2")).where(F.col("chi2") > least)
    return np.array(sorted(r.term for r in best.collect()), np.uint32)


def train(found: list[np.ndarray], labels: np.ndarray, index: np.ndarray, factors: int = FACTORS, steps: int = STEPS, decay: float = 2e-4, seed: int = 7) -> Model:
    """Fits a model to documents, given by the places of their terms in `index`, and labels 0 or 1."""
    y = np.asarray(labels, float)
    of = np.repeat(np.arange(len(y)), [len(f) for f in found])
    at = np.concatenate(found).astype(np.int64) if len(found) else np.empty(0, np.int64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))), index, np.zeros(len(index)), np.random.default_rng(seed).normal(0, 0.05, (len(index), factors)))
    if not len(index):
        return model
    n = len(y)
    # documents without a chosen term differ in nothing but their label: the bias sees their number
    values = [np.array([model.bias]), model.weight, model.factors]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        bias, weight, vectors = values
        sums = np.stack([np.bincount(of, vectors[at, f], n) for f in range(factors)], 1)
        squares = np.bincount(of, (vectors[at] ** 2).sum(1), n)
        logit = bias[0] + np.bincount(of, weight[at], n) + 0.5 * ((sums**2).sum(1) - squares)
        slope = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / n
        own = slope[of]
        pull = np.stack([np.bincount(at, own * (sums[of, f] - vectors[at, f]), len(index)) for f in range(factors)], 1)
        slopes = [np.array([slope.sum()]), np.bincount(at, own, len(index)) + decay * weight / len(index), pull + decay * vectors / factors]
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        for v, g, a, b in zip(values, slopes, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return Model(float(values[0][0]), index, values[1], values[2])


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, **options) -> Model:
    """A model from the labelled rows outside the held-out quarter, `sample` of them at most.

    A label other than 0 or 1, or without an id, counts for nothing. An id with several labels, or with several
    documents, gives a row for each pair of them; of more than `sample` rows those of the smallest hash are used."""
    chosen = labels.select(F.col(doc_id).alias("d"), F.col(label).cast("int").alias("y")).where("d IS NOT NULL AND y IN (0, 1)")
    chosen = chosen.where(~held_out("d")).orderBy(F.xxhash64("d"), "d", "y").limit(sample)
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(chosen), "d")  # at most `sample` rows of two numbers

    @tidy
    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                found = pa.array([terms(t).astype(np.int32) for t in some.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), found], names=["d", "y", "terms"])

    known = cut(rows.select(F.col("d").cast("long"), "t", "y").mapInArrow(read, "d long, y int, terms array<int>"), "toxic-terms")
    if known.count() > sample:  # ids that repeat
        known = cut(known.orderBy(F.xxhash64("d", "y", "terms"), "d").limit(sample), "toxic-terms")
    index = chosen_terms(known)

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.flatnonzero(np.isin(index, np.array(t, np.uint32), assume_unique=True)).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["d", "y", "terms"])

    got = known.mapInArrow(places, "d long, y int, terms array<int>").toArrow()
    d, y = got.column("d").to_numpy(), got.column("y").to_numpy()
    found = got.column("terms").to_pylist()
    order = sorted(range(len(d)), key=lambda k: (d[k], y[k], found[k]))
    return train([np.array(found[k], np.int64) for k in order], y[order], index, **options)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """`docs`, or its columns `keep`, with a probability from each row's whole text; a null or empty one gets what the bias says."""
    keep = docs.columns if keep is None else keep
    place = {int(t): k for k, t in enumerate(model.index)}
    at = keep.index(text) if text in keep else len(keep)

    @tidy
    def read(batches):
        import pyarrow as pa

        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            texts = batch.column(at)
            for k in range(0, batch.num_rows, 512):
                found = []
                for text in texts.slice(k, 512).to_pylist():
                    own = words(text)
                    for w in own.difference(known):
                        known[w] = tuple(place[t] for t in _terms(w) if t in place)
                    found.append(sorted({i for f in map(known.__getitem__, own) if f for i in f}))
                if len(known) > _KNOWN:
                    known.clear()
                some = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(model.scores(found))], names=[*keep, column])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes if c in keep)
    sent = [F.col(f"`{c}`") for c in keep] + ([] if text in keep else [F.col(text).alias("__text")])
    return docs.select(*sent).mapInArrow(read, f"{schema}, `{column}` double")


def decided(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; repeated rows are scored alike. With no usable label
    every row gets the same score, under the threshold. An empty table gives no rows."""
    model = fit(docs, labels, doc_id, text, **options)
    scored = score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), model, "__text", keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of `docs` scored under the threshold, with all their columns, whatever their names. Null and empty
    texts score what the bias says; without labels nothing goes. An empty table stays empty."""
    column = free_name(docs, "__toxicity")
    return score(docs, fit(docs, labels, doc_id, text, **options), text, column).where(F.col(column) < threshold).drop(column)


def op9_toxicity(spark, sf_dir):
    """All documents scored by a model of three quarters of the labels."""
    return decided(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
