"""Near-duplicate groups by MinHash with tensored banding.

A document is the set of its distinct shingles of `words` words. Two collections of `collections` sub-bands,
each of `rows` min-hashes, are computed once; a table's key is the pair of one sub-band of either collection.
collections^2 tables of 2 * rows hashes so take 2 * collections * rows min-hashes, the square root or so of what
tables of their own would. With 12 sub-bands of 2 rows a pair of similarity 0.75 shares a table with probability
0.9999. Candidates are confirmed on their full sets.

Groups of any size, in order:
  copies      documents with the same set are one node, so that copies never meet in a table;
  sub-bands   a table's key can only be shared where both its sub-bands are, so only those are paired;
  stars       each member of a table is compared with one member, the most connected; links form components;
  the rest    where a table still holds members of two components, those are compared with each other: in blocks
              of `block` rows, by an exact upper bound on the overlap first, and by the full sets where it allows
              a link. No pair of one table goes unconfirmed unless both are in one component already.
Components come from labels passed along links, in the cluster.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, free_name, small_side, tidy, with_row

WORDS = 5
PERCENT = 75
COLLECTIONS = 12
ROWS = 2
BLOCK = 512
BINS = 512
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of words, with what a table entry takes, whose hashes a worker keeps.
_KNOWN = 48 << 20
_ENTRY = 160
_U = np.uint64


@lru_cache(maxsize=64)
def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed) | 1 for k in range(n)], _U)


_MIX = _constants(64, 1)


class Shingler:
    """Texts to sorted distinct 64-bit shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.known, self.held = words, {}, 0

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode(errors="replace").translate(_LOWER).split()
        if not found:
            return np.empty(0, _U)
        known = self.known
        if self.held > _KNOWN:
            known.clear()
            self.held = 0
        try:
            w = np.fromiter(map(known.__getitem__, found), _U, len(found))
        except KeyError:
            for x in set(found).difference(known):
                known[x] = xxhash.xxh64_intdigest(x, 5)
                self.held += len(x) + _ENTRY
            w = np.fromiter(map(known.__getitem__, found), _U, len(found))
        n = min(self.words, len(w))
        h = w[: len(w) - n + 1] * _MIX[0]
        for k in range(1, n):
            h = h + (w[k : len(w) - n + 1 + k] ^ (w[k : len(w) - n + 1 + k] >> _U(29))) * _MIX[k]
        h ^= h >> _U(32)
        h *= _MIX[32 + n]
        h ^= h >> _U(29)
        h.sort()  # much faster than np.unique, which goes by a table
        return h[np.r_[True, h[1:] != h[:-1]]]


def sub_bands(shingles: np.ndarray, collections: int, rows: int) -> np.ndarray:
    """2 * collections numbers: sub-bands of the first, then of the second collection."""
    n = 2 * collections * rows
    a, b = _constants(n, 2), _constants(n, 3)
    low = np.full(n, np.iinfo(_U).max, _U)
    for k in range(0, len(shingles), 1 << 14):
        some = shingles[k : k + (1 << 14)]
        np.minimum(low, ((some[None, :] ^ b[:, None]) * a[:, None]).min(1), out=low)
    band = low[::rows].copy()
    for k in range(1, rows):
        band = (band ^ (band >> _U(31))) * _MIX[40] + low[k::rows] * _MIX[41 + k]
    return band ^ (band >> _U(32))


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def shared_pairs(one: np.ndarray, other: np.ndarray, i: int, collections: int) -> np.ndarray:
    """Which pairs share a sub-band of the second collection and none of the first before `i`, as a matrix."""
    found = np.zeros((len(one), len(other)), bool)
    for c in range(collections, one.shape[1]):
        found |= one[:, c][:, None] == other[:, c]
    for c in range(i if found.any() else 0):
        found &= one[:, c][:, None] != other[:, c]
    return found


def _over_texts(docs: DataFrame, make, schema: str) -> DataFrame:
    """Runs `make(text) -> tuple` over `docs` (columns first, text last); the tuple follows the other columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    @tidy
    def read(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]
        work = make()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                made = list(zip(*map(work, some.column(some.num_columns - 1).to_pylist())))
                fixed = some.columns[:-1]
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(c, t) for c, t in zip(made, types[len(fixed) :]))], names=names)

    return docs.mapInArrow(read, schema)


def signatures(docs: DataFrame, words: int, collections: int, rows: int) -> DataFrame:
    """row, id, n, the set's 128-bit digest, and the sub-bands (none of an empty set)."""

    def make():
        shingle = Shingler(words)

        def work(text):
            s = shingle(text)
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            return len(s), digest, sub_bands(s, collections, rows).view(np.int64) if len(s) else []

        return work

    return _over_texts(docs.select("row", "id", "text"), make, "row long, id long, n long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """row and its set as bytes of sorted 64-bit numbers."""

    def make():
        shingle = Shingler(words)
        return lambda text: (shingle(text).tobytes(),)

    return _over_texts(docs.select("row", "text"), make, "row long, shingles binary")


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """row, set size, and how many shingles fall into each of BINS bins; no bins where a bin can't hold its count."""

    def make():
        shingle = Shingler(words)

        def work(text):
            s = shingle(text)
            bins = np.bincount((s >> _U(64 - int(math.log2(BINS)))).astype(np.int64), minlength=BINS)
            return len(s), bins.astype(np.uint8).tobytes() if bins.max(initial=0) < 256 else b""

        return work

    return _over_texts(docs.select("row", "text"), make, "row long, n long, bins binary")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of rows that are linked by their full sets."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "near-wanted")
    own = docs.select("row", "text").join(small_side(wanted, wanted.count()), "row", "left_semi")
    sets = shingle_sets(own, words)
    one = sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb"))
    other = sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa"))

    @tidy
    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                common = len(np.intersect1d(x, y, assume_unique=True)) if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) else 0
                keep.append(bool(linked(common, len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(one, "b").join(other, "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that it reaches, of every node of the links (a, b)."""
    edges = cut(links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*").distinct(), "near-edges")
    labels = cut(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("label")), "near-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        step = cut(step, "near-step")
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        after = cut(step.join(jump, "low").select("node", "label", F.least("low", "lower").alias("next")), "near-labels")
        labels = after.select("node", F.col("next").alias("label"))
        if after.where("next <> label").isEmpty():
            return labels


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("row"))
    return members.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))


def _rest(tables: DataFrame, signed: DataFrame, docs: DataFrame, labels: DataFrame, words: int, percent: int, collections: int, block: int) -> DataFrame:
    """Pairs of rows of different components that share a table and that the upper bound allows to be linked."""
    members = _labelled(tables, labels)
    mixed = cut(members.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key"), "near-mixed")
    # the tables of one sub-band of the first collection are compared at once, and a pair where it first shares one
    left = cut(members.join(mixed, "key").groupBy("row", "i", "u", "label").agg(F.count("*").alias("t")).drop("t"), "near-left")
    sizes = cut(left.groupBy("i", "u").agg(F.count("*").alias("size")), "near-sizes")
    wanted = cut(left.select("row").distinct(), "near-wanted")
    count = wanted.count()
    if not count:
        return None
    sketches = _sketches(docs.select("row", "text").join(small_side(wanted, count), "row", "left_semi"), words)
    facts = sketches.join(signed.select("row", "bands"), "row")
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = left.join(sizes, ["i", "u"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("p"), F.greatest(k, "own").alias("q"))))
    cells = dealt.withColumn("cell", cell).select("row", "label", "i", "u", "own", "cell.p", "cell.q").join(facts, "row")

    def compare(pdf):
        import pandas as pd

        i, p, q = int(pdf.i.iloc[0]), int(pdf.p.iloc[0]), int(pdf.q.iloc[0])
        rows, label, n = pdf.row.to_numpy(), pdf.label.to_numpy(), pdf.n.to_numpy()
        bands = np.stack(pdf.bands.to_list())
        known = np.array([len(b) == BINS for b in pdf.bins])
        bins = np.stack([np.frombuffer(b, np.uint8) if len(b) == BINS else np.zeros(BINS, np.uint8) for b in pdf.bins])
        one = np.flatnonzero(pdf.own.to_numpy() == p)
        other = np.flatnonzero(pdf.own.to_numpy() == q)
        open_ = shared_pairs(bands[one], bands[other], i, collections)
        open_ &= label[one][:, None] != label[other]
        if p == q:
            open_ &= rows[one][:, None] < rows[other]
        x, y = np.nonzero(open_)
        x, y = one[x], other[y]
        near = percent * np.maximum(n[y], n[x]) <= 100 * np.minimum(n[y], n[x])
        x, y = x[near], y[near]
        a, b = [], []
        for k in range(0, len(x), 4096):
            u, v = x[k : k + 4096], y[k : k + 4096]
            most = np.minimum(bins[v], bins[u]).sum(1, dtype=np.uint32).astype(np.int64)
            most = np.where(known[v] & known[u], most, np.minimum(n[v], n[u]))
            keep = linked(most, n[v], n[u], percent)
            a += rows[u[keep]].tolist()
            b += rows[v[keep]].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return cells.groupBy("i", "u", "p", "q").applyInPandas(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, collections: int = COLLECTIONS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """__row, doc_id, n_shingles, component_id, kept of every row of `docs`, a table as read.

    With fewer words than `words` a text is one shingle. A text that is null, empty or white space only has no
    shingle and is linked with nothing. Repeated rows are copies of each other. component_id is the smallest id
    of the component, and a row with it is kept; of rows that share that id, all are. A null id counts as
    larger than all others and, where a component has no other, such a row is kept with a null component_id.
    Other columns are not read, and an empty table gives no rows.
    """
    slim = with_row(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), "row")
    signed = cut(signatures(slim, words, collections, rows), "near-signed")
    nodes = cut(signed.where("n > 0").groupBy("digest").agg(F.min("row").alias("node")), "near-nodes")
    copies = signed.select("row", "id", "n", "digest").join(nodes, "digest", "left").select("row", "id", "n", F.coalesce("node", "row").alias("node"))
    heads = cut(nodes.select(F.col("node").alias("row")).join(signed.select("row", "bands"), "row"), "near-heads")

    bands = heads.select("row", F.posexplode("bands").alias("place", "band"))
    shared = cut(bands.groupBy("place", "band").agg(F.min("row").alias("l"), F.max("row").alias("h")).where("l < h").select("place", "band"), "near-shared")
    both = bands.join(shared, ["place", "band"]).groupBy("row").agg(F.collect_list(F.struct("place", "band")).alias("s"))
    side = lambda low: F.explode(F.filter("s", lambda x: (x["place"] < collections) if low else (x["place"] >= collections)))
    keys = both.withColumn("a", side(True)).withColumn("b", side(False))
    tables = keys.select("row", F.col("a.place").alias("i"), F.col("a.band").alias("u"), F.xxhash64("a.place", "a.band", "b.place", "b.band").alias("key"))
    tables = cut(tables, "near-tables")
    degree = tables.groupBy("row").agg(F.count("*").alias("degree"))
    ranked = tables.join(degree, "row").select("row", "i", "u", "key", "degree")
    leader = cut(ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("row")).alias("r"))).alias("m"), F.count("*").alias("c")).where("c > 1").select("key", (-F.col("m.r")).alias("leader")), "near-leaders")
    shared_tables = cut(tables.join(leader, "key"), "near-stars")
    stars = cut(shared_tables.where("row <> leader").select(F.least("row", "leader").alias("a"), F.greatest("row", "leader").alias("b")).distinct(), "near-pairs")
    links = cut(confirmed(stars, slim, words, percent), "near-links")
    labels = components(links)
    more = _rest(shared_tables, signed, slim, labels, words, percent, collections, block)
    if more is not None:
        fresh = cut(confirmed(cut(more, "near-pairs"), slim, words, percent), "near-links")
        if not fresh.isEmpty():
            labels = components(links.unionByName(fresh))
    found = cut(copies.join(labels, "node", "left").select("row", "id", "n", F.coalesce("label", "node").alias("label")), "near-found")
    least = cut(found.groupBy("label").agg(F.min("id").alias("component_id")), "near-least")
    return found.join(least, "label").select(
        F.col("row").alias("__row"),
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, a table as read, that are kept, with all their columns, whatever their names. Texts without
    words all stay; of repeated rows with the kept id all do. An empty table stays empty."""
    row = free_name(docs, "__row")
    kept = near_groups(docs, doc_id, text, **options).where("kept").select(F.col("__row").alias(row))
    return with_row(docs, row).join(kept, row, "left_semi").drop(row)


def op4_near_dedup(spark, sf_dir):
    """Groups of near copies among all documents."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("__row")
