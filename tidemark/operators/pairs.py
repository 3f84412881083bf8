"""Pairs of rows as matrices between blocks, so that no pair is shuffled.

Blocks are the points of a projective plane and groups its lines: any two blocks meet in one group, and a block is copied
to as many groups as a line has points.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Perfect difference sets: of all differences but 0, modulo the number of blocks, each occurs once.
PLANE, NARROW = (31, (0, 1, 3, 8, 12, 18)), (13, (0, 1, 3, 9))
#: Rows and columns of a tile, features of a dense product, shared features that are listed at once.
STRIP, WIDE, DEEP, LISTED = 256, 2048, 256, 1 << 21
#: A cell and feature of a dense product costs this part of a shared feature that is listed.
DENSE = 1 / 300


class Block:
    """Rows with sparse features: ascending ids, features of each (`ptr`, `at`, `w`) by their place in `names`, and columns."""

    def __init__(self, ids, ptr, at, w, names, **columns):
        self.ids, self.ptr, self.at, self.w, self.names, self.columns = ids, ptr, at, w, names, columns

    def __len__(self) -> int:
        return len(self.ids)

    def pack(self) -> bytes:
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0)))) if (x == np.floor(x)).all() and x.min(initial=0) >= 0 else x
        return zlib.compress(pickle.dumps((self.ids, small(np.diff(self.ptr)), small(self.at), small(self.w), self.names, self.columns)), 1)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        ids, n, at, w, names, columns = pickle.loads(zlib.decompress(data))
        return cls(ids, np.append(0, np.cumsum(n, dtype=np.int64)), at.astype(np.int64), w.astype(float), names, **columns)

    def take(self, rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (by its place in `rows`), new place and weight of the features that have one (`place`, else -1)."""
        n = self.ptr[rows + 1] - self.ptr[rows]
        k = spread(self.ptr[rows], n)
        at = place[self.at[k]]
        keep = at >= 0
        return np.repeat(np.arange(len(rows)), n)[keep], at[keep], self.w[k][keep]


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, and so on."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def from_rows(table: pa.Table) -> Block:
    """A block of rows (id, f, w)."""
    ids, row = np.unique(table["id"].to_numpy(), return_inverse=True)
    f = table["f"].combine_chunks().dictionary_encode()
    at, w = f.indices.to_numpy(), table["w"].to_numpy().astype(float)
    order = np.lexsort((at, row))
    return Block(ids, np.append(0, np.cumsum(np.bincount(row, minlength=len(ids)))), at[order], w[order], f.dictionary.to_pylist())


def blocks(df: DataFrame, make: Callable[[pa.Table], Block], n: int) -> DataFrame:
    """Rows (id, ...), none of whose ids is null, as one packed row a block; `make` gives what has a method `pack`."""

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"][:1], "data": pa.array([make(table).pack()], pa.binary())})

    return df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("block").applyInArrow(pack, "block long, data binary")


def in_groups(packed: DataFrame, group, n: int, work: Callable[[int, dict[int, bytes]], Iterator[dict]], schema: str) -> DataFrame:
    """What `work` yields for the packed blocks of each group; `group` is an array column, the groups of a block."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: d for b in batches for k, d in zip(b["block"].to_pylist(), b["data"].to_pylist())}
        for columns in work(key[0].as_py(), held):
            yield pa.RecordBatch.from_pydict(columns)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    rows = packed.select(F.explode(group).alias("g"), "block", "data")
    return rows.repartition(4 * n, "g").groupBy("g").applyInArrow(run, schema)


def block_pairs(packed: DataFrame, plane, work: Callable[[Block, Block], Iterator[dict]], schema: str, unpack=Block.unpack) -> DataFrame:
    """What `work` yields for each pair of blocks, and for each block with itself."""
    n, line = plane

    def each(g: int, held: dict[int, bytes]) -> Iterator[dict]:
        own = [k for d in line if (k := (g + d) % n) in held]
        for i, a in enumerate(own):
            x = unpack(held[a])
            if a == g:
                yield from work(x, x)
            for b in own[i + 1 :]:
                yield from work(x, unpack(held[b]))

    return in_groups(packed, F.array(*(F.pmod(F.col("block") - d, F.lit(n)) for d in line)), n, each, schema)


def _least(x, y, out):
    part = np.empty_like(out[0])
    for k in range(len(y)):
        np.minimum(x[:, k, None], y[k], out=part)
        out[0] += part


def _dot(x, y, out):
    out[0] += x @ y


def _adamic(x, y, out, weight):
    out[0] += x.astype(np.float32) @ y.astype(np.float32)
    out[1] += (x * weight) @ y


def overlaps(a: Block, b: Block, measure: str, keep, weight=None, rows=None, columns=None) -> Iterator[tuple]:
    """(row of a, row of b, values) of pairs that share a feature and that `keep(row, row, values)` keeps, tile by tile.

    Values are sums over the shared features: "least" of the lesser weight, "dot" of the product of weights, "adamic" of 1
    and of `weight` (of a's feature); weights are above 0.
    Few shared features are listed, many are multiplied out; both give the same."""
    where = {f: k for k, f in enumerate(b.names)}
    both = np.array([(i, where[f]) for i, f in enumerate(a.names) if f in where], np.int64).reshape(-1, 2)
    rows, columns = np.arange(len(a)) if rows is None else rows, np.arange(len(b)) if columns is None else columns
    size = len(both)
    place = [np.full(len(s.names), -1) for s in (a, b)]
    place[0][both[:, 0]] = place[1][both[:, 1]] = np.arange(size)
    weight = np.zeros(size) if weight is None else weight[both[:, 0]]
    (ra, fa, wa), (cb, fb, wb) = a.take(rows, place[0]), b.take(columns, place[1])
    if measure == "adamic":
        wa, wb = np.ones(len(fa)), np.ones(len(fb))
    hits = np.bincount(fa, minlength=size) @ np.bincount(fb, minlength=size)
    if not hits:
        return
    dense = hits > DENSE * len(rows) * len(columns) * size
    # Sums of whole numbers below 2 ** 24 are exact in single precision.
    kind = np.float32 if measure == "least" and max(x.sum() for x in (wa, wb)) < 1 << 24 and all((x == np.floor(x)).all() for x in (wa, wb)) else np.float64
    cut = np.searchsorted(ra, np.arange(0, len(rows) + STRIP, STRIP))
    if not dense:
        order = np.argsort(fb, kind="stable")
        cb, wb = cb[order], wb[order]
        n = np.bincount(fb, minlength=size)
        start = np.cumsum(n) - n
    for s, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
        first = s * STRIP
        if lo == hi:
            continue
        r, f, w = ra[lo:hi] - first, fa[lo:hi], wa[lo:hi]
        if dense:
            for c0 in range(0, len(columns), WIDE):
                i, j = np.searchsorted(cb, (c0, c0 + WIDE))
                shape = (min(STRIP, len(rows) - first), min(WIDE, len(columns) - c0))
                values = [np.zeros(shape, t) for t in ((np.float32, float) if measure == "adamic" else (kind,))]
                for k in range(0, size, DEEP):
                    depth = min(DEEP, size - k)
                    x, y = np.zeros((shape[0], depth), kind), np.zeros((depth, shape[1]), kind)
                    m = (f >= k) & (f < k + depth)
                    x[r[m], f[m] - k] = w[m]
                    m = (fb[i:j] >= k) & (fb[i:j] < k + depth)
                    y[fb[i:j][m] - k, cb[i:j][m] - c0] = wb[i:j][m]
                    _least(x, y, values) if measure == "least" else _dot(x, y, values) if measure == "dot" else _adamic(x, y, values, weight[k : k + depth])
                got = _kept(rows[first : first + shape[0]], columns[c0 : c0 + shape[1]], values, keep)
                if got is not None:
                    yield got
        else:
            # Whole rows, as many as LISTED shared features allow: a pair's features are added up at once.
            per_row = np.cumsum(np.bincount(r, n[f], minlength=STRIP))
            r0 = 0
            while r0 < STRIP and per_row[-1] > (before := per_row[r0 - 1] if r0 else 0):
                r1 = max(r0 + 1, int(np.searchsorted(per_row, before + LISTED, side="right")))
                p, q = np.searchsorted(r, (r0, r1))
                r0 = r1
                many = n[f[p:q]]
                k = spread(start[f[p:q]], many)
                pair, at = np.unique(np.repeat(r[p:q] + first, many) * len(columns) + cb[k], return_inverse=True)
                add = [None, np.repeat(weight[f[p:q]], many)] if measure == "adamic" else [(np.minimum if measure == "least" else np.multiply)(np.repeat(w[p:q], many), wb[k])]
                values = [np.bincount(at, x, minlength=len(pair)) for x in add]
                x, y = rows[pair // len(columns)], columns[pair % len(columns)]
                m = keep(x, y, values)
                if m.any():
                    yield x[m], y[m], [v[m] for v in values]


def _kept(rows, columns, values, keep):
    m = keep(rows[:, None], columns[None, :], values) & (values[0] > 0)
    if not m.any():
        return None
    r, c = np.nonzero(m)
    return rows[r], columns[c], [v[m] for v in values]


def ends(a: Block, b: Block, x: np.ndarray, y: np.ndarray) -> dict:
    """The lesser and the greater id of pairs."""
    x, y = a.ids[x], b.ids[y]
    return {"e1": np.minimum(x, y), "e2": np.maximum(x, y)} if a is not b else {"e1": x, "e2": y}


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As SQL rounds: halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


class Tops:
    """The k best (value, id) of each row: greatest values first, rounded to nine digits, not-a-number before all and -inf
    (no value) last, then the least ids."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int):
        self.key, self.value, self.id = np.full((n, k), -np.inf), np.full((n, k), -np.inf), np.full((n, k), self.NONE)

    def floor(self) -> np.ndarray:
        """No lesser value can enter a row."""
        return self.key[:, -1] - 1e-9

    def add(self, row: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        key = np.where(np.isnan(value), np.inf, rounded(value, 9))
        m = (key > self.key[row, -1]) | ((key == self.key[row, -1]) & (ids < self.id[row, -1]))
        if not m.any():
            return
        row, ids, value, key = row[m], ids[m], value[m], key[m]
        old, k = np.unique(row), self.key.shape[1]
        row, key = np.append(np.repeat(old, k), row), np.append(self.key[old].ravel(), key)
        ids, value = np.append(self.id[old].ravel(), ids), np.append(self.value[old].ravel(), value)
        order = np.lexsort((ids, -key, row))
        rank = np.arange(len(row)) - np.repeat(np.searchsorted(row[order], old), np.bincount(np.searchsorted(old, row)))
        best = order[rank < k]
        self.key[old], self.id[old], self.value[old] = (x[best].reshape(-1, k) for x in (key, ids, value))

    def rows(self, ids: np.ndarray) -> dict:
        """Rows of id, other, value (null for none), as columns."""
        m = self.id != self.NONE
        value = self.value[m]
        return {"id": np.repeat(ids, self.id.shape[1])[m.ravel()], "other": self.id[m], "value": pa.array(value, mask=np.isneginf(value))}
