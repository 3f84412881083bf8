"""Exact top-k inner products by aggregation of sorted lists without random access.

Each dimension is a list of the candidates by their component, and each candidate carries its norm. A query reads
lists in the order of its own largest components, each in sorted order from the end that scores most, down to a
frontier at `DEPTH` of its length. Of a candidate the entries seen so far give a lower and an upper bound:

    seen in a list          its product
    below the frontier      at most the frontier's product, at least that of the list's far end
    in the lists not read   at most what their heads would give, and, by Cauchy-Schwarz, no more than the query's
                            rest times the norm that the entries seen leave; at least minus that

Candidates whose upper bound is under the k-th largest lower bound are outsiders and are read no further. The first
lists, up to the first comparison, are read for `CHUNK` queries at once, what is left for each query by itself. Reading
stops for a query when `LEFT` candidates for each of k are left, or all lists are read; the scores of those left are
then resolved exactly.

Candidates are dealt into blocks and queries into batches, and a task reads the lists of one block for one
batch; per query k rows of each block, and the ties of the k-th, go on to the final ranking.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import with_row

BLOCK = 16384
BATCH = 16384
#: Queries whose first lists are read at once.
CHUNK = 32
SCALE = 256
#: How much of a list is read before its frontier bounds the rest; shares of the lists after which bounds are
#: compared; how many candidates for each of k may be left to resolve.
DEPTH = 15 / 16
ROUNDS = (11 / 16, 3 / 4, 7 / 8, 15 / 16)
LEFT = 16
_LONG = (-(1 << 63), (1 << 63) - 1)


class Lists:
    """The sorted lists of a block of candidates, in both directions: 0 for queries above 0, 1 for those below."""

    def __init__(self, rows: np.ndarray, kind, depth: float, bound: int):
        # rounding, of sums that may be in single precision: those of scores, and of squares under a root
        self.slack = 0.5 + (1e-6 * bound if kind is np.float32 else 0)
        column = np.ascontiguousarray(rows.T.astype(kind))
        ordered = np.sort(column, axis=1)
        n = column.shape[1]
        far = min(n - 1, int(n * (1 - depth)))
        self.head = np.stack([ordered[:, -1], ordered[:, 0]])
        frontier, end = (ordered[:, far], ordered[:, n - 1 - far]), (ordered[:, 0], ordered[:, -1])
        seen = np.stack([column >= frontier[0][:, None], column <= frontier[1][:, None]])
        self.most = np.stack([np.maximum(column, frontier[0][:, None]), np.minimum(column, frontier[1][:, None])])
        self.least = np.stack([np.where(s, column, e[:, None]) for s, e in zip(seen, end)])
        self.square = np.where(seen, column**2, 0)
        self.norm = (column.astype(float) ** 2).sum(0)

    def begun(self, queries: np.ndarray, own: np.ndarray, k: int, stop: int):
        """The first `stop` lists of many queries at once, as matrix products in which a query has zeros at the lists
        that it doesn't read. Yields for each query: its lists in order, the places whose upper bound isn't under
        the k-th largest lower bound, and of those the sums seen so far (high, low, squares)."""
        n, d = len(self.norm), queries.shape[1]
        kind = self.head.dtype
        for a in range(0, len(queries), CHUNK):
            some, mine = queries[a : a + CHUNK], own[a : a + CHUNK]
            order = np.argsort(-np.abs(some), axis=1, kind="stable")
            taken = np.zeros(some.shape, bool)
            np.put_along_axis(taken, order[:, :stop], True, axis=1)
            below = some < 0
            of = [(taken & ~below), (taken & below)]
            weight = [np.where(t, some, 0).astype(kind) for t in of]
            high = weight[0] @ self.most[0] + weight[1] @ self.most[1]
            low = weight[0] @ self.least[0] + weight[1] @ self.least[1]
            seen = of[0].astype(kind) @ self.square[0] + of[1].astype(kind) @ self.square[1]
            rest = np.where(taken, 0, some).astype(float)
            heads = (np.where(below, rest * self.head[1], rest * self.head[0])).sum(1).astype(kind)
            reach = np.maximum(self.norm.astype(kind) - seen, 0)
            reach *= (rest**2).sum(1).astype(kind)[:, None]
            np.sqrt(reach, out=reach)
            reach *= 1 + 1e-9
            lower = low - reach
            upper = high + np.minimum(reach, heads[:, None])
            there = np.flatnonzero(mine >= 0)
            lower[there, mine[there]] = upper[there, mine[there]] = -np.inf
            # the k-th largest of the largest of each group isn't above the k-th largest of all
            width = max(1, n // max(64, 8 * k))
            least = np.maximum.reduceat(lower, np.arange(0, n, width), axis=1)
            least = np.partition(least, least.shape[1] - k, axis=1)[:, least.shape[1] - k] if least.shape[1] >= k else np.full(len(some), -np.inf)
            keep = upper >= (least - self.slack)[:, None]
            keep[there, mine[there]] = False
            for i in range(len(some)):
                alive = np.flatnonzero(keep[i])
                yield order[i], alive, high[i, alive].astype(float), low[i, alive].astype(float), seen[i, alive].astype(float)

    def survivors(self, query: np.ndarray, begun, k: int, stops: list[int], left: int) -> tuple[np.ndarray, int, bool]:
        """Places that may hold the k best, entries read, and whether reading stopped before the last list."""
        n, d = len(self.norm), len(query)
        order, alive, high, low, seen = begun
        way = (query < 0).astype(int)
        heads = (query * self.head[way, np.arange(d)]).astype(float)
        at = stops[0]
        read = at * n
        for stop in [*stops[1:], d]:
            lists = order[at:stop]
            if len(alive) <= left * k or not len(lists):
                break
            of = lambda part: part[way[lists], lists][:, alive] if 2 * len(alive) > n else part[way[lists][:, None], lists[:, None], alive]  # noqa: B023, E731
            high += query[lists] @ of(self.most)
            low += query[lists] @ of(self.least)
            seen += of(self.square).sum(0)
            read, at = read + len(lists) * len(alive), stop
            rest = order[at:]
            reach = np.sqrt(float((query[rest].astype(float) ** 2).sum()) * np.maximum(self.norm[alive] - seen, 0)) * (1 + 1e-9)
            upper = high + np.minimum(reach, heads[rest].sum())
            lower = low - reach
            least = np.partition(lower, len(alive) - k)[len(alive) - k] if len(alive) > k else -np.inf
            keep = upper >= least - self.slack  # scores are whole numbers: half of one covers rounding
            alive, high, low, seen = alive[keep], high[keep], low[keep], seen[keep]
        return alive, read, at < d


def top_of_block(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, rounds=ROUNDS, left: int = LEFT, depth: float = DEPTH, seen: list | None = None):
    """For each query: places of candidates that hold its k best scores and all ties of the k-th, and the scores.

    queries and rows are integers; own[i] is the place of query i among the rows, or -1. `seen` gets (entries
    read, stopped before the last list, candidates resolved) of each query. Numbers beyond what a double holds exactly
    are resolved without bounds; scores beyond the range of a long are its ends.
    """
    n, d = rows.shape
    size = max(1, *(int(max(x.max(initial=0), -int(x.min(initial=0)))) for x in (queries, rows)))
    bound = size * size * max(1, d)
    lists = Lists(rows, np.float32 if bound < 1 << 24 else np.float64, depth, bound) if n and d and bound < 1 << 50 else None
    whole = rows if bound < 1 << 62 else rows.astype(object)
    result = []
    stops = [max(1, round(d * r)) for r in rounds]
    begun = lists.begun(queries, own, k, stops[0]) if lists else None
    for q, mine in zip(queries, own):
        if lists is None:
            places, read, early = np.flatnonzero(np.arange(n) != mine), n * d, False
        else:
            places, read, early = lists.survivors(q, next(begun), k, stops, left)
        if seen is not None:
            seen.append((read, early, len(places)))
        scores = whole[places] @ (q if whole is rows else q.astype(object))
        if len(places) > k:
            keep = scores >= np.sort(scores)[-k]
            places, scores = places[keep], scores[keep]
        result.append((places, np.array([min(max(int(s), _LONG[0]), _LONG[1]) for s in scores], np.int64)))
    return result


def _matrix(column) -> np.ndarray:
    width = max((len(v) for v in column), default=0)
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, chosen, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row that `chosen`, a condition
    on columns of `vectors`, picks, with all rows but itself; ties go to the smaller id, then the row read first.

    Components become floor(scale * x). Rows with a null id or vector, or a component that is null or not
    finite, take no part; a shorter vector counts as ended with zeros; a component beyond the range of a long when
    scaled counts as its nearest end. Repeated rows are rows of their own, so
    that a query can find its copy. Other columns are not read but by `chosen`; no rows give no rows.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = with_row(vectors).withColumn("__asked", F.coalesce(chosen, F.lit(False))).where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(finite)
    rows = rows.select("__row", "__asked", F.col(vec_id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("x"))
    n, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("__asked").cast("long")), F.lit(0))).first()
    blocks, batches = max(1, math.ceil(n / block)), max(1, math.ceil(asked / batch))
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = lambda parts: F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int")
    # names of their own: two sides that share columns of one plan aren't kept apart by a cogroup
    candidates = rows.select(F.col("__row").alias("c_row"), F.col("id").alias("c_id"), F.col("x").alias("c_x"), own(blocks).alias("c_block"), spread(batches).alias("c_batch"))
    queries = rows.where("__asked").select("__row", "id", "x", spread(blocks).alias("block"), own(batches).alias("batch"))

    def read(asked, held):
        import pandas as pd

        if not len(asked) or not len(held):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q", "query_id", "row", "vec_id", "score")})
        xs = _matrix([*asked.x, *held.c_x])
        place = {r: i for i, r in enumerate(held.c_row)}
        mine = np.array([place.get(r, -1) for r in asked["__row"]])
        found = top_of_block(xs[: len(asked)], xs[len(asked) :], mine, k)
        size = [min(len(p), k) for p, _ in found]
        ids, rows_ = held.c_id.to_numpy(), held.c_row.to_numpy()
        best = [p[np.lexsort((rows_[p], ids[p], -s))][:k] for p, s in found]
        score = [s[np.lexsort((rows_[p], ids[p], -s))][:k] for p, s in found]
        at = np.concatenate(best).astype(int)
        return pd.DataFrame({"q": np.repeat(asked["__row"].to_numpy(), size), "query_id": np.repeat(asked.id.to_numpy(), size), "row": rows_[at], "vec_id": ids[at], "score": np.concatenate(score)})

    cells = queries.groupBy("block", "batch").cogroup(candidates.groupBy("c_block", "c_batch")).applyInPandas(read, "q long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir):
    """The five best for every fiftieth embedding among all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda t: t[1] * t[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
