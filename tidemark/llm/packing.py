"""Packing by cutting stock: column generation over the histogram of piece lengths.

Every document is cut into pieces of `capacity` ids and one shorter rest. How often each length occurs is all
that the linear program sees: a column is a pattern, the lengths that share a sequence; a pattern costs what its
sequence takes when padded. A knapsack dynamic programme prices new patterns by the duals until none helps. Pivots
alone stall, their steps are too small; so the program is solved by an interior point method first, each of whose
steps prices patterns, a vertex is made of its solution, and pivots go on from there. The rounded-down patterns and, for what rounding leaves, sequences filled one at a time by exact subset sums, are
then dealt out: the pieces of a length are ranked, and rank r goes to the slot that the patterns give it.

The driver holds at most `capacity` lengths and one pattern for each, and never a document. Ranks are counted
in the partitions that cut the documents, so that one very common length makes no large task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, tidy
from tidemark.llm.tokens import encoder, vocabulary

CAPACITY = 1024
END_ID = 0
_FRESH = 256  # pivots after which the basis is inverted anew, fewer once that many lost it
_HELD = 32  # pivots that are kept beside the inverse before it is changed by all of them at once
_PLANS = 4  # greedy plans that the interior point method starts from
_STEPS = 400  # its steps, after which only pivots are left
_SMALL = 1e-7  # entries below aren't pivoted on: rounding alone can leave as much, and then the basis is singular


def padded(total: int, capacity: int = CAPACITY) -> int:
    """What a sequence of `total` ids takes: itself at a power of two, else the capacity."""
    return total if total & (total - 1) == 0 else capacity


def _priced(lengths: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """value[s]: the largest sum of duals of lengths that add up to s exactly; item[s]: the last of them."""
    back, item = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)  # back[capacity - s] is value[s]
    back[capacity] = 0.0
    dual, place = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    dual[lengths], place[lengths] = duals, np.arange(len(lengths))
    for s in range(1, capacity + 1):
        worth = back[capacity - s + 1 :] + dual[1 : s + 1]
        k = worth.argmax()
        back[capacity - s], item[s] = worth[k], place[k + 1]
    return back[::-1].copy(), item


def _columns(lengths, duals, cost, capacity, most=24):
    """Patterns of negative reduced cost, the best first, each about a length that none before it has: counts by index of length."""
    value, item = _priced(lengths, duals, capacity)
    totals = np.argsort(cost - value)[:8]
    room = totals[:, None] - lengths
    gain = np.where(room >= 0, value[np.maximum(room, 0)] + duals - cost[totals][:, None], -np.inf)
    out, seen = [], set()
    for at in np.argsort(-gain, axis=None).tolist():
        row, k = divmod(at, len(lengths))
        if gain[row, k] <= 1e-7 * capacity or len(out) == most:
            break
        if k in seen:
            continue
        column, left = {k: 1}, int(room[row, k])
        while left:
            j = int(item[left])
            column[j] = column.get(j, 0) + 1
            left -= int(lengths[j])
        seen.update(column)
        out.append((column, float(cost[totals[row]])))
    return out


class _Pool:
    """Columns of the linear program, their entries and the products of each one's entries in flat arrays."""

    def __init__(self, m: int, capacity: int):
        self.m, self.capacity, self.columns, self.at = m, capacity, [], {}
        self.entries, self.products = np.empty((3, 0)), np.empty((3, 0))

    def add(self, columns) -> int:
        entries, products, before = [self.entries], [self.products], len(self.columns)
        for column, price in columns:
            name = tuple(sorted(column.items()))
            if name in self.at:
                continue
            j = self.at[name] = len(self.columns)
            self.columns.append((column, price))
            k, n = np.array(list(column), float), np.array(list(column.values()), float)
            entries.append(np.stack([k, np.full(len(k), j), n]))
            products.append(np.stack([(k[:, None] * self.m + k).ravel(), np.full(len(k) ** 2, j), np.outer(n, n).ravel()]))
        self.entries, self.products = np.concatenate(entries, 1), np.concatenate(products, 1)
        self.row, self.column, self.count = self.entries[0].astype(int), self.entries[1].astype(int), self.entries[2]
        self.pair, self.of, self.product = self.products[0].astype(int), self.products[1].astype(int), self.products[2]
        self.cost = np.array([price for _, price in self.columns]) / self.capacity
        return len(self.columns) - before

    def uses(self, x):
        return np.bincount(self.row, self.count * x[self.column], self.m)

    def worth(self, y):
        return np.bincount(self.column, self.count * y[self.row], len(self.columns))

    def normal(self, weight):
        return np.bincount(self.pair, self.product * weight[self.of], self.m * self.m).reshape(self.m, self.m)


def _interior(lengths, demand, cost, capacity, enough):
    """The linear program by an interior point method, whose every step prices patterns: a pool and what it takes of each.

    It starts from the mean of some greedy plans, which differ by the order in which room is filled, and from duals a
    little below the lengths themselves, at which no pattern is worth more than its cost. None where it doesn't end:
    after `_STEPS` steps, or where its equations can't be solved.
    """
    m, rng = len(lengths), np.random.default_rng(0)
    place = {int(n): k for k, n in enumerate(lengths)}
    pool, plans = _Pool(m, capacity), []
    for run in range(_PLANS):
        over = dict(zip(lengths.tolist(), demand.tolist()))
        while over:
            keys = np.array(list(over))
            order = keys[np.argsort(-keys * rng.uniform(0.6 if run else 1, 1, len(keys)))].tolist()
            pattern = _filled(over, capacity, order)
            times = min(over[k] / c for k, c in pattern.items())
            plans.append(({place[k]: c for k, c in pattern.items()}, float(cost[sum(k * c for k, c in pattern.items())]), times))
            for k, c in pattern.items():
                over[k] -= times * c
                if over[k] <= 1e-9 * demand[place[k]]:
                    del over[k]
    pool.add([(column, price) for column, price, _ in plans])
    x = np.zeros(len(pool.columns))
    for column, _, times in plans:
        x[pool.at[tuple(sorted(column.items()))]] += times / _PLANS
    x = np.maximum(x, 0.01)
    y = lengths / capacity * 0.99
    s = pool.cost - pool.worth(y)
    ending, mended, centre = False, 0, 0.2
    for _ in range(_STEPS):
        new = 0
        if not ending and (new := pool.add(_columns(lengths, y * capacity, cost, capacity, 32))):
            slack = max(1e-3, float(np.median(s)))
            x = np.append(x, np.full(new, max(x @ s / len(x), 1e-9) / slack))
            s = np.append(s, np.full(new, slack))
        primal, dual, mu = demand - pool.uses(x), pool.cost - pool.worth(y) - s, x @ s / len(x)
        miss = float(np.abs(primal) @ lengths)
        ending = ending or miss < capacity / 8 and (capacity * (pool.cost @ x) < enough - capacity / 2 or not new and capacity * (x @ s) < capacity / 8)
        mended += ending
        if ending and (miss < 1e-5 * capacity or mended > 25):
            return pool.columns, x
        matrix = pool.normal(x / s)
        matrix.flat[:: m + 1] *= 1 + 1e-12
        aim = centre * mu / s - x
        try:
            dy = np.linalg.solve(matrix, primal + pool.uses(x / s * dual - aim))
        except np.linalg.LinAlgError:
            return None
        ds = dual - pool.worth(dy)
        dx = aim - x / s * ds
        if not (np.isfinite(dx).all() and np.isfinite(ds).all()):
            return None
        down, fall = dx < 0, ds < 0
        long = min(1.0, 0.95 * float((-x[down] / dx[down]).min(initial=np.inf)))
        far = min(1.0, 0.95 * float((-s[fall] / ds[fall]).min(initial=np.inf)))
        x, y, s = x + long * dx, y + far * dy, s + far * ds
        # after short steps back to the middle; at the end only what is missing is put right
        centre = 1.0 if ending else 0.2 if min(long, far) > 0.4 else 1.0 if min(long, far) > 0.1 else 3.0
    return None


def _vertex(columns, x, m, cost, lengths):
    """A basis among `columns`, as far as they are independent, that does what `x` does at no more cost: the columns taken
    most enter in place of single lengths; others are brought to zero one by one, or enter where a basic one is first."""
    basis = [({k: 1}, float(cost[n])) for k, n in enumerate(lengths)]
    inverse, value, alone = np.eye(m), np.zeros(m), np.ones(m, bool)
    ways, rows_held, held, since = np.zeros((m, _HELD)), np.zeros((_HELD, m)), 0, 0
    rest = []
    turns = [(j, True) for j in np.argsort(-x).tolist()]
    while turns:
        for j, first in turns:
            column, _ = columns[j]
            at, copies = list(column), np.array(list(column.values()), float)
            way = inverse[:, at] @ copies - ways[:, :held] @ (rows_held[:held, at] @ copies)
            if first:
                row = int(np.where(alone, np.abs(way), 0).argmax())
                if not alone[row] or abs(way[row]) < 1e-5:
                    rest.append((j, False))
                    continue
                value[row], alone[row] = x[j], False
            else:
                # less of this column is more of those it stands for, and less of those with a negative entry
                rows = np.flatnonzero(~alone & (way < -_SMALL))
                ratio = value[rows] / -way[rows]
                step = min(float(x[j]), float(ratio.min(initial=np.inf)))
                if step == x[j]:
                    value[~alone] += step * way[~alone]
                    np.maximum(value, 0, out=value)
                    continue
                rows = rows[ratio <= ((value[rows] + 1e-9) / -way[rows]).min()]
                row = int(rows[way[rows].argmin()])
                value[~alone] += step * way[~alone]
                np.maximum(value, 0, out=value)
                value[row] = x[j] - step
            pivot = (inverse[row] - ways[row, :held] @ rows_held[:held]) / way[row]
            ways[:, held], rows_held[held] = way, pivot
            ways[row, held] -= 1
            basis[row] = columns[j]
            held, since = held + 1, since + 1
            if since == _FRESH:
                matrix = np.zeros((m, m))
                for i, (column, _) in enumerate(basis):
                    matrix[list(column), i] = list(column.values())
                inverse, held, since = np.linalg.inv(matrix), 0, 0
            elif held == _HELD:
                inverse -= ways @ rows_held
                held = 0
        turns, rest = rest[::-1], []
    return basis


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, pivots: int | None = None, gap: float = 0.0) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: copies}, times) that use up the histogram exactly.

    The linear program ends when no pattern improves it, its padding is less than one sequence, so that no more than
    that is to be gained, or its value hasn't fallen for as many rounds of pricing as there are lengths. `gap` (a
    share of all ids that padding may take) and `pivots` end it sooner; what it says then is still a feasible plan,
    only with a little more padding. So it is where rounding loses the basis however often it is inverted. With
    `pivots` there are only these.
    """
    histogram = {int(k): int(v) for k, v in histogram.items() if v > 0}
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    cost = np.array([padded(s, capacity) if s else 0 for s in range(capacity + 1)], float)
    place = {int(n): k for k, n in enumerate(lengths)}
    m, bound = len(lengths), float(sum(k * v for k, v in histogram.items()))
    # A greedy pattern, taken as often as it lasts, fractions included, uses up a length that no later one
    # has: with a pattern, taken zero times, for each length that ended along with another, they are a basis.
    basis, x, over = [], [], {int(k): float(histogram[int(k)]) for k in lengths}
    while over:
        pattern = _filled(over, capacity)
        times = min(over[k] / c for k, c in pattern.items())
        basis.append(({place[k]: c for k, c in pattern.items()}, float(cost[sum(k * c for k, c in pattern.items())])))
        x.append(times)
        for k, c in pattern.items():
            over[k] -= times * c
        ended = [k for k in pattern if over[k] <= 1e-9 * histogram[k]]
        for k in ended:
            del over[k]
        basis += [({place[k]: 1}, float(cost[k])) for k in ended[1:]]
        x += [0.0] * len(ended[1:])
    demand = np.array([float(histogram[int(k)]) for k in lengths])

    def inverted() -> tuple[np.ndarray, np.ndarray] | None:
        """The basis inverted and what it takes of each pattern; None where rounding has lost it."""
        matrix = np.zeros((m, m))
        for j, (column, _) in enumerate(basis):
            matrix[list(column), j] = list(column.values())
        try:
            inverse = np.linalg.inv(matrix)
        except np.linalg.LinAlgError:
            return None
        x = inverse @ demand
        if not np.abs(matrix @ x - demand).max() <= 1e-6 * demand.max() or x.min() < -1e-6 * demand.max():
            return None
        return inverse, np.maximum(x, 0)

    start = inverted()
    if start is None:  # counts that follow from one another can make numbers too far apart: each length by itself
        basis = [({k: 1}, float(cost[n])) for k, n in enumerate(lengths)]
        start = inverted()
    enough = bound + max(gap * bound, capacity)
    if pivots is None and start[1] @ [c for _, c in basis] >= enough and (found := _interior(lengths, demand, cost, capacity, enough)):
        before, basis = basis, _vertex(*found, m, cost, lengths)
        vertex = inverted()
        if vertex is None or vertex[1] @ [c for _, c in basis] > start[1] @ [c for _, c in before]:
            basis = before
        else:
            start = vertex
    inverse, x = start
    duals = np.array([c for _, c in basis]) @ inverse
    sound, fresh = list(basis), _FRESH
    done, since, stalled, best, held, lost = 0, 0, 0, np.inf, 0, 0
    ways, rows_held = np.zeros((m, _HELD)), np.zeros((_HELD, m))  # the inverse now is inverse - ways @ rows_held
    while pivots is None or done < pivots:
        value = sum(c * v for (_, c), v in zip(basis, x))
        stalled = 0 if value < best * (1 - 1e-9) else stalled + 1
        best = min(best, value)
        ended = value < enough or stalled > m
        moved = False
        for column, price in [] if ended else _columns(lengths, duals, cost, capacity):
            at, copies = list(column), np.array(list(column.values()), float)
            reduced = price - duals[at] @ copies
            if reduced >= -1e-7 * capacity:
                continue
            way = inverse[:, at] @ copies - ways[:, :held] @ (rows_held[:held, at] @ copies)
            rows = np.flatnonzero(way > _SMALL)
            if not len(rows):
                continue
            # of the rows that end first, but for rounding, the one with the largest entry
            ratio = x[rows] / way[rows]
            rows = rows[ratio <= ((x[rows] + 1e-9) / way[rows]).min()]
            row = int(rows[way[rows].argmax()])
            step = x[row] / way[row]
            x -= step * way
            x[row] = step
            np.maximum(x, 0, out=x)
            pivot = (inverse[row] - ways[row, :held] @ rows_held[:held]) / way[row]
            ways[:, held], rows_held[held] = way, pivot
            ways[row, held] -= 1
            held += 1
            if held == _HELD:
                inverse -= ways @ rows_held
                held = 0
            basis[row] = (column, price)
            duals += reduced * pivot
            done, since, moved = done + 1, since + 1, True
            if since >= fresh:
                break
        if since and (since >= fresh or not moved):
            # no end is believed before the basis was inverted anew; one that rounding has lost is taken back
            anew = inverted()
            if anew is None:
                basis, moved = list(sound), fresh > 1
                fresh, best, lost = max(1, fresh // 4), np.inf, lost + 1
                anew = inverted()
            else:
                sound, moved = list(basis), not ended
                fresh = min(_FRESH, 2 * fresh) if lost < _HELD else fresh
            (inverse, x), since, held = anew, 0, 0
            duals = np.array([c for _, c in basis]) @ inverse
        if not moved:
            break
    out, left = [], dict(histogram)
    for (column, _), times in sorted(zip(basis, x), key=lambda b: -b[1]):
        pattern = {int(lengths[k]): c for k, c in column.items()}
        n = min(int(times + 1e-6), *(left[k] // c for k, c in pattern.items()))
        if n > 0:
            out.append((pattern, n))
            for k, c in pattern.items():
                left[k] -= n * c
    out += _greedy(left, capacity)
    paid = lambda plan: sum(n * cost[sum(k * c for k, c in pattern.items())] for pattern, n in plan)
    return min(out, _greedy(histogram, capacity), key=paid)


def _filled(left: dict[int, float], capacity: int, order: list[int] | None = None) -> dict[int, int]:
    """The longest piece left with the others, the longer or those earlier in `order` first, that leave the least room."""
    first = max(left)
    room, reach, steps = capacity - first, 1, []
    for k in order or sorted(left, reverse=True):
        for _ in range(min(math.ceil(left[k]) - (k == first), room // k)):
            if (more := (reach | reach << k) & ((1 << room + 1) - 1)) == reach:
                break
            steps.append((k, reach))
            reach = more
        if reach >> room & 1:
            break
    at, pattern = reach.bit_length() - 1, {first: 1}
    for k, before in reversed(steps):
        if not before >> at & 1:
            pattern[k] = pattern.get(k, 0) + 1
            at -= k
    return pattern


def _greedy(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The longest piece left, with the others that fill its sequence best, as often as they last; and again."""
    out, left = [], {k: v for k, v in left.items() if v > 0}
    while left:
        pattern = _filled(left, capacity)
        times = min(left[k] // c for k, c in pattern.items())
        for k, c in pattern.items():
            left[k] -= times * c
            if not left[k]:
                del left[k]
        out.append((pattern, times))
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: from rank `low` on, pieces of `length` go `copies` to a sequence, from
    sequence `first` on, the first copy at `offset`."""
    rows, ranks, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            low = ranks.get(length, 0)
            rows.append((length, low, copies, sequence, offset))
            ranks[length] = low + copies * times
            offset += length * copies
        sequence += times
    rows.sort()
    return dict(zip(("length", "low", "copies", "first", "offset"), np.array(rows, np.int64).reshape(-1, 5).T.copy()))


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: str | None = None, end_id: int | None = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens, and where it was cut: part, rank
    among the pieces of its length there. With `with_ids`, the ids besides. Without an end id an empty text
    has no pieces."""
    vocab = vocab or vocabulary()

    @tidy
    def cuts(batches):
        import pyarrow as pa

        encode, part = encoder(vocab), TaskContext.get().partitionId()
        last = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        ranks = [0] * (capacity + 1)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(names), 256):
                rows = []
                for name, ids in zip(names[k : k + 256], encode(texts.slice(k, 256).to_pylist())):
                    ids += last
                    for at in range(0, len(ids), 4 * capacity):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((name, at // 4, n, zlib.crc32(own), len(ids) // 4, part, ranks[n], own if with_ids else None))
                        ranks[n] += 1
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"])

    found = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(cuts, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long, ids binary")
    return found if with_ids else found.drop("ids")


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """Pieces with their place: `sequence_id`, and `offset` in it, gapless from 0.

    A null text counts as empty and gives a piece of the end id alone. Ids, null or repeated ones too, are only
    carried along, and columns other than the two aren't read; of an empty table nothing is packed. Which of
    several pieces of one length takes which slot depends on how the table is split.
    """
    cutted = cut(pieces(docs, doc_id, text, capacity=capacity, **options), "packing-pieces")
    counts = cut(cutted.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(capacity, 0)
    plan = patterns(histogram, capacity) + ([({capacity: 1}, whole)] if whole else [])
    table = slots(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cutted.join(counts.withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0))), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("n")).drop("n", "part")

    def placed(batches):
        import pyarrow as pa

        width = int(table["low"].max(initial=0)) + 1
        keys = table["length"] * width + table["low"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), side="right") - 1
            nth, copy = np.divmod(rank - table["low"][k], table["copies"][k])
            own = {"sequence_id": pa.array(table["first"][k] + nth), "offset": pa.array(table["offset"][k] + copy * length)}
            kept = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            yield pa.RecordBatch.from_pydict(kept | own)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in ranked.drop("rank").dtypes)
    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def op8_packing(spark, sf_dir):
    """All documents packed into sequences of 1024."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
