"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

The segmentations of a text are the paths of a lattice; a path's probability is proportional to the product of
exp(score / temperature) over its pieces. Gumbel top-k without replacement takes the k paths of largest perturbed
log-probability, and an A* search finds them from the top: the root's perturbed value is a Gumbel number, a node's is
the largest among its children's. The child that keeps it is drawn by the children's probabilities; given that, the
others get Gumbel numbers cut off at it, so that the next value on the queue is always exact. A path that comes off
the queue at the end of the text is a sample; the value on top of the queue after the last one is the threshold, and a
path's inclusion score the probability to exceed it.

Where no piece holds two characters side by side the lattice is cut, so it is a chain of words. The lattices of
distinct words are built at once, in arrays, short words' are kept for the texts that follow, and the search steps
along all words of some documents (`CHARS` characters, or one document) at once. Of the children that it leaves behind
only the `samples` best of a document can come off the queue. They mostly stand near the path's start, as probabilities
fall along it: those further on are drawn one by one only where the best of them is good enough.

Random numbers are drawn from a hash of row key, sample, place and piece: the same rows give the same samples,
however they are split.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import tidy
from tidemark.llm.tokens import vocabulary

SAMPLES = 2
TEMPERATURE = 1.0
SEED = 11
CHARS = 500_000
KEPT = 3_000_000  # edges of short words' lattices
SHORT, LONG = 9, 32  # characters of words that are kept, and of words that are looked up at all
HORIZON = 8.0  # log-probability of a path's first part, in which children left behind are drawn one by one
_U = np.uint64
_HEAD = 16  # bits of a hash that are looked up first


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's last steps."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1, in steps of 2^-52."""
    return ((_mixed(key) >> _U(12)).astype(float) + 0.5) * 2.0**-52


_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), np.uint32).astype(_U)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of `size` numbers each, in a row."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _hashes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of a stretch from a to b is (sums[b] - sums[a]) * scale[a]."""
    n = len(code)
    return np.concatenate([np.zeros(1, _U), np.cumsum(_mixed(code) * _powers(_B, n)[:-1], dtype=_U)]), _powers(_B_INVERSE, n)


class Pieces:
    """A model's pieces by length and hash, with their log-probabilities."""

    def __init__(self, path: str, temperature: float = TEMPERATURE):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        scores = [sp.get_score(k) for k in range(n)]
        merges = all(s == int(s) for s in scores)  # ranks of merges, no log-probabilities: Zipf's law makes them such
        by: dict[int, list] = {}
        pairs = set()
        for k in range(n):
            if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k)):
                log = -math.log(2.0 + min(-scores[k], n)) if merges else scores[k]
                piece = sp.id_to_piece(k)
                c = _codes(piece)
                pairs.update(zip(piece, piece[1:]))
                by.setdefault(len(piece), []).append((int((_mixed(c) * _powers(_B, len(c))[:-1]).sum()), k, log / temperature))
        self.tables = []
        for length, rows in sorted(by.items()):
            rows.sort()
            self.tables.append((length, np.array([r[0] for r in rows], _U), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))
        self.heads = []  # by length: which first bits of a hash occur
        for _, hashes, _, _ in self.tables:
            self.heads.append(np.zeros(1 << _HEAD, bool))
            self.heads[-1][hashes >> _U(64 - _HEAD)] = True
        self.worst = min(float(t[3].min()) for t in self.tables) - 10.0
        kinds = {c: k + 1 for k, c in enumerate(sorted(set().union(*pairs)))}  # 0: characters that stand alone
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in kinds]] = list(kinds.values())
        self.beside = np.zeros((len(kinds) + 1, len(kinds) + 1), bool)  # whether a piece holds two side by side
        for x, y in pairs:
            self.beside[kinds[x], kinds[y]] = True
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()

    def marked(self, text: str | None) -> str:
        return self.model.normalize(text or "").replace(" ", "▁")

    def split(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters of all texts in a row; where each word begins, with the end of all; how many words each
        text has."""
        code = _codes("".join(marked))
        ends = np.cumsum([len(m) for m in marked], dtype=np.int64)
        kind = self.kind[code.astype(np.int64)]
        opens = np.ones(len(code) + 1, bool)
        if len(code):
            opens[1:-1] = ~self.beside.ravel()[kind[:-1] * len(self.beside) + kind[1:]]
        opens[ends] = True
        begins = np.flatnonzero(opens)
        return code, begins, np.diff(np.searchsorted(begins, ends), prepend=0)

    def words(self, text: str | None) -> list[str]:
        marked = self.marked(text)
        begins = self.split([marked])[1].tolist()
        return [marked[a:b] for a, b in zip(begins, begins[1:])]

    def spelt(self, code: int) -> tuple[int, ...]:
        """Ids of a character that is no piece: its bytes, or the unknown id where a model has no bytes."""
        if self.unknown in self.bytes:
            return (self.unknown,)
        return tuple(self.bytes[b] for b in chr(code).encode(errors="replace"))

    def ids(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with characters that are no piece, kept as -1 - code point, spelt out; and where each one's ids
        begin, with the end of all."""
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces, np.arange(len(pieces) + 1)
        kinds, which = np.unique(pieces[odd], return_inverse=True)
        spelt = [self.spelt(-1 - p) for p in kinds.tolist()]
        size = np.ones(len(pieces), np.int64)
        size[odd] = np.array([len(s) for s in spelt])[which]
        out = np.repeat(pieces, size)
        begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        order = np.argsort(which, kind="stable")
        for s, at in zip(spelt, np.split(begins[odd][order], np.cumsum(np.bincount(which))[:-1])):
            for place, one in enumerate(s):
                out[at + place] = one
        return out, begins


class Lattices:
    """The lattices of some words as flat arrays: node -> edges (piece, next node, log-probability given the node).

    Word w's nodes are its places and its end: the place i of all words' characters is node i + w. `cum` is the
    probability of a node's edges up to this one.
    """

    def __init__(self, pieces: Pieces, words: list[str] | None, code: np.ndarray | None = None, size: np.ndarray | None = None):
        """words: the words, or None where `code` has their characters in a row and `size` how many each has."""
        if words is not None:
            code, size = _codes("".join(words)), np.array([len(w) for w in words], np.int64)
        n, of = len(code), np.repeat(np.arange(len(size)), size)
        end = np.cumsum(size)[of] if n else of
        sums, scale = _hashes(code)
        source, target, piece, log = [], [], [], []
        place = np.arange(n)
        single = np.zeros(n, bool)
        for (length, hashes, ids, logs), heads in zip(pieces.tables, pieces.heads):
            place = place[place + length <= end[place]]
            h = (sums[place + length] - sums[place]) * scale[place]
            may = np.flatnonzero(heads[h >> _U(64 - _HEAD)])  # most stretches begin like no piece's hash
            k = np.searchsorted(hashes, h[may]).clip(max=len(hashes) - 1)
            same = hashes[k] == h[may]
            hit, k = may[same], k[same]
            source.append(place[hit])
            target.append(place[hit] + length)
            piece.append(ids[k])
            log.append(logs[k])
            if length == 1:
                single[place[hit]] = True
        odd = np.flatnonzero(~single)
        source.append(odd)
        target.append(odd + 1)
        piece.append(-1 - code[odd].astype(np.int64))
        log.append(np.full(len(odd), pieces.worst))
        source, target, piece, log = (np.concatenate(x) for x in (source, target, piece, log))
        order = np.argsort(source, kind="stable")
        source, target, piece, log = (x[order] for x in (source, target, piece, log))
        left = end[source] - source if n else source
        near = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")  # nodes nearest to their word's end first
        source, target, left = source + of[source], target + of[source], left[near]
        nodes = n + len(size)
        back = np.zeros(nodes)
        bounds = np.searchsorted(left, np.arange(1, int(left[-1]) + 2)) if n else [0]
        from_, into, weights = source[near], target[near], log[near]
        for a, b in zip(bounds, bounds[1:]):
            weight = weights[a:b] + back[into[a:b]]
            opens = np.flatnonzero(np.r_[True, from_[a + 1 : b] != from_[a : b - 1]])
            row = np.repeat(np.arange(len(opens)), np.diff(np.r_[opens, b - a]))
            top = np.maximum.reduceat(weight, opens)
            whole = top + np.log(np.add.reduceat(np.exp(weight - top[row]), opens))
            back[from_[a + opens]] = whole
            weights[a:b] = np.minimum(weight - whole[row], 0)
        log[near] = weights
        self.piece, self.to, self.log = piece, target, log
        self.count = np.bincount(source, minlength=nodes)
        self.first = np.cumsum(self.count) - self.count
        self.starts = np.cumsum(size) - size + np.arange(len(size))
        # added up by an edge's number in its node, so that nothing but its node's probabilities goes into it
        self.cum, inner = np.exp(log), np.flatnonzero(np.diff(source) == 0) + 1
        nth = np.arange(len(source)) - self.first[source]
        for k in range(1, int(nth.max(initial=0)) + 1):
            inner = inner[nth[inner] >= k]
            e = inner[nth[inner] == k]
            self.cum[e] += self.cum[e - 1]
        last = self.count > 0
        self.cum[(self.first + self.count - 1)[last]] = 2.0


class Store:
    """Lattices of words that were met, as one set of flat arrays; words go by a hash of their characters.

    Those of words up to `SHORT` characters stay for the texts that follow, until they hold `KEPT` edges: then all
    are dropped. Those of other words, which seldom come again, are dropped after each run of texts.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.piece, self.to, self.log, self.cum = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0), np.empty(0)
        self.count, self.first = np.empty(0, np.int32), np.empty(0, np.int32)
        self.known, self.start = np.empty(0, _U), np.empty(0, np.int64)  # sorted hashes of kept words, and their first nodes
        self.edges = self.nodes = 0  # of kept words

    def _add(self, code: np.ndarray, begin: np.ndarray, size: np.ndarray, edges: int, nodes: int) -> tuple[np.ndarray, int, int]:
        """Writes some words' lattices behind those that are there: the words' first nodes, and the new ends."""
        t = Lattices(self.pieces, None, code[_ranges(begin, size)], size)
        for names, a, columns in ((("piece", "to", "log", "cum"), edges, (t.piece, t.to + nodes, t.log, t.cum)), (("count", "first"), nodes, (t.count, t.first + edges))):
            for name, column in zip(names, columns):
                held, b = getattr(self, name), a + len(column)
                if len(held) < b:
                    held = np.concatenate([held[:a], np.empty(b + b // 4 - a, held.dtype)])
                    setattr(self, name, held)
                held[a:b] = column
        return t.starts + nodes, edges + len(t.piece), nodes + len(t.count)

    def find(self, code: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The first node of each word's lattice; good until the next call."""
        if self.edges > KEPT:
            self.known, self.start, self.edges, self.nodes = self.known[:0], self.start[:0], 0, 0
        size, begin = np.diff(begins), begins[:-1]
        sums, scale = _hashes(code)
        h = (sums[begins[1:]] - sums[begin]) * scale[begin] + _mixed(size.astype(_U))
        out = np.empty(len(size), np.int64)
        usual = np.flatnonzero(size <= LONG)
        kinds, first, which = np.unique(h[usual], return_index=True, return_inverse=True)
        first = usual[first]
        node = np.empty(len(kinds), np.int64)
        k = np.searchsorted(self.known, kinds)
        old = np.zeros(len(kinds), bool)
        if len(self.known):
            old = self.known[k.clip(max=len(self.known) - 1)] == kinds
            node[old] = self.start[k[old]]
        new = np.flatnonzero(~old & (size[first] <= SHORT))
        node[new], self.edges, self.nodes = self._add(code, begin[first[new]], size[first[new]], self.edges, self.nodes)
        self.known, self.start = np.insert(self.known, k[new], kinds[new]), np.insert(self.start, k[new], node[new])
        new = np.flatnonzero(~old & (size[first] > SHORT))
        rest = np.flatnonzero(size > LONG)  # each by itself
        every = np.concatenate([first[new], rest])
        some, _, _ = self._add(code, begin[every], size[every], self.edges, self.nodes)
        node[new] = some[: len(new)]
        out[usual], out[rest] = node[which], some[len(new) :]
        return out


def _descend(t: Store, doc, node, shift, key):
    """Draws a path from `node` of each word on to the word's end, many words of many documents at once.

    doc, shift: each word's document, and what is added to a node for its place in there; key: a number for each
    document. Returns the path's edges in order, and where each word's begin, with the end of all.
    """
    steps, at, live = [], node.copy(), np.flatnonzero(t.count[node] > 0)
    size = np.zeros(len(doc), np.int64)
    while len(live):
        here = at[live]
        edge = t.first[here].astype(np.int64)
        todo = np.flatnonzero(t.count[here] > 1)  # where there is but one edge, it is taken
        who = live[todo]
        u, e = _uniform(key[doc[who]] + _mixed((here[todo] + shift[who]).astype(_U) * _U(2))), edge[todo]
        while len(todo):
            over = np.flatnonzero(u > t.cum[e])
            todo, u, e = todo[over], u[over], e[over] + 1
            edge[todo] = e
        steps.append((live, edge))
        at[live] = to = t.to[edge]
        size[live] += 1
        live = live[t.count[to] > 0]
    begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    path = np.empty(begins[-1], np.int64)
    for order, (live, edge) in enumerate(steps):
        path[begins[live] + order] = edge
    return path, begins


def _left(t: Store, doc, node, shift, key, path, begins, prior, top, beside: int):
    """For each document the `beside` best children that its path left behind: (document, value, word, pieces before,
    edge, log-probability with the edge), words and pieces counted from the path's start.

    prior, top: log-probability of all before the document's first word here, and the value that its path keeps.

    The children's values fall as exponential times rise, whose rates are the children's probabilities. Those along
    the path's first part (`HORIZON`) are drawn one by one. Of the rest the least time is drawn alone, at the sum of
    the rates: mostly it is too late. Where it isn't, the rest is drawn too, and moved to that least time: how much later
    than the first the others are, and which is first, doesn't depend on it.
    """
    opens = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    of, low, high = doc[opens], begins[opens], begins[np.r_[opens[1:], len(doc)]]
    prior, top, key = prior[of], top[of], key[of]
    logs = t.log[path]
    before = np.concatenate([np.zeros(1), np.cumsum(logs)])  # falls all along
    near = np.searchsorted(-before, HORIZON - before[low], side="right").clip(low, high)

    def drawn(docs, a, b):
        """Children along the path from a to b: document, time's logarithm above the top's, place, edge, log-probability."""
        k, d = _ranges(a, b - a), np.repeat(docs, b - a)
        word = np.searchsorted(begins, k, side="right") - 1
        here = np.where(k == begins[word], node[word], t.to[path[k - 1]])
        seat = key[d] + _mixed((here + shift[word]).astype(_U) * _U(2) + _U(1))
        n = t.count[here]
        edge = _ranges(t.first[here], n)
        row = np.repeat(np.arange(len(k)), n)
        lost = np.flatnonzero(edge != path[k][row])
        edge, row = edge[lost], row[lost]
        d, k = d[row], k[row]
        phi = prior[d] + (before[k] - before[low[d]]) + t.log[edge]
        return d, top[d] - phi + np.log(-np.log(_uniform(seat[row] ^ _mixed(t.piece[edge].astype(_U) + _U(1))))), k, edge, phi

    def best(d, u, k, edge, phi):
        order = np.lexsort((k, u, d))
        nth = np.arange(len(d)) - np.searchsorted(d[order], d[order])
        order = order[nth < beside]
        return d[order], u[order], k[order], edge[order], phi[order]

    found = best(*drawn(np.arange(len(of)), low, near))
    many = np.bincount(found[0], minlength=len(of))
    limit = np.where(many == beside, found[1][(np.cumsum(many) - 1).clip(0)] if len(found[0]) else np.inf, np.inf)
    with np.errstate(divide="ignore"):
        rate = prior + before[near] - before[low] + np.log(-np.expm1(before[high] - before[near]))
        least = top - rate + np.log(-np.log(_uniform(key ^ _U(_B))))
    far = np.flatnonzero((near < high) & ~(least > limit))
    if len(far):
        d, u, *rest = drawn(far, near[far], high[far])
        first = np.full(len(of), np.inf)
        np.minimum.at(first, d, u)
        with np.errstate(divide="ignore"):
            moved = np.logaddexp(least[d], u + np.log1p(-np.exp(first[d] - u)))
        u = np.where(least[d] < np.inf, moved, u)
        found = best(*(np.concatenate(c) for c in zip(found, (d, u, *rest))))
    d, u, k, edge, phi = found
    # once more by the document's own numbers, as `before` has the rounding of those that stand before it
    own = prior[d] + np.array([logs[a:b].sum() for a, b in zip(low[d].tolist(), k.tolist())]) + t.log[edge]
    u, phi = u + (phi - own), own
    value = top[d] - np.maximum(u, 0) - np.log1p(np.exp(-np.abs(u)))
    word = np.searchsorted(begins, k, side="right") - 1 - opens[d]
    return zip(of[d].tolist(), value.tolist(), word.tolist(), (k - low[d]).tolist(), edge.tolist(), phi.tolist())


def sample(own: Pieces, keys: list[int], texts: list[str | None], samples: int = SAMPLES, seed: int = SEED):
    """For each text up to `samples` segmentations, by falling perturbed value: (ids, log-probability, log of the
    inclusion score). A text with fewer segmentations gives all of them, with inclusion 1."""
    ids, bounds, rows = _sample(Store(own), keys, [own.marked(t) for t in texts], samples, seed)
    results: list[list] = [[] for _ in texts]
    for (i, _, log, inclusion), a, b in zip(rows, bounds, bounds[1:]):
        results[i].append((ids[a:b], log, inclusion))
    return results


def _sample(t: Store, keys: list[int], marked: list[str], samples: int, seed: int):
    """All samples' ids in a row, where each one's begin (with the end of all), and (text, rank, log-probability, log
    of the inclusion score) of each."""
    code, begins, words = t.pieces.split(marked)
    n, nodes = len(marked), t.find(code, begins)
    ends = np.cumsum(words).tolist()
    opens = [0, *ends[:-1]]
    first = np.cumsum([0, *map(len, marked)])[:-1]  # a text's first character
    shifts = begins[:-1] - np.repeat(first, words) - nodes
    base = np.array([xxhash.xxh64_intdigest(str(k), seed) for k in keys], _U)
    # on a document's queue: value; word, pieces and edge where a path is left, or the root's; log-probability with that edge; number of the path
    queue: list[list] = [[(g, 0, 0, None, 0.0, 0)] for g in (-np.log(-np.log(_uniform(base)))).tolist()]
    paths: list[list] = [[] for _ in marked]  # (pieces, log-probability)
    for turn in range(samples):
        going = [i for i in range(n) if queue[i]]
        if not going:
            break
        doc, node, shift, prior, top = [], [], [], np.zeros(n), np.zeros(n)
        heads = {}
        for i in going:
            q = max(range(len(queue[i])), key=lambda k: queue[i][k][0])
            top[i], w, at, edge, prior[i], of = queue[i].pop(q)
            rest = nodes[opens[i] + w : ends[i]]
            ahead = None
            if edge is not None:
                ahead = np.append(paths[i][of][0][:at], t.piece[edge])
                rest = rest.copy()
                rest[0] = t.to[edge]
            heads[i] = w, ahead
            doc.append(np.full(len(rest), i))
            node.append(rest)
            shift.append(shifts[opens[i] + w : ends[i]])
        doc, node, shift = (np.concatenate(c) for c in (doc, node, shift))
        key = base + _mixed(np.array([turn + 1], _U))
        path, starts = _descend(t, doc, node, shift, key)
        pieces, logs = t.piece[path], t.log[path]
        cuts = starts[np.searchsorted(doc, np.arange(n + 1))].tolist()
        for i in going:
            a, b = cuts[i], cuts[i + 1]
            own = pieces[a:b] if heads[i][1] is None else np.concatenate([heads[i][1], pieces[a:b]])
            paths[i].append((own, float(prior[i]) + float(logs[a:b].sum())))
        if len(doc):
            for i, value, w, at, edge, phi in _left(t, doc, node, shift, key, path, starts, prior, top, samples - turn):
                w0, ahead = heads[i]
                queue[i].append((value, w0 + w, at + (0 if ahead is None else len(ahead)), edge, phi, turn))
    ids, begins = t.pieces.ids(np.concatenate([np.empty(0, np.int32), *(pieces for of in paths for pieces, _ in of)]))
    rows = []
    for i in range(n):
        threshold = max((q[0] for q in queue[i]), default=-np.inf)
        for rank, (_, log) in enumerate(paths[i], 1):
            if threshold == -np.inf:
                inclusion = 0.0
            else:
                x = log - threshold
                inclusion = float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)
            rows.append((i, rank, log, inclusion))
    return ids, begins[np.cumsum([0, *(len(pieces) for of in paths for pieces, _ in of)])].tolist(), rows


@lru_cache(maxsize=2)
def pieces_of(path: str, temperature: float) -> Pieces:
    """One set of pieces for each model and Python worker."""
    return Pieces(path, temperature)


@lru_cache(maxsize=1)
def store_of(path: str, temperature: float) -> Store:
    """One store of lattices for each Python worker."""
    return Store(pieces_of(path, temperature))


def _batches(sizes: list[int], most: int = CHARS):
    """Bounds of runs of texts, of so many characters each, that have `most` together at most, or of one text."""
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    yield start, len(sizes)


def sampled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, samples: int = SAMPLES, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """doc_id, rank (from 1), n_pieces, ids, log_prob, log_inclusion, decoded (whether the ids decode to the
    normalised text) of up to `samples` distinct segmentations of every row's whole text.

    Rows are seeded by their id (null like the text "None"), so repeated rows get equal samples. A null or empty
    text has one segmentation, of no pieces. Columns other than the two aren't read; no rows give no rows.
    """
    model = model or vocabulary("piece_bpe_32k.model")

    @tidy
    def work(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        store = store_of(model, temperature)
        own = store.pieces
        names = ["doc_id", "rank", "n_pieces", "ids", "log_prob", "log_inclusion", "decoded"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            every = batch.column(0).to_pylist()
            for a, b in _batches(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
                keys, marked = every[a:b], [own.marked(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, bounds, rows = _sample(store, keys, marked, samples, seed)
                ids = ids.astype(np.int32, copy=False)
                plain = [m.replace("▁", " ").removeprefix(" ") for m in marked]
                columns = [[], [], [], None, [], [], []]
                for (i, rank, log, inclusion), c, d in zip(rows, bounds, bounds[1:]):
                    same = own.model.decode(ids[c:d]) == plain[i]
                    for column, x in zip((0, 1, 2, 4, 5, 6), (keys[i], rank, d - c, log, inclusion, same)):
                        columns[column].append(x)
                columns[3] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([c if k == 3 else pa.array(c, kinds[k]) for k, c in enumerate(columns)], names=names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(work, "doc_id long, rank int, n_pieces long, ids array<int>, log_prob double, log_inclusion double, decoded boolean")


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """doc_id and ids: the model's own, best segmentation of every row's whole text (null: empty)."""
    model = model or vocabulary("piece_bpe_32k.model")

    @tidy
    def work(batches):
        import pyarrow as pa

        sp = pieces_of(model, 1.0).model
        for batch in batches:
            ids = sp.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(work, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, doc_id: str = "doc_id", column: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids (null: none)."""
    model = model or vocabulary("piece_bpe_32k.model")

    @tidy
    def work(batches):
        import pyarrow as pa

        sp = pieces_of(model, 1.0).model
        for batch in batches:
            texts = [sp.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column)).mapInArrow(work, "doc_id long, text string")


def op6_piece_sampling(spark, sf_dir):
    """Sampled segmentations of all documents, their ids as a checksum."""
    found = sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    crc = F.crc32(F.array_join("ids", ",").cast("binary"))
    return found.select("doc_id", "rank", "n_pieces", crc.alias("ids_crc32"), F.round("log_prob", 6).alias("log_prob"), F.round("log_inclusion", 6).alias("log_inclusion"), "decoded")
