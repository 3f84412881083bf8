import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests_llm_odd import ODD
from tidemark.llm import packing, piece_sampling, token_files
from tidemark.llm.tokens import Encoder, encoder, vocabulary


def direct(texts):
    return [np.array(e.ids, "<u4") for e in encoder(vocabulary()).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_is_the_library(monkeypatch):
    rng = random.Random(1)
    letters = [" ", " ", "a", "B", "é", "1", "'", "s", "\n", "\t", "\xa0", " ", "​", "\x1c", "\x85", ".", ",", "中", "᠎", "😀", "\x00", "Ġ", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + [t for _, t in ODD] + ["the cat, and\nThe dog. It 's   fine", " lead", "trail ", "  ", "a" * 500]
    own = Encoder(vocabulary())
    want = [x.tobytes() for x in direct(texts)]
    assert own(texts) == want
    monkeypatch.setattr("tidemark.llm.tokens.KEPT", 50)
    assert [own([t])[0] for t in texts[:300]] == want[:300]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(planes, width):
    ids = np.random.default_rng(0).integers(0, 50257, 1000).astype("<u4")
    for n in (0, 1, 7, 8, 1000):
        assert (token_files.unshuffled(token_files.shuffled(ids[:n], width, planes), n, width, planes) == ids[:n]).all()


@pytest.mark.parametrize("options", [{}, {"chunk": 16, "planes": "bit"}, {"chunk": 1000, "width": 4}])
def test_files_round_trip(spark, read, tmp_path, options):
    rows = ODD + [(100 - i, f"document {i} " * (i % 7)) for i in range(60)]
    manifest = token_files.write_files(read(rows), str(tmp_path / "files"), **options)
    got = token_files.read_files(spark, manifest).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (i, t), ids in zip(got, rows, direct([t for _, t in rows])):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids) + 1, np.append(ids, 2).astype("<u4").tobytes())
        start += r.n_tokens
    assert len(got) == len(rows)
    assert token_files.read_files(spark, token_files.write_files(read([]), str(tmp_path / "none"))).count() == 0


def test_damaged_file_is_refused(read, tmp_path):
    path = token_files.write_files(read([(1, "a b c")]), str(tmp_path / "files")).first().path
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-3])
    with pytest.raises(ValueError):
        list(token_files.read_file(path))


def test_packing(read):
    rows = ODD + [(100 + i, "word and " * (i * 37 % 900)) for i in range(120)]
    got = packing.pack(read(rows, parts=3), capacity=256).toPandas()
    ids = {}
    for (i, _), x in zip(rows, direct([t for _, t in rows])):
        ids.setdefault(i, []).append(np.append(x, 0).astype("<u4"))
    assert got.doc_tokens[got.start == 0].sum() == got.length.sum() == sum(len(x) for v in ids.values() for x in v)
    for r in got[got.doc_id >= 100].itertuples():
        own = ids[r.doc_id][0][r.start : r.start + r.length]
        assert (len(own), zlib.crc32(own.tobytes())) == (r.length, r.ids_crc32)
    waste = 0
    for _, q in got.sort_values("offset").groupby("sequence_id"):
        assert q.offset.tolist() == [0, *q.length.cumsum()[:-1]] and q.length.sum() <= 256
        waste += packing.padded(int(q.length.sum()), 256) - q.length.sum()
    assert waste < 0.05 * got.length.sum()
    assert packing.pack(read([])).count() == 0


def test_plans_use_up_the_histogram():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 3000):
        h = dict(zip(*(a.tolist() for a in np.unique(rng.integers(1, 128, n), return_counts=True)))) if n else {}
        plan, used = packing.patterns(h, 128, pivots=200), {}
        for pattern, times in plan:
            assert sum(k * c for k, c in pattern.items()) <= 128 and times > 0
            for k, c in pattern.items():
                used[k] = used.get(k, 0) + c * times
        assert used == h


def test_column_generation_beats_its_start():
    h = {6: 400, 5: 300, 4: 300, 3: 100}  # capacity 10: 6+4, 5+5 and 4+3+3 waste nothing
    plan = packing.patterns(h, 10, gap=0.0)
    used = sum(packing.padded(sum(k * c for k, c in p.items()), 10) * t for p, t in plan)
    assert used <= 1.02 * sum(k * v for k, v in h.items())


def test_wide_ids_are_refused(tmp_path):
    out = token_files.Writer(str(tmp_path / "f"), 1, "byte", 4, 1)
    out.add(1, np.array([255], "<u4").tobytes())
    with pytest.raises(ValueError):
        out.add(2, np.array([256], "<u4").tobytes())


def test_columns_are_priced_over_a_smooth_histogram(monkeypatch):
    """No cap ends the programme: it stops where no pattern improves it, here after many rounds of pricing."""
    rng, rounds, price = np.random.default_rng(3), [], packing._columns
    monkeypatch.setattr(packing, "_columns", lambda *a: rounds.append(price(*a)) or rounds[-1])
    h = dict(zip(*(a.tolist() for a in np.unique(rng.integers(1, 1024, 50_000), return_counts=True))))
    plan = packing.patterns(h)
    cost = sum(packing.padded(sum(k * c for k, c in p.items())) * n for p, n in plan)
    assert len(rounds) > 20 and cost < 1.005 * sum(k * v for k, v in h.items())


@pytest.mark.parametrize("seed, mean, spread, n", [(3, 5, 1, 400), (12, 5, 1, 400), (31, 5, 1, 400), (35, 5, 1, 400), (0, 1.5, 1.5, 5000), (2, 3, 1.5, 5000)])
def test_pivots_keep_the_basis(seed, mean, spread, n):
    """Histograms whose basis became singular by pivots on what rounding had left, or is too far from even at the start."""
    lengths = np.random.default_rng(seed).lognormal(mean, spread, n).astype(int) % 1024
    h = dict(zip(*(a.tolist() for a in np.unique(lengths[lengths > 0], return_counts=True))))
    plan, used = packing.patterns(h), {}
    for pattern, times in plan:
        assert sum(k * c for k, c in pattern.items()) <= 1024 and times > 0
        for k, c in pattern.items():
            used[k] = used.get(k, 0) + c * times
    cost = sum(packing.padded(sum(k * c for k, c in p.items())) * n for p, n in plan)
    assert used == h and cost < 1.05 * sum(k * v for k, v in h.items())


def test_small_steps_dont_hold_up_the_programme(monkeypatch):
    """Histograms over which pivots alone priced patterns thousands of times, or stalled above the least padding."""
    price = packing._columns
    for n, top in ((60_000, 1024), (1000, 700)):
        lengths, rounds = np.random.default_rng(1).gamma(2, 240, n).astype(int) % top, []
        h = dict(zip(*(a.tolist() for a in np.unique(lengths[lengths > 0], return_counts=True))))
        monkeypatch.setattr(packing, "_columns", lambda *a: rounds.append(0) or (len(rounds) <= 500 or pytest.fail("too many rounds")) and price(*a))  # noqa: B023
        plan, used = packing.patterns(h), {}
        for pattern, times in plan:
            for k, c in pattern.items():
                used[k] = used.get(k, 0) + c * times
        cost = sum(packing.padded(sum(k * c for k, c in p.items())) * n for p, n in plan)
        assert used == h and cost < sum(k * v for k, v in h.items()) + 4 * 1024


def test_every_segmentation_with_its_probability():
    """More samples than there are paths: all of them, by falling probability-weighted noise, none twice."""
    own = piece_sampling.Pieces(vocabulary("piece_bpe_32k.model"), 1.0)
    score = {own.model.id_to_piece(k): s for _, _, ids, logs in own.tables for k, s in zip(ids.tolist(), logs.tolist())}

    def paths(word):
        if not word:
            return [()]
        return [(word[:n], *rest) for n in range(1, len(word) + 1) if word[:n] in score for rest in paths(word[n:])]

    words = own.words("the cat")
    every = [a + b for a in paths(words[0]) for b in paths(words[1])]
    weight = {p: sum(map(score.get, p)) for p in every}
    whole = np.log(sum(np.exp(w) for w in weight.values()))
    [found] = piece_sampling.sample(own, [1], ["the cat"], len(every) + 5)
    got = {tuple(own.model.id_to_piece(k) for k in ids.tolist()): (log, inclusion) for ids, log, inclusion in found}
    assert set(got) == set(every) and len(found) == len(every)
    for p, (log, inclusion) in got.items():
        assert log == pytest.approx(weight[p] - whole, abs=1e-9) and inclusion == 0
    for k in (1, 2, 7):  # fewer samples are the first ones of more
        [some] = piece_sampling.sample(own, [1], ["the cat"], k)
        assert len(some) == k and len({tuple(i.tolist()) for i, _, _ in some}) == k


def test_lookups_rule_out_most_stretches(monkeypatch):
    """Most stretches of a text are no piece: few of them are searched for among the pieces' hashes."""
    own, asked, search = piece_sampling.Pieces(vocabulary("piece_bpe_32k.model"), 1.0), [], np.searchsorted
    hashes = {id(t[1]) for t in own.tables}
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *k, **o: (asked.append(np.size(v)) if id(a) in hashes else None, search(a, v, *k, **o))[1])
    words = own.words(" ".join("".join(random.Random(i).choices("abcdefghijklmnopqrst", k=12)) for i in range(500)))
    found = piece_sampling.Lattices(own, words)
    stretches = sum(max(0, len(w) - t[0] + 1) for w in words for t in own.tables)
    assert len(found.piece) <= sum(asked) + sum(map(len, words)) and sum(asked) < 0.5 * stretches


def _whole(own, text):
    """Every segmentation of a text, as one lattice that is cut nowhere, with its probability."""
    score = {own.model.id_to_piece(k): x for _, _, ids, logs in own.tables for k, x in zip(ids.tolist(), logs.tolist())}

    def paths(rest):
        if not rest:
            return [()]
        pieces = [rest[:n] for n in range(1, len(rest) + 1) if rest[:n] in score]
        return [(p, *more) for p in (pieces if rest[0] in score else [rest[0], *pieces]) for more in paths(rest[len(p) :])]

    weight = {p: np.exp(sum(score.get(x, own.worst) for x in p)) for p in paths(own.marked(text))}
    return {tuple(i for x in p for i in ([own.model.piece_to_id(x)] if x in score else own.spelt(ord(x)))): w / sum(weight.values()) for p, w in weight.items()}


@pytest.mark.parametrize("horizon", [0.0, 0.7, 8.0])
def test_pairs_of_samples_without_replacement(monkeypatch, horizon):
    """First and second samples by their joint probability p * q / (1 - p), wherever children are drawn one by one or by
    their least time; more samples than paths give every path of the text's whole lattice."""
    monkeypatch.setattr(piece_sampling, "HORIZON", horizon)
    own = piece_sampling.Pieces(vocabulary("piece_bpe_32k.model"), 1.0)
    n, text, known = 30000, "on it", _whole(own, "on it")
    seen = Counter(tuple(tuple(ids.tolist()) for ids, _, _ in found) for found in piece_sampling.sample(own, list(range(n)), [text] * n, 2, seed=3))
    for a, p in known.items():
        for b, q in known.items():
            if a != b:
                due = p * q / (1 - p)
                assert abs(seen[a, b] - n * due) < 5 * (n * due) ** 0.5 + 3
    assert sum(seen.values()) == n and all(a in known and b in known and a != b for a, b in seen)
    for text in ("on it.", "a.\nB1", "it\x00's", "", "漢é on"):
        known = _whole(own, text)
        [found] = piece_sampling.sample(own, [1], [text], len(known) + 3)
        assert len(found) == len(known)
        for ids, log, inclusion in found:
            assert np.exp(log) == pytest.approx(known[tuple(ids.tolist())], rel=1e-9) and inclusion == 0


def test_children_left_behind_are_drawn_near_the_start(monkeypatch):
    """Two samples of a long text draw values (logarithms of numbers) for few of the edges that the paths pass."""
    own, made, log = piece_sampling.Pieces(vocabulary("piece_bpe_32k.model"), 1.0), [], np.log
    text = " ".join(random.Random(1).choices(["the", "nation", "thing", "reason", "was", "under"], k=3000))
    monkeypatch.setattr(np, "log", lambda x, *k, **o: made.append(np.size(x)) or log(x, *k, **o))
    [found] = piece_sampling.sample(own, [1], [text])
    assert len(found) == 2 and sum(made) < 0.5 * sum(len(ids) for ids, _, _ in found)


def test_lattices_of_words_that_come_again(monkeypatch):
    """Short words' lattices are built once for many runs of texts; samples don't depend on what was met or dropped."""
    own, built, build = piece_sampling.Pieces(vocabulary("piece_bpe_32k.model"), 1.0), [], piece_sampling.Lattices
    texts = [own.marked(f"the cat {w} {'ab' * 9} {'ab' * 40} on the mat") for w in ("sat", "is", "sat", "", "x" * 50)]
    alone = [piece_sampling._sample(piece_sampling.Store(own), [k], [t], 2, 1) for k, t in enumerate(texts)]
    for kept in (10**6, 40, 0):
        monkeypatch.setattr(piece_sampling, "KEPT", kept)
        store = piece_sampling.Store(own)
        for k, t in enumerate(texts):
            ids, bounds, rows = piece_sampling._sample(store, [k], [t], 2, 1)
            assert ids.tolist() == alone[k][0].tolist() and (bounds, rows) == alone[k][1:]
    monkeypatch.setattr(piece_sampling, "KEPT", 10**6)
    monkeypatch.setattr(piece_sampling, "Lattices", lambda pieces, words, code=None, size=None: built.append(len(size)) or build(pieces, words, code, size))
    store = piece_sampling.Store(own)
    for t in texts[:3]:
        piece_sampling._sample(store, [0], [t], 2, 1)
    assert built[::2][2] == 0 and built[0] > built[2] >= 1  # short words: all, then the new one, then none


def test_scores_do_not_depend_on_the_texts_beside():
    """Log-probabilities are equal to the last digit, whatever stands before a text in its run."""
    own = piece_sampling.Pieces(vocabulary("piece_bpe_32k.model"))
    texts = [" ".join(random.Random(k).choices(["the", "nation", "Thing,", "reason.", "was", "under"], k=400)) for k in range(60)]
    for k, found in enumerate(piece_sampling.sample(own, list(range(60)), texts, 3)):
        [alone] = piece_sampling.sample(own, [k], [texts[k]], 3)
        assert [(i.tolist(), log) for i, log, _ in found] == [(i.tolist(), log) for i, log, _ in alone]
        assert [c for _, _, c in found] == pytest.approx([c for _, _, c in alone], abs=1e-12)


def test_samples_are_distinct_and_decode():
    own = piece_sampling.Pieces(vocabulary("piece_bpe_32k.model"))
    texts = ["ab cd", "the cat", "héx", "", None, " a  b", "漢x", "\x00", "a" * 200]
    for text, found in zip(texts, piece_sampling.sample(own, list(range(len(texts))), texts, 4)):
        assert len({tuple(ids.tolist()) for ids, _, _ in found}) == len(found) >= 1
        assert all(own.model.decode(ids.tolist()) == own.model.decode(own.model.encode(text or "")) for ids, _, _ in found)
        assert all(log <= 1e-9 and inclusion <= 1e-9 for _, log, inclusion in found)


def test_samples_follow_the_lattice():
    """First samples come as often as the probabilities say, and inclusion scores estimate sums without bias."""
    own = piece_sampling.Pieces(vocabulary("piece_bpe_32k.model"))
    n, first, known, total = 4000, {}, {}, 0.0
    for found in piece_sampling.sample(own, list(range(n)), ["the cat"] * n, 2, seed=5):
        key = tuple(found[0][0].tolist())
        first[key] = first.get(key, 0) + 1
        for ids, log, inclusion in found:
            known[tuple(ids.tolist())] = log
            total += np.exp(log - inclusion)
    for key, count in first.items():
        assert count / n == pytest.approx(np.exp(known[key]), abs=0.03)
    assert total / n == pytest.approx(1.0, abs=0.03)


def test_sampling_ignores_the_split(read):
    rows = ODD + [(i, f"some words number {i}") for i in range(20, 40)]
    got = [sorted(map(str, piece_sampling.sampled(read(rows, parts=p)).select("doc_id", "rank", "ids").collect())) for p in (1, 5)]
    assert got[0] == got[1]
    plain = piece_sampling.decoded(piece_sampling.encoded(read(rows))).collect()
    assert sorted(r.text for r in plain) == sorted(t or "" for _, t in rows)
    assert piece_sampling.sampled(read([])).count() == 0
