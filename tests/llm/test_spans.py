import hashlib
import random
import re

from pyspark.sql import functions as F

from tests_llm_odd import ODD
from tidemark.llm import pii, secret_scan
from tidemark.llm.spans import shown

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0


def personal(t):
    def holds(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, r in KINDS.items() for m in re.finditer(r, t or "") if holds(k, m[0])]


def secret(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def noise(parts, n, seed):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(n)]


def test_personal_data(read):
    parts = ["a", "b.c", "@", "@d.e", ".f", "_", "-", " ", "1", "12", "256", "255", ".", "0.0.0.0", "4111111111111111", "4111 1111-1111 1111", "+", "+1 (555) 123-4567", "(", "\n", "é", "😀", "%", "x@y.z", "7"]
    rows = noise(parts, 1200, 5) + [(9000 + k, t) for k, (_, t) in enumerate(ODD)] + [(9100, "a@b.co " * 3000), (9101, "1" * 3000)]
    got = pii.find(read(rows)).select("doc_id", shown(F.col("base")).alias("base"), shown(F.col("spans")).alias("spans")).collect()
    want = {i: ",".join(personal(t)) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.base == want[r.doc_id]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_patterns_discover_candidates(read):
    rows = [(i, f"please call phone: +1 555 123 45{i:02d} now") for i in range(20)] + [(50, "please call phone: (555) 987-6543 now"), (51, "the number (555) 987-1111 stands alone")]
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans] for r in pii.find(read(rows)).join(read(rows), "doc_id").collect()}
    assert got[50] == ["(555) 987-6543"] and got[51] == []
    assert pii.find(read([])).count() == 0


def test_secrets(read):
    parts = ["password", "=", ":", " ", "'", '"', "token", "abc12", "x", "AKIA", "ABCDEFGH12345678", "deadbeef00112233445566", "0a", "é", "\n", "Secret", "api_key", "zzzzzz", "😀"]
    rows = noise(parts, 1200, 3) + [(9000 + k, t) for k, (_, t) in enumerate(ODD)] + [(9100, "token=abcdefg " * 3000)]
    got = secret_scan.scan(read(rows)).select("doc_id", F.sha2(shown(F.col("__base")), 256).alias("h")).collect()
    want = {i: hashlib.sha256(",".join(secret(t)).encode()).hexdigest() for i, t in rows}
    assert len(got) == len(rows) and all(r.h == want[r.doc_id] for r in got)


def graph(edges, rounds, accept, support):
    """What pii._scores has to find, one value and one pattern at a time."""
    seeds = {(k, v) for k, _, v, s in edges if s}
    score = {(k, v): float((k, v) in seeds) for k, _, v, _ in edges}
    known = set(seeds)
    for _ in range(rounds):
        mean = {}
        for pattern in {(k, p) for k, p, _, _ in edges}:
            own = [(k, v) for k, p, v, _ in edges if (k, p) == pattern]
            if sum(v in known for v in own) >= support:
                mean[pattern] = sum(score[v] for v in own) / (len(own) + 1)
        fresh = {}
        for k, p, v, s in edges:
            if not s and (k, p) in mean:
                fresh[k, v] = 1 - (1 - fresh.get((k, v), 0.0)) * (1 - min(mean[k, p], 0.999))
        score = {v: 1.0 if v in seeds else fresh.get(v, 0.0) for v in score}
        known |= {v for v, s in score.items() if s >= accept}
    return known


def test_graph_scores_against_brute_force(spark):
    rng = random.Random(9)
    edges = {}
    for _ in range(400):
        p = rng.randrange(12)
        v = rng.randrange(60) if p > 3 else rng.randrange(25)
        edges["phone" if p % 3 else "ip", f"p{p}", f"v{v}"] = v < 14
    edges = [(*e, s) for e, s in edges.items()]
    df = spark.createDataFrame(edges, "kind string, pattern string, value string, seed boolean").repartition(3)
    for rounds, accept, support in ((1, 0.5, 3), (3, 0.6, 3), (4, 0.45, 2)):
        got = {tuple(r) for r in pii._scores(df, rounds, accept, support).collect()}
        assert got == graph(edges, rounds, accept, support)


def test_accepted_values_support_other_patterns(read):
    """`Fax` comes with no seed; values found by `phone` make it known, and it finds one that `phone` never shows."""
    seeds = [f"phone: +1 212 555 {k:04d}" for k in range(30)]
    shared = [f"{w} 212-555-{k:04d}" for k in range(8000, 8012) for w in ("phone:", "fax:")]
    rows = list(enumerate([*seeds, *shared, "fax: 646-555-9999", "order 646-555-1111"]))
    spans = {r.doc_id: len(r.spans) for r in pii.find(read(rows), rounds=4).collect()}
    assert all(spans[i] == 1 for i in range(len(rows) - 1)) and spans[len(rows) - 1] == 0
    once = {r.doc_id: len(r.spans) for r in pii.find(read(rows), rounds=1).collect()}
    assert once[len(rows) - 2] == 0


def test_entropy_and_allow_list(read):
    import math
    from collections import Counter

    def entropy(s):
        return max(-sum(n / 20 * math.log2(n / 20) for n in Counter(s[k : k + 20]).values()) for k in range(len(s) - 19))

    values = ["wJalrXUtnFEMI/K7MDENGbPxRfiCYzz9", "aaaaaaaaaaaaaaaaaaaaab", "0123456789abcdef01234567"]
    got = read([(k, v) for k, v in enumerate(values)]).select("text", secret_scan.window_entropy(F.col("text")).alias("e")).collect()
    assert all(abs(r.e - entropy(r.text)) < 1e-9 for r in got)
    rows = [(0, "key wJalrXUtnFEMI/K7MDENGbPxRfiCYzz9 end"), (1, "id 123e4567-e89b-12d3-a456-426614174000 end"), (2, "the-quick-brown-fox-jumps-over-lazy-dogs"), (3, "wJalrXUtnEXAMPLE7MDENGbPxRfiCYzz9")]
    found = {r.doc_id: len(r["__spans"]) for r in secret_scan.scan(read(rows)).collect()}
    assert found == {0: 1, 1: 0, 2: 0, 3: 0}


def test_allow_list_excuses_windows_only(read):
    """Placeholders and repeats inside longer candidates, which hold secrets beside them."""
    key = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZWQyNTUxOQ"
    token = "T0q9XzR4vB7mLk2PwYc8JdHs"
    held = [key, "/hooks/your-team/" + token, token + "/example/" + "x" * 12, token + "z" * 9, token[:19] + "w" * 8 + token[:19], "zzzzzzzz" + token]
    free = ["wJalrXUtnEXAMPLE7MDENGbPxRfiCYzz9", "Z" * 24 + "b1", "your-your-your-dummy-x1Y2", "/path/to/your-team/joined-words/12"]
    rows = [(k, f"at {v} end") for k, v in enumerate(held + free)]
    found = {r.doc_id: [s.value for s in r["__spans"]] for r in secret_scan.scan(read(rows)).collect()}
    assert [found[k] for k in range(len(rows))] == [[v] for v in held] + [[] for _ in free]
    text = {r.doc_id: r.text for r in secret_scan.mask_secrets(read(rows)).collect()}
    assert all(text[k] == "at [secret] end" for k in range(len(held)))


def test_masking(read):
    rows = [(1, "x password=abcdef123 y", None, None, 22), (2, None, None, None, 0), (3, "clean", None, None, 5), (4, "token=deadbeefdeadbeefdeadbeefdeadbeef😀z", None, None, 40)]
    df = read(rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.mask_secrets(df).collect()}
    assert got == {1: ("x [secret] y", 12), 2: (None, 0), 3: ("clean", 5), 4: ("[secret]😀z", 10)}
    assert secret_scan.mask_secrets(df).columns == df.columns and secret_scan.mask_secrets(read([])).count() == 0
