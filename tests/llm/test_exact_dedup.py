import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import drop_copies, exact_dedup
from tests_llm_odd import ODD


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    return {hashlib.sha256(k.encode()).hexdigest(): (None if min(v)[1] else min(v)[2], len(v)) for k, v in groups.items()}


def colliding(block, seed):
    """Keys that collide until the third seed."""
    h = F.char_length(block).cast("long") if seed < 2 else F.xxhash64(block)
    return F.struct(h.alias("h1"), F.lit(0).cast("long").alias("h2"))


@pytest.mark.parametrize("options", [{}, {"block_chars": 3}, {"block_chars": 2, "key": colliding}])
def test_against_brute_force(read, options):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 14)))) for i in range(300)] + ODD
    got = exact_dedup(read(rows), **options).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert all(want[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
    assert sum(r.kept for r in got) == len(want)


def test_rows_that_stay_keep_their_columns(read):
    df = read([(1, "a b"), (2, "ab"), (2, "ab"), (3, "c")])
    kept = drop_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_empty_table_and_clashing_names(read):
    assert exact_dedup(read([])).count() == 0
    df = read([(1, "a", 1, 2)], "doc_id long, text string, name int, pos int")
    assert exact_dedup(df).first().keep_id == 1
