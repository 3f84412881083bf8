import re

import corpus_pipeline as pipeline
from test_near_dedup import brute
from test_spans import secret
from tests_llm_odd import ODD
from tidemark.llm.tokens import encoder, vocabulary


def test_stages_over_the_smallest_tables(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        if k + 1 < len(pipeline.STAGES):
            assert docs.columns == columns
        seen.append(docs.toPandas())
    start, calm, exact, near, clean, packed = seen
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas()
    good = set(labels.doc_id[labels.toxic == 0])
    assert len(good & set(calm.doc_id)) >= 0.95 * len(good & set(start.doc_id))
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    assert exact.text.map(norm).is_unique and set(exact.text.map(norm)) == set(calm.text.map(norm))
    _, roots = brute(list(near[["doc_id", "text"]].itertuples(index=False)))
    assert roots == list(range(len(near)))
    _, roots = brute(list(exact[["doc_id", "text"]].itertuples(index=False)))
    assert len(set(roots)) == len(near)
    assert set(clean.doc_id) == set(near.doc_id) and not any(secret(t) for t in clean.text)
    untouched = near.merge(clean, on="doc_id")
    assert all(a == b for a, b in zip(untouched.text_x, untouched.text_y) if not secret(a))
    sizes = {d: len(i) // 4 + 1 for d, i in zip(clean.doc_id, encoder(vocabulary())(clean.text.tolist()))}
    assert packed.groupby("doc_id").length.sum().to_dict() == sizes


def test_run_gives_the_last_stage(spark, small):
    assert "sequence_id" in pipeline.run(spark, small).columns


WIDE = "doc_id long, text string, lang string, source string, n_chars long, __row long, __base string, __spans string, __toxicity double"


def test_stages_take_odd_rows_empty_tables_and_clashing_names(spark, read, tmp_path):
    """Nulls, empty and repeated rows go through every stage; columns named like helpers stay as they are."""
    labels = read([(k, 0, int(k % 4 == 1)) for k in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "t" / "labels.parquet"))
    for rows in ([], [(i, t, None, None, None, 7, "b", "s", 0.5) for i, t in ODD] + [(20, "password=abcdef1 x", None, None, 18, 8, "b", "s", 0.5)]):
        docs = read(rows, WIDE)
        for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
            path = str(tmp_path / f"{len(rows)}-{k}")
            stage(spark, docs, str(tmp_path / "t")).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == [c.split()[0] for c in WIDE.split(", ")]
        left = docs.collect()
        assert all((r["__base"], r["__spans"], r["__toxicity"]) == ("b", "s", 0.5) for r in left)
        if rows:
            assert {r["__row"] for r in left} == {7, 8} and [r.text for r in left if r.doc_id == 20] == ["[secret] x"]
        assert pipeline.STAGES[-1][1](spark, docs, "").where("start = 0").count() == len(left)
