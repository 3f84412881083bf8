import pytest


@pytest.fixture
def read(spark, tmp_path):
    """Rows as a table that was read: what the operators take."""

    def made(rows, schema="doc_id long, text string, lang string, source string, n_chars long", parts=2):
        width = schema.count(",") + 1
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return made


