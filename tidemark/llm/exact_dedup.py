"""Exact deduplication by deterministic block naming.

Every text, with white space deleted, is cut into blocks of `block_chars` characters. The distinct blocks are
dealt by hash and sorted there, and a block's place among all (partition, then place in it) is its integer name. Then
adjacent names are paired, the distinct pairs are sorted and named in turn, and so on until one name is left of each document: (level, name), equal
exactly for equal texts, as each step maps distinct things to distinct numbers.

Blocks travel once, as map-side distinct values. Documents refer to them by a 128-bit key; that the key has
one block only is checked over all blocks, and with other seeds the naming starts again where it hasn't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE, cut, free_name, with_row

BLOCK_CHARS = 8192


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}+"), F.lit(0))


def _key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("h2"))


def _named(df: DataFrame, *by: str) -> DataFrame:
    """Distinct values of the columns with a unique integer each, by their order in their partition."""
    return df.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, text: str, block_chars: int = BLOCK_CHARS, key=_key) -> tuple[DataFrame, DataFrame]:
    """(rows, names): the facts of each row without its text, and each row's identity (__row, level, name)."""
    seed = 0
    while True:
        k = lambda block: key(block, seed)  # noqa: B023, E731
        plain = with_row(docs).withColumn("__norm", normalised(F.col(text)))
        rows = cut(
            plain.select(
                "__row",
                *[c for c in docs.columns if c != text],
                F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("__points"),
                F.sha2(F.col("__norm"), 256).alias("__sha"),
                F.transform(_blocks(F.col("__norm"), block_chars), k).alias("__keys"),
            ),
            "dedup-rows",
        )
        blocks = docs.select(F.explode(_blocks(normalised(F.col(text)), block_chars)).alias("block"))
        named = cut(_named(blocks, "block").select(k(F.col("block")).alias("k"), "name").select("k.h1", "k.h2", "name"), "dedup-blocks")
        if named.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
        seed += 1
    placed = rows.select("__row", F.posexplode_outer("__keys").alias("pos", "k")).select("__row", "pos", "k.h1", "k.h2")
    level = placed.join(named, ["h1", "h2"], "left").select("__row", "pos", "name")
    gathered = lambda df: df.groupBy("__row").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "name")))).getField("name").alias("names"))
    level = cut(gathered(level), "dedup-level")
    done, n = [], 0
    most = level.agg(F.max(F.size("names"))).first()[0] or 0
    while True:
        done.append(level.where(F.size("names") <= 1).select("__row", F.lit(n).alias("__level"), F.coalesce(F.get("names", F.lit(0)), F.lit(-1)).alias("__name")))
        if most <= 1:
            break
        most, n = (most + 1) // 2, n + 1
        halves = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
        pair = lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b"))
        pairs = level.where(F.size("names") > 1).select("__row", F.posexplode(F.transform(halves, pair)).alias("pos", "p")).select("__row", "pos", "p.a", "p.b")
        named = cut(_named(pairs, "a", "b"), "dedup-pairs")
        level = cut(gathered(pairs.join(named, ["a", "b"]).select("__row", "pos", "name")), "dedup-level")
    return rows, reduce(DataFrame.unionByName, done)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, key=_key) -> DataFrame:
    """One row per row of `docs`: its __row, id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and all empty texts are equal. Of equal texts the one with the most code
    points before deletion stays, then the smallest id (null after all others), then the first read, so that
    of repeated rows one stays. An empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    slim = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    rows, names = identities(slim, "__text", block_chars, key)
    found = cut(rows.drop("__keys").join(names, "__row"), "dedup-found")
    best = F.min(F.struct((-F.col("__points")).alias("p"), F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__row").alias("r")))
    groups = cut(found.groupBy("__level", "__name").agg(F.count("*").alias("group_size"), best.alias("best")), "dedup-groups")
    return found.join(groups, ["__level", "__name"]).select(
        "__row",
        F.col("__id").alias(doc_id),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("__row") == F.col("best.r")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, a table as read, that stay, with all their columns, whatever their names: by the rules of
    `exact_dedup` for nulls, ties and repeated rows. An empty table stays empty."""
    row = free_name(docs, "__row")
    kept = exact_dedup(docs, doc_id, text, **options).where("kept").select(F.col("__row").alias(row))
    return with_row(docs, row).join(kept, row, "left_semi").drop(row)


def op1_exact_dedup(spark, sf_dir):
    """Copies among all documents by their whole texts without white space."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).drop("__row")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER w AS n, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS size
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(size AS BIGINT) AS group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
