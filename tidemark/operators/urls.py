"""Urls of the pages: masked paths, their query parameters, and templates of a prefix tree that gives up crowded places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.net import DEPTH, etld1, mask_path, mask_segment, normal_host, path_segments, query_names
from tidemark.plans.catalog import query

CHILDREN, SHARE, RARE = 40, 0.5, 2
VAR = "{var}"


def templates(rows: DataFrame, key: list[str], segments: str, depth: int = DEPTH, children: int = CHILDREN, share: float = SHARE, rare: int = RARE) -> DataFrame:
    """`rows` with `template`, the path as the tree of its `key` shows it. In the tree a literal segment seen `rare` times or
    less is {var}; where a place has more than `children` children and none holds `share` of it, all are {var}. Masks stay.
    What lies below `depth` segments is one {var}.

    The tree is read level by level: of each level only the counts of its children are shuffled and joined back, so
    that a prefix of very many rows costs one row a child."""
    found = rows.withColumn("__path", F.lit("")).withColumn("__segs", F.transform(F.slice(segments, 1, depth), mask_segment)).withColumn("__deep", F.size(segments) > depth)
    for level in range(depth):
        found = found.withColumn("__s", F.get("__segs", F.lit(level)))
        place = [*key, "__path"]
        counts = found.where("__s IS NOT NULL").groupBy(*place, "__s").agg(F.count("*").alias("__n"))
        mask = F.col("__s").startswith("{")
        shown = F.when(mask | (F.col("__n") > rare), F.col("__s")).otherwise(VAR)
        merged = counts.withColumn("__shown", shown)
        kept = merged.groupBy(*place, "__shown").agg(F.sum("__n").alias("__m"))
        crowded = kept.groupBy(*place).agg((F.count("*") > children).alias("__many"), (F.max("__m") / F.sum("__m") < share).alias("__flat")).where("__many AND __flat").select(*place, F.lit(True).alias("__all"))
        named = merged.join(crowded, place, "left").select(*place, "__s", F.when(F.col("__all"), VAR).otherwise(F.col("__shown")).alias("__t"))
        found = found.join(named, [*place, "__s"], "left").withColumn("__path", F.when(F.col("__t").isNull(), F.col("__path")).otherwise(F.concat("__path", F.lit("/"), F.col("__t")))).drop("__t")
    template = F.concat(F.col("__path"), F.when(F.col("__deep"), "/" + VAR).otherwise(F.when(F.col("__path") == "", "/").otherwise("")))
    return found.withColumn("template", template).select(*rows.columns, "template")


_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^.*?://', ''), '/.*$', '', 's'), ':[0-9]*$', '')"
_SEGMENTS = r"list_filter([split_part(x, ';', 1) for x in string_split(regexp_replace(regexp_replace(url, '[?#].*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/')], lambda x: x <> '')"
_MASKED = r"""[CASE WHEN regexp_full_match(x, '[0-9]+') THEN '{num}' WHEN regexp_full_match(x, '[0-9a-fA-F]{16,}') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-fA-F]') THEN '{hex}'
 WHEN regexp_full_match(x, '[A-Za-z0-9]{8,}') AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 3 THEN '{id}' WHEN regexp_full_match(x, '[0-9]+\.[a-z]{1,5}') THEN '{num}.' || split_part(x, '.', 2) ELSE x END for x in SEGS]""".replace("SEGS", _SEGMENTS)


@query("url_path_mask", f"""
SELECT page_id, {_HOST} AS host, '/' || array_to_string(list_slice(m, 1, 6), '/') || CASE WHEN len(m) > 6 THEN '/{{var}}' ELSE '' END AS path_template FROM (SELECT page_id, url, {_MASKED} AS m FROM pages) p""")
def url_path_mask(spark, sf_dir):
    """Host and masked path of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", normal_host(F.col("url")).alias("host"), mask_path(F.col("url")).alias("path_template"))


@query("url_query_param_names", r"""
WITH q AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages), n AS (SELECT DISTINCT page_id, split_part(p, '=', 1) AS name FROM (SELECT page_id, unnest(string_split(q, '&')) AS p FROM q) u WHERE split_part(p, '=', 1) <> '')
SELECT q.page_id, COALESCE(string_agg(name, ',' ORDER BY name), '') AS names FROM q LEFT JOIN n USING (page_id) GROUP BY q.page_id""")
def url_query_param_names(spark, sf_dir):
    """Names of the query parameters of every page."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.array_join(query_names(F.col("url")), ",").alias("names"))


_FIRST = f"""
WITH s AS (SELECT page_id, {_HOST} AS host, {_MASKED} AS m FROM pages), a AS (SELECT page_id, host, m, m[1] AS s1, COUNT(*) OVER (PARTITION BY host, m[1]) AS n1 FROM s),
b AS (SELECT *, CASE WHEN s1 IS NULL THEN '' WHEN s1 LIKE '{{%' OR n1 > 2 THEN '/' || s1 ELSE '/{{var}}' END AS p1 FROM a),
c AS (SELECT *, m[2] AS s2, COUNT(*) OVER (PARTITION BY host, p1, m[2]) AS n2 FROM b), d AS (SELECT *, p1 || CASE WHEN s2 IS NULL THEN '' WHEN s2 LIKE '{{%' OR n2 > 2 THEN '/' || s2 ELSE '/{{var}}' END AS p2 FROM c),
e AS (SELECT *, m[3] AS s3, COUNT(*) OVER (PARTITION BY host, p2, m[3]) AS n3 FROM d)
SELECT page_id, p2 || CASE WHEN s3 IS NULL THEN '' WHEN s3 LIKE '{{%' OR n3 > 2 THEN '/' || s3 ELSE '/{{var}}' END || CASE WHEN len(m) > 3 THEN '/{{var}}' WHEN len(m) = 0 THEN '/' ELSE '' END AS template FROM e"""


@query("url_prefix_templates", _FIRST)
def url_prefix_templates(spark, sf_dir):
    """Every page's path as the tree of its host shows it, three segments deep."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", normal_host(F.col("url")).alias("host"), path_segments(F.col("url")).alias("segs"))
    return templates(pages, ["host"], "segs", depth=3).select("page_id", "template")


@query("url_domain_traffic", f"""
WITH h AS (SELECT {_HOST} AS host, html FROM pages), l AS (SELECT string_split(host, '.') AS l, html FROM h)
SELECT array_to_string(list_slice(l, CASE WHEN len(l) > 2 THEN -2 ELSE 1 END, -1), '.') AS domain, COUNT(*) AS pages, CAST(SUM(length(html)) AS BIGINT) AS chars FROM l GROUP BY ALL""")
def url_domain_traffic(spark, sf_dir):
    """Pages and characters of each registrable domain."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(etld1(F.col("url")).alias("domain"), F.char_length("html").alias("n"))
    return pages.groupBy("domain").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"))
