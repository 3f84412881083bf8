"""Personal data by bootstrapped contextual extraction, with built-in functions alone.

Four patterns find e-mail addresses, IP addresses, card and phone numbers: the seeds. Looser patterns of the same
kinds find candidates, such as a phone number without a country code or an address with "(at)". The word before
a mention, with a mark after it if there is one, is its lexical pattern. Patterns and the values seen with them
are a graph of two sides, scored in turn for `ROUNDS` rounds: a pattern by the mean score of its distinct values
(with one value more of score 0), a value by noisy-or over its patterns; seeds are 1 throughout. Only patterns with
`SUPPORT` or more known values count. Seeds are known from the start; a candidate whose score reaches `ACCEPT` is personal
data too, known from then on, and so supports patterns that no seed came with, which find others in later rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE, cut, small_side, with_row
from tidemark.llm.spans import SPAN, in_order, matches, shown

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
ACCEPT = 0.6
SUPPORT = 3

# The contract's patterns. A match starts where the one before it ended, or where no earlier start would have
# taken the same characters, so that no run of characters is tried from each of its places; quantifiers are
# possessive where nothing that follows could take from them.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"

#: Candidates by kind, looser than the patterns above.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|@)\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[a-z0-9-]{1,63}+){0,4}+",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}+::?){2,7}+[0-9a-f]{1,4}+(?![0-9a-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20.-])[0-9]{4}(?:[.\x20-][0-9]{4,6}){2,3}+(?![.\x20-]?[0-9])",
    "phone": r"(?<![0-9+(])(?<![0-9+][\x20.-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
_CONTEXT = 48


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    backwards = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("."), F.lit(0)), lambda c: c.cast("int"))
    doubled = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four patterns, those that fail their tests dropped, by kind as listed, then by start."""
    ip = F.filter(matches(text, IP, "ip"), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.rlike(p, F.lit(_BYTE))))
    card = F.filter(matches(text, CARD, "card"), lambda s: _luhn(_digits(s["value"])))
    phone = F.filter(matches(text, PHONE, "phone"), lambda s: F.char_length(_digits(s["value"])).between(8, 15))
    return F.concat(matches(text, EMAIL, "email"), ip, card, phone)


def loose_spans(text: Column, base: Column) -> Column:
    """Candidates that no base span overlaps."""
    name = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    found = F.concat(*[matches(text, p, k) for k, p in LOOSE.items()])
    # most are base spans: those go by name, which takes no comparison of each with each
    parts = F.transform(F.array_except(name(found), name(base)), lambda n: F.split(n, ":"))
    spans = F.transform(parts, lambda p: F.struct(p[0].alias("kind"), p[1].cast("bigint").alias("start"), p[2].cast("bigint").alias("end")))
    free = F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    value = lambda s: F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.transform(free, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s).alias("value")))


def _mentions(text: Column, spans: Column, seed: bool) -> Column:
    """Spans with their value's key and their lexical pattern: the word before, lower case, and the mark after it."""

    def one(s: Column) -> Column:
        low = F.greatest(s["start"] - _CONTEXT, F.lit(0).cast("bigint"))
        before = F.lower(F.substring(text, (low + 1).cast("int"), (s["start"] - low).cast("int")))
        word = F.regexp_extract(before, r"(\p{L}++)([:=#]?)[^\p{L}\p{N}]*$", 1)
        mark = F.regexp_extract(before, r"(\p{L}++)\x20?([:=#]?)[^\p{L}\p{N}]*$", 2)
        key = F.regexp_replace(F.lower(s["value"]), SPACE, "")
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), key.alias("value"), F.concat(word, mark).alias("pattern"), F.lit(seed).alias("seed"))

    return F.transform(spans, one)


def _scores(edges: DataFrame, rounds: int, accept: float, support: int) -> DataFrame:
    """kind, value of what is known in the end. edges: kind, pattern, value, seed, once each."""
    values = cut(edges.groupBy("kind", "value").agg(F.max("seed").alias("seed")).select("*", F.col("seed").cast("double").alias("score"), F.col("seed").alias("known")), "pii-values")
    for _ in range(rounds):
        scored = edges.select("kind", "pattern", "value").join(values, ["kind", "value"])
        mean = (F.sum("score") / (F.count("*") + 1)).alias("mean")
        patterns = cut(scored.groupBy("kind", "pattern").agg(mean, F.sum(F.col("known").cast("int")).alias("of")).where(F.col("of") >= support).drop("of"), "pii-patterns")
        doubt = edges.where(~F.col("seed")).join(small_side(patterns, patterns.count()), ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("mean"), F.lit(0.999)))))).alias("fresh"))
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("fresh", F.lit(0.0)))
        values = cut(values.join(doubt, ["kind", "value"], "left").select("kind", "value", "seed", score.alias("score"), (F.col("known") | (score >= accept)).alias("known")), "pii-values")
    return values.where("known").select("kind", "value")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """__row, id, base and spans of every row of `docs`, a table as read: arrays of kind, start, end.

    A null or empty text has no spans. A candidate with a known value, a seed's too, is a span. Repeated rows are looked at one by one, but their values count once.
    Ids may be null or repeated; columns other than the two are not read. An empty table gives no rows.
    """
    slim = with_row(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    marked = slim.withColumn("b", base_spans(F.col("text")))
    marked = marked.withColumn("m", F.concat(_mentions(F.col("text"), F.col("b"), True), _mentions(F.col("text"), loose_spans(F.col("text"), F.col("b")), False)))
    facts = cut(marked.select("__row", "id", "m"), "pii-facts")
    mentions = facts.select("__row", F.explode("m").alias("m")).select("__row", "m.*")
    edges = cut(mentions.where("pattern <> ''").groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    accepted = cut(_scores(edges, rounds, accept, support), "pii-accepted")
    found = mentions.where(~F.col("seed")).join(accepted, ["kind", "value"]).groupBy("__row").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("more"))
    strip = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    base = strip(F.filter("m", lambda s: s["seed"]))
    joined = facts.join(found, "__row", "left").select("__row", F.col("id").alias(doc_id), base.alias("base"), F.coalesce("more", F.array().cast(SPAN)).alias("more"))
    return joined.select("__row", doc_id, "base", _by_kind(F.concat("base", "more")).alias("spans"))


def _by_kind(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    sorted_ = in_order(spans, KINDS)
    of = lambda kind: F.filter(sorted_, lambda s: s["kind"] == kind)
    return F.concat(*map(of, KINDS))


def op2_pii(spark, sf_dir):
    """Personal data in all documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
