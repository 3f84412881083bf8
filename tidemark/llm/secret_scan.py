"""Secret scans with built-in functions alone.

Three patterns find assignments, access keys and long hexadecimal runs. Beside them, every run of 20 or more
characters that keys are made of is a candidate: a window of `WINDOW` characters slides along it, the counts of
its characters change by one in and one out, and with them the sum of n * log2(n), from which the window's
Shannon entropy follows. A candidate whose largest entropy reaches the threshold of its character class is a
secret, unless the allow-list names the whole of it or a pattern's match covers it. Windows that touch a placeholder
word or hold a character repeated eight times don't count; the rest of their candidate does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name
from tidemark.llm.spans import SPAN, in_order, matches, shown

#: The contract's patterns, the quantifiers made possessive where nothing can follow.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Bits at least, by class: hexadecimal digits only, else the characters of base 64.
HEX_BITS, BASE64_BITS = 3.0, 3.7
#: Candidates that are no secrets as a whole: letters or digits alone, UUIDs, paths and joined words.
ALLOWED = (
    r"^[A-Za-z+/_=-]*$",
    r"^[0-9+/_=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:[a-z]{2,}|[A-Z]{2,}|[A-Z][a-z]+|[0-9]{1,4})?(?:[/_=+-]+(?:[a-z]{2,}|[A-Z]{2,}|[A-Z][a-z]+|[0-9]{1,4}))+[/_=+-]*$",
)
#: What excuses the windows that touch it, and a repeat that excuses the windows that hold it.
PLACEHOLDER = r"(?i)example|placeholder|changeme|dummy|redacted|your[_-]?"
REPEAT = r"(.)\1{7,}+"
MASK = "[secret]"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any `window` neighbouring characters (ASCII); null if shorter."""
    part = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(0.0)
    codes = F.transform(F.regexp_extract_all(value, F.lit("."), F.lit(0)), lambda c: F.ascii(c))
    begin = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("least"))

    def step(codes: Column):
        def one(a: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.get(codes, i - window)
            n, m = F.get(a["counts"], new), F.when(new == old, -1).otherwise(F.get(a["counts"], old))
            gained = part(n + 1) - part(n)
            total = F.when(old.isNull(), a["total"] + gained).when(m < 0, a["total"]).otherwise(a["total"] + gained + part(m - 1) - part(m))
            counts = F.transform(a["counts"], lambda c, k: c + (k == new).cast("int") - F.coalesce((k == old).cast("int"), F.lit(0)))
            least = F.when(i >= window - 1, F.least(a["least"], total)).otherwise(a["least"])
            return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, one, lambda a: F.log2(F.lit(float(window))) - a["least"] / window)

    return F.when(F.char_length(value) >= window, _let(codes, step))


def _judged(value: Column) -> Column:
    """The parts of a candidate whose windows count: cut at placeholders, and amid repeats so that seven are left at either side."""
    return F.split(F.regexp_replace(F.regexp_replace(value, PLACEHOLDER, " "), REPEAT, "$1" * 7 + " " + "$1" * 7), " ")


def _suspicious(value: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(value, F.lit(pattern))

    def high(part: Column) -> Column:
        bits = F.when(F.rlike(part, F.lit("^[0-9a-fA-F]+$")), HEX_BITS).otherwise(BASE64_BITS)
        return F.coalesce(window_entropy(part) >= bits, F.lit(False))

    return ~allowed & F.exists(_judged(value), high)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns by start, then kind."""
    assign = F.filter(matches(text, ASSIGN, "assign"), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    access = F.filter(matches(text, ACCESS, "access"), lambda s: F.char_length(s["value"]) >= 20)
    return in_order(F.concat(assign, access, matches(text, HEX, "hex")), KINDS)


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidates of high entropy that no base span overlaps."""
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(matches(text, CANDIDATE, "entropy"), lambda s: free(s) & _suspicious(s["value"]))


def scan(docs: DataFrame, text: str = "text", base: str = "__base", spans: str = "__spans") -> DataFrame:
    """`docs` with `base` and `spans`, arrays of kind, start, end, value; the second has the first and more. Columns
    that have these names already are an error.

    A null or empty text has no spans. Rows are looked at one by one: repeated rows and null ids are no matter,
    and an empty table gives an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    for name in (base, spans):
        if free_name(docs, name) != name:
            raise ValueError(f"there is a column {name} already")
    found = docs.withColumn(base, base_spans(whole))
    return found.withColumn(spans, in_order(F.concat(base, entropy_spans(whole, F.col(base))), KINDS))


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch that spans cover, one or more that overlap, replaced by MASK."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def one(a: Column, s: Column) -> Column:
        apart = s["start"] >= a["at"]
        more = F.when(apart, F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(MASK))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), more.alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, one, rest)).otherwise(text)


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the secrets in `text` masked, and `n_chars`, if there is such a column, made to fit.

    No row goes and no other column changes; a null text stays null. An empty table stays empty."""
    base, spans = free_name(docs, "__base"), free_name(docs, "__spans")
    found = scan(docs, text, base, spans)
    out = found.withColumn(text, masked(F.col(text), F.col(spans)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = (F.size(spans) > 0) & F.col(text).isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.char_length(text)).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def op5_secret_scan(spark, sf_dir):
    """Secrets in all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(F.col("__base")), 256).alias("base_sha256"), shown(F.col("__spans")).alias("spans"))
