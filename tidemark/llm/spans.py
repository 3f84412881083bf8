"""Places of regular-expression matches in texts, by built-in functions alone.

A pattern's matches and the pieces between them come from one extraction and one split; their lengths, summed,
are the places. Sums are taken over blocks of `_BLOCK`, so that a text of very many matches costs little more
than their number. Places count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128

SPAN = "array<struct<kind: string, start: bigint, end: bigint, value: string>>"


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _before(lengths: Column, parts: Column, i: Column) -> Column:
    """The sum of the first i lengths, given the sums of whole blocks before each block."""
    k = F.floor(i / _BLOCK).cast("int")
    return F.get(parts, k) + _sum(F.slice(lengths, k * _BLOCK + 1, i - k * _BLOCK))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost matches that do not overlap, in order, as SPAN. No text may be null; a pattern matches no
    empty string, and looks at most at what is around the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(every: Column, between: Column) -> Column:
        # lengths of a piece and the match after it
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(every)), every, lambda p, m: (F.char_length(p) + F.char_length(m)).cast("bigint"))
        return _let(steps, lambda lengths: _let(_blocks(lengths), lambda parts: F.transform(every, lambda m, i: _span(kind, _before(lengths, parts, i + 1) - F.char_length(m), m))))

    empty = F.array().cast(SPAN)
    return F.when(F.rlike(text, F.lit(pattern)), _let(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("s")), lambda x: placed(x["m"], x["s"]))).otherwise(empty)


def _span(kind: str, start: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"))


def _blocks(lengths: Column) -> Column:
    """Sums of all lengths before each block."""
    n = F.floor(F.size(lengths) / _BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), n), lambda k: _sum(F.slice(lengths, k * _BLOCK + 1, _BLOCK)))
    return _let(sums, lambda s: F.transform(s, lambda x, k: _sum(F.slice(s, 1, k))))


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shown(spans: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans by start, then by kind as listed."""
    rank = lambda kind: F.array_position(F.array(*[F.lit(k) for k in kinds]), kind)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s["kind"]).alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])
