"""Spans of regular expressions in whole texts, by SQL functions only.

A span is a struct (start, finish, found): code points, finish exclusive. Positions come
from what lies between matches: the n-th match starts after n+1 gaps and n matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,finish:bigint,found:string>>"


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


#: Spans are put together in blocks of so many: adding to an array copies it.
BLOCK = 512


def positions(pairs: str) -> Column:
    """Spans from a column of (found, gap): each match and what lies between it and the one before."""
    of = F.col(pairs)
    step = F.struct(F.lit(0).cast("bigint").alias("at"), no_spans().alias("spans"))

    def placed(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        finish = begin + F.length(pair["found"])
        span = F.struct(begin.cast("bigint").alias("start"), finish.cast("bigint").alias("finish"), pair["found"].alias("found"))
        return F.struct(finish.cast("bigint").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def block(done: Column, n: Column) -> Column:
        """The blocks so far and the n-th, which begins where the last one ends."""
        begin = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0).cast("bigint"))
        first = F.struct(begin.alias("at"), no_spans().alias("spans"))
        return F.concat(done, F.array(F.aggregate(F.slice(of, n * BLOCK + 1, F.lit(BLOCK)), first, placed)))

    none = F.filter(F.array(step), lambda _: F.lit(False))
    blocks = F.sequence(F.lit(0), F.ceil(F.size(of) / BLOCK).cast("int") - 1)
    return F.aggregate(blocks, none, block, lambda done: F.flatten(F.transform(done, lambda x: x["spans"])))


def with_spans(df: DataFrame, patterns: dict[str, tuple[str, Column | None]], text: str = "text") -> DataFrame:
    """df with a column of spans for each pattern: {column: (pattern, condition without which nothing can match)}.

    Texts are searched once for matches, and a second time, for the gaps, only where there are any.
    """
    kept = df.columns

    def search(pattern: str, needs: Column | None) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return found if needs is None else F.when(needs, found)

    def paired(found: Column, pattern: str) -> Column:
        gaps = F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(found))
        return F.when(F.size(F.coalesce(found, F.array())) > 0, F.arrays_zip(found.alias("found"), gaps.alias("gap")))

    searched = df.select(*kept, *[search(p, needs).alias(f"_{c}") for c, (p, needs) in patterns.items()])
    both = searched.select(*kept, *[paired(F.col(f"_{c}"), p).alias(f"_{c}") for c, (p, _) in patterns.items()])
    return both.select(*kept, *[F.when(F.col(f"_{c}").isNotNull(), positions(f"_{c}")).otherwise(no_spans()).alias(c) for c in patterns])


def listed(kinds: Sequence[str], spans: dict[str, Column]) -> Column:
    """All spans as "kind:start:finish", by start, then kind in the given order, joined by commas. No kind has a span twice."""

    def rows_of(n: int, kind: str) -> Column:
        return F.transform(spans[kind], lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["finish"].alias("finish"), F.lit(kind).alias("kind")))

    rows = F.concat(*[rows_of(n, k) for n, k in enumerate(kinds) if k in spans])
    shown = F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["finish"].cast("string")))
    return F.array_join(shown, ",")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["finish"]) & (b["start"] < a["finish"])
