"""Matches of a pattern with their places, by Spark's own functions only.

Spark has no function that gives the places of all matches.  The matches and the
pieces between them do: the lengths summed up are the places.  Sums run in two
levels (blocks of a few hundred matches, then blocks), so that a text with very many
matches doesn't cost their square.  Lengths and places count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256
#: Characters before and after a match that count as nearby.
NEARBY = 40


def with_matches(df: DataFrame, text: str, out: str, pattern: str, guard: Column | None = None) -> DataFrame:
    """df with out: array<struct<start, end, value, before, after>>, the leftmost non-overlapping matches of pattern.

    guard: a cheap condition without which there can't be a match.  before and after
    are the nearby characters up to the neighbouring matches.  The pattern must not
    match the empty text, and must be written so that it neither backtracks far nor
    recurses (possessive quantifiers).
    """
    m, g, items, sums = f"__{out}_m", f"__{out}_g", f"__{out}_i", f"__{out}_s"
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.lit(None).cast("array<string>")
    df = df.withColumn(m, found if guard is None else F.when(guard, found).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)))
    df = df.withColumn(
        items,
        F.when(
            F.size(m) > 0,
            F.expr(
                f"transform({m}, (x, i) -> named_struct('value', x, 'gap', length(get({g}, i)), 'long', length(x), "
                f"'before', substring(get({g}, i), -{NEARBY}, {NEARBY}), 'after', substring(get({g}, i + 1), 1, {NEARBY})))"
            ),
        ),
    )
    df = df.withColumn(
        sums,
        F.when(
            F.size(m) > 0,
            F.expr(
                f"transform(sequence(0, (size({items}) - 1) div {_BLOCK}), b -> aggregate(slice({items}, cast(b * {_BLOCK} + 1 as int), {_BLOCK}), "
                "named_struct('pos', 0, 'starts', cast(array() as array<int>)), "
                "(a, x) -> named_struct('pos', a.pos + x.gap + x.long, 'starts', concat(a.starts, array(a.pos + x.gap)))))"
            ),
        ),
    )
    bases = (
        f"aggregate({sums}, named_struct('pos', 0, 'bases', cast(array() as array<int>)), "
        "(a, x) -> named_struct('pos', a.pos + x.pos, 'bases', concat(a.bases, array(a.pos)))).bases"
    )
    starts = f"flatten(zip_with({sums}, {bases}, (r, b) -> transform(r.starts, s -> s + b)))"
    spans = (
        f"zip_with({starts}, {items}, (s, x) -> named_struct('start', s, 'end', s + x.long, 'value', x.value, 'before', x.before, 'after', x.after))"
    )
    empty = "cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)"
    df = df.withColumn(out, F.expr(f"case when size({m}) > 0 then {spans} else {empty} end"))
    return df.drop(m, g, items, sums)


def listed(spans: str, kinds: list[str]) -> Column:
    """kind:start:end of sorted structs (start, kind_no, end), comma-joined; kind_no counts from 0."""
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(get({names}, x.kind_no), ':', x.start, ':', x.end)), ',')")
