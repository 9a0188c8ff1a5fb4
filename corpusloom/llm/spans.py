"""Regex spans with code-point positions, by SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,text:string>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find_spans(text: Column, pattern: str, maybe: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` (which must not match nothing) as SPAN; end is exclusive.

    The matches and the pieces between them have the text's length together, so running lengths give positions.
    ``maybe``: a cheap condition without which no match is possible.
    """
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("before"), found.alias("found"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["before"])
            end = start + F.length(x["found"])
            span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["found"].alias("text"))
            return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)["out"]

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))
    return found if maybe is None else F.when(maybe, found).otherwise(none)


def digest(spans: Column) -> Column:
    """``kind:start:end`` comma-joined; ``spans``: array of structs in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """Spans with kind, in a struct that sorts by start, then by the kind's rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))
