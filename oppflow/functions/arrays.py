"""Ranking and checks inside one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ranked(scores: Column, order: list[str]) -> Column:
    """Array of struct(label, score) by score, the fixed order deciding ties; null scores last."""
    place = F.array(*[F.lit(x) for x in order])
    return F.array_sort(
        scores,
        lambda x, y: F.when(F.coalesce(x["score"], F.lit(-1)) != F.coalesce(y["score"], F.lit(-1)), F.coalesce(y["score"], F.lit(-1)) - F.coalesce(x["score"], F.lit(-1))).otherwise(
            F.array_position(place, x["label"]) - F.array_position(place, y["label"])
        ).cast("int"),
    )


def matches(scores: Column, order: list[str], threshold: int, most: int) -> Column:
    """The first ``most`` labels whose score reaches the threshold."""
    return F.slice(F.transform(F.filter(ranked(scores, order), lambda x: x["score"] >= threshold), lambda x: x["label"]), 1, most)


def tied_at_top(scores: Column) -> Column:
    top = F.array_max(F.transform(scores, lambda x: x["score"]))
    return F.size(F.filter(scores, lambda x: x["score"] == top))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, order and repeats apart; a null array equals only a null one."""
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def range_valid(start_year: Column, start_month: Column, end_year: Column, end_month: Column) -> Column:
    """Whether a range of partial dates isn't reversed; months count only if both are known."""
    return F.coalesce(
        (start_year < end_year) | ((start_year == end_year) & F.coalesce(start_month <= end_month, F.lit(True))), start_year.isNull() | end_year.isNull()
    )
