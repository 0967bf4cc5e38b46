"""The listing feed: scores joined to records, optional filters, a stable order, and pages.

Everything is declarative: filters written here reach the Parquet scan, and an
ordered page becomes a distributed top-k.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Filters by equality, in the order in which a saved search lists them.
EQUAL_FILTERS = ("province", "work_arrangement", "employment_relationship", "application_status")
MOST_ROWS = 100


def long_scores(df: DataFrame, keys: Sequence[str], labels: Mapping[str, str], label: str = "discipline", score: str = "score") -> DataFrame:
    """One row for each key and score column; labels: column to label."""
    return df.select(*keys, *(F.col(c).alias(name) for c, name in labels.items())).unpivot(list(keys), list(labels.values()), label, score)


def feed_matches(records: DataFrame, classified: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """Active records with a score that reaches the threshold of their classification. Inner joins; Spark broadcasts what is small."""
    return (
        scores.join(classified, key)
        .where(F.col("score") >= F.col("relevance_threshold"))
        .join(records.where(F.col("source_status") == "active"), key)
    )


def matches_text(c: Column, search: str, escape: bool = False) -> Column:
    """Case-insensitive substring; % and _ are wildcards unless escaped."""
    text = search.strip()
    if escape:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(f"%{text}%")


def filtered(df: DataFrame, filters: Mapping[str, str | None], escape: bool = False) -> DataFrame:
    """Optional filters: search (title), client (client_name), and equalities; blank ones don't filter, unknown names are an error."""
    for name, value in filters.items():
        if name not in ("search", "client", *EQUAL_FILTERS):
            raise ValueError(f"unknown filter {name}")
        if value is None or not str(value).strip():
            continue
        if name == "search":
            df = df.where(matches_text(F.col("title"), value, escape))
        elif name == "client":
            df = df.where(matches_text(F.col("client_name"), value, escape))
        else:
            df = df.where(F.col(name) == value)
    return df


def detail(df: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The rows of one key; the filter comes before anything else, so that it reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def in_feed_order(df: DataFrame, personal: bool, deadline: str = "application_deadline", key: str = "id") -> DataFrame:
    """By score (personal) and deadline, nulls of the score first and of the deadline last; the id makes the order unique."""
    first = [F.col("score").desc_nulls_first()] if personal else []
    return df.orderBy(*first, F.col(deadline).asc_nulls_last(), F.col(key).asc())


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """limit + 1 rows from the offset on; the one too many tells that there are more."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST_ROWS} and offset not negative")
    return df.offset(offset).limit(limit + 1)


def has_more(rows: DataFrame, limit: int) -> DataFrame:
    return rows.agg((F.count("*") > limit).alias("has_more"), F.least(F.count("*"), F.lit(limit)).alias("rows"))


def nested(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, columns: Sequence[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children; parents without children have an empty one.

    An array grows with its parent's children: where a parent may have very many, join the tables instead. Children
    without a parent key belong to none and are left out before the shuffle.
    """
    inside = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias(parent_key)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(inside, parent_key, "left").withColumn(name, F.coalesce(name, F.array().cast(inside.schema[name].dataType)))
