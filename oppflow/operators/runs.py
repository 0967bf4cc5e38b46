"""Run ledger: roll-ups, comparison with the run before, and closing what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut
from .versions import same_key


def action_counts(df: DataFrame, by: Sequence[str], action: str = "action", kinds: Sequence[str] = ("created", "changed", "unchanged", "failed")) -> DataFrame:
    """by and the number of rows of each kind."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(action) == k).alias(k) for k in kinds))


def numbered_batches(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """df with batch_no, counted from 1 within ``by``; the order must be unique within ``by``.

    A group of any size is numbered by many tasks: rows are split to ranges of (by, order), which are written once so
    that they stay as they are, and numbered within their range from the count of the group's rows in ranges before.
    """
    if not 1 <= size <= 100:
        raise ValueError("a batch has 1 to 100 rows")
    ranges = cut(df.repartitionByRange(*[F.col(b).asc_nulls_first() for b in by], *order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range", *by).agg(F.count("*").alias("_rows"))
    ahead = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    before = counts.select("_range", *by, F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    local = F.row_number().over(W.partitionBy("_range", *by).orderBy(*order))
    numbered = same_key(ranges, before, ["_range", *by], "left").withColumn("batch_no", F.ceil((local + F.col("_ahead")) / size).cast("int"))
    return numbered.select(*df.columns, "batch_no")


def rolled_up_status(done: Column, failed: Column) -> Column:
    return F.when(failed == 0, "succeeded").when(done > 0, "partial").otherwise("failed")


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str, qualifying: Column) -> DataFrame:
    """df with the value of the last qualifying row before each; the order must be unique within ``by``."""
    held = F.when(qualifying, F.struct(F.col(value).alias("v")))
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(held, ignorenulls=True).over(w)["v"])


def closure_guard(current: Column, previous: Column, least: int = 50, ratio: str = "0.70") -> tuple[Column, Column]:
    """Whether missing rows may be closed, and the least count at which they may; exact decimals, so no rounding error moves the bound."""
    bound = F.greatest(F.lit(least), F.ceil(previous.cast("decimal(18,0)") * F.lit(ratio).cast("decimal(4,2)")).cast("long"))
    known = previous.isNotNull() & (previous >= 1)
    return F.coalesce(known & (current >= bound), F.lit(False)), F.when(known, bound)


def missing_rows(active: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of active whose key wasn't seen."""
    return active.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def work_queue(df: DataFrame, done: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows whose keys (an id and a version, say) have no row in done: a distributed top-k after the anti-join."""
    return missing_rows(df, done, keys).orderBy(*order).limit(limit)


def first_errors(df: DataFrame, by: Sequence[str], message: str, order: Sequence[str], most: int = 5) -> DataFrame:
    """by and the first messages joined; only ``most`` rows of a group are ever collected."""
    w = W.partitionBy(*by).orderBy(*order, message)
    few = df.where(F.col(message).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", message))), lambda x: x[message])
    return few.groupBy(*by).agg(F.array_join(listed, "; ").alias("errors"))
