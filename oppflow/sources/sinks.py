"""Writing results. Every sink writes to a new path; none overwrites what a query reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines without null fields; with ``by``, a folder for each value."""
    (df.write.partitionBy(by) if by else df.write).mode("errorifexists").json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("errorifexists").text(path)
