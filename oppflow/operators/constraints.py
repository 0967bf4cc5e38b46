"""Rules over rows, keys and references; rows are told apart, never dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def one_of(c: str, values: Sequence[str], nullable: bool = True) -> Column:
    ok = F.col(c).isin(*values)
    return F.coalesce(ok, F.lit(nullable))


def between(c: str, low: float, high: float) -> Column:
    return F.coalesce(F.col(c).between(low, high), F.lit(True))


def not_below(high: str, low: str) -> Column:
    return F.coalesce(F.col(high) >= F.col(low), F.lit(True))


def not_blank(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def has_form(c: str, pattern: str) -> Column:
    return F.coalesce(F.col(c).rlike(pattern), F.lit(True))


def implies(if_: Column, then: Column) -> Column:
    return ~F.coalesce(if_, F.lit(False)) | F.coalesce(then, F.lit(False))


def checked(df: DataFrame, rules: Mapping[str, Column], name: str = "violations") -> DataFrame:
    """df with the names of the broken rules, in order."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(~rule, F.lit(k)) for k, rule in rules.items()])))


def split(df: DataFrame, name: str = "violations") -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules (without the column), and the others."""
    return df.where(F.size(name) == 0).drop(name), df.where(F.size(name) > 0)


def repeated_keys(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys with several rows (of those that where selects), and how many; keys with a null are never equal."""
    rows = df if where is None else df.where(where)
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose reference has no parent; a null reference is none. Parent keys are unique, so they aren't made distinct first."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def cascaded(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child that are left when those of missing parents go."""
    return child.join(parent.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def set_null(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """child with references to missing parents made null."""
    known = parent.select(F.col(key).alias("_key"), F.lit(True).alias("_there")).distinct()
    return child.join(known, child[column] == known["_key"], "left").withColumn(column, F.when(F.col("_there"), F.col(column))).drop("_key", "_there")


def restricted(parent: DataFrame, key: str, child: DataFrame, column: str) -> DataFrame:
    """Rows of parent that must not go, as rows of child refer to them."""
    return parent.join(child.where(F.col(column).isNotNull()).select(F.col(column).alias(key)).distinct(), key, "left_semi")


def owned_by(df: DataFrame, user: str, column: str = "user_id") -> DataFrame:
    """Row-level security: the rows of one user."""
    return df.where(F.col(column) == user)
