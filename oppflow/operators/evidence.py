"""Checking claims against the text that they were taken from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import collapse, evidence_found, fold_case


def verified(claims: Column, source: Column) -> Column:
    """Struct of total, verified and missing (the claims not found, in order) of an array of claims.

    The source is folded once a row: it is bound as the variable of an outer lambda instead of being folded for each claim.
    """
    folded = F.transform(F.array(fold_case(collapse(source))), lambda s: F.filter(claims, lambda c: ~stands_in(c, s)))
    lost = F.coalesce(F.get(folded, 0), F.array().cast("array<string>"))
    total = F.when(claims.isNull(), 0).otherwise(F.size(claims))
    return F.transform(F.array(lost), lambda m: F.struct(total.alias("total"), (total - F.size(m)).alias("verified"), m.alias("missing")))[0]


def stands_in(claim: Column, folded: Column) -> Column:
    part = fold_case(collapse(claim))
    return F.coalesce((part != "") & F.contains(folded, part), F.lit(False))


def claim_issues(df: DataFrame, key: str, claims: str, source: str) -> DataFrame:
    """key, path, claim of every claim that its source doesn't hold: one row each."""
    each = df.select(key, F.col(source).alias("_source"), F.posexplode(claims).alias("pos", "claim"))
    return each.where(~evidence_found(F.col("claim"), F.col("_source"))).select(key, F.concat(F.lit(claims + "["), "pos", F.lit("]")).alias("path"), "claim")


def by_severity(issues: Column, severity: str) -> Column:
    return F.filter(issues, lambda i: i["severity"] == severity)
