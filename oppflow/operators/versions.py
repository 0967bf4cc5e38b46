"""Change detection, version numbers and merges.

A table's rows are immutable files here, so a merge gives the next state as a
DataFrame, to be written to a new path; nothing overwrites what it reads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a null key equals a null key. The keys come out once; right has no other column of left."""
    other = right.select(*(F.col(k).alias(f"_right_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"_right_{k}"])
    joined = left.join(other, on, how)
    if how in ("left_anti", "left_semi"):
        return joined
    keyed = [F.coalesce(k, f"_right_{k}").alias(k) for k in keys] if how == "full_outer" else [F.col(k) for k in keys]
    return joined.select(*keyed, *(c for c in joined.columns if c not in keys and not (c.startswith("_right_") and c[7:] in keys)))


def observed_actions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], fingerprint: Column, stored: DataFrame | None = None) -> DataFrame:
    """df with action ('created', 'changed', 'unchanged') and version_no of each observation of a key.

    Observations of one key may come in any number in one batch: each is compared with the one before it, the first
    with the stored state (keys, _fingerprint, _version). A null fingerprint is a value of its own, and so is a null
    key. Going back to an earlier content is a new version. One shuffle by the key.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    now = df.withColumn("_now", fingerprint)
    if stored is not None:
        now = same_key(now, stored.select(*keys, "_fingerprint", "_version", F.lit(True).alias("_known")), keys, "left")
    else:
        now = now.withColumns({"_fingerprint": F.lit(None).cast("string"), "_version": F.lit(0), "_known": F.lit(None).cast("boolean")})
    first = F.row_number().over(w) == 1
    before = F.when(first, F.col("_fingerprint")).otherwise(F.lag("_now").over(w))
    new = first & F.col("_known").isNull()
    out = now.withColumn("_before", before).withColumn("_new", new).withColumn("action", F.when(F.col("_new"), "created").when(F.col("_now").eqNullSafe(F.col("_before")), "unchanged").otherwise("changed"))
    step = F.sum(F.when(F.col("action") != "unchanged", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("version_no", (F.coalesce("_version", F.lit(0)) + step).cast("int")).drop("_now", "_before", "_new", "_fingerprint", "_version", "_known")


def merge_current(current: DataFrame, incoming: DataFrame, keys: Sequence[str], fingerprint: str, observed: str, keep_if_null: Sequence[str] = (), reset: dict[str, str] | None = None) -> DataFrame:
    """The next current table: one row a key, the last observation winning; ``action`` says what happened to it.

    Columns of keep_if_null keep the stored value where the incoming one is null. reset: columns set when a key is
    created or changed, kept else. Null-safe by key; of an incoming key's rows the last by ``observed`` counts.
    """
    last = last_observed(incoming, keys, [observed, fingerprint])
    columns = [c for c in current.columns if c not in keys]
    old = current.select(*keys, F.struct(*columns).alias("_old"))
    new = last.select(*keys, F.struct(*[F.col(c) if c in last.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in columns]).alias("_in"))
    both = same_key(old, new, keys, "full_outer")
    same = F.col(f"_old.{fingerprint}").eqNullSafe(F.col(f"_in.{fingerprint}"))
    action = F.when(F.col("_in").isNull(), "kept").when(F.col("_old").isNull(), "created").when(same, "unchanged").otherwise("changed")

    def value(c: str) -> Column:
        taken = F.coalesce(f"_in.{c}", f"_old.{c}") if c in keep_if_null else F.col(f"_in.{c}")
        if reset and c in reset:
            taken = F.when(F.col("action").isin("created", "changed"), F.lit(reset[c])).otherwise(F.col(f"_old.{c}"))
        return F.when(F.col("action") == "kept", F.col(f"_old.{c}")).otherwise(taken).alias(c)

    return both.withColumn("action", action).select(*keys, *(value(c) for c in columns), "action")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new, and those of old whose key isn't among them; a null key is a key like others."""
    return new.unionByName(same_key(old, new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df without the rows of the keys; a null key is a key like others."""
    return same_key(df, gone.select(*keys).distinct(), keys, "left_anti")


def updated(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of changes set where its key, null or not, has a row there (one a key)."""
    columns = [c for c in changes.columns if c not in keys]
    joined = same_key(df, changes.select(*keys, F.struct(*columns).alias("_set")), keys, "left")
    return joined.withColumns({c: F.when(F.col("_set").isNotNull(), F.col(f"_set.{c}")).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def last_observed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest by the order columns, nulls least; rows are combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in others)).select(*df.columns)


def backfilled(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """df with the values in place of nulls of their columns."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def failed(df: DataFrame, errors: DataFrame, key: str, message: str, status: str = "status", longest: int = 4000) -> DataFrame:
    """df with status 'failed' and the message, cut to ``longest`` characters, where errors has a row for the key."""
    changes = errors.select(key, F.lit("failed").alias(status), F.substring(message, 1, longest).alias(message))
    return updated(df, changes, [key])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], among: int | None = None, qualifying: Column | None = None) -> DataFrame:
    """The first row of each key in the order that qualifies; with ``among``, looked for in the first so many rows only."""
    w = W.partitionBy(*keys).orderBy(*order)
    if among is not None:
        df = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= among).drop("_n")
    if qualifying is not None:
        df = df.where(qualifying)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sole_active(df: DataFrame, owner: str, order: Sequence[Column], flag: str = "is_active") -> DataFrame:
    """df with the flag set on the first row of each owner only."""
    return df.withColumn(flag, F.row_number().over(W.partitionBy(owner).orderBy(*order)) == 1)
