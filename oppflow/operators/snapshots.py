"""What changed between consecutive full snapshots of a table.

Both directions of EXCEPT ALL are taken in one aggregation (signed counts of
equal rows), which leaves the residues; a full join of the two residues by key
then says whether a key was added, removed or changed.

The latest delivery of each key is chosen by a partially aggregated ``max_by``,
so a key delivered millions of times is combined before it is shuffled. From
there at most one row for each export and key is left; it is partitioned once,
by key alone, and the signed counts keep that partitioning. Only the residues,
which hold what changed, are shuffled once more for the full join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: An export is one delivery of the whole table; more of them than this is taken for a wrong column.
MAX_SNAPSHOTS = 100_000

_WHITE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip_white(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, _WHITE, "")


def _held(c: Column) -> Column:
    """A null gets a value of its own, so that plain equality is enough later on."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def _free(c: Column) -> Column:
    return F.when(c != "", F.substring(c, 2, 2**31 - 1))


def consecutive_pairs(df: DataFrame, snapshot: str) -> dict[int, int]:
    """Each snapshot number and the next one that exists (numbers may have gaps)."""
    rows = df.select(F.col(snapshot).cast("long").alias("n")).where("n is not null").distinct().limit(MAX_SNAPSHOTS + 1).collect()
    if len(rows) > MAX_SNAPSHOTS:
        raise ValueError(f"{snapshot} has more than {MAX_SNAPSHOTS} values")
    numbers = sorted(r.n for r in rows)
    return dict(zip(numbers, numbers[1:]))


def except_all_both_ways(signed: DataFrame, sign: str, by: Sequence[str]) -> DataFrame:
    """``by`` and n, the surplus of each row: n > 0 is new EXCEPT ALL old, n < 0 old EXCEPT ALL new."""
    return signed.groupBy(*by).agg(F.sum(sign).alias("n")).where("n <> 0")


def snapshot_changes(
    df: DataFrame,
    snapshot: str = "snapshot_no",
    keys: Sequence[str] = ("source_id", "source_reference"),
    compared: Sequence[str] = ("content_hash", "source_status"),
    delivered: str = "delivered_at",
) -> DataFrame:
    """snapshot_no (of the later export), the keys, change_kind ('added', 'removed', 'changed').

    Defined cases:

    * keys are compared trimmed and upper case (the first key, an id, trimmed only, as it is
      returned), compared columns trimmed and lower case; null is a value of its own in either,
      distinct from an empty string; a key that is null in every column is a key like others;
    * several rows of a key in an export: the one delivered last holds, a null time counting as
      earliest; at equal times the greatest normalised values hold, so the result is stable;
    * rows repeated in full change nothing; rows without a snapshot number belong to no export;
    * the first export has no rows in the result; an empty table gives an empty result;
    * other columns, whatever their names, are not read.
    """
    first, *others = keys
    by = [f"_k{i}" for i in range(len(keys))]
    values = [f"_v{i}" for i in range(len(compared))]
    plain = df.select(
        F.col(snapshot).cast("long").alias("_s"),
        _held(strip_white(F.col(first).cast("string"))).alias(by[0]),
        *(_held(F.upper(strip_white(F.col(k).cast("string")))).alias(a) for k, a in zip(others, by[1:])),
        *(_held(F.lower(strip_white(F.col(c).cast("string")))).alias(a) for c, a in zip(compared, values)),
        F.col(delivered).alias("_at"),
    ).where("_s is not null").repartition(*by)  # every step until the join keeps this partitioning
    following = consecutive_pairs(df, snapshot)
    last = plain.groupBy("_s", *by).agg(
        F.max(F.struct(F.coalesce(F.col("_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"), *values)).alias("_m")
    )
    last = last.select("_s", *by, *(F.col(f"_m.{v}").alias(v) for v in values))
    later = set(following.values())
    numbers = df.sparkSession.createDataFrame([(n, m, n in later) for n, m in sorted({**{m: None for m in later}, **following}.items())], "_s long, _next long, _later boolean")
    placed = last.join(F.broadcast(numbers), "_s")  # MAX_SNAPSHOTS rows at most
    signed = placed.select(
        *by,
        *values,
        F.explode(
            F.array(
                F.struct(F.when(F.col("_later"), F.col("_s")).alias("pair"), F.lit(1).alias("sign")),
                F.struct(F.col("_next").alias("pair"), F.lit(-1).alias("sign")),
            )
        ).alias("_p"),
    ).select("_p.pair", "_p.sign", *by, *values).where("pair is not null")
    residue = except_all_both_ways(signed, "sign", ["pair", *by, *values])
    new = residue.where("n > 0").select("pair", *by, F.lit(1).alias("_new"))
    old = residue.where("n < 0").select("pair", *by, F.lit(1).alias("_old"))
    joined = new.join(old, ["pair", *by], "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return joined.select(
        F.col("pair").cast("int").alias(snapshot), *(_free(F.col(a)).alias(k) for k, a in zip(keys, by)), kind.alias("change_kind")
    )
