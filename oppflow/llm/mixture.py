"""Mixing sources to target shares of the total size in tokens.

1. Every document of a target source gets its size. Documents fall into hash
   buckets within each source; neighbouring buckets are joined to blocks of about
   equal size, by prefix sums of the buckets of a source.
2. The total is the largest one at which every source that has documents can
   give its share with no document used more than max_repeats times (or the
   total asked for). A source's quota is whole passes over its blocks and part
   of one more, whose blocks come in a random order; the one block at which
   that part ends is cut at the document nearest the quota, by a running sum
   within one of its buckets.
3. A splitting tree over the output shards divides each source's block quota:
   at each node the numbers that go left are one draw from the multivariate
   hypergeometric distribution, so all quotas come out exactly and the shards
   are as mixed as if all blocks had been shuffled together.
4. The block uses of a source stand in a random order; each shard takes the
   next ones, so shards are disjoint. The order within a shard is a hash sort.

All of this is computed in Spark; only the number of block uses of each target
reaches the driver, which draws the tree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut
from .bpe import count_ids

#: Hash buckets of a source: at least BUCKETS, about a thousand documents a bucket, and at most MOST_BUCKETS, whose sums one task adds up.
BUCKETS, DOCUMENTS_A_BUCKET, MOST_BUCKETS = 1024, 1000, 1_000_000
SHARD_TOKENS = 4_000_000
LEAST_SHARDS = 8
BLOCKS_A_SHARD = 16


def bucket_of(source: Column, key: Column, seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), source, key), F.lit(buckets)).cast("int")


def buckets_for(documents: int) -> int:
    """Buckets of each source, by the documents of the largest one."""
    return max(BUCKETS, min(-(-documents // DOCUMENTS_A_BUCKET), MOST_BUCKETS))


def checked_targets(targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats: of repeated sources the one with the largest share; shares and repeats that are null or not positive are 0."""
    least = lambda c, kind: F.greatest(F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)), F.lit(0).cast(kind)).alias(c)
    rows = targets.where("source is not null").select("source", F.struct(least("target_share", "double"), least("max_repeats", "int")).alias("t"))
    return rows.groupBy("source").agg(F.max("t").alias("t")).select("source", "t.*")


def sized_documents(docs: DataFrame, wanted: DataFrame, key: str, text: str, source: str, path: str | None) -> DataFrame:
    """_key, source, n_tokens of the documents of the sources, written to the shared folder as the sizes are used twice."""
    own = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), F.col(text).alias("_t")).join(wanted.select("source"), "source", "left_semi")
    return cut(own.select("_key", "source", count_ids(F.col("_t"), path).alias("n_tokens")))


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources numbers of blocks; rows differ by one block at most in their sums, columns sum to the quotas."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = int(sum(quotas))

    def split(first: int, n: int, left: np.ndarray) -> None:
        if n == 1:
            out[first] = left
            return
        half = n // 2
        at = lambda k: total * k // shards
        draw = np.random.default_rng(np.random.SeedSequence([seed, first, n])).multivariate_hypergeometric(left, at(first + half) - at(first), method="marginals")
        split(first, half, draw)
        split(first + half, n - half, left - draw)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def source_quotas(wanted: DataFrame, sums: DataFrame, total: int | None) -> DataFrame:
    """source, size, max_repeats, quota (tokens) of the sources that can give any. sums: source, bucket, tokens."""
    sizes = sums.groupBy("source").agg(F.sum("tokens").alias("size"))
    able = cut(wanted.join(sizes, "source").where("target_share > 0 and max_repeats > 0 and size > 0"))
    whole_share = able.agg(F.sum("target_share")).first()[0] or 1.0
    share = F.col("target_share") / F.lit(whole_share)
    most = able.agg(F.min(F.col("size") * F.col("max_repeats") / share)).first()[0] or 0.0
    quota = F.least(F.floor(share * F.lit(float(most if total is None else total))), F.col("size") * F.col("max_repeats"))
    return able.select("source", "size", "max_repeats", quota.cast("long").alias("quota"))


def block_uses(blocks: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """source, block, repeat_no, left (tokens of the block that are used, null if all), use_no (from 0 in a random order).

    blocks: source, block, tokens.
    """
    full = F.least(F.floor(F.col("quota") / F.col("size")), F.col("max_repeats")).cast("int")
    each = blocks.join(quotas.select("source", "max_repeats", full.alias("full"), (F.col("quota") - full * F.col("size")).alias("rest")), "source")
    whole = each.where("full > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("repeat_no"), F.lit(None).cast("long").alias("left"))
    once_more = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 3), "source", "block"), "block").rowsBetween(W.unboundedPreceding, -1)
    last = each.where("rest > 0 and full < max_repeats").withColumn("_before", F.coalesce(F.sum("tokens").over(once_more), F.lit(0))).where("_before < rest")
    left = F.when(F.col("tokens") > F.col("rest") - F.col("_before"), F.col("rest") - F.col("_before"))
    uses = whole.union(last.select("source", "block", (F.col("full") + 1).alias("repeat_no"), left.alias("left")))
    order = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 4), "source", "repeat_no", "block"), "repeat_no", "block")
    return cut(uses.withColumn("use_no", F.row_number().over(order) - 1))


def shards_of_uses(uses: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, use_no, shard by the splitting tree. The driver holds a number for each source and shard."""
    counts = sorted((r.source, r.n) for r in uses.groupBy("source").agg(F.count("*").alias("n")).collect())  # a row for each target
    if not counts:
        return uses.select("source", "use_no", F.lit(0).alias("shard")).limit(0)
    given = split_quotas([n for _, n in counts], shards, seed)
    rows = [(source, [int(n) for n in given[:, k]], [int(n) for n in np.cumsum(given[:, k]) - given[:, k]]) for k, (source, _) in enumerate(counts)]
    drawn = uses.sparkSession.createDataFrame(rows, "source string, n array<long>, first array<long>")
    each = drawn.select("source", F.posexplode(F.arrays_zip("n", "first")).alias("shard", "_p")).where("_p.n > 0")
    return each.select("source", F.explode(F.sequence(F.col("_p.first").cast("int"), (F.col("_p.first") + F.col("_p.n") - 1).cast("int"))).alias("use_no"), "shard")


def mix(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total: int | None = None,
    shards: int | None = None,
    seed: int = 7,
    path: str | None = None,
) -> DataFrame:
    """key, source, repeat_no (from 1), n_tokens, shard, position: one row for each use of a document.

    Defined cases: sources without a target, null sources and targets without
    documents give no rows (the shares of the latter go to the others in
    proportion; ``mixture_shares`` reports them); documents of no tokens are
    used with their bucket; rows with the same key are documents of their own;
    a quota that can't be met at max_repeats is met as far as that goes; an
    empty table of either kind gives an empty result.
    """
    wanted = cut(checked_targets(targets))
    sized = sized_documents(docs, wanted, key, text, source, path)
    largest = sized.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sized = sized.withColumn("bucket", bucket_of(F.col("source"), F.col("_key"), seed, buckets_for(largest)))
    sums = cut(sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")))
    quotas = source_quotas(wanted, sums, total)
    whole, filled = quotas.agg(F.sum("quota")).first()[0] or 0, sums.join(quotas, "source", "left_semi").count()
    # no more shards than there are blocks for
    shards = shards or max(LEAST_SHARDS, min(math.ceil(whole / SHARD_TOKENS), filled // BLOCKS_A_SHARD))
    aim = max(1, whole // (shards * BLOCKS_A_SHARD))
    so_far = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    in_blocks = sums.withColumn("block", F.floor(F.coalesce(F.sum("tokens").over(so_far), F.lit(0)) / F.lit(aim)))
    uses = block_uses(in_blocks.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), quotas, seed)
    placed = uses.join(shards_of_uses(uses, shards, seed), ["source", "use_no"])
    ahead = W.partitionBy("source", "block").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = in_blocks.withColumn("_ahead", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))).join(placed, ["source", "block"])
    still = F.col("left") - F.col("_ahead")
    parts = parts.where("left is null or left > _ahead").select("source", "bucket", "repeat_no", "shard", F.when(F.col("tokens") > still, still).alias("cut_tokens"))
    drawn = sized.join(parts, ["source", "bucket"])
    in_block = W.partitionBy("source", "bucket", "repeat_no", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "_key")
    # Only the buckets in which a quota ends are windowed, one of each source.
    ended = drawn.where("cut_tokens is not null").withColumn("_to", F.sum("n_tokens").over(in_block)).where("_to - n_tokens / 2 <= cut_tokens").drop("_to")
    kept = drawn.where("cut_tokens is null").unionByName(ended)
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "_key", "repeat_no"), "_key", "repeat_no")
    return kept.select(
        F.col("_key").alias(key), F.col("source"), "repeat_no", "n_tokens", "shard", F.row_number().over(order).alias("position")
    )


def mixture_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, uses, most_repeats, largest (tokens of the largest document used): one row for each target."""
    got = cut(mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.max("repeat_no").alias("most_repeats"), F.max("n_tokens").alias("largest")))
    whole = got.agg(F.sum("tokens")).first()[0] or 1
    return checked_targets(targets).join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.col("tokens") / F.lit(whole), F.lit(0.0)).alias("actual_share"), F.coalesce("largest", F.lit(0)).alias("largest"),
    )


def share_bounds(shares: DataFrame, documents: DataFrame, source: str = "source") -> DataFrame:
    """source, target_share, max_repeats, within_cap, reached: whether the tokens are those due among the targets with documents.

    A quota ends within a document, so a source is off by one of its documents at most, and the sum by one of each source.
    """
    there = documents.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.lit(True).alias("_there")).distinct()
    able = cut(shares.join(there, "source", "left").withColumn("_able", F.coalesce("_there", F.lit(False)) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)))
    asked, whole, rounding = able.agg(F.sum(F.when(F.col("_able"), F.col("target_share"))), F.sum("tokens"), F.sum("largest")).first()
    due = F.when(F.col("_able"), F.col("target_share") / F.lit(asked or 1.0)).otherwise(F.lit(0.0))
    off = F.abs(F.col("tokens") - due * F.lit(whole or 0))
    return able.select("source", "target_share", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), (off <= F.col("largest") + due * F.lit(rounding or 0)).alias("reached"))
