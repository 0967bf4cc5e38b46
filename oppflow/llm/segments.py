"""Pairs of strings within k edits, by the pigeonhole principle.

A string of length n is cut into k + 1 segments; k edits leave one of them
whole, and moved by at most k places. So the segments go into an inverted index
under (length, number, segment), and every string looks up its substrings at
the shifted positions, for the k lengths below and above its own. Pairs that
meet are verified by a banded edit distance. No pair within k edits is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def cuts(n: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the k + 1 segments of a string of length n."""
    at = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def index_keys(s: str, k: int) -> list[str]:
    n = len(s)
    return [f"{n}:{i}:{s[a : a + m]}" for i, (a, m) in enumerate(cuts(n, k))]


def probe_keys(s: str, k: int, longer_only: bool) -> list[str]:
    """Keys at which the partners of s are found; longer_only: partners at least as long (a pair is then met from its shorter side)."""
    out = []
    for n in range(len(s) if longer_only else max(1, len(s) - k), len(s) + k + 1):
        shift = n - len(s)
        for i, (a, m) in enumerate(cuts(n, k)):
            # i edits at most on the left of segment i, and k - i on its right, or the pair is met at another segment
            low = max(0, a - i, a - shift - (k - i))
            high = min(len(s) - m, a + i, a - shift + (k - i))
            out += {f"{n}:{i}:{s[p : p + m]}" for p in range(low, high + 1)}
    return out


def _keyed(strings: DataFrame, keys) -> DataFrame:
    @F.pandas_udf("array<string>")
    def made(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in s:
            yield pd.Series([keys(x) for x in batch], dtype=object)

    return strings.select("s", F.explode(made("s")).alias("key"))


def segment_pairs(strings: DataFrame, k: int, against: DataFrame | None = None) -> DataFrame:
    """a, b, edits of the pairs within k edits (Levenshtein): a < b of strings, or a of strings and b of against.

    strings, against: column s, distinct and not null; strings of at most k characters are in no pair.
    A swap of neighbours counts as two edits here.
    """
    fit = F.length("s") > k
    within = against is None
    probe = _keyed(strings.where(fit), lambda s: probe_keys(s, k, within))
    index = _keyed((strings if against is None else against).where(fit), lambda s: index_keys(s, k))
    met = probe.withColumnRenamed("s", "a").join(index.withColumnRenamed("s", "b"), "key").drop("key")
    if against is None:
        met = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.distinct().withColumn("edits", F.levenshtein("a", "b", k)).where("edits >= 0")


def typed_pairs(strings: DataFrame) -> DataFrame:
    """a < b of the strings that are one edit apart, a swap of neighbours being one; strings of fewer than two letters are in no pair.

    Two segments, of which one edit leaves one whole, moved by the difference of the lengths. A swap across the cut
    touches both, so each string looks up itself with the letters at the cut swapped as well. strings: column s, distinct.
    """
    n, s = F.length("s"), F.col("s")

    def key(size: Column, number: int, segment: Column) -> Column:
        return F.concat_ws(":", size.cast("string"), F.lit(number).cast("string"), segment)

    def part(start: Column | int, length: Column | int) -> Column:
        return F.substring(s, start, length)

    half, next_half = F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")
    rest = F.lit(1 << 20)
    own = [key(n, 0, part(F.lit(1), half)), key(n, 1, part(half + 1, rest))]
    longer = [key(n + 1, 0, part(F.lit(1), next_half)), key(n + 1, 1, part(next_half, rest))]
    swapped = [key(n, 0, F.concat(part(F.lit(1), half - 1), part(half + 1, F.lit(1)))), key(n, 1, F.concat(part(half, F.lit(1)), part(half + 2, rest)))]
    fit = strings.where(n >= 2)
    index = fit.select(s.alias("b"), F.explode(F.array(*own)).alias("key"))
    probe = fit.select(s.alias("a"), F.explode(F.array(*own, *longer, *swapped)).alias("key"))
    met = probe.join(index, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.where(one_edit(F.col("a"), F.col("b")))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two strings are one edit apart or equal, a swap of neighbours being one edit."""
    near = F.levenshtein(a, b, 2)
    turned = lambda i: F.concat(F.substring(b, F.lit(1), i - 1), F.substring(b, i + 1, F.lit(1)), F.substring(b, i, F.lit(1)), F.substring(b, i + 2, F.lit(1 << 20)))
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(b) - 1, F.lit(1))), lambda i: turned(i) == a)
    return F.when(near < 0, False).when(near <= 1, True).otherwise((F.length(a) == F.length(b)) & swap)
