"""Documents made of keywords, tags or links instead of writing.

Neighbouring words of writing belong together; those of a keyword page don't,
whatever its words are. For each pair of neighbours the corpus gives a
normalised pointwise mutual information from the counts of the pair and of its
two words, taken without the document's own occurrences. A document whose
distinct pairs have a low mean is word salad; so is one with a higher mean that
repeats its collocations excessively and in all combinations.

Pages of the same keywords vouch for each other, the more of them there are. So
what isn't flagged is measured again by counts without the flagged texts: a text
whose mean falls by that had its evidence from keyword pages, and is one itself.

Counts are over all distinct texts, so that copies of one spam page don't
vouch for each other. Words are 64-bit hashes. Texts are dealt to blocks of about
``BLOCK_CHARS`` characters by their digest; a block counts its pairs together, so
that a row stands for a pair and a block, not for a pair and a text. The corpus
counts come back to the blocks in the same rows, and a block scores all its texts
at once. No block grows with the corpus, and no pair has more rows than there are
blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

#: Characters of the texts of a block, about; a longer text is a block of its own or more than that.
BLOCK_CHARS = 6_000_000
#: Mean information below which a text is word salad; below DOUBT it needs a word to have FEW different followers on
#: average, and below CLEAR it needs nothing else.
CLEAR, DOUBT, FEW = 0.36, 0.42, 1.4
#: A text is stuffed as well if its mean is below LOOSE, at least REPEATS of its pairs are repeats, and a word has at
#: least MANY different followers: collocations repeated in every combination, as sentences, even repeated ones, are not.
LOOSE, REPEATS, MANY = 0.64, 0.25, 1.8
#: A text is stuffed as well if its mean falls by this much, to below LOOSE, when the texts flagged before are left out of the counts.
FALL = 0.03
#: Texts of fewer pairs are never flagged.
LEAST_PAIRS = 12
#: Added to the count of a pair, so that pairs found nowhere else have a value.
SMOOTH = 0.02

_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SCORES = "_block int, _text binary, mean_npmi double, repeat_share double, n_pairs long, branches double"


def words(text: str) -> list[str]:
    """Lower-case words; the digits of a number count as one 0."""
    return _WORD.findall(_DIGITS.sub("0", _INVISIBLE.sub("", text).lower()))


def _digest(c: Column) -> Column:
    """16 bytes, as the key of a text."""
    return F.unhex(F.md5(c))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest (second column) this task hasn't met: copies are left out before the shuffle."""
    met: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column(1).to_pylist():
            keep.append(d not in met)
            met.add(d)
        if len(met) > 1_000_000:
            met.clear()
        yield batch.filter(pa.array(keep))


def blocked_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """_block, _text (digest), _t: the texts that aren't empty, those of a block in one partition; copies of a text share its block."""
    full = docs.select(_digest(F.col(text)).alias("_text"), F.col(text).alias("_t")).where("_t is not null and _t <> ''")
    chars = full.agg(F.sum(F.length("_t"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    keyed = full.select(F.pmod(F.xxhash64("_text"), F.lit(blocks)).cast("int").alias("_block"), "_text", "_t")
    return keyed.mapInArrow(_first_of_each, "_block int, _text binary, _t string").repartition(blocks, "_block")


class _Block:
    """The words of the distinct texts of a block: their codes, and the texts as numbers of these."""

    def __init__(self, digests: list[bytes], sizes: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> None:
        self.digests, self.sizes, self.flat, self.codes = digests, sizes, flat, codes

    @staticmethod
    def read(frame: pd.DataFrame) -> _Block:
        kept = frame.drop_duplicates("_text").sort_values("_text")
        local: dict[str, int] = {}
        ids: list[int] = []
        sizes: list[int] = []
        for t in kept["_t"]:
            mine = words(t)
            sizes.append(len(mine))
            ids += [local.setdefault(w, len(local)) for w in mine]
        codes = np.array([xxhash.xxh64_intdigest(w) - (1 << 63) for w in local], dtype=np.int64)
        return _Block(kept["_text"].tolist(), np.array(sizes, dtype=np.int32), np.array(ids, dtype=np.int32), codes)

    def packed(self) -> bytes:
        parts = [b"".join(self.digests), self.sizes.tobytes(), self.flat.tobytes(), self.codes.tobytes()]
        return zstandard.compress(np.array([len(x) for x in parts], dtype=np.int64).tobytes() + b"".join(parts), 6)

    @staticmethod
    def unpacked(data: bytes) -> _Block:
        raw = zstandard.decompress(data)
        ends = 32 + np.cumsum(np.frombuffer(raw, dtype=np.int64, count=4))
        d, s, f, c = (raw[x:y] for x, y in zip((32, *ends), ends))
        return _Block([d[i : i + 16] for i in range(0, len(d), 16)], np.frombuffer(s, dtype=np.int32), np.frombuffer(f, dtype=np.int32), np.frombuffer(c, dtype=np.int64))

    def pairs(self, without: set[bytes]) -> _Pairs:
        return _Pairs(self, np.array([d not in without for d in self.digests], dtype=bool))


class _Pairs:
    """The pairs of neighbouring words of the texts of a block that are kept."""

    def __init__(self, block: _Block, kept: np.ndarray) -> None:
        owner, flat = np.repeat(np.arange(len(kept)), block.sizes), block.flat.astype(np.int64)
        inside = (owner[1:] == owner[:-1]) & kept[owner[1:]]
        self.digests, self.codes, self.wide = block.digests, block.codes, max(1, len(block.codes))
        self.text, self.left, self.right = owner[:-1][inside], flat[:-1][inside], flat[1:][inside]
        self.known, self.at, self.counts = np.unique(self.left * self.wide + self.right, return_inverse=True, return_counts=True)

    def scores(self, ab: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, total: float) -> pd.DataFrame:
        """Of each text its scores. ab, of_a, of_b: corpus counts of the known pairs and of their words."""
        size, many = len(self.digests), max(1, len(self.known))
        found, n = np.unique(self.text * many + self.at, return_counts=True)
        text, at = found // many, found % many
        left, right = self.known[at] // self.wide, self.known[at] % self.wide

        def own(word: np.ndarray, of_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each text and word on that side, and how often the text has the word of each of its pairs."""
            keys, counts = np.unique(self.text * self.wide + word, return_counts=True)
            return keys, counts[np.searchsorted(keys, text * self.wide + of_pair)]

        firsts, own_a = own(self.left, left)
        _, own_b = own(self.right, right)
        seen = ab[at] - n + SMOOTH
        pmi = np.log(seen * total / ((of_a[at] - own_a + 1) * (of_b[at] - own_b + 1)))
        npmi = pmi / np.log((total + 1.0) / seen)
        pairs, all_, different = np.bincount(text, minlength=size), np.bincount(text, n, minlength=size), np.bincount(firsts // self.wide, minlength=size)
        some = np.maximum(pairs, 1)
        out = pd.DataFrame(
            {"_text": self.digests, "mean_npmi": np.bincount(text, npmi, minlength=size) / some, "repeat_share": 1 - pairs / np.maximum(all_, 1), "n_pairs": all_.astype(np.int64), "branches": pairs / np.maximum(different, 1)}
        )
        return out[pairs > 0]


def packed_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """_block, words: a row for each block, its texts cut to words once and packed; written to the shared folder."""

    def pack(block: tuple, mine: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_block": [block[0]], "words": [_Block.read(mine).packed()]})

    return cut(blocked_texts(docs, text).groupBy("_block").applyInPandas(pack, "_block int, words binary"))


def coherence(blocks: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """_block, _text (digest), mean_npmi, repeat_share, n_pairs, branches of each text of the packed blocks, by the counts of all of them.

    without: _block and _text of texts that neither count nor are scored.
    """
    by = "_block"
    if without is None:
        held = blocks.withColumn("gone", F.array().cast("array<binary>"))
    else:  # a block's texts at most
        gone = without.groupBy(by).agg(F.collect_list("_text").alias("gone"))
        held = blocks.join(gone, by, "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<binary>")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, out in zip(*(c.to_pylist() for c in batch.columns)):
                p = _Block.unpacked(data).pairs(set(out))
                columns = [np.full(len(p.known), number, dtype=np.int32), np.arange(len(p.known), dtype=np.int32), p.codes[p.known // p.wide], p.codes[p.known % p.wide], p.counts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=[by, "place", "a", "b", "n"])

    pairs = held.select(by, "words", "gone").mapInArrow(counted, "_block int, place int, a long, b long, n long")
    known = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("ab")))
    total = float(known.agg(F.sum("ab")).first()[0] or 0)
    left = known.groupBy("a").agg(F.sum("ab").alias("of_a"))
    right = known.groupBy("b").agg(F.sum("ab").alias("of_b"))
    counts = pairs.select(by, "place", "a", "b").join(known.join(left, "a").join(right, "b"), ["a", "b"]).select(by, "place", "ab", "of_a", "of_b")

    def scored(block: tuple, mine: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({c.split()[0]: [] for c in _SCORES.split(", ")})
        own = counts.sort_values("place")
        p = _Block.unpacked(mine["words"].iloc[0]).pairs(set(mine["gone"].iloc[0]))
        found = p.scores(*(own[c].to_numpy(dtype=np.float64) for c in ("ab", "of_a", "of_b")), total)
        found.insert(0, by, np.full(len(found), block[0], dtype=np.int32))
        return found

    return held.groupBy(by).cogroup(counts.groupBy(by)).applyInPandas(scored, _SCORES)


def stuffed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", clear: float = CLEAR, doubt: float = DOUBT, loose: float = LOOSE, repeats: float = REPEATS, fall: float = FALL) -> DataFrame:
    """key, mean_npmi, repeat_share, branches, stuffed: one row for each row of docs.

    Defined cases: null, empty and blank texts and those of fewer than
    LEAST_PAIRS pairs aren't stuffed (scores null where there is no pair);
    copies of a text share its scores; repeated rows come out as often; texts
    are read whole; an empty table gives an empty result.
    """
    blocks = packed_blocks(docs, text)
    few = F.col("n_pairs") < LEAST_PAIRS
    mean, branches = F.col("mean_npmi"), F.col("branches")
    salad = (mean < clear) | (mean < doubt) & (branches >= FEW)
    is_spam = salad | (mean < loose) & (F.col("repeat_share") >= repeats) & (branches >= MANY)
    scores = cut(coherence(blocks).withColumn("_first", F.coalesce(is_spam & ~few, F.lit(False))))
    others = coherence(blocks, scores.where("_first")).select("_text", F.col("mean_npmi").alias("_apart"))
    fallen = (mean - F.col("_apart") >= fall) & (F.col("_apart") < loose) & ~few
    flagged = scores.drop("_block").join(others, "_text", "left").withColumn("stuffed", F.col("_first") | F.coalesce(fallen, F.lit(False)))
    ids = docs.select(F.col(key).alias("_key"), _digest(F.col(text)).alias("_text"))
    return ids.join(flagged, "_text", "left").select(
        F.col("_key").alias(key), "mean_npmi", "repeat_share", "branches", F.coalesce("stuffed", F.lit(False)).alias("stuffed")
    )
