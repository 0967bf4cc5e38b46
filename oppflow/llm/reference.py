"""Mapping typed values to the entries of a reference list.

Distinct values are folded and cut to words. Each distinct word is joined to the
words of the list by edit distance: words within one edit share a string that is
left when one letter is deleted, and a word that lost two letters is what is left
when two are deleted from a long one, so an equality join on those finds all of
them. An entry is looked up by each of its weightiest words without which it
can't be met (``LOOKED_UP``) and by its longest one, none of them by a short form; each is ranked by soft
TF-IDF, the sum over its words of weight times similarity. An entry whose words
are all met (a short form counts) comes before any that is met in part; of those
one that covers more weight of the value beats those it contains. Where no entry
is met whole, the one that is met for the greatest share of its weight stands, if
this is ``PARTLY`` or more and the value has no other word.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut
from .spelling import banded_distance, fold, is_short_for

#: Words of fewer letters must be equal.
LEAST_TYPED = 4
#: Similarity of a word one edit away, and of a short form or a word that lost two letters.
TYPED, SHORT = 0.9, 0.8
#: Letters of a word from which it may have lost two of them.
LEAST_LOST = 7
#: Share of its weight for which an entry must be met; it is looked up by the weightiest words that make up more than the rest of it.
PARTLY = 0.75
LOOKED_UP = 1 - PARTLY
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Folded words of letters; single letters parted by full stops or slashes also stand joined as one word."""
    folded = fold(text)
    found = _TOKEN.findall(folded)
    for run in re.findall(r"(?<![^\W\d_])(?:[^\W\d_][./]){1,}[^\W\d_](?![^\W\d_])", folded):
        found.append(re.sub(r"\W", "", run))
    return found


def _deleted(s: str) -> list[str]:
    return [s] + [s[:i] + s[i + 1 :] for i in range(len(s))] if len(s) >= LEAST_TYPED else [s]


def _lost(word: str) -> list[str]:
    """What is left of a long word without two letters, the first one kept."""
    if len(word) < LEAST_LOST:
        return []
    return [word[:i] + word[i + 1 : j] + word[j + 1 :] for i in range(1, len(word)) for j in range(i + 1, len(word))]


def has_lost(typed: str, word: str) -> bool:
    """Whether typed is word without two letters, the first one kept."""
    return len(word) >= LEAST_LOST and len(typed) == len(word) - 2 and is_short_for(typed, word)


def _alike(typed: str, word: str) -> float:
    """How alike a typed word and one of the list are, 0 if too little."""
    if typed == word:
        return 1.0
    if min(len(typed), len(word)) >= LEAST_TYPED and banded_distance(typed, word, 1) <= 1:
        return TYPED
    return SHORT if has_lost(typed, word) else 0.0


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(s: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(tokens(x))) for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletions(s: pd.Series) -> pd.Series:
    return pd.Series([sorted(set(_deleted(x))) for x in s], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _listed(s: pd.Series) -> pd.Series:
    return pd.Series([sorted({*_deleted(x), *_lost(x)}) for x in s], dtype=object)


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_alike(x, y) for x, y in zip(a, b)])


def match_entry(value: list[str], entry: list[str], weights: dict[str, float], known: set[str]) -> tuple[float, float, float]:
    """Soft TF-IDF of the entry in the words of a value, the weight of known words of the value that it leaves over, and the share of its weight that is met.

    (0, 0, 0) if too little of it is met, or not all and the value has other words.
    """
    left, score = list(value), 0.0
    missing = []
    for w in sorted(entry, key=lambda w: -len(w)):
        if w in left:
            left.remove(w)
            score += weights[w]
            continue
        near = max(((_alike(v, w), v) for v in left if v not in known), default=(0.0, ""))
        if near[0]:
            left.remove(near[1])
            score += near[0] * weights[w]
        else:
            missing.append(w)
    lost = 0.0
    initials = sorted(w[0] for w in missing)
    together = [v for v in left if len(v) > 1 and v not in known and sorted(v) == initials]
    if together:  # one word of the first letters of all that is missing
        left.remove(together[0])
        score += sum(SHORT * weights[w] for w in missing)
        missing = []
    for w in missing:
        # letters left out of a short form, or of a word of which most is there
        short = [v for v in left if v not in known and (len(v) <= 3 or len(v) >= 0.6 * len(w)) and is_short_for(v, w)]
        if short:
            left.remove(short[0])
            score += SHORT * weights[w]
        else:
            lost += weights[w]
    whole = sum(weights[w] for w in entry)
    met = 1 - lost / whole
    if lost and (met < PARTLY or any(len(v) > 1 for v in left)):
        return 0.0, 0.0, 0.0
    return score, sum(weights[v] for v in left if v in known), met


def entry_names(entries: DataFrame, ref_id: str, names: list[Column]) -> DataFrame:
    """ref_id and words of each name of each entry; names in several words also stand joined."""
    each = entries.select(F.col(ref_id).cast("long").alias("ref_id"), F.explode(F.array_compact(F.flatten(F.array(*names)))).alias("name"))
    worded = each.select("ref_id", _tokens("name").alias("words"), F.col("name")).where("size(words) > 0")
    joined = each.select("ref_id", _joined_name("name").alias("words"), F.col("name")).where("words[0] <> ''")
    return worded.union(joined).select("ref_id", "words").distinct()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _joined_name(s: pd.Series) -> pd.Series:
    return pd.Series([["".join(t)] if len(t := _TOKEN.findall(fold(x))) > 1 else [""] for x in s], dtype=object)


def rank_entries(values: DataFrame, names: DataFrame) -> DataFrame:
    """value, ref_ids (sorted; of the best names, several at a tie or if separate names are met), for values that meet any.

    values: column value, distinct and not null; names: ref_id, words.
    """
    names = cut(names)
    worded = cut(values.select("value", _tokens("value").alias("value_words")))
    vocabulary = names.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = names.count()
    vocabulary = vocabulary.withColumn("weight", F.log(F.lit(1.0) + F.lit(float(max(total, 1))) / F.col("df")))
    typed = worded.select(F.explode("value_words").alias("typed")).distinct()
    at = lambda c: F.explode(_deletions(c)).alias("key")
    met = typed.select("typed", at("typed")).join(vocabulary.select("word", F.explode(_listed("word")).alias("key")), "key").select("typed", "word").distinct()
    repaired = met.withColumn("similarity", _similarity("typed", "word")).where("similarity > 0").select("typed", "word")
    # a name is looked up by its longest word, which nobody abbreviates, and by the weightiest ones that make up more than LOOKED_UP of it
    weighed = names.select("ref_id", "words", F.explode("words").alias("word")).join(vocabulary, "word")
    whole = weighed.groupBy("ref_id", "words").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("minus"), "word"))).alias("ws"), F.max(F.struct(F.length("word").alias("n"), "weight", "word"))["word"].alias("longest"))
    total_weight = F.aggregate("ws", F.lit(0.0), lambda acc, x: acc - x["minus"])
    ahead = lambda i: F.aggregate(F.slice("ws", F.lit(1), i), F.lit(0.0), lambda acc, x: acc - x["minus"])
    leading = F.filter("ws", lambda x, i: (i == 0) | (ahead(i) <= LOOKED_UP * total_weight))
    lead = whole.select(
        "ref_id", "words", F.map_from_entries(F.transform("ws", lambda x: F.struct(x["word"].alias("word"), (-x["minus"]).alias("weight")))).alias("weights"),
        F.explode(F.array_distinct(F.concat(F.transform(leading, lambda x: x["word"]), F.array("longest")))).alias("word"),
    )
    spoken = worded.select("value", "value_words", F.explode("value_words").alias("typed"))
    candidates = spoken.join(repaired, "typed").join(lead, "word").dropDuplicates(["value", "ref_id", "words"]).select("value", "value_words", "ref_id", "words", "weights")
    own = spoken.join(vocabulary, spoken.typed == vocabulary.word).groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("own"))

    @F.pandas_udf("score double, over double, met double, matched array<string>")
    def scored(value: pd.Series, entry: pd.Series, weights: pd.Series, own: pd.Series) -> pd.DataFrame:
        out = []
        for v, e, w, o in zip(value, entry, weights, own):
            o = dict(o) if o is not None else {}
            out.append((*match_entry(list(v), list(e), {**o, **dict(w)}, set(o)), sorted(e)))
        return pd.DataFrame(out, columns=["score", "over", "met", "matched"])

    ranked = (
        candidates.join(own, "value", "left")
        .select("value", "ref_id", scored("value_words", "words", "weights", "own").alias("s"))
        .select("value", "ref_id", "s.*")
        .where("score > 0")
    )

    @F.pandas_udf("array<long>")
    def best(options: pd.Series) -> pd.Series:
        return pd.Series([_best_of([(float(x["score"]), float(x["over"]), int(x["ref_id"]), tuple(x["matched"]), float(x["met"])) for x in o]) for o in options], dtype=object)

    # the options of a value: entries of the list of which it has a leading word
    grouped = ranked.groupBy("value").agg(F.collect_list(F.struct("score", "over", "ref_id", "matched", "met")).alias("o"))
    return grouped.select("value", best("o").alias("ref_ids"))


def _best_of(options: list[tuple[float, float, int, tuple[str, ...], float]]) -> list[int]:
    """Ids of the best names: among those that are met whole, else those that are met for the greatest share."""
    whole = [x[:4] for x in options if x[4] > 1 - 1e-9]
    if whole:
        return _best(whole)
    most = max(x[4] for x in options)
    return sorted({x[2] for x in options if most - x[4] < 1e-9})


def _best(options: list[tuple[float, float, int, tuple[str, ...]]]) -> list[int]:
    """Ids of the best names. Of names inside other met names only the larger counts; separate names leave the value unsettled."""
    options = sorted(options, key=lambda x: (-x[0], x[1], x[2]))
    top_score, top_over, _, top_words = options[0]
    if top_over > 1e-9:
        # words of the list are left over: either a second name is met, or it is a name that the list doesn't have
        rest = [x for x in options if x[0] > 0]
        return sorted({x[2] for x in rest}) if any(not set(x[3]) <= set(top_words) for x in rest) else []
    return sorted({x[2] for x in options if abs(x[0] - top_score) < 1e-9 or (len(x[3]) == len(top_words) and x[3] == top_words)})


def _blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"(?U)[\s\p{Cf}]+", ""), F.lit("")) == ""


def located(rows: DataFrame, places: DataFrame, provinces: DataFrame, key: str = "id", location: str = "location", province: str = "province") -> DataFrame:
    """key, field_name, ref_id: each non-blank location and province once a key; -1 if it means no entry, or several that the row doesn't settle.

    Places of one name are settled by the row's province where that maps to one entry. Defined cases: null and
    blank values have no row; of rows with one key and different values each value has a row, with the least ref_id
    of equal ones; an empty list maps everything to -1; an empty table gives an empty result.
    """
    typed = cut(rows.select(F.col(key).alias("_key"), F.col(location).alias("_l"), F.col(province).alias("_p")).distinct())
    province_names = entry_names(provinces, "province_id", [F.array("province_name"), F.array("abbreviation")])
    place_names = entry_names(places, "place_id", [F.array("place_name"), F.coalesce("alt_names", F.array().cast("array<string>"))])
    distinct = lambda c: typed.select(F.col(c).alias("value")).where(~_blank(F.col("value"))).distinct()
    by_province = cut(rank_entries(distinct("_p"), province_names).select(F.col("value").alias("_p"), F.when(F.size("ref_ids") == 1, F.col("ref_ids")[0]).alias("province_id")))
    by_place = cut(rank_entries(distinct("_l"), place_names).select(F.col("value").alias("_l"), "ref_ids"))
    of_place = F.explode("ref_ids")
    # Of several places the one in each province, if only one is
    pairs = by_place.where("size(ref_ids) > 1").select("_l", of_place.alias("place_id"))
    in_province = (
        pairs.join(places.select(F.col("place_id").cast("long").alias("place_id"), "province_name"), "place_id")
        .join(provinces.select(F.col("province_id").cast("long").alias("province_id"), "province_name"), "province_name")
        .groupBy("_l", "province_id")
        .agg(F.count("*").alias("_n"), F.min("place_id").alias("_only"))
        .where("_n = 1")
        .select("_l", "province_id", "_only")
    )
    single = by_place.where("size(ref_ids) = 1").select("_l", F.col("ref_ids")[0].alias("_one"))
    full = typed.join(by_province, "_p", "left").join(single, "_l", "left").join(in_province, ["_l", "province_id"], "left")
    found = full.select(
        "_key",
        F.explode(
            F.array(
                F.struct(F.lit("location").alias("field_name"), F.col("_l").alias("value"), F.coalesce("_one", "_only", F.lit(-1).cast("long")).alias("ref_id")),
                F.struct(F.lit("province").alias("field_name"), F.col("_p").alias("value"), F.coalesce("province_id", F.lit(-1).cast("long")).alias("ref_id")),
            )
        ).alias("f"),
    )
    return found.select(F.col("_key").alias(key), "f.*").where(~_blank(F.col("value"))).groupBy(key, "field_name", "value").agg(F.max("ref_id").alias("ref_id")).select(key, "field_name", "ref_id")
