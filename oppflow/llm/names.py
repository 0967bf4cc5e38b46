"""Linking the spellings of one client.

Every distinct stored value is parsed to its words (folded, without articles,
desks and departments). Links between such forms come from

* typing errors: a segment join of the words of all names (``segments``), through
  whose pairs the names are met, verified by a banded edit distance word by word;
* other orders of the words: the sorted words are the form;
* short forms: the words of a name with short words or a particle are matched with those of a
  full name that shares its rarest long word up to one edit (the same segment join);
  a short word stands for one whose letters it keeps in order, and one word may
  be a nickname if the rest decides;
* letters: a value that gives both ("Name (ABC)", "ABC - Name") defines them.

Connected components of the links are the clients.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .components import components
from .segments import one_edit, typed_pairs
from .spelling import banded_distance, fold, is_short_for, mend

# Words that name nobody, articles, and what marks a desk of a client.
NOBODY = {
    "", "onbekend", "nvt", "n v t", "niet van toepassing", "vertrouwelijk", "geheim", "anoniem", "diverse opdrachtgevers", "diverse", "divers", "opdrachtgever",
    "zie omschrijving", "nader te bepalen", "nog te bepalen", "tbd", "n t b", "ntb", "geen", "none", "null", "unknown", "nb", "n n b", "nnb", "klant", "eindklant",
    "via bemiddelaar", "wordt later bekendgemaakt", "niet bekend", "niet bekendgemaakt", "overheid", "overheidsorganisatie", "test", "meerdere opdrachtgevers", "in overleg", "xxx",
}
ARTICLES = {"de", "het", "een", "the"}
DESK = {"afd", "afdeling", "inkoop", "inhuur", "inhuurdesk", "hr", "hrm", "hro", "tav", "t.a.v", "desk", "team", "inkoopteam", "inhuurteam", "nl", "bv", "b.v", "po", "ict", "it", "inkoopdesk", "servicedesk", "personeelszaken", "flexdesk", "secretariaat", "crediteurenadministratie"}
SMALL = {"van", "der", "den", "en", "aan", "op", "ter", "ten", "te", "voor", "in", "bij", "of"}

#: Letters of a word from which one typing error may stand in it whatever it is; shorter ones have narrower rules.
LONG = 5
#: Share of a nickname's letters that the name has in the same order.
NICK = 0.7
#: Letters of a nickname at most, unless it begins as the name does: long words have letters in common by chance.
LONGEST_NICK = 6

_CAMEL = re.compile(r"(?<=[a-zà-ÿ]{3})(?=[A-ZÀ-Þ][a-zà-ÿ]{2})|(?<=[a-zà-ÿ]{3})(?=(?:Oost|West|Noord|Zuid)-)")
_DEFINED = re.compile(r"^\s*(?:(?P<long>.{6,}?)\s*\((?P<in>[A-Z]{2,8})\)|(?P<before>[A-Z]{2,8})\s*-\s*(?P<rest>.{6,}))\s*$")
_TOKEN = re.compile(r"[^\W_](?:[\w.'’]*[^\W_])?(?:\.(?=[ )]))?")


def parse_name(value: str) -> tuple[list[str], str | None]:
    """The words of a name, sorted, and the letters it defines; no words if it names nobody."""
    text = re.sub(r"\s+", " ", mend(value)).strip()
    letters = None
    if found := _DEFINED.match(text):
        long, short = found["long"] or found["rest"], found["in"] or found["before"]
        first = fold(long)
        if len(long.split()) > 1 and is_short_for(short.lower(), re.sub(r"\W", "", first)) and len(short) >= 3:
            text, letters = long, short.lower()
    text = _CAMEL.sub(" ", text)
    folded = fold(text)
    joined = re.sub(r"\W+", " ", folded).strip()
    if joined in NOBODY or " ".join(w for w in joined.split() if w not in ARTICLES) in NOBODY or not re.search(r"[^\W\d_]", folded):
        return [], None
    if re.fullmatch(r"(?:[a-z]\.){3,}[a-z]?\.?", folded.strip()):
        return [folded.replace(".", "").strip()], letters
    words = [w for w in _TOKEN.findall(folded)]
    kept = [w for i, w in enumerate(words) if w not in ARTICLES and not (w.rstrip(".") in DESK and len(words) > 1 and _is_desk(words, i, folded))]
    kept = [re.sub(r"[’']", "'", w) for w in kept] or words
    return sorted(kept), letters


def _is_desk(words: list[str], i: int, folded: str) -> bool:
    return any(len(w) > 4 and w not in DESK for w in words) or len(folded) > 12


def is_short(word: str) -> bool:
    return word not in SMALL and ("." in word or "'" in word or len(word) <= 4)


def same_but_typed(a: str, b: str) -> bool:
    """Whether two forms differ by typing errors only: at most one edit in each word of five letters or more, two words at most."""
    x, y = a.split(), b.split()
    for w in list(x):
        if w in y:
            x.remove(w)
            y.remove(w)
    if not x and not y:
        return True
    if "".join(sorted(x)) and (len(x) == len(y) <= 2):
        for p in ([0, 1], [1, 0])[: len(x)]:
            if all(min(len(x[i]), len(y[p[i]])) >= 5 and not re.search(r"\d", x[i] + y[p[i]]) and banded_distance(x[i], y[p[i]], 1) <= 1 for i in range(len(x))):
                return True
    longest = lambda ws: len(max(ws, key=len, default=""))
    # a space lost or put in, with no other change
    return abs(len(x) - len(y)) == 1 and longest(x) >= 5 and longest(y) >= 5 and sorted("".join(x)) == sorted("".join(y)) and _joined(x, y)


def _joined(x: list[str], y: list[str]) -> bool:
    from itertools import permutations

    short, long = sorted((x, y), key=len)
    return len(long) <= 3 and any("".join(p) == "".join(short) for p in permutations(long))


def common_letters(a: str, b: str) -> int:
    """Length of the longest sequence of letters that both have in this order."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def short_form_score(short: list[str], full: list[str]) -> float:
    """How well the words of short stand for all the words of full: 0 if they don't."""
    left, score, odd = list(full), 0.0, []
    for w in sorted(short, key=lambda w: (is_short(w), -len(w))):
        if w in left:
            left.remove(w)
            score += len(w)
            continue
        near = [f for f in left if len(w) >= 5 and banded_distance(w, f, 1) <= 1]
        if near:
            left.remove(near[0])
            score += len(w) - 0.5
            continue
        odd.append(w)
    names = []
    for w in odd:
        parts = [p for p in re.split(r"[.']", w) if p]
        options = [f for f in left if len(f) > len(w.replace(".", "")) and is_short_for(w, f) and (len(parts) < 2 or all(p in f for p in parts))]
        if options:
            best = max(options, key=lambda f: (sum(f.endswith(p) or f.startswith(p) for p in parts), -len(f)))
            left.remove(best)
            score += 1.0
        else:
            names.append(w)
    if len(names) > 1 or len(left) != len(names):
        return 0.0
    if names:  # a nickname for the one word that is left, if they share letters enough
        w, f = names[0], left[0]
        if len(w) < 3 or is_short(f) or common_letters(w, f) < NICK * len(w) or len(w) > LONGEST_NICK and w[:2] != f[:2]:
            return 0.0
        score += 0.2
    return score


def name_forms(values: DataFrame) -> DataFrame:
    """value, form, letters; values that name nobody are left out. values: column value, distinct and not null."""

    @F.pandas_udf("form string, letters string")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [parse_name(v) for v in batch]
            yield pd.DataFrame({"form": [" ".join(w) for w, _ in got], "letters": [x for _, x in got]}, dtype=object)

    return values.select("value", parsed("value").alias("_p")).select("value", "_p.form", "_p.letters").where("form <> ''")


def near_words(words: DataFrame) -> DataFrame:
    """a, b of the words (column s) one edit apart, both ways, and each word with itself; written once."""
    pairs = typed_pairs(words.where(F.length("s") >= LONG))
    return cut(pairs.union(pairs.select("b", "a")).union(words.select(F.col("s").alias("a"), F.col("s").alias("b"))).toDF("a", "b"))


def _typed_links(strings: DataFrame, near: DataFrame) -> DataFrame:
    @F.pandas_udf("boolean")
    def typed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_but_typed(x, y) for x, y in zip(a, b)])

    met = _word_pairs(strings, near).union(_same_letters(strings))
    return met.distinct().where(typed("a", "b")).union(_short_word_pairs(strings))


def _same_letters(strings: DataFrame) -> DataFrame:
    """Pairs of forms of the same letters: those with a space lost or put in, in any order of their words."""
    keyed = strings.select("s", F.array_join(F.array_sort(F.split(F.regexp_replace("s", " ", ""), "")), "").alias("letters"))
    return keyed.withColumnRenamed("s", "a").join(keyed.withColumnRenamed("s", "b"), "letters").where("a < b").select("a", "b")


def _word_pairs(strings: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of forms of as many words that differ in one or two long words, by one edit in each.

    The words of all forms are joined by segments; forms are met at their other words and the near ones.
    So the pairs depend neither on the order of the words nor on how many names share a word.
    """
    near = near.where(F.length("a") >= LONG)
    second = near.union(near.sparkSession.createDataFrame([("", "")], "a string, b string"))

    @F.pandas_udf("array<struct<rest:string,x:string,y:string>>")
    def without(s: pd.Series) -> pd.Series:
        return pd.Series([_without(x) for x in s], dtype=object)

    open_ = cut(strings.select(F.col("s").alias("form"), F.explode(without("s")).alias("w")).select("form", "w.*"))
    left = open_.join(near.select(F.col("a").alias("x"), F.col("b").alias("x2")), "x").join(second.select(F.col("a").alias("y"), F.col("b").alias("y2")), "y")
    # two words differ, or the one: that neither does is in no need of a pair
    left = left.where("x <> x2 and (y = '' or y <> y2)")
    left = left.select("rest", F.greatest("x2", "y2").alias("x"), F.least("x2", "y2").alias("y"), F.col("form").alias("a")).distinct()
    return left.join(open_.withColumnRenamed("form", "b"), ["rest", "x", "y"]).where("a < b").select("a", "b")


def _short_word_pairs(strings: DataFrame) -> DataFrame:
    """Pairs of forms that are equal but for one edit in one short word, their other words having LONG letters or more together.

    Forms are met at their other words and what is left of the short one without a letter, which is exact. As short
    words are often one edit apart and not the same, the first letter must agree and one of the two words must stand
    in no other form, or the edit be a swap.
    """
    words = strings.select("s", F.split("s", " ").alias("w"))
    each = words.select("s", "w", F.explode(F.array_distinct("w")).alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("forms"))
    short = each.where(F.length("word").between(3, LONG - 1) & ~F.col("word").rlike(r"[\d.']"))
    short = short.select("s", "word", F.array_join(F.array_remove("w", F.col("word")), " ").alias("rest")).where(F.length(F.regexp_replace("rest", " ", "")) >= LONG)
    short = short.join(often, "word")
    without = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.lit(LONG))))
    keyed = short.select("s", "word", "rest", "forms", F.explode(F.array_distinct(F.concat(F.array("word"), without))).alias("key"))
    a, b = (keyed.select("rest", "key", *(F.col(c).alias(f"{c}_{side}") for c in ("s", "word", "forms"))) for side in "ab")
    met = a.join(b, ["rest", "key"]).where("s_a < s_b and word_a <> word_b").drop("key").distinct()
    swap = (F.length("word_a") == F.length("word_b")) & (F.levenshtein("word_a", "word_b") == 2)
    fits = swap | (F.least("forms_a", "forms_b") == 1) & (F.left("word_a", F.lit(1)) == F.left("word_b", F.lit(1)))
    return met.where(one_edit(F.col("word_a"), F.col("word_b")) & fits).select(F.col("s_a").alias("a"), F.col("s_b").alias("b"))


def _without(form: str) -> list[tuple[str, str, str]]:
    """Of each long word and each two of a form: the other words, the greater one and the other (empty if it is one)."""
    words = form.split()
    long = [i for i, w in enumerate(words) if len(w) >= LONG]
    out = {(" ".join(words[:i] + words[i + 1 :]), words[i], "") for i in long}
    for k, i in enumerate(long):
        for j in long[k + 1 :]:
            y, x = sorted((words[i], words[j]))
            out.add((" ".join(w for n, w in enumerate(words) if n not in (i, j)), x, y))
    return sorted(out)


def _short_links(forms: DataFrame, words: DataFrame, near: DataFrame) -> DataFrame:
    """Each form with short words and the full form that it fits best.

    Full forms are looked up by the rarest long word of the short one that is longer than a nickname; as a longer one
    may still be a nickname, also by the next such word together with how the first one begins. A word is as rare as
    the most frequent word within one edit, so that typing errors of a common word are common. Without such words
    the rarest long word decides, or the longest one.
    """
    @F.pandas_udf("boolean")
    def has_short(s: pd.Series) -> pd.Series:
        return pd.Series([" " in x and any(is_short(w) or w in SMALL for w in x.split()) for x in s])

    @F.pandas_udf("double")
    def fit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([short_form_score(x.split(), y.split()) for x, y in zip(a, b)])

    often = words.groupBy("word").agg(F.count("*").alias("forms"))
    rarity = near.join(often, near.b == often.word).groupBy("a").agg(F.max("forms").alias("common")).withColumnRenamed("a", "word")
    short = cut(forms.select("form").where(has_short("form")))
    plain = ~F.col("word").rlike("[.']")
    own = words.join(short, "form", "left_semi").where(plain & (F.length("word") >= 3)).join(rarity, "word")
    is_long = F.length("word") >= LONG
    rank = F.struct((F.length("word") <= LONGEST_NICK).alias("nick"), F.col("common"), (-F.length("word")).alias("n"), "word")
    ranked = own.groupBy("form").agg(F.array_sort(F.collect_list(F.when(is_long, rank))).alias("long"), F.min(F.struct((-F.length("word")).alias("n"), "word"))["word"].alias("longest"))
    one = near.select(F.col("a").alias("stem"), F.col("b").alias("word"))
    full = words.select(F.col("form").alias("b"), F.col("n").alias("n_b"), "word")
    first = ranked.select(F.col("form").alias("a"), F.coalesce(F.get(F.col("long")["word"], F.lit(0)), "longest").alias("stem"))
    next_ = ranked.where(F.size("long") >= 2).select(F.col("form").alias("a"), F.col("long")[1]["word"].alias("stem"), F.left(F.col("long")[0]["word"], F.lit(2)).alias("begins"))
    begun = forms.select(F.col("form").alias("b"), F.explode(F.array_distinct(F.transform(F.split("form", " "), lambda w: F.left(w, F.lit(2))))).alias("begins"))
    met = first.join(one, "stem").join(full, "word").select("a", "b", "n_b")
    met = met.union(next_.join(one, "stem").join(full.join(begun, "b"), ["word", "begins"]).select("a", "b", "n_b"))
    scored = met.where("a <> b and length(b) > length(a)").distinct().withColumn("fit", fit("a", "b")).where("fit > 0")
    best = scored.groupBy("a").agg(F.max(F.struct("fit", "n_b", "b")).alias("m"))
    return best.select("a", F.col("m.b").alias("b"))


def client_names(df: DataFrame, name: str = "client_name") -> DataFrame:
    """value (as stored) and client (the least form of the client's), one row for each distinct value that names someone.

    Defined cases: null, empty and blank values and those that say that nobody is named have no row; values
    are told apart exactly as stored, so rows repeated alike count once; an empty table has an empty result.
    """
    values = df.select(F.col(name).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    parsed = cut(name_forms(values.select("value")).join(values, "value"))
    forms = cut(parsed.groupBy("form").agg(F.sum("n").alias("n")))
    defined = parsed.where("letters is not null").select(F.col("letters").alias("a"), F.col("form").alias("b"))
    spelled = forms.select("form").join(defined.select(F.col("a").alias("form")).distinct(), "form", "left_semi").select(F.col("form").alias("a")).join(defined, "a")
    words = forms.select("form", "n", F.explode(F.array_distinct(F.split("form", " "))).alias("word"))
    near = near_words(words.select(F.col("word").alias("s")).distinct())
    strings = forms.select(F.col("form").alias("s"))
    edges = _typed_links(strings, near).union(_short_links(forms, words, near)).union(spelled).union(_defined_alike(defined))
    clients = components(forms.select(F.col("form").alias("node")), edges)
    return parsed.join(clients, parsed.form == clients.node).select("value", F.col("component").alias("client"))


def _defined_alike(defined: DataFrame) -> DataFrame:
    """Forms that define the same letters, each with the first of them."""
    first = defined.groupBy("a").agg(F.min("b").alias("c"))
    return defined.join(first, "a").where("b <> c").select(F.col("b").alias("a"), F.col("c").alias("b")).distinct()


def linked_pairs(df: DataFrame, name: str = "client_name") -> DataFrame:
    """name_a < name_b by code points: the pairs of different stored values of one client."""
    clients = cut(client_names(df, name))
    a = clients.select(F.col("value").alias("name_a"), "client")
    b = clients.select(F.col("value").alias("name_b"), "client")
    return a.join(b, "client").where("name_a < name_b").select("name_a", "name_b")
