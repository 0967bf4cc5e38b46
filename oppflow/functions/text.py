"""Text functions as columns; all of them stay in the JVM except where noted.

White space is what Unicode calls so (and the separators U+001C to U+001F), not
only what a plain ``\\s`` of a regular expression finds.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WHITE = r"(?U)[\s\x1c-\x1f]"
# Fixed value: what counts as a phone number in a text.
PHONE = r"\+?\d[\d\s()./\-]{5,}\d"
#: Line ends as a text reader counts them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def collapse(c: Column) -> Column:
    """White space of any length to one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, WHITE + "+", " "))


def optional_text(c: Column) -> Column:
    """Collapsed; null if nothing is left."""
    return F.nullif(collapse(c), F.lit(""))


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(c, 256)


def clean_lines(c: Column) -> Column:
    """Lines with blanks collapsed, without empty ones and without a line equal to the one before it."""
    lines = F.transform(F.split(F.regexp_replace(c, "\u00a0", " "), LINE_END), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    seen = F.filter(lines, lambda x: x != "")
    return F.array_join(F.filter(seen, lambda x, i: (i == 0) | (x != F.get(seen, i - 1))), "\n")


def fold_case(c: Column) -> Column:
    """Lower case with sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def ordered_distinct(a: Column) -> Column:
    """Items collapsed, without blank ones, the first of each that differ by case only; null counts as blank, a null array stays null."""
    items = F.filter(F.transform(a, collapse), lambda x: x.isNotNull() & (x != ""))
    keys = F.transform(items, fold_case)
    return F.filter(items, lambda x, i: F.array_position(keys, fold_case(x)) == i + 1)


def readable_characters(c: Column) -> Column:
    """Code points that aren't white space."""
    return F.length(F.regexp_replace(c, WHITE, ""))


def without_controls(c: Column) -> Column:
    """Without the characters below the space, except line feeds."""
    return F.regexp_replace(c, r"[\x00-\x09\x0b-\x1f]", "")


def truncated(c: Column, most: int) -> tuple[Column, Column]:
    """The first ``most`` code points, and whether any were cut."""
    return F.substring(c, 1, most), F.length(c) > most


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone_supported(phone: Column, text: Column, least: int = 7) -> Column:
    """Whether the text holds a number of the same digits; false for fewer than ``least``."""
    numbers = F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))
    return (F.length(digits(phone)) >= least) & F.exists(numbers, lambda x: digits(x) == digits(phone))


def window_around(text: Column, marks: Sequence[Column], before: int, after: int, otherwise: int) -> Column:
    """From ``before`` code points ahead of the first mark found to ``after`` behind it; the first ``otherwise`` if none is."""
    low = fold_case(text)
    at = F.least(*[F.nullif(F.instr(low, fold_case(m)), F.lit(0)) for m in marks], F.lit(None).cast("int"))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at.isNull(), F.substring(text, 1, otherwise)).otherwise(F.substring(text, start, at + after - start))


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Whether the folded text holds one of the phrases."""
    folded = fold_case(c)
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(folded, p))


def contains_all(c: Column, phrases: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in phrases:
        out = out & F.contains(c, p)
    return out


def find_references(c: Column, pattern: str) -> Column:
    """All that group 1 of the pattern finds after undoing escaped slashes, the first of each kept."""
    return F.array_distinct(F.regexp_extract_all(F.replace(c, F.lit("\\/"), F.lit("/")), F.lit(pattern), F.lit(1)))


def is_number(c: Column) -> Column:
    return F.trim(c).rlike("^[0-9]+$")


def key_of(*parts: Column) -> Column:
    """SHA-256 of the trimmed parts joined by bars; null if a part is null or blank."""
    trimmed = [F.trim(p) for p in parts]
    whole = F.lit(True)
    for p in trimmed:
        whole = whole & F.coalesce(p != "", F.lit(False))
    return F.when(whole, F.sha2(F.concat_ws("|", *trimmed), 256))


def percent_encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def html_escaped(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n+"), lambda x: F.trim(x)), lambda x: x != "")


# Python is needed for Unicode normal forms and for exact JSON; both are Arrow-batched.


@F.pandas_udf(T.StringType())
def folded_nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility form, white space collapsed, case folded."""
    for s in batches:
        yield s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Keys sorted, compact, characters kept; what isn't JSON has its white space collapsed."""

    def one(x: str) -> str:
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return " ".join(x.split())

    for s in batches:
        yield s.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def merged_json(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Union of two JSON objects, the right one winning by key; values of any kind stay as they are. What is no object counts as empty."""

    def read(x: str | None) -> dict:
        try:
            value = json.loads(x) if isinstance(x, str) else None
        except ValueError:
            value = None
        return value if isinstance(value, dict) else {}

    for left, right in pairs:
        yield pd.Series([json.dumps(read(a) | read(b), ensure_ascii=False, separators=(",", ":")) for a, b in zip(left, right)], dtype=object)


@F.pandas_udf(T.StringType())
def document_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility form; blanks collapsed and lines trimmed; at most one empty line in a row."""
    import re

    def one(x: str) -> str:
        x = unicodedata.normalize("NFKC", x).replace("\u00a0", " ").replace("\r\n", "\n").replace("\r", "\n")
        lines = [re.sub(r"[ \t]+", " ", line).strip() for line in x.split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()

    for s in batches:
        yield s.map(one, na_action="ignore")


def evidence_found(evidence: Column, source: Column) -> Column:
    """Whether a non-blank snippet stands in the source, case and white space apart (JVM form; see folded_nfkc)."""
    part = fold_case(collapse(evidence))
    return F.coalesce((part != "") & F.contains(fold_case(collapse(source)), part), F.lit(False))
