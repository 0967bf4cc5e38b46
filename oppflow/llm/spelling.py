"""Folding and comparing short typed strings."""

from __future__ import annotations

import re
import unicodedata

_BROKEN = re.compile("[ÂÃâ][\u0080-¿€-™ŒœŠšŸŽžƒ]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def mend(text: str) -> str:
    """UTF-8 that was read as a single-byte code page, read right."""
    if _BROKEN.search(text):
        for page in ("cp1252", "latin-1"):
            try:
                return text.encode(page).decode("utf-8")
            except UnicodeError:
                pass
    return text


def fold(text: str) -> str:
    """Lower case without marks, invisible characters and broken encodings."""
    plain = unicodedata.normalize("NFKD", mend(_INVISIBLE.sub("", text)))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def banded_distance(a: str, b: str, k: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or k + 1 if more than k; only a band of width 2k + 1 is filled."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    if a == b:
        return 0
    far = k + 1
    two, one = None, [j if j <= k else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [far] * (len(b) + 1)
        if i <= k:
            row[0] = i
        least = row[0]
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if two is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, two[j - 2] + 1)
            row[j] = best
            least = min(least, best)
        if least > k:
            return far
        two, one = one, row
    return min(one[-1], far)


def is_short_for(short: str, word: str) -> bool:
    """Whether the letters of short stand in word in this order, the first one first."""
    letters = re.sub(r"[^\w]", "", short)
    if not letters or len(letters) >= len(word) or letters[0] != word[:1]:
        return False
    at = iter(word)
    return all(c in at for c in letters)
