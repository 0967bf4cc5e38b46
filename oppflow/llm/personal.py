"""Finding personal data in texts and putting typed placeholders in their place.

A text is cut to tokens (words, initials, numbers, addresses with an at sign); a
skip-chain conditional random field (``skipchain``) labels them, and the items
are the labelled spans. A token says what it looks like (how many digits, which
signs), never what it is; mark-up stands as a break before the next token, so
that the name of a field speaks to its value. Words that read the same or nearly
so in a document share potentials, so a name that is clear in one place is found
in another.

Every stretch of every text is scored. A skip edge is left out only where it can
change nothing: potentials only reward agreement, so an edge whose ends both have
the same kind of label with a probability of ``SURE`` by the chains alone could
but confirm it.

No text is labelled. The field is fitted to at most ``TRAIN_TEXTS`` texts of each
table, labelled weakly (``weak_spans``): by the contact data that the structured
records of pages hold, and by the forms of addresses, numbers and names. What the
weak labels can't know it learns from copies of these texts (``varied``): names
that it has never seen, surnames after a title alone, and surnames that recur
without anything beside them, misspelled or not, in the same document.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field as data_field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import skipchain
from .spelling import banded_distance, fold

#: Texts of each table that the field is fitted to, at most.
TRAIN_TEXTS = 900
#: Pieces of one wording (rare capitalised words apart) that the field is fitted to, at most: with items, without.
ALIKE, ALIKE_WITHOUT = 24, 120
#: Capitalised words that stand in the sample this often are words of that wording.
OFTEN = 12
#: Chains with items that the field is fitted to, and chains without, at most.
WITH_ITEMS, WITHOUT = 4000, 7000
#: Probability from which the kind of a label is sure by its chain alone.
SURE = 0.99
#: Tokens of the name of a field at most.
FIELD_NAME = 3
#: Letters of words that skip edges join: equal words, and words one edit apart.
LINKED, LINKED_TYPED = 3, 5
#: Stretches that a worker remembers, if they are short, before it forgets them all (about 100 MB).
REMEMBERED = 200_000
KINDS = ("email", "phone", "id_number", "address", "person_name")
LABELS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
#: Marks of a token's type: mark-up, or the end of a line, stands before it.
BREAK, LINE = "\x1e", "\x1f"

# Particles and titles of names, ends of street names, words before them, words of organisations.
PARTICLES = {"van", "de", "der", "den", "ter", "ten", "te", "het", "'t", "von", "du", "la", "le", "el", "al", "op", "in"}
TITLES = {"heer", "mevrouw", "mevr", "mw", "dhr", "drs", "dr", "ir", "ing", "mr", "prof", "collega", "teamleider", "hr", "msc", "bsc", "mrs", "ms", "herr", "frau", "monsieur", "madame"}
STREET = re.compile(r"(?:straat|laan|weg|dreef|pad|kade|gracht|singel|hof|plein|steeg|dijk|plantsoen|boulevard|park|ring|markt|wal|baan|erf|burg)$", re.I)
STREET_TITLES = {"burg", "dr", "mr", "prof", "ds", "pres", "burgemeester", "st", "ir", "jhr"}
STREET_FIRST = {"oude", "nieuwe", "lange", "korte", "grote", "kleine", "eerste", "tweede", "noorder", "zuider", "ooster", "wester", "hoge", "lage", "achter"}
ORGANISATION = {"adviesbureau", "bureau", "stichting", "gemeente", "waterschap", "ziekenhuis", "hogeschool", "school", "sint", "st", "adv.bureau", "dienst", "ab"}
ID_CUES = {"bsn", "burgerservicenummer", "burgerservicenr", "sofinummer", "legitimatie", "paspoort", "paspoortnummer", "identiteitskaart", "id-kaart", "rijbewijs", "documentnummer", "nr", "nummer"}

_AT = r"(?:\s?@\s?|&#0*64;|&#x0*40;|&commat;|&#0*9;|\s?[\[(]\s?(?:at|apenstaartje)\s?[\])]\s?)"
_DOT = r"(?:\.|&#0*46;|&period;|\s?[\[(]\s?(?:dot|punt)\s?[\])]\s?)"
_MAIL = rf"[^\W_][\w.+%-]*{_AT}[^\W_][\w-]*(?:{_DOT}[\w-]+)*"
_NUMBER = r"(?:\+|\(\+?)?\d(?:\d|\)?[ .\-]{1,3}(?=\d)|[ ]?\(0\)[ \-]?(?=\d)|\)(?=\d))*"
_OTHERS = (
    r"|(?P<entity>&#?\w+;)"
    r"|(?P<code>\b(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z0-9]{6,20}\b)"
    rf"|(?P<number>{_NUMBER})(?P<suffix>(?:[a-zA-Z]|[ -]?(?:bis|[IVX]{{1,4}}|[A-Z]))\b(?![\w@]|\.\w))?"
    r"|(?P<line>\n)|(?P<sign>[^\s\w])|(?P<rest>\w+)"
)
_WORDS = (
    r"(?P<initial>(?:[^\W\d_]\.[ ]?)+(?=[ ]?[^\W\d_]|[,<\s)]|$))"
    r"|(?P<word>(?>[^\W\d_]+(?:['’-][^\W\d_]+|&[a-zA-Z]+;[^\W\d_]*|&#\d+;[^\W\d_]+)*)(?![\d_]))"
)
#: The first pattern is for stretches in which an address with an at sign, however written, can stand.
_TOKEN = re.compile(
    rf"(?P<email>{_MAIL})"
    r"|(?P<tag></?[a-zA-Z!](?![^>]*(?:mailto:|@|tel:|&#|&commat|[\[(]\s?(?:at|apenstaartje)\s?[\])]))[^<>]*>)"
    rf"|{_WORDS}{_OTHERS}"
)
_PLAIN = re.compile(rf"{_WORDS}|(?P<tag></?[a-zA-Z!][^<>]*>){_OTHERS}")
_BLOCK = re.compile(r"[^\n]+(?:(?<![>.:;])\n(?![<\s•*\-])[^\n]+)*")
#: The end of a sentence within such a stretch: not after a short word, which may be a title or an abbreviation.
_SENTENCE = re.compile(r"(?<=[a-zß-öø-ÿ]{5}[.?!])\s+(?=[^\W\d_a-zß-öø-ÿ])")


Token = tuple[str, int, int]  # type, start, end


def stretches(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of the lines and sentences, each of which is a chain; a line that goes on in the next one is one with it."""
    for m in _BLOCK.finditer(text):
        line, at = m[0], m.start()
        if len(line) < 80:
            yield at, line
            continue
        a = 0
        for end in _SENTENCE.finditer(line):
            yield at + a, line[a : end.start()]
            a = end.end()
        yield at + a, line[a:] if a else line


def context_of(types: list) -> int:
    """How many of the last types of a stretch the next one has as context: of a short one, which may be the name of a field, the last, and what stands before a colon."""
    if len(types) > FIELD_NAME:
        return 0
    return 2 if len(types) > 1 and types[-1] == ":" else 1


def elevenproof(digits: str) -> bool:
    return len(digits) == 9 and sum(int(d) * w for d, w in zip(digits, (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0 and len(set(digits)) > 1


@lru_cache(100_000)
def number_type(text: str) -> str:
    """What a number looks like: how it begins, how many digits follow a country's code, the signs in it, whether it passes the eleven test."""
    digits = re.sub(r"\D", "", text)
    lead, rest = "", digits
    if digits.startswith("0031"):
        lead, rest = "0031", digits[4:]
    elif text.lstrip("(").startswith("+"):
        lead, rest = ("+31", digits[2:]) if digits.startswith("31") else ("+", digits)
    if lead in ("0031", "+31") and len(rest) > 9 and rest.startswith("0"):
        rest = rest[1:]
    if not lead:
        lead = "0" if digits.startswith("0") and not digits.startswith("00") else "00" if digits.startswith("00") else "19" if len(digits) == 4 and digits[:2] in ("19", "20") else "1"
    signs = "".join(sorted({c for c in text if c in ".-("}))
    return f"#{lead}:{min(len(rest), 15)}:{signs}" + (":eleven" if lead in ("0", "1", "00") and elevenproof(digits) else "")


@lru_cache(100_000)
def mail_type(text: str) -> str:
    """What stands around an at sign: how the sign is written, how many dots follow."""
    sign = re.search(_AT, text)[0].strip()
    dots = len(re.findall(_DOT, re.split(_AT, text, maxsplit=1)[1]))
    return f"@{'@' if sign == '@' else '&' if sign[0] == '&' else '('}:{min(dots, 3)}"


def code_type(text: str) -> str:
    """Letters and digits mixed: how many, whether capitals, how it begins and ends."""
    sort = lambda c: "0" if c.isdigit() else "X" if c.isupper() else "x"
    case = "X" if not re.search("[a-z]", text) else "x" if not re.search("[A-Z]", text) else "m"
    return f"${case}:{len(text)}:{''.join(sort(c) for c in text[:2])}:{sort(text[-1])}"


_fold = lru_cache(200_000)(fold)


def tokens(text: str, base: int = 0) -> list[Token]:
    out: list[Token] = []
    add = out.append
    mark = ""
    rich = "@" in text or "&" in text or "(" in text or "[" in text or "mailto:" in text or "tel:" in text
    for m in (_TOKEN if rich else _PLAIN).finditer(text):
        kind = m.lastgroup
        if kind == "word" or kind == "sign":
            word, a = m[0], base + m.start()
            add((mark + word if mark else word, a, a + len(word)))
            mark = ""
            continue
        if kind == "tag":
            mark = BREAK
            continue
        if kind == "line":
            mark = mark or LINE
            continue
        a, b = base + m.start(), base + m.end()
        if kind == "entity" or kind == "rest":
            add((mark + m[0], a, b))
        elif kind == "email":
            add((mark + mail_type(m[0]), a, b))
        elif kind == "code":
            add((mark + code_type(m[0]), a, b))
        elif kind == "initial":
            add((mark + ("#init" if m[0][0].isupper() else m[0].strip().lower()), a, base + m.start() + len(m[0].rstrip())))
        else:
            number, suffix = m["number"], m["suffix"]
            shape = number_type(number)
            if not suffix:
                add((mark + shape, a, b))
            elif len(re.sub(r"\D", "", number)) <= 4:
                add((mark + shape + ":s", a, b))
            else:
                add((mark + shape, a, base + m.end("number")))
                add((suffix.strip(" -"), base + m.start("suffix"), b))
        mark = ""
    # a comma before a capital says what follows it, as names stand in reverse order
    for i in range(len(out) - 1):
        if out[i][0] == ",":
            t = out[i + 1][0]
            if t == "#init" or t[0].isupper():
                out[i] = ("," + t, out[i][1], out[i][2])
    return out


def bare(t: str) -> str:
    """A type without the mark before it."""
    return t[1:] if t[0] in BREAK + LINE else t


def unseen(t: str) -> str:
    """The type of a word like this one that no text has."""
    mark, word = (t[0], t[1:]) if t[0] in BREAK + LINE else ("", t)
    return f"{mark}?{'XX' if word.isupper() else 'Xx'}"


def type_features(t: str, first_names: set[str]) -> list[str]:
    """Features of a token's type."""
    mark = {BREAK: ["break"], LINE: ["line"]}.get(t[0], [])
    t = bare(t)
    if t[0] == "?" and len(t) > 2:
        return mark + ["s=" + t[1:3]]
    if t == "#init":
        return mark + ["init"]
    if t[0] == "@" and len(t) > 1:
        return mark + ["t=" + t]
    if t[0] == "," and len(t) > 1:
        return mark + ["t=,", "sign", "next"] + (["nextinit"] if t[1] == "#" else ["nextfirst"] if _fold(t[1:]) in first_names else ["nextXX"] if t[1:].isupper() else [])
    if t[0] in "#$" and len(t) > 1:
        parts = t.split(":")
        return mark + ["t=" + t, "u=" + ":".join(parts[:2]), "kind=" + t[0], "last=" + parts[-1]]
    low = _fold(t)
    if not t[0].isalpha():
        return mark + ["t=" + t, "sign"]
    shape = "XX" if t.isupper() and len(t) > 1 else "Xx" if t[0].isupper() else "xx"
    if low in PARTICLES:
        return mark + ["particle", "particle" + shape] + (["w=" + low] if low in ("op", "in", "te", "het") else [])
    out = mark + ["w=" + low, "s=" + shape, "e3=" + low[-3:], shape + "e3=" + low[-3:]]
    if low in TITLES:
        out.append("title")
    if low in first_names and shape != "xx":
        out.append("first")
    if STREET.search(low) and shape != "xx" and len(low) > 5:
        out.append("street")
    if low in STREET_FIRST or low in STREET_TITLES and shape == "Xx":
        out.append("street1")
    if low in ORGANISATION:
        out.append("org")
    if low in ID_CUES:
        out.append("idcue")
    return out


def is_word(t: str) -> bool:
    """A capitalised word of two letters or more."""
    t = bare(t)
    return t[0].isalpha() and t[0].isupper() and len(t) > 1


def _house_number(t: str) -> bool:
    return bool(re.match(r"#(?:1|19):[1-4]:\W?(?::s)?$", bare(t)))


def _phone_like(t: str) -> bool:
    return bool(re.match(r"#(?:(?:\+31|0031):9|0:10):[^:]*$", bare(t)))


def weak_spans(toks: list[Token], first_names: set[str], own: frozenset[str] = frozenset()) -> list[int]:
    """Labels by the forms of items and by known contact names. own: folded words of the name in the record of the text."""
    y = [0] * len(toks)
    types = [t[0] for t in toks]
    low = [_fold(bare(t)) if bare(t)[0].isalpha() else bare(t) for t in types]
    known = lambda w: w in first_names or w in own

    def mark(a: int, b: int, kind: str) -> None:
        k = LABELS.index("B-" + kind)
        if any(y[a:b]):
            return
        y[a] = k
        for i in range(a + 1, b):
            y[i] = k + 1

    cap = lambda i: i < len(toks) and is_word(types[i])
    joined = lambda i: i < len(toks) and types[i][0] not in BREAK + LINE
    for i, t in enumerate(types):
        t = bare(t)
        if t[0] == "@" and t[-1] != "0" and len(t) > 1:
            mark(i, i + 1, "email")
        elif _phone_like(t):
            mark(i, i + 1, "phone")
        elif (t[0] == "$" and t.startswith("$X:9:XX") and t.endswith("0")) or t.endswith(":eleven") and (any(w in ID_CUES for w in low[max(0, i - 3) : i]) or "geboren" in low[max(0, i - 9) : i]):
            mark(i, i + 1, "id_number")
        elif cap(i) and "street" in type_features(t, first_names) and joined(i + 1) and _house_number(types[i + 1]):
            a = i - 1 if i and low[i - 1] in STREET_FIRST and cap(i - 1) and joined(i) else i
            if a > 1 and types[a - 1] == "." and low[a - 2] in STREET_TITLES and cap(a - 2):
                a -= 2
            mark(a, i + 2, "address")
    i = 0
    while i < len(toks):
        t = bare(types[i])
        b = 0
        starts_first = cap(i) and known(low[i])
        if (starts_first or t == "#init") and not y[i]:
            j = i + 1
            while joined(j) and (low[j] in PARTICLES or low[j] == "#init"):
                j += 1
            if joined(j) and cap(j) and not y[j] and low[j] not in ORGANISATION and (t == "#init" or len(low[j]) > 3):
                b = j + 1
        elif cap(i) and joined(i + 1) and joined(i + 2) and types[i + 1][0] == "," and (known(low[i + 2]) and cap(i + 2) or low[i + 2] == "#init") and not y[i]:
            b = i + 3
            while joined(b) and low[b] in PARTICLES:
                b += 1
            if joined(b) and cap(b) and low[b] not in TITLES:  # what stands before the comma is no surname
                b = 0
        if b:
            if not any(w in ORGANISATION for w in low[max(0, i - 2) : i]):
                mark(i, b, "person_name")
            i = b
        else:
            i += 1
    return y


@dataclass(slots=True)
class Block:
    """A stretch of a text: where its tokens stand in it and their types, what its chain alone makes of it."""

    starts: array  # of the tokens
    ends: array
    types: np.ndarray | list[int]  # with those of the context first
    ahead: int  # tokens of the context
    after: tuple[int, ...]  # types that the next stretch has as context
    items: list[tuple[str, int, int]] = data_field(default_factory=list)
    hot: list[tuple[int, int, int, bool]] = data_field(default_factory=list)  # linked words that may be of an item: word, position, likeliest kind, whether that is sure


@dataclass
class Finder:
    """Labels texts by a fitted field."""

    model: skipchain.Field
    first_names: set[str]
    sure: float = SURE
    types: dict[str, int] = data_field(default_factory=dict)
    names: list[str] = data_field(default_factory=list)
    scores: list[np.ndarray] = data_field(default_factory=list)
    word_of: list[int] = data_field(default_factory=list)  # of each type: number of the word that skip edges join it by, or -1
    words: dict[str, int] = data_field(default_factory=dict)
    shapes: list[tuple[int, int, bool]] = data_field(default_factory=list)  # of each word: length, letters, whether it is double
    known: dict[tuple, Block] = data_field(default_factory=dict)
    cut: dict[str, tuple] = data_field(default_factory=dict)  # of a stretch: tokens, types, context of the next one
    blank: set[str] = data_field(default_factory=set)  # stretches without tokens
    near: dict[tuple[int, int], bool] = data_field(default_factory=dict)
    _arrays: tuple | None = None

    def type_id(self, t: str) -> int:
        i = self.types.get(t)
        if i is None:
            i = self.types[t] = len(self.scores)
            self.names.append(t)
            self.scores.append(self.model.type_scores(type_features(t, self.first_names)))
            word = _linked(t)
            self.word_of.append(-1 if word is None else self.words.setdefault(word, len(self.words)))
            if len(self.shapes) < len(self.words):
                letters = 0
                for c in word:
                    letters |= 1 << (ord(c) & 63)
                self.shapes.append((len(word), letters, "-" in word))
        return i

    def toks(self, b: Block) -> list[Token]:
        return [(self.names[t], a, z) for t, a, z in zip(b.types[b.ahead :].tolist(), b.starts, b.ends)]

    def arrays(self) -> tuple:
        """The scores and words of all types; the spellings of all words, their lengths, letters (a bit each) and whether they are double."""
        if self._arrays is None or len(self._arrays[0]) != len(self.scores):
            spelled = list(self.words)
            self._arrays = np.stack(self.scores), np.array(self.word_of), spelled, np.array(self.shapes, dtype=np.uint64).reshape(-1, 3)
        return self._arrays

    def find(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Of each text its items: kind, start, end (code points)."""
        if len(self.types) > 300_000 or len(self.known) + len(self.blank) > REMEMBERED or len(self.near) > 2_000_000:
            self.types, self.names, self.scores, self.word_of, self.words, self.shapes = {}, [], [], [], {}, []
            self.known, self.cut, self.blank, self.near, self._arrays = {}, {}, set(), {}, None
        parts: list[list[tuple[Block, int]]] = []  # of each text its stretches and where they begin
        new: list[Block] = []
        known, cut, blank, ids = self.known, self.cut, self.blank, self.types
        for text in texts:
            own: list[tuple[Block, int]] = []
            parts.append(own)
            context: tuple[int, ...] = ()
            for at, stretch in stretches(text or ""):
                if stretch in blank:
                    continue
                key = context, stretch
                block = known.get(key)
                if block is None:
                    got = cut.get(stretch)
                    if got is None:
                        toks = tokens(stretch)
                        mine = [ids[t[0]] if t[0] in ids else self.type_id(t[0]) for t in toks]
                        got = array("i", [t[1] for t in toks]), array("i", [t[2] for t in toks]), mine, tuple(mine[len(mine) - context_of([t[0] for t in toks]) :])
                        if len(stretch) <= 400:
                            cut[stretch] = got
                    starts, ends, mine, after = got
                    if not mine:  # mark-up alone
                        blank.add(stretch)
                        continue
                    block = Block(starts, ends, [*context, *mine], len(context), after)
                    new.append(block)
                    if len(stretch) <= 400:
                        known[key] = block
                own.append((block, at))
                context = block.after
        self._alone(new)
        edges, again = [], []
        for k, own in enumerate(parts):
            mine = self._open_edges(own)
            if mine:
                edges += [((k, *x[:2]), (k, *y[:2]), sort) for x, y, sort in mine]
                again += sorted({(k, e[0]) for x, y, _ in mine for e in (x, y)})
        anew: dict[int, dict[int, list]] = {}
        for (k, n), found in self._together(parts, again, edges).items():
            anew.setdefault(k, {})[n] = found
        out = []
        for k, own in enumerate(parts):
            other = anew.get(k)
            if other:
                items = {(kind, at + a, at + z) for n, (b, at) in enumerate(own) for kind, a, z in other.get(n, b.items)}
            else:
                items = {(kind, at + a, at + z) for b, at in own if b.items for kind, a, z in b.items}
            out.append(sorted(items, key=lambda x: (x[1], x[0])))
        return out

    def _alone(self, new: list[Block]) -> None:
        """What the chain alone makes of each stretch."""
        if not new:
            return
        scores, word_of, _, _ = self.arrays()
        lengths = np.array([len(b.types) for b in new])
        types = np.array([t for b in new for t in b.types], dtype=np.int32)
        first = np.cumsum(lengths) - lengths
        for b, f, n in zip(new, first.tolist(), lengths.tolist()):
            b.types = types[f : f + n].copy()
        u = skipchain.flat_unary(scores, types, lengths)
        p = skipchain.chain_marginals(self.model, u, lengths)
        kinds = self.model.kind_of
        by_kind = p @ (kinds[:, None] == np.arange(kinds.max() + 1)).astype(p.dtype)
        kind, sure = by_kind.argmax(axis=1), by_kind.max(axis=1) >= self.sure
        maybe = (kind > 0) | ~sure
        open_ = np.logical_or.reduceat(maybe, first)
        # if the likeliest labels of a chain are right together with more than even odds, they are its best labels
        best = p.argmax(axis=1)
        unsure = np.add.reduceat(1 - p.max(axis=1), first) >= 0.49
        if unsure.any():
            best[np.repeat(unsure, lengths)] = skipchain.best_labels(self.model, u[np.repeat(unsure, lengths)], lengths[unsure])
        for c in np.flatnonzero(open_).tolist():
            b, f = new[c], int(first[c])
            b.items = spans(self.toks(b), best[f + b.ahead : f + int(lengths[c])].tolist())
        chain = np.repeat(np.arange(len(new)), lengths)
        word = word_of[types]
        for i in np.flatnonzero(maybe & (word >= 0)).tolist():
            c = int(chain[i])
            b, place = new[c], i - int(first[c])
            if place >= b.ahead:
                b.hot.append((int(word[i]), place, int(kind[i]), bool(sure[i])))

    def _open_edges(self, parts: list[tuple[Block, int]]) -> list[tuple[tuple, tuple, int]]:
        """The skip edges of a text that can change something. An end: stretch, position, kind, whether sure.

        Words none of whose mentions may be of an item have no edges, as these could but confirm that.
        """
        hot: dict[int, dict[tuple[int, int], tuple[int, bool]]] = {}
        for n, (b, _) in enumerate(parts):
            if b.hot:
                for word, i, kind, sure in b.hot:
                    hot.setdefault(word, {})[(n, i)] = (kind, sure)
        if not hot:
            return []
        # a stretch with its context; mentions in the context are left out
        lengths = [len(b.types) for b, _ in parts]
        words = self.arrays()[1][np.concatenate([b.types for b, _ in parts])]
        at = np.flatnonzero(words >= 0)
        words = words[at]
        alike = self._near(list(hot), np.unique(words))
        wanted = set(hot).union(*alike.values())
        mentions: dict[int, list[tuple[int, int, int, bool]]] = {w: [] for w in wanted}
        ends = np.cumsum(lengths)
        for i, w in zip(at.tolist(), words.tolist()):
            if w in wanted:
                n = int(np.searchsorted(ends, i, side="right"))
                place = (n, i - int(ends[n]) + lengths[n])
                if place[1] >= parts[n][0].ahead:
                    mentions[w].append((*place, *hot.get(w, {}).get(place, (0, True))))
        edges: list[tuple[tuple, tuple, int]] = []
        for w in hot:
            mine = mentions[w]
            edges += [(x, y, 0) for x, y in zip(mine, mine[1:])]
            edges += [(mine[0], mentions[o][0], 1) for o in alike[w] if (o not in hot or w < o) and mentions[o]]
        return edges if any(x[2] != y[2] or not (x[3] and y[3]) for x, y, _ in edges) else []

    def _near(self, hot: list[int], here: np.ndarray) -> dict[int, list[int]]:
        """Of each hot word the words here that read nearly so."""
        _, _, spelled, shape = self.arrays()
        mine, these = shape[hot][:, None, :], shape[here][None, :, :]
        # one edit changes the length by one and the set of letters by two at most; a double name has the letters of its parts
        other = mine[..., 1] ^ these[..., 1]
        may = (np.maximum(mine[..., 0], these[..., 0]) - np.minimum(mine[..., 0], these[..., 0]) <= 1) & (np.bitwise_count(other) <= 2)
        may |= (these[..., 2] > 0) & (mine[..., 1] & ~these[..., 1] == 0) | (mine[..., 2] > 0) & (these[..., 1] & ~mine[..., 1] == 0)
        out: dict[int, list[int]] = {w: [] for w in hot}
        rows, columns = np.nonzero(may)
        for w, o in zip(np.array(hot)[rows].tolist(), here[columns].tolist()):
            key = (w, o) if w < o else (o, w)
            close = self.near.get(key)
            if close is None:
                close = self.near[key] = reads_nearly(spelled[w], spelled[o])
            if close:
                out[w].append(o)
        return out

    def _together(self, parts: list[list[tuple[Block, int]]], again: list[tuple[int, int]], edges: list) -> dict[tuple[int, int], list[tuple[str, int, int]]]:
        """The items of the stretches (text, number) that have skip edges, labelled again by all of them."""
        if not again:
            return {}
        blocks = [parts[k][n][0] for k, n in again]
        lengths = np.array([len(b.types) for b in blocks])
        ends = np.cumsum(lengths).tolist()
        starts = {c: e - len(b.types) for c, e, b in zip(again, ends, blocks)}
        u = skipchain.flat_unary(self.arrays()[0], np.concatenate([b.types for b in blocks]), lengths)
        pairs = np.array([(starts[x[:2]] + x[2], starts[y[:2]] + y[2]) for x, y, _ in edges])
        labels = skipchain.decode(self.model, u, lengths, pairs, np.array([sort for _, _, sort in edges])).tolist()
        return {c: spans(self.toks(b), labels[starts[c] + b.ahead : e]) for c, e, b in zip(again, ends, blocks)}


def _linked(t: str) -> str | None:
    """What a token is joined by to others of its document: a capitalised word as it is folded."""
    if t[0] in BREAK + LINE:
        t = t[1:]
    if len(t) >= LINKED and t[0].isalpha() and t[0].isupper():
        low = _fold(t)
        return None if low in PARTICLES or low in TITLES else low
    return None


def reads_nearly(a: str, b: str) -> bool:
    """Whether two words are one edit apart, or one is a part of the other, a double name."""
    if a == b or min(len(a), len(b)) < LINKED_TYPED:
        return False
    return banded_distance(a, b, 1) <= 1 or "-" in a and b in a.split("-") or "-" in b and a in b.split("-")


def spans(toks: list[Token], labels: list[int]) -> list[tuple[str, int, int]]:
    """Labelled stretches of the tokens, each checked for the form that its kind must have."""
    out, i = [], 0
    while i < len(labels):
        if labels[i] == 0:
            i += 1
            continue
        kind = LABELS[labels[i]][2:]
        j = i + 1
        inside = LABELS.index("I-" + kind)
        while j < len(labels) and labels[j] == inside:
            j += 1
        a, b = i, j
        types = [bare(t[0]) for t in toks[a:b]]
        while b - a > 1 and types[b - a - 1][0] in ",.:;|<-(":
            b -= 1
        if kind == "person_name":  # no name begins with a title, a sign or a particle in small letters
            while a < b - 1 and (_fold(types[a - i]) in TITLES or types[a - i] in PARTICLES or not (types[a - i][0].isalpha() or types[a - i] == "#init")):
                a += 1
            comma = next((k for k in range(a, b) if types[k - i][0] == ","), None)
            if comma and sum(t == "#init" or t[0].isupper() for t in types[comma + 1 - i : b - i]) > 1:
                a = comma + 1  # what stands before a whole name is no part of it
        if _well_formed(kind, [t[0] for t in toks[a:b]], _before(toks, a)):
            out.append((kind, toks[a][1], toks[b - 1][2]))
        i = j
    return out


def _before(toks: list[Token], a: int) -> list[str]:
    """The two words before a token, as far as no mark-up parts them from it."""
    out = []
    while len(out) < 2 and a > 0 and toks[a][0][0] != BREAK:
        a -= 1
        out.append(_fold(bare(toks[a][0])))
    return out


def _well_formed(kind: str, types: list[str], before: list[str]) -> bool:
    """The exact check of a labelled span; a name after the word of an organisation is part of that one's name."""
    first = bare(types[0])
    if kind == "email":
        return len(types) == 1 and first[0] == "@" and len(first) > 1
    if kind == "phone":
        return first[0] == "#" and first != "#init"
    if kind == "id_number":
        return first[0] in "#$" and first != "#init" and len(first) > 1
    if kind == "address":
        return len(types) > 1 and is_word(types[0]) and any(t[0] == "#" and t != "#init" for t in map(bare, types[1:])) and _fold(first) != "postbus"
    return any(is_word(t) for t in types) and not any(_fold(bare(w)) in ORGANISATION for w in (*before, *types))


def _pieces(y: list[int], around: int = 6, longest: int = 30) -> list[tuple[int, int]]:
    """Ranges that hold each item and some tokens on either side; what has no item is cut to ranges as long."""
    marked = [i for i, g in enumerate(y) if g]
    if not marked:
        return [(a, min(len(y), a + longest)) for a in range(0, len(y), longest)]
    out = []
    for i in marked:
        a, b = max(0, i - around), min(len(y), i + around + 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    # a range doesn't begin or end within an item
    return [(max(0, a - (y[a] % 2 == 0 and y[a] > 0)), b) for a, b in out]


_NAME = LABELS.index("B-person_name")
Chain = tuple[int, list[str], list[int]]  # document, types, labels


def _chance(*parts: object) -> float:
    """A number from 0 to 1 that depends on the parts alone."""
    return zlib.crc32(repr(parts).encode()) / 2**32


def _told(types: list[str], y: list[int], i: int) -> bool:
    """Whether a field's mark stands before the name that goes on at i."""
    while i and y[i] == _NAME + 1:
        i -= 1
    return types[i][0] == BREAK or i > 0 and types[i - 1] == ":"


def varied(chains: list[Chain]) -> tuple[list[Chain], int]:
    """The chains and copies of them that hold what the weak labels can't know, and the number of documents then.

    Of each chain without items that has a number of nine digits: one in which this passes the eleven test. Of each with
    a name: three in which words of the name are such as no text has, one of them without the mark before it; if a title stands before it, one with the surname
    alone; and, as a document of its own, the chain followed by a chain without items in which the surname, as it is
    or with a letter lost, stands for a capitalised word.
    """
    out = list(chains)
    plain = [(t, y) for _, t, y in chains if not any(y) and any(is_word(x) for x in t[1:])]
    documents = 1 + max((c[0] for c in chains), default=-1)
    for n, (_, types, y) in enumerate(chains):
        passing = [t + ":eleven" if re.match(r"#[01]:9:[^:]*$", bare(t)) else t for t in types]
        if not any(y) and passing != types:
            out.append((documents, passing, y))
            documents += 1
        if _NAME not in y:
            continue
        # a name in reverse order among other words is told from a list of words by its first name alone, which then stays
        turned = {i + 1 for i, t in enumerate(types) if t[0] == "," and len(t) > 1 and y[i] and not _told(types, y, i)}
        for k, share in enumerate((1.0, 1.0, 0.5)):
            hidden = [unseen(t) if g in (_NAME, _NAME + 1) and is_word(t) and i not in turned and _chance(n, k, i) < share else t for i, (t, g) in enumerate(zip(types, y))]
            hidden = ["," + unseen(t[1:]) if g and t[0] == "," and len(t) > 1 and hidden[i + 1][0] == "?" else t for i, (t, g) in enumerate(zip(hidden, y))]
            a = y.index(_NAME)
            if k == 0 and a and hidden[a][0] in BREAK + LINE:  # the mark before the name is not always there
                sign = [":"] if hidden[a][0] == BREAK and hidden[a - 1][0].isalpha() or is_word(hidden[a - 1]) else []
                hidden, labels = [*hidden[:a], *sign, hidden[a][1:], *hidden[a + 1 :]], [*y[:a], *[0] * len(sign), *y[a:]]
                if hidden[a - 1] == ",":
                    hidden[a - 1] = "," + hidden[a]
                out.append((documents, hidden, labels))
            else:
                out.append((documents, hidden, y))
            documents += 1
        a = y.index(_NAME)
        b = a + 1
        while b < len(y) and y[b] == _NAME + 1:
            b += 1
        if any(t[0] == "," for t in types[a:b]) or not is_word(types[b - 1]):
            continue
        surname = bare(types[b - 1])
        before = _fold(bare(types[a - 1])) if a else ""
        if a > 1 and before == ".":
            before = _fold(bare(types[a - 2]))
        if before in TITLES and a:
            for word in (surname, unseen(surname)):
                out.append((documents, [*types[:a], word, *types[b:]], [*y[:a], _NAME, *y[b:]]))
                documents += 1
        if plain and len(surname) >= LINKED_TYPED:
            other, none = plain[int(_chance(n, "other") * len(plain))]
            places = [i for i, t in enumerate(other) if i and is_word(t)]
            i = places[int(_chance(n, "place") * len(places))]
            word = surname
            if _chance(n, "typed") < 0.4:
                k = 1 + int(_chance(n, "letter") * (len(surname) - 1))
                word = surname[:k] + surname[k + 1 :]
            mark = other[i][0] if other[i][0] in BREAK + LINE else ""
            out.append((documents, types, y))
            out.append((documents, [*other[:i], mark + word, *other[i + 1 :]], [*none[:i], _NAME, *none[i + 1 :]]))
            documents += 1
    return out, documents


def skip_edges(chains: list[Chain]) -> list[tuple[int, int, int, int, int]]:
    """Chain, position, chain, position, sort of the skip edges of all documents."""
    documents: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for c, (d, types, _) in enumerate(chains):
        words = documents.setdefault(d, {})
        for i, t in enumerate(types):
            word = _linked(t)
            if word:
                words.setdefault(word, []).append((c, i))
    out = []
    for words in documents.values():
        for word, places in words.items():
            out += [(*x, *y, 0) for x, y in zip(places, places[1:])]
            out += [(*places[0], *words[o][0], 1) for o in words if word < o and abs(len(o) - len(word)) < 2 + 20 * ("-" in o + word) and reads_nearly(word, o)]
    return out


def known_first_names(contact_names: list[str]) -> set[str]:
    """First names that two contacts or more have."""
    seen: dict[str, int] = {}
    for name in contact_names:
        words = [bare(t[0]) for t in tokens(name)]
        if len(words) > 2 and words[1][0] == ",":
            words = words[2:] + words[:1]
        if len(words) > 1 and words[0][0].isalpha() and len(words[0]) > 2 and fold(words[0]) not in PARTICLES | TITLES:
            seen[fold(words[0])] = seen.get(fold(words[0]), 0) + 1
    return {n for n, k in seen.items() if k > 1}


def fit_finder(texts: list[str | tuple[str, str | None]], contact_names: list[str], no_people: list[str] = (), rounds: int = 80) -> Finder:
    """Fit to unlabelled texts with the help of contact names. texts: each alone or with the contact name of its record; no_people: names of clients and places, titles."""
    names = known_first_names(contact_names)
    cut: list[tuple[int, list[str], list[int]]] = []
    often: dict[str, int] = {}
    for d, text in enumerate(texts):
        text, contact = (text, None) if isinstance(text, str) else text
        own = frozenset(_fold(bare(t[0])) for t in tokens(contact or "") if is_word(t[0]))
        context: tuple[list[str], list[int]] = [], []
        for _, stretch in stretches(text):
            toks = tokens(stretch)
            mine, labels = [t[0] for t in toks], weak_spans(toks, names, own)
            types, y = context[0] + mine, context[1] + labels
            n = len(mine) - context_of(mine)
            context = (mine[n:], labels[n:]) if mine else context
            for t in types:
                often[t] = often.get(t, 0) + 1
            if not _doubtful(types, y):
                cut += [(d, types[a:b], y[a:b]) for a, b in _pieces(y) if b > a]
    chains: list[Chain] = []
    seen: dict[str, int] = {}
    for d, types, y in cut:
        # capitalised words that are rare count as one
        shape = " ".join((LABELS[g] if g else "") + ("X" if bare(t)[0].isupper() and (g or often[t] < OFTEN) else t) for t, g in zip(types, y))
        seen[shape] = seen.get(shape, 0) + 1
        if seen[shape] <= (ALIKE if any(y) else ALIKE_WITHOUT):
            chains.append((d, types, y))
    for d, name in enumerate(no_people, len(texts)):
        types = [t[0] for t in tokens(name)]
        if types and not any(weak_spans(tokens(name), names)):
            chains.append((d, types, [0] * len(types)))
    with_items = [c for c in chains if any(c[2])]
    without = sorted((c for c in chains if not any(c[2])), key=lambda c: (not any(map(_like_item, c[1])), _chance(c[1])))[:WITHOUT]
    step = max(1, -(-len(with_items) // WITH_ITEMS))
    kept, _ = varied(sorted(with_items[::step] + without, key=lambda c: c[0]))
    types: dict[str, int] = {}
    coded = [[types.setdefault(t, len(types)) for t in c[1]] for c in kept]
    model = skipchain.fit(coded, [c[2] for c in kept], [type_features(t, names) for t in types], LABELS, skip_edges(kept), rounds)
    return Finder(model, names)


def _like_item(t: str) -> bool:
    t = bare(t)
    return t[0] in "#@$" and len(t) > 1 and not re.match(r"#1:[123]:$", t)


def _doubtful(types: list[str], y: list[int]) -> bool:
    """Whether a capitalised word without a label stands after a title, which may be a name that the weak labels don't know."""
    for i, t in enumerate(types[:-1]):
        if _fold(bare(t)) in TITLES:
            j = i + 1 + (types[i + 1] == ".")
            if j < len(types) and is_word(types[j]) and not y[j] and _fold(bare(types[j])) not in TITLES:
                return True
    return False


def training_finder(snippets: DataFrame, pages: DataFrame, records: DataFrame, most: int = TRAIN_TEXTS) -> Finder:
    """Fit to the first ``most`` texts of each table (a quarter as many pages) in the order of a hash; of an id with several texts the least."""

    def some(df: DataFrame, key: str, n: int, *columns: str) -> list:
        """Rows key, columns: of an id with several rows the least."""
        ids = [r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(n).collect()]
        if not ids:
            return []
        return sorted((r[0], *r[1]) for r in df.where(F.col(key).isin(ids)).groupBy(key).agg(F.min(F.struct(*columns))).collect())

    own_columns = ["raw_opportunity_id", *(F.col(f"contact_information.{k}").alias(k) for k in ("name", "email", "phone")), "client_name", "location", "title"]
    flat = records.select("id", *own_columns)
    some_records = some(flat, "id", 4 * most, "name", "email", "phone", "client_name", "location", "title")
    values = lambda i, n: [r[i] for r in some_records if r[i]][:n]
    some_pages = [r for r in some(pages, "id", most // 4, "raw_content") if r[1]]
    own = {}
    if some_pages:
        mine = flat.where(F.col("raw_opportunity_id").isin([r[0] for r in some_pages]))
        own = dict(mine.groupBy("raw_opportunity_id").agg(F.min("name")).collect())  # a row for each of the pages
    texts = [r[1] for r in some(snippets, "snippet_id", most, "text") if r[1]] + [(r[1], own.get(r[0])) for r in some_pages] + values(2, most) + values(3, most)
    return fit_finder(texts, values(1, 4 * most), values(4, most) + values(5, most) + values(6, most))


_OWN: list[tuple[object, Finder]] = []


def own_finder(fitted: tuple) -> Finder:
    """The finder of this worker for a fitted field, with what it remembers from earlier tasks."""
    if not _OWN or _OWN[0][0] is not fitted:
        _OWN[:] = [(fitted, Finder(*fitted))]
    return _OWN[0][1]


#: Texts labelled together: stretches of like length of all of them are summed at once.
TOGETHER = 400


def found_items(fields: list[tuple[str, DataFrame]], finder: Finder, with_text: bool = True) -> DataFrame:
    """field_name, record_id, text (null unless with_text), items (array of kind, start, end). fields: name and a frame of record_id, text."""
    rows = None
    for name, df in fields:
        part = df.where("text is not null and text <> ''").distinct().select(F.lit(name).alias("field_name"), "record_id", "text")
        rows = part if rows is None else rows.unionByName(part)
    shared = rows.sparkSession.sparkContext.broadcast((finder.model, finder.first_names))  # some MB, bounded by TRAIN_TEXTS
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("field_name", pa.string()), ("record_id", pa.string()), ("text", pa.string()), ("items", pa.list_(item))])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_finder(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                items = own.find(part.column(2).to_pylist())
                values = pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in x] for x in items], pa.list_(item))
                text = part.column(2) if with_text else pa.nulls(part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text, values], schema=schema)

    return rows.mapInArrow(labelled, "field_name string, record_id string, text string, items array<struct<kind:string,start:int,end:int>>")


def masked(found: DataFrame) -> DataFrame:
    """field_name, record_id, masked: every item replaced by its kind in brackets, everything else kept.

    Pieces are cut and joined by built-in functions, in code points, from the items in order.
    """
    ordered = F.array_sort("items", lambda x, y: x["start"] - y["start"])
    text = F.col("text")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    merged = F.aggregate(
        ordered,
        begin,
        lambda s, x: F.struct(
            F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("out"),
            F.greatest(x["end"], s["at"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return found.select("field_name", "record_id", merged.alias("masked"))
