"""Canonical rewritings of names as people type them.

A name is parsed into loosely spelled tokens and rewritten by rule: any order of its tokens, the initial for the
given name, nicknames and shortened given names, dropped middle names, particles, legal forms and marks, one lost
letter. Two spellings of one name share a rewriting, so variants meet in an equi-join on rewritings; how rare a
rewriting is says how much sharing it means.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.similarity import edits

#: Letters that decomposition leaves as they are, and Cyrillic letters, by usual Latin spelling. Fixed values.
LETTERS = {
    "ø": "o", "æ": "ae", "å": "a", "ß": "ss", "ı": "i", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "œ": "oe",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "z", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "c", "ш": "s", "щ": "s", "ъ": "", "ы": "i", "ь": "",
    "э": "e", "ю": "ju", "я": "ja", "ђ": "d", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "џ": "dz",
}
PARTICLES = {"van", "der", "den", "von", "af", "av", "ben", "bin", "ibn", "al", "el", "dos", "das", "de", "do", "du", "di", "la", "le", "da", "del", "wan"}
#: Given names that share no beginning or ending with what they are short for. Fixed values.
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bobby": "robert", "bill": "william", "billy": "william", "will": "william", "liam": "william", "dick": "richard", "rick": "richard",
    "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "ted": "edward", "ned": "edward", "eddie": "edward", "tony": "anthony", "toni": "antonio", "tonio": "antonio",
    "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "molly": "mary", "polly": "mary", "betty": "elizabeth", "liz": "elizabeth", "beth": "elizabeth", "lisa": "elizabeth",
    "harry": "henry", "hank": "henry", "chuck": "charles", "charlie": "charles", "kate": "katherine", "kitty": "katherine", "sally": "sarah", "nancy": "ann", "hans": "johannes", "hannes": "johannes",
    "pepe": "jose", "paco": "francisco", "pancho": "francisco", "kiko": "francisco", "nacho": "ignacio", "chema": "jose maria", "quique": "enrique", "kike": "enrique", "lalo": "eduardo",
    "tito": "alberto", "beto": "alberto", "sasha": "aleksandr", "sascha": "alexander", "misha": "mihail", "vanya": "ivan", "kolya": "nikolaj", "dima": "dmitrij", "zhenya": "evgenij",
    "volodya": "vladimir", "lyosha": "aleksej", "gigi": "luigi", "beppe": "giuseppe", "pippo": "filippo", "zeca": "jose", "chico": "francisco", "mo": "mohammed", "hamza": "hamzah",
}
#: Legal forms of organisations; the short ones are also family names, so they only give a further rewriting. Fixed values.
LEGAL_FORMS = {"ltd", "limited", "llc", "inc", "incorporated", "corp", "corporation", "gmbh", "plc", "srl", "sarl", "llp", "pty", "aps", "oyj", "spa", "company", "holding", "holdings"}
SHORT_LEGAL_FORMS = {"sa", "ag", "ab", "as", "co", "nv", "bv", "oy", "kg", "kk", "se", "sl"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "junior", "senior"}
#: Spellings that stand for one sound, tried in order.
SOUNDS = [("sch", "s"), ("ch", "c"), ("sh", "s"), ("zh", "z"), ("gh", "g"), ("kh", "k"), ("th", "t"), ("ph", "f"), ("ck", "k"), ("oe", "o"), ("ae", "a"), ("aa", "a"), ("ue", "u"), ("ei", "i"), ("ey", "i"), ("c", "k"), ("q", "k"), ("w", "v"), ("y", "i"), ("j", "i")]

_JUNK = re.compile(r"\([^)]*\)|\[[^\]]*\]|#\s*\d+|\*+|\bU\d\d\b")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-ZÀ-ÖØ-ÞČŠŽŞİĞ][^\W\d_])")
_HYPHEN = re.compile(r"(?<=\w)[\-‐-―](?=\w)")
_SPLIT = re.compile(r"[\s\-‐-―.'’`,/]+")


@lru_cache(maxsize=1 << 16)
def ascii_fold(text: str) -> str:
    """Lower case without marks, Latin letters only where a usual spelling exists."""
    text = unicodedata.normalize("NFKD", text.replace("İ", "I").lower())
    out = []
    for ch in text:
        if unicodedata.combining(ch):
            continue
        out.append(LETTERS.get(ch, ch))
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def loose(token: str) -> str:
    """One spelling for all that sound alike; doubled letters count once. Empty tokens stay empty."""
    for a, b in SOUNDS:
        token = token.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", token)


def _words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text) if w]


@lru_cache(maxsize=1 << 16)
def squeezed(token: str) -> str:
    """Doubled letters count once."""
    return re.sub(r"(.)\1+", r"\1", token)


def parse(name: str | None, spell: Callable[[str], str] = loose) -> list[str]:
    """Tokens, spelled loosely, given name first; particles, legal forms and marks left out. Nothing for null or blank names.

    'Family, Given' is turned round, 'GivenFamily' and 'Given-Family' are split. Where only particles are left
    they are kept, so that a name never vanishes for its form.
    """
    if name is None:
        return []
    text = _JUNK.sub(" ", unicodedata.normalize("NFC", name))
    head, comma, tail = text.partition(",")
    if comma and loose(ascii_fold(tail).strip(" .")) not in SUFFIXES and tail.strip():
        text = f"{tail} {head}"
    text = _CAMEL.sub(" ", text)
    if len(text.split()) > 1:  # 'Given-Second Family': hyphens join parts of one name, alone they stand for lost spaces
        text = _HYPHEN.sub("", text)
    words = [re.sub(r"[^a-z0-9]", "", w) or w for w in map(ascii_fold, _words(text))]
    words = [w for w in words if w not in SUFFIXES]
    named = [w for w in words if w not in LEGAL_FORMS]
    words = named or words
    kept = [w for w in words if w not in PARTICLES] or words
    tokens = [t for t in map(spell, kept) if t]
    if len(tokens) > 1 and len(tokens[-1]) == 1 and len(tokens[0]) > 1:  # 'Family G.'
        tokens = tokens[-1:] + tokens[:-1]
    return tokens


def deletions(s: str) -> list[str]:
    """s and every string with one letter of it lost; one letter alone only itself."""
    return [s] if len(s) < 2 else list(dict.fromkeys([s, *[s[:i] + s[i + 1 :] for i in range(len(s))]]))


#: Letters up to which a whole name is also written with one letter lost; the strings of a longer one would fill its
#: square, it meets its variants by the forms made from tokens.
WHOLE_LETTERS = 80


@lru_cache(maxsize=1 << 16)
def _token_deletions(token: str) -> list[str]:
    return deletions(token)


@lru_cache(maxsize=1 << 18)
def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")


def forms(tokens: list[str], years: Iterable[int], rotate: bool) -> list[str]:
    """Every rewriting, prefixed with its rule. rotate: also with the tokens in the other orders (one side of a match suffices).

    c: all letters, one lost at most. o: the tokens in any order, one letter lost at most (a sum of token hashes).
    n: nickname or full given name, with the rest. s: initial and a later name, one letter of it lost at most.
    b, e: beginning or ending of the given name, with a later name. y: a name alone with a year of birth. g: given
    name, one letter lost at most, with a year and the family initial.
    """
    if not tokens:
        return []
    out: list[str] = []
    orders = [tokens]
    if rotate and len(tokens) > 1:
        orders += [tokens[k:] + tokens[:k] for k in range(1, len(tokens) if len(tokens) <= 4 else 2)]
    for order in orders:
        whole = "".join(order)
        out += ["c|" + d for d in (deletions(whole) if len(whole) <= WHOLE_LETTERS else [whole])]
        first, rest = order[0], order[1:]
        for later in rest:
            initial = f"s|{first[0]}|"
            out += [initial + d for d in _token_deletions(later)]
            if len(first) >= 3:
                out += [f"b|{first[:3]}|{later}", f"e|{first[-3:]}|{later}"]
        if rest:
            after = "".join(rest)
            out += [f"n|{g}|{after}" for g in _given_names(first)]
            for y in years:
                dated = f"g|{y}|{rest[-1][0]}|"
                out += [dated + d for d in _token_deletions(first)]
    if len(tokens) > 2:
        total = sum(map(_token_hash, tokens))
        out.append(f"o|{total & (1 << 64) - 1:x}")
        for t in set(tokens):
            rest_sum = total - _token_hash(t)
            out += [f"o|{rest_sum + _token_hash(d) & (1 << 64) - 1:x}" for d in _token_deletions(t)[1:]]
    for y in years:
        out += [f"y|{y}|{t}" for t in tokens]
    return list(dict.fromkeys(out))


_nicknames: dict[str, str] = {}


def _given_names(token: str) -> list[str]:
    """The given name and, for a nickname, what it is short for, both spelled loosely."""
    if not _nicknames:
        _nicknames.update((spell(k), spell(v.replace(" ", ""))) for spell in (loose, squeezed) for k, v in NICKNAMES.items())
    full = _nicknames.get(token)
    return [token] if full is None or full == token else [token, full]


def rewritings(name: str | None, years: Iterable[int], rotate: bool) -> list[str]:
    """Every rewriting of a name: of its loose spelling, and of its letters as they are where these differ, for a
    typing error may make or break a pair of letters that counts as one sound; and without a short legal form at its end."""
    years = list(years)
    sound, letters = parse(name), parse(name, squeezed)
    out = forms(sound, years, rotate)
    if letters != sound:
        out = list(dict.fromkeys(out + forms(letters, years, rotate)))
    if len(letters) > 1 and letters[-1] in SHORT_LEGAL_FORMS:
        out = list(dict.fromkeys(out + forms(sound[:-1], years, rotate)))
    return out


def forms_column(name: Column, years: Column, rotate: bool) -> Column:
    """array<string> of the rewritings of a name given an array<int> of years of birth (both may be null)."""

    @F.pandas_udf("array<string>")
    def run(n: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([rewritings(a, [int(v) for v in b] if b is not None else [], rotate) for a, b in zip(n, y)], dtype=object)

    return run(name, F.coalesce(years, F.array().cast("array<int>")))


def _whole(a: str, b: str) -> float:
    """1 for equal texts, less by edits, against the longer one's length."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    return max(0.0, 1.0 - edits(a, b, most=n) / n)


#: The same for tokens, of which many names have the same.
_near = lru_cache(maxsize=1 << 18)(_whole)


@lru_cache(maxsize=1 << 18)
def _given(a: str, b: str) -> float:
    """Given names: an initial or a short form (shared beginning, short ending) nearly counts as the name."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.85 if a[0] == b[0] else 0.0
    if set(_given_names(a)) & set(_given_names(b)):
        return 0.85
    short, long = sorted((a, b), key=len)
    stem = 0
    while stem < len(short) and short[stem] == long[stem]:
        stem += 1
    nick = 0.85 if stem >= 2 and len(short) - stem <= 1 and len(short) < len(long) else 0.0
    if long.endswith(short) and len(short) >= 3:
        nick = max(nick, 0.8)
    return max(_near(a, b), nick)


def compare(x: list[str], y: list[str]) -> tuple[float, float, float]:
    """(given, family, whole): similarity of given names, of the best-agreeing family names, of all letters.

    The order of x that agrees best with y counts. given is -1 where one side has a family name alone.
    """
    if not x or not y:
        return 0.0, 0.0, 0.0
    joined, letters = "".join(y), "".join(x)
    n = max(len(letters), len(joined))

    def raised(given: float, family: float, whole: float) -> tuple[float, float, float]:
        if whole > 0.9:
            return (1.0, 1.0, whole) if alone else (max(given, whole), max(family, whole), whole)
        return given, family, whole

    total = lambda c: max(c[0], 0.3) + c[1] + c[2]
    alone = len(x) == 1 or len(y) == 1
    parts = []
    for k in range(len(x)):
        o = x[k:] + x[:k]
        if alone:
            one, many = (o[0], y) if len(o) == 1 else (y[0], o)
            parts.append((k, o, -1.0, max(_near(one, t) for t in (many[1:] or many))))
        else:
            parts.append((k, o, _given(o[0], y[0]), max(_near(a, b) for a in o[1:] for b in y[1:])))
    # the order that promises most goes first; one is compared letter by letter only where it could still reach the best
    parts.sort(key=lambda p: -(p[2] + p[3]))
    best, reached, first = (0.0, 0.0, 0.0), 0.3, -1
    most, counted = min(len(letters), len(joined)), False
    for k, o, given, family in parts:
        if first >= 0:
            if total(raised(given, family, 1.0 - (n - most) / n)) < reached:
                continue
            if not counted:
                most, counted = sum(min(letters.count(c), joined.count(c)) for c in set(letters)), True
                if total(raised(given, family, 1.0 - (n - most) / n)) < reached:
                    continue
        cand = raised(given, family, _whole("".join(o), joined))
        if total(cand) > reached or (total(cand) == reached and k < first):
            best, reached, first = cand, total(cand), k
    return best


def compare_columns(x: Column, y: Column) -> Column:
    """struct<given, family, whole> of two name columns."""

    @F.pandas_udf("given double, family double, whole double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known: dict[str | None, list[str]] = {}

        def tokens(n: str | None) -> list[str]:
            if n not in known:
                known[n] = parse(n)
            return known[n]

        return pd.DataFrame([compare(tokens(p), tokens(q)) for p, q in zip(a, b)], columns=["given", "family", "whole"], dtype=float)

    return run(x, y)


#: Words of club names that many clubs share.
CLUB_WORDS = {"fc", "as", "cd", "fk", "sv", "sc", "ac", "real", "sporting", "dynamo", "athletic", "ath", "united", "utd", "city", "rovers", "wanderers", "wand", "1904"}


def club_key(name: str | None) -> str:
    """The part of a club's name that tells it from others, loosely spelled; '' where there is none."""
    if name is None:
        return ""
    words = [re.sub(r"[^a-z0-9]", "", w) for w in map(ascii_fold, _words(name))]
    kept = [w for w in words if w and w not in CLUB_WORDS]
    return loose("".join(kept))


def clubs_agree(a: Column, b: Column) -> Column:
    """For arrays of club names: 1 where two agree but for one letter, 0 where none do, null where a side knows none."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[str | None, str] = {}

        def key(n: str | None) -> str:
            if n not in known:
                known[n] = club_key(n)
            return known[n]

        def one(p: object, q: object) -> float | None:
            ps = {k for k in map(key, p if p is not None else []) if k}
            qs = {k for k in map(key, q if q is not None else []) if k}
            if not ps or not qs:
                return None
            # a letter more or less makes another name of a short one
            return 1.0 if ps & qs or any(edits(i, j, most=1) <= 1 for i in ps for j in qs if min(len(i), len(j)) > 3) else 0.0

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)
