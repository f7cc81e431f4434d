"""Sentence boundaries by a linear-chain model over all characters of a text.

Every character is tagged: the last of a sentence, or inside one. Its score comes from hashed features of the
letters and character classes on both sides (marks skipped, so that a place looks the same with and without
them), of whether end marks occur near it at all, and, where marks, quotations or the spaces of Thai give a cue, of
what kind of cue that is and what can be read off it. Transitions score neighbouring tags; Viterbi decoding is
exact and takes time in proportion to the text: characters no tagging could end at are passed over, the others
are decided together.

Weights come from an averaged structured perceptron. There are no gold tags; it learns from the cues that are
sure, and twice from each text: as it stands, and with end marks and capitals stripped, where only wording can
tell. That second reading is what decides scripts and texts without marks: their boundaries are found between
any two characters, not at a list of places. Which words report speech behind a quotation and which follow an
ordinal's stop is counted in the same texts, not listed.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Abbreviations, without their last stop, that something always follows. Fixed values.
LEADING = set(
    "mr mrs ms sr dr dra drs prof st mt no nos nr nº n.º art vs v cf vgl bzw z d ca approx fig figs p pp pág págs pag s b i.e e.g u.a "
    "env mme mlle mm ex p.ex g env aprox sra srta ud ok np m.in tj ul inż hab mgr "
    "стр см напр им т гг ул рис проф акад д г-н π.χ κ κα vb örn yy bkz นพ พญ พ.ศ ค.ศ ดร د أ डॉ रु श्री cd viz incl inkl mio mrd mill mln tys mn milj".split()
)
#: Abbreviations a sentence can end with. Fixed values.
CLOSING = set("etc a.m p.m f.c jr ltd inc co jun jul dic ene ej u u.s uu ee h r tyg нед г руб е к млн млрд εκ χλμ usw bijv".split())
#: Short months, which a year can follow. Fixed values.
MONTHS = set("jan feb mar apr may jun jul aug sep sept oct nov dec ene abr ago dic fev mai set out dez".split())
_OPEN = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "‹": "›"}
_CLOSERS = "”»」』)）]›\"’"
_QUOTED = re.compile("[" + re.escape("".join({*_OPEN, *"".join(_OPEN.values()), '"'})) + "]")
_MARK = re.compile(r"[.!?…。！？।॥؟;;．]+")
_CLING = re.compile(r"(?:[\s  ]*(?:[:;=8][-']?[()DPp/\\|]+(?=\s|$)|[\U0001F000-\U0001FAFF☀-➿⭐️‍❤]+))+")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_ITEM = re.compile(r"(?:^|\n)[^\S\n]*([•‣◦▪●■*∙·\-–—])[^\S\n]+")
_THAI = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
_SPACE = re.compile(r"\s")
_SPACES = re.compile(r"\s+")
_SAYS_ZH = re.compile(r"^[^。！？，、“”「」\n]{0,8}(?:说|問|问|道|表示|称)")
_SAYS_KO_JA = ("と", "って", "라고", "고 ", "이라", "라며")

BITS = 18
SURE_YES, SURE_NO, UNSURE = 1, 0, 2

#: Characters of a token that are read back from a mark; what is longer is no abbreviation.
TOKEN = 40
_EMPTY: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Habits:
    """What the texts themselves show: words that go on behind a closed quotation, words that follow an ordinal's stop."""

    reporting: frozenset[str] = _EMPTY
    after_ordinal: frozenset[str] = _EMPTY


@dataclass
class Place:
    """A place where a sentence may end: ``end`` (exclusive), what the rule says, the marks and the words around."""

    end: int
    rule: int
    mark: str
    left: str
    right: str
    gap: str
    fixed: bool = False  # the end of a block


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans no sentence crosses: between blank lines and list marks, the marks and outer white space left out."""
    cuts = [0]
    spans: list[tuple[int, int]] = []
    for m in _BLANK.finditer(text):
        spans.append((cuts[-1], m.start()))
        cuts.append(m.end())
    spans.append((cuts[-1], len(text)))
    for a, b in spans:
        start = a
        body = text[a:b]
        for m in _ITEM.finditer(body):
            k = m.start()
            while k > 0 and body[k - 1].isspace():
                k -= 1
            if m.group(1) in "-–—*·∙" and k and body[k - 1] not in ".!?…。！？।؟:;»”\"')":
                continue  # a dash that a broken line begins with
            yield from _trim(text, start, a + m.start())
            start = a + m.end()
        yield from _trim(text, start, b)


def _trim(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a < b:
        yield a, b


def _nesting(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of closed quotations and brackets in a block, outermost only."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    waiting: dict[str, int] = {}  # closers that something open waits for
    straight = -1
    for m in _QUOTED.finditer(text, a, b):
        i, ch = m.start(), m.group()
        if ch == '"':
            if straight < 0:
                straight = i
            else:
                out.append((straight, i + 1))
                straight = -1
            continue
        hit = next((k for k in range(len(stack) - 1, -1, -1) if ch in stack[k][1]), -1) if waiting.get(ch) else -1
        if hit >= 0 and not (ch == "“" and stack[hit][1] != "“”"):
            out.append((stack[hit][0], i + 1))
            for _, closers in stack[hit:]:
                for c in closers:
                    waiting[c] -= 1
            del stack[hit:]
        elif ch in _OPEN:
            stack.append((i, _OPEN[ch]))
            for c in _OPEN[ch]:
                waiting[c] = waiting.get(c, 0) + 1
    out.sort(key=lambda s: (s[0], -s[1]))
    outer: list[tuple[int, int]] = []
    for s in out:
        if not outer or s[0] >= outer[-1][1]:
            outer.append(s)
    return outer


def _token_before(text: str, a: int, i: int) -> str:
    """The word (with stops inside) that ends at i, or its last ``TOKEN`` characters."""
    j, a = i, max(a, i - TOKEN)
    while j > a and not text[j - 1].isspace() and text[j - 1] not in "(（“«„「\"'’،,;:!?":
        j -= 1
    return text[j:i]


def _kind(text: str, i: int, b: int) -> str:
    """What the text goes on with at i: U(pper), l(ower), d(igit), o(ther letter), q(uote or bracket), p(unctuation), e(nd)."""
    if i >= b:
        return "e"
    ch = text[i]
    if ch in _OPEN or ch in "¿¡\"":
        return "q"
    if ch.isdigit():
        return "d"
    if ch.isupper() or ch.istitle():
        return "U"
    if ch.islower():
        return "U" if i + 1 < b and text[i + 1].isupper() else "l"
    if ch.isalpha():
        return "o"
    return "p"


def _cased(text: str, a: int, b: int) -> bool:
    """Whether a block writes capitals at all."""
    return text[a:b].lower() != text[a:b]


def places(text: str, a: int, b: int, habits: Habits = Habits()) -> list[Place]:
    """The cues of the block [a, b): places that marks, quotations or Thai spaces speak about, in order; the last is the block's end."""
    out: list[Place] = []
    nest = _nesting(text, a, b)
    opened = {e: i for i, e in nest}
    cased, looks = _cased(text, a, b), _looks_cased(text, a, b)
    k, last = 0, a

    def inside(i: int) -> tuple[int, int] | None:
        nonlocal k
        while k < len(nest) and nest[k][1] <= i:
            k += 1
        return nest[k] if k < len(nest) and nest[k][0] <= i < nest[k][1] else None

    def add(end: int, rule: int, mark: str, i: int, j: int, gap: str) -> None:
        nonlocal last
        if end <= last or end > b:
            return
        last = end
        out.append(Place(end, rule, mark, text[max(a, i - 24) : i], text[j : j + 24], gap))

    events = [(m.start(), m.end(), True) for m in _MARK.finditer(text, a, b)]
    if _THAI.search(text, a, b):
        events += [(m.start(), m.end(), False) for m in _SPACES.finditer(text, a, b)]
        # a quotation that ends a Thai sentence carries no mark of its own
        events.sort()
    for i, e, is_mark in events:
        if e <= last and is_mark:
            continue
        if not is_mark:
            prev, nxt = text[i - 1], text[e] if e < b else ""
            if not (_THAI.match(prev) or _THAI.match(nxt)) or inside(i):
                continue
            before = _token_before(text, a, i)
            if nxt == "ๆ" or nxt.isdigit() or text.startswith(("พ.ศ", "ค.ศ"), e) or before.endswith(".") or nxt in "“\"(":
                rule = SURE_NO
            elif prev == "ๆ" or prev.isdigit() or prev in _CLOSERS or prev.isascii():
                rule = UNSURE if prev not in "”" else SURE_YES
            else:
                rule = SURE_YES if _THAI.match(prev) and _THAI.match(nxt) else UNSURE
            add(i, rule, " ", i, e, " ")
            continue
        run = text[i:e]
        if run.strip(";;") == "":
            if not (i > a and "Ͱ" <= text[i - 1] <= "Ͽ" or i > a and "ἀ" <= text[i - 1] <= "῿"):
                continue
        elif ";" in run:
            e = i + len(run.rstrip(";"))
            run = text[i:e]
        if run == "." and e < b and i > a and text[i - 1].isdigit() and text[e].isdigit():
            continue
        j = e
        closed = ""
        while True:  # closing quotes and brackets, behind a space only where they close what is open
            q = j
            while q < b and text[q] in " \u00a0\u202f":
                q += 1
            ends = q < b and opened.get(q + 1, i) < i  # the quotation that is open here
            if q < b and (ends or q == j and text[q] in _CLOSERS):
                closed += text[q]
                j = q + 1
                while j < b and text[j] in "!?…。！？.؟":
                    j += 1
            else:
                break
        c = _CLING.match(text, j, b)
        clung = c is not None
        if c:
            j = c.end()
        g = j
        while g < b and text[g].isspace():
            g += 1
        gap = "" if g == j else "n" if "\n" in text[j:g] else " "
        if g >= b:
            continue  # the block's end follows
        around = inside(i)
        kind = _kind(text, g, b)
        nxt = text[g]
        word = _token_before(text, a, i)
        if around is not None and around[1] > j:
            rule = SURE_NO
        elif nxt in ",،、，;:؛：)”»」' " or (nxt in "—–-" and closed):
            rule = SURE_NO
        else:
            rule = _rule(text, a, i, run, word, closed, gap, kind, g, cased, looks, clung, around, habits)
        add(j, rule, run[:1] + closed[:1] if len(run) == 1 else run[:2] + closed[:1], i, g, gap)
    out.append(Place(b, SURE_YES, "", "", "", "", True))
    return out


def _rule(text: str, a: int, i: int, run: str, word: str, closed: str, gap: str, kind: str, g: int, cased: bool, looks: bool, clung: bool, around: tuple[int, int] | None, habits: Habits) -> int:
    """What marks, words and case say about a place outside quotations; UNSURE where they leave it open."""
    rest = text[g : g + 80]
    if closed and around is not None and closed[0] not in ")）]":
        led = text[max(a, around[0] - 3) : around[0]].rstrip()
        introduced = led != "" and led[-1] in ":,：，" or led[-2:] == "ว่า"
        if rest.startswith(_SAYS_KO_JA) or _SAYS_ZH.match(rest) or any(w in habits.reporting for w in _openings(rest)):
            return SURE_NO
        if introduced or kind in "Uqd" or (kind == "o" and not gap):
            return SURE_YES
        return SURE_NO if kind == "l" and cased else UNSURE
    if run[0] in "。！？।॥؟":
        return SURE_NO if rest.startswith(_SAYS_KO_JA[:2]) and closed else SURE_YES
    if run[0] == "…" or run.startswith(".."):
        if kind in "Uq":
            return SURE_YES
        if kind in "ld" and cased:
            return SURE_NO if kind == "l" else UNSURE
        return UNSURE if cased is False and kind == "l" else SURE_NO if kind == "o" and not gap else UNSURE
    if run[0] in "!?;;" or len(run) > 1 or clung or closed:
        if kind == "l" and cased:
            return SURE_NO
        return SURE_YES
    # a single full stop
    written = word.strip("([“«„\"'")
    bare = written.lower()
    first = re.match(r"[\w'’]+", rest)
    following = first.group().lower() if first else ""
    if bare in LEADING or bare in MONTHS and kind == "d" or (bare, following) == ("ee", "uu") or bare == "h" and re.search(r"\bd\. ?h$", text[max(a, i - 6) : i], re.I):
        return SURE_NO
    if len(bare) == 1 and bare.isalpha() and (written.isupper() or bare not in CLOSING):
        return SURE_NO
    if re.fullmatch(r"\d{1,3}", bare) and following in habits.after_ordinal:
        return SURE_NO
    if re.fullmatch(r"\d{4}", bare) and re.match(r"\d{1,2}\.", rest) or re.fullmatch(r"\d{1,2}", bare) and re.search(r"\d{4}\.\s*(?:\d{1,2}\.\s*){1,2}$", text[max(a, g - 16) : g]):
        return SURE_NO  # a date written year, month, day
    if not gap:
        if "." in word or kind in "dp" or re.match(r"[\w-]*\.\w", rest):  # addresses, versions, stops inside an abbreviation
            return SURE_NO
        if kind == "l":
            return SURE_NO if cased else UNSURE
        return SURE_YES if len(bare) > 2 else UNSURE
    if bare in CLOSING:
        return SURE_NO if kind == "l" and cased or kind == "p" else UNSURE
    if kind == "l":
        return SURE_NO if cased and not re.fullmatch(r"[\d/.,]+", bare) and looks else UNSURE
    if kind == "p":
        return UNSURE
    return SURE_YES


def _looks_cased(text: str, a: int, b: int) -> bool:
    """Whether the block's first letter is a capital, as in text that writes them at all."""
    for i in range(a, b):
        if text[i].isalpha():
            return text[i].isupper() or not text[i].islower()
    return False


_WORDS = re.compile(r"[\w'’]+")


def _openings(rest: str) -> list[str]:
    """The first word and the first two words, in lower case."""
    w = [m.group().lower() for m in _WORDS.finditer(rest)][:2]
    return w[:1] + [" ".join(w)] if len(w) == 2 else w


def learn_habits(texts: Iterable[str], least: int = 3) -> Habits:
    """Counts, over texts, of words behind quotations that surely go on and behind numbers with a stop, against how often
    the same words begin a sentence behind a sure end. A word is kept where it is seen ``least`` times and begins
    sentences less often."""
    goes_on, ordinal, begins = Counter(), Counter(), Counter()
    for text in texts:
        for m in re.finditer(r"[,，][”\"»’]\s+|[!?.…][”\"»’]\s+(?=[^\W\d_A-Z])", text):
            goes_on.update(_openings(text[m.end() : m.end() + 60]))
        for m in re.finditer(r"(?<![\w.,:-])\d{1,3}\. +(?=[^\W\d_])", text):
            ordinal.update(_openings(text[m.end() : m.end() + 60])[:1])
        for m in re.finditer(r"[^\W\d_]{3,}[.!?] +(?=[^\W\d_])", text):
            begins.update(_openings(text[m.end() : m.end() + 60]))
    keep = lambda c: frozenset(w for w, n in c.items() if n >= least and n > 2 * begins[w])
    return Habits(keep(goes_on), keep(ordinal))


#: Classes of characters, as small numbers.
SPACE, UPPER, LOWER, DIGIT, LETTER, HAN, KANA, SYLLABLE, UNSPACED, END, PAUSE, OPENER, CLOSER, OTHER = range(14)
_NEAR = 400  # characters to both sides within which an end mark makes a text one that has them


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the first 0x20000 code points; what lies beyond is taken as Han."""
    kind, low = np.full(0x20000, OTHER, np.uint8), np.arange(0x20000, dtype=np.uint32)
    for i in range(0x20000):
        ch = chr(i)
        if ch.isspace():
            kind[i] = SPACE
        elif ch in ".!?…。！？।॥؟;．":
            kind[i] = END
        elif ch in ",;:،、，；：؛·":
            kind[i] = PAUSE
        elif ch in _OPEN or ch in "¿¡":
            kind[i] = OPENER
        elif ch in _CLOSERS:
            kind[i] = CLOSER
        elif ch.isdigit():
            kind[i] = DIGIT
        elif 0x4E00 <= i <= 0x9FFF or 0x3400 <= i <= 0x4DBF or 0xF900 <= i <= 0xFAFF or ch == "々":
            kind[i] = HAN
        elif 0x3040 <= i <= 0x30FF:
            kind[i] = KANA
        elif 0xAC00 <= i <= 0xD7A3:
            kind[i] = SYLLABLE
        elif 0x0E00 <= i <= 0x0EFF or 0x1000 <= i <= 0x109F or 0x1780 <= i <= 0x17FF:
            kind[i] = UNSPACED
        elif ch.isupper() or ch.istitle():
            kind[i] = UPPER
        elif ch.islower():
            kind[i] = LOWER
        elif ch.isalpha() or 0x0300 <= i <= 0x036F or unicodedata.category(ch)[0] == "M":
            kind[i] = LETTER
        one = ch.lower()
        if len(one) == 1:
            low[i] = ord(one)
    return kind, low


_cache: list[tuple[np.ndarray, np.ndarray]] = []


def _classes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not _cache:
        _cache.append(_tables())
    kind, low = _cache[0]
    near = codes < 0x20000
    at = np.where(near, codes, 0)
    return np.where(near, kind[at], HAN).astype(np.uint64), np.where(near, low[at], codes).astype(np.uint64)


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _mix(salt: int, *parts: np.ndarray) -> np.ndarray:
    """One hashed feature for every character."""
    h = np.full(len(parts[0]), salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def character_features(text: str, cued: np.ndarray) -> np.ndarray:
    """(features, characters): what stands on both sides of every character, marks and spaces passed over.

    cued: 0 where there is no cue, else 1 and what its rule says. Left letters end at the last letter or digit up to the character, right ones begin at the next that is no space.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind, x = _classes(codes)
    n = len(codes)
    at = np.arange(n)
    letter = np.maximum.accumulate(np.where((kind >= UPPER) & (kind <= UNSPACED), at, -1))
    solid = np.where(kind != SPACE, at, n)
    following = np.minimum.accumulate(solid[::-1])[::-1]
    right = np.append(following[1:], n)
    x, kind = np.append(x, np.zeros(16, np.uint64)), np.append(kind, np.full(16, SPACE, np.uint64))
    l = lambda k: np.where(letter - k >= 0, x[np.maximum(letter - k, 0)], 0).astype(np.uint64)
    r = lambda k: x[right + k]
    gap = (right - at > 1).astype(np.uint64)
    ends = np.cumsum(kind[:n] == END)
    marked = (ends[np.minimum(at + _NEAR, n - 1)] > ends[np.maximum(at - _NEAR, 0)]).astype(np.uint64)
    here, before, then, later = kind[:n], kind[np.maximum(at - 1, 0)], kind[right], kind[right + 1]
    state = cued * np.uint64(2) + marked
    l0, l1, l2, r0, r1, r2, r3 = l(0), l(1), l(2), r(0), r(1), r(2), r(3)
    return np.stack(
        [
            _mix(1, state, here, gap, then),
            _mix(2, state, before, here, gap, then, later),
            _mix(3, state, gap),
            _mix(4, l0, gap, r0),
            _mix(5, l1, l0),
            _mix(6, l2, l1, l0),
            _mix(7, l(4), l(3), l2, l1, l0),
            _mix(8, gap, r0, r1),
            _mix(9, gap, r0, r1, r2),
            _mix(10, gap, r0, r1, r2, r3),
            _mix(11, gap, r0, r1, r2, r3, r(4), r(5)),
            _mix(12, gap, r0, r1, r2, r3, r(4), r(5), r(6), r(7)),
        ]
    )


def cue_features(p: Place) -> list[int]:
    """Hashed features of a cue: its marks, what they say, and the word they stand at."""
    word = p.left.rsplit(None, 1)[-1].lower() if p.left and not p.left[-1].isspace() else ""
    return [_h(f"m={p.mark}"), _h(f"R={p.rule}"), _h(f"R={p.rule}|m={p.mark}"), _h(f"g={p.gap}|R={p.rule}"), _h(f"m={p.mark}|lw={word}"), _h(f"m={p.mark}|l={p.left[-6:].lower()}")]


@dataclass
class Model:
    """Weights of the features (for boundary), of neighbouring tags ([previous][tag]), and the habits of the texts learnt from."""

    weights: np.ndarray
    transitions: np.ndarray
    habits: Habits = Habits()

    def scores(self, text: str, cues: Sequence[Place]) -> np.ndarray:
        """Score of a boundary after each character, chunk by chunk of overlapping context for long texts."""
        n = len(text)
        cued = np.zeros(n, np.uint64)
        cued[[p.end - 1 for p in cues]] = [1 + p.rule for p in cues]
        out, step, margin = np.empty(n, np.float32), 1 << 16, 2 * _NEAR
        for i in range(0, n, step):
            lo, hi = max(0, i - margin), min(n, i + step + margin)
            out[i : i + step] = self.weights.take(character_features(text[lo:hi], cued[lo:hi])).sum(axis=0)[i - lo : i - lo + step]
        out[[m.start() for m in _SPACE.finditer(text)]] = -1e9
        for p in cues:
            if not p.fixed:
                out[p.end - 1] += self.weights[cue_features(p)].sum()
        return out


def viterbi(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best tags of a block's characters, 1 for a boundary; inside scores 0, the tag before the block and the last are boundaries.

    A character whose score cannot make up for the best its transitions could give is inside in some best
    tagging; only the others take part in the recursion, the inside runs between them are one step.
    """
    t, n = transitions.tolist(), len(scores)
    tags = np.zeros(n, np.int8)
    if not n:
        return tags
    gain = max(t[p][1] + t[1][q] - t[p][0] - t[0][q] for p in (0, 1) for q in (0, 1))
    inside, bound, last = -1e18, 0.0, -1  # best scores by the tag of the character before
    steps: list[tuple[int, int, int, int]] = []
    for i in [*np.flatnonzero(scores[:-1] + gain > 0).tolist(), n - 1]:
        run = -1
        if i - last > 1:  # a run of characters inside
            run = int(bound + t[1][0] > inside + t[0][0])
            inside, bound = max(inside + t[0][0], bound + t[1][0]) + (i - last - 2) * t[0][0], -1e18
        stay, leave = (inside + t[0][0], bound + t[1][0]), (inside + t[0][1], bound + t[1][1])
        steps.append((i, run, int(stay[1] > stay[0]), int(leave[1] > leave[0])))
        inside, bound, last = max(stay), max(leave) + float(scores[i]), i
    tag = 1
    for i, run, from_inside, from_bound in reversed(steps):
        tags[i] = tag
        tag = from_bound if tag else from_inside
        tag = run if run >= 0 else tag
    return tags


@dataclass
class Lesson:
    """A text to learn from: features of its characters and cues, tags (or UNSURE), and the spans of its blocks."""

    features: np.ndarray
    cues: list[tuple[int, list[int]]]
    gold: np.ndarray
    spans: list[tuple[int, int]]


def _lessons(text: str, habits: Habits, openings: set[str]) -> Iterator[Lesson]:
    """The text as it stands, and stripped of end marks, quotation marks, pauses and capitals with its tags moved to what is left."""
    spans = list(blocks(text))
    chains = [places(text, a, b, habits) for a, b in spans]
    gold, cued, cues = np.zeros(len(text), np.int8), np.zeros(len(text), np.uint64), []
    for p in (p for chain in chains for p in chain):
        gold[p.end - 1] = int(p.right[:4] in openings) if p.mark == " " and p.rule == UNSURE else p.rule
        cued[p.end - 1] = 1 + p.rule
        if not p.fixed:
            cues.append((p.end - 1, cue_features(p)))
    yield Lesson(character_features(text, cued).astype(np.int32), cues, gold, spans)
    kind = _classes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))[0]
    keep = (kind < END) | (kind == OTHER)
    place = np.cumsum(keep) - 1  # where what stands at or before a character comes to lie
    bare = "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch, k in zip(text, keep) if k)
    solid = np.maximum.accumulate(np.where(keep & (kind != SPACE), np.arange(len(text)), -1))
    moved, parts = np.zeros(len(bare), np.int8), []
    for (a, b), chain in zip(spans, chains):
        lo, hi = int(place[a - 1]) + 1 if a else 0, int(place[b - 1]) + 1
        if lo < hi:
            parts.append((lo, hi))
        for p in chain:
            if solid[p.end - 1] >= a:
                moved[place[solid[p.end - 1]]] = gold[p.end - 1]
    if parts:
        yield Lesson(character_features(bare, np.zeros(len(bare), np.uint64)).astype(np.int32), [], moved, parts)


def train(texts: Iterable[str], epochs: int = 4, seed: int = 7, lean: float = 12.0) -> Model:
    """Averaged structured perceptron over the blocks of the texts, on the characters whose tag is sure.

    Unsure spaces of scripts without end marks are sure once wording is known: a boundary is followed by what
    follows sure boundaries. Other unsure cues are given the tag the model itself prefers (they never cause an
    update). Each text is learnt twice, as it stands and stripped. Learning starts from a ``lean`` towards what sure
    cues say, so that few texts do not outvote them for unknown words; 0 starts from nothing.
    """
    texts = [t for t in texts if t]
    habits = learn_habits(texts)
    spans = [(text, a, b) for text in texts for a, b in blocks(text)]
    openings = {text[a : a + 4] for text, a, _ in spans}
    openings |= {p.right[:4] for text, a, b in spans for p in places(text, a, b, habits) if p.mark == " " and p.rule == SURE_YES}
    lessons = [x for text in texts for x in _lessons(text, habits, openings)]
    w, t = np.zeros(1 << BITS, np.float32), np.zeros((2, 2))
    w[_h(f"R={SURE_YES}")], w[_h(f"R={SURE_NO}")] = lean, -lean
    wa, ta = np.zeros(1 << BITS), np.zeros_like(t)
    rng, step = np.random.default_rng(seed), 1
    for _ in range(epochs):
        for k in rng.permutation(len(lessons)):
            x = lessons[k]
            scores = w[x.features].sum(axis=0)
            for i, f in x.cues:
                scores[i] += w[f].sum()
            # sure tags are pulled towards the wrong one by a margin, so that they end up clear of it
            pulled = scores + np.where(x.gold == SURE_YES, -1.0, np.where(x.gold == SURE_NO, 1.0, 0.0))
            wrong: dict[int, int] = {}
            for a, b in x.spans:
                tags = viterbi(pulled[a:b], t)
                want = np.where(x.gold[a:b] == UNSURE, tags, x.gold[a:b])
                want[-1] = 1
                off = np.flatnonzero(want != tags)
                if not len(off):
                    continue
                wrong |= {a + i: int(want[i]) - int(tags[i]) for i in off.tolist()}
                count = lambda z: np.bincount(2 * np.append(1, z[:-1]) + z, minlength=4).reshape(2, 2)
                delta = 0.1 * (count(want.astype(int)) - count(tags.astype(int)))
                t += delta
                ta += step * delta
            for i, d in wrong.items():
                np.add.at(w, x.features[:, i], d)
                np.add.at(wa, x.features[:, i], step * d)
            for i, f in x.cues:
                if i in wrong:
                    np.add.at(w, f, wrong[i])
                    np.add.at(wa, f, step * wrong[i])
            step += 1
    return Model((w - wa / step).astype(np.float32), t - ta / step, habits)


def split(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Sentences as (start, end) in code points, end exclusive, without outer white space. Null and blank texts have none."""
    if not text:
        return []
    spans = list(blocks(text))
    cues = [p for a, b in spans for p in places(text, a, b, model.habits)]
    scores, out = model.scores(text, cues), []
    for a, b in spans:
        start = a
        for i in np.flatnonzero(viterbi(scores[a:b], model.transitions)).tolist():
            out.extend(_trim(text, start, a + i + 1))
            start = a + i + 1
    return out
