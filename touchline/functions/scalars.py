"""Guarded arithmetic, labels, dates and text rules as column expressions (all JVM-side but ``fold_name``)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_number(c: Column) -> Column:
    """A double with NaN as null; anything that is no number is null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def plain_number(kind: T.DataType) -> bool:
    """Whether a type is a number's (flags are none)."""
    return isinstance(kind, T.NumericType)


def guarded_rate(num: Column, den: Column, least: float = 0.0, inclusive: bool = False) -> Column:
    """num / den where den is over ``least`` (or reaches it), else null."""
    ok = den >= least if inclusive else den > least
    return F.when(ok & (den != 0), num / den)


def flag(c: Column) -> Column:
    """A comparison with null as False."""
    return F.coalesce(c, F.lit(False))


def clip_lower(c: Column, low: float = 0.0) -> Column:
    """c, but not under ``low``; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def completeness(columns: Sequence[Column]) -> Column:
    """Share of columns that are not null."""
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns]) / F.lit(float(len(columns)))


def first_source(choices: Sequence[tuple[str, Column]], none: str = "none") -> tuple[Column, Column]:
    """The first non-null value in order of priority, and the name of its source from the same condition."""
    value = F.coalesce(*[c for _, c in choices])
    label = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in choices], F.lit(none))
    return value, label


def mapped(c: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Lookup in a small literal map; ``default`` where the key is missing or null."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.when(c.isNotNull(), F.try_element_at(m, c)), F.lit(default)) if default is not None else F.when(c.isNotNull(), F.try_element_at(m, c))


def first_token(c: Column, table: Mapping[str, str], unknown: str | None = None, strict: bool = False) -> Column:
    """First comma-separated token by a taxonomy. An unknown one gives ``unknown``, or an error where strict."""
    token = F.trim(F.split_part(c, F.lit(","), F.lit(1)))
    out = mapped(token, table)
    if strict:
        return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(out, F.raise_error(F.concat(F.lit("no class for "), c)).cast("string")))
    return out if unknown is None else F.coalesce(out, F.lit(unknown))


def key_of(*columns: Column, separator: str = "|") -> Column:
    """A composite key in which null counts as the empty text, so that nulls match."""
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def synthetic_id(*columns: Column, prefix: str = "synthetic_", digits: int = 12) -> Column:
    """prefix and the first digits of the SHA-256 of the composite key."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(key_of(*columns), 256), 1, digits))


def slug(c: Column) -> Column:
    """Lower case with u for ü and underscores for spaces, as folders of leagues are named."""
    return F.translate(F.lower(c), "ü ", "u_")


def months_until(end: Column, start: Column, days_per_month: float = 30.44) -> Column:
    """Months from start to end, 0 once it is past; null where a date is."""
    return clip_lower(F.datediff(end, start) / days_per_month)


def age_at(born_on: Column, born_year: Column, on: Column) -> tuple[Column, Column]:
    """(age in years, precision): exact from a date of birth, else the difference of years, ``year_only`` even where that is null."""
    exact = F.datediff(on, born_on) / 365.25
    rough = (F.year(on) - born_year).cast("double")
    return F.coalesce(exact, rough), F.when(born_on.isNotNull(), "exact").otherwise("year_only")


def transfer_window(on: Column) -> Column:
    """winter for January and February, else summer; null for a null date."""
    return F.when(F.month(on).isin(1, 2), "winter").when(on.isNotNull(), "summer")


def next_period(season: Column) -> Column:
    """'2021-22' -> '2022-23'."""
    y = F.substring(season, 1, 4).cast("int") + 1
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def extrapolated(year: Column, table: Mapping[int, float], growth: float = 1.15) -> Column:
    """Value of a year by table; beyond its last year, grown by ``growth`` a year; null before its first."""
    last = max(table)
    m = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))])
    return F.when(year > last, F.lit(float(table[last])) * F.pow(F.lit(growth), year - last)).otherwise(F.try_element_at(m, year))


def fee_parts(text: Column) -> tuple[Column, Column]:
    """(amount, kind) of a fee as written: '€1.5m' -> (1500000, 'paid').

    Free transfers come first, then ends of loans, then loans; none has an amount. A number counts where the text
    begins with it (without the euro sign), its commas dropped ('1,5m' is 15 million), times bn, m or k. All else,
    and a number that is none ('1.2.3'), is undisclosed.
    """
    t = F.trim(F.replace(F.lower(F.trim(F.replace(text, F.lit("\u00a0"), F.lit(" ")))), F.lit("€"), F.lit("")))
    begin = r"^([\d.,]+)\s*(bn|m|k)?"
    number = F.replace(F.regexp_extract(t, begin, 1), F.lit(","), F.lit("")).try_cast("double")
    factor = mapped(F.regexp_extract(t, begin, 2), {"bn": 1e9, "m": 1e6, "k": 1e3}, 1.0)
    kind = F.when(text.isNull(), "undisclosed")
    for word, name in (("free", "free"), ("end of loan", "end_of_loan"), ("loan", "loan")):
        kind = kind.when(t.contains(word), name)
    kind = kind.when(number.isNotNull(), "paid").otherwise("undisclosed")
    return F.when(kind == "paid", number * factor), kind


def year_of(c: Column) -> Column:
    """The year in a date as people write it: the four digits in a row that begin with 19 or 20; null without."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"(?<!\d)((?:19|20)\d\d)(?!\d)", 1), F.lit("")), F.lit("9999")).cast("int")


def folded(c: Column) -> Column:
    """Letters of a text in lower case without marks, JVM-side, for short closed vocabularies."""
    plain = F.translate(F.lower(F.replace(c, F.lit("İ"), F.lit("i"))), "áàâäãåčçćéèêëğíìîïıñóòôöõøřšşúùûüýž", "aaaaaaccceeeegiiiiinoooooorssuuuuyz")
    return F.regexp_replace(plain, "[^a-z]", "")


#: Letters that Unicode decomposition leaves whole. Fixed values.
WHOLE_LETTERS = {"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i", "ħ": "h"}


def plain_letters(text: str) -> str:
    """Case folded, without marks, letters that decomposition leaves whole by their usual spelling."""
    text = "".join(WHOLE_LETTERS.get(ch, WHOLE_LETTERS.get(ch.lower(), ch)) for ch in text)
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)).casefold()


def fold_text(name: str | None) -> str | None:
    """Latin letters and digits in lower case without marks; apostrophes vanish, all else parts words, spaces are squeezed."""
    if name is None:
        return None
    return " ".join(re.sub(r"[^a-z0-9]+", " ", re.sub("['’]", "", plain_letters(name))).split())


def fold_compact(text: str | None) -> str | None:
    """Latin letters and digits alone, for names of countries."""
    return None if text is None else re.sub(r"[^a-z0-9]", "", plain_letters(text))


def fold_ascii(name: str | None) -> str | None:
    """The plainer fold of source cross-checks: letters outside ASCII are dropped, marks too, gaps are kept as they are."""
    if name is None:
        return None
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z ]", " ", text).strip()


def _each_distinct(c: Column, f: Callable[[str], str | None]) -> Column:
    """f over Arrow batches, once for each distinct text of a batch."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map({t: f(t) for t in texts.dropna().unique()})

    return run(c)


def fold_name(c: Column) -> Column:
    """``fold_text`` of a column."""
    return _each_distinct(c, fold_text)


def fold_country(c: Column) -> Column:
    """``fold_compact`` of a column."""
    return _each_distinct(c, fold_compact)


def fold_name_ascii(c: Column) -> Column:
    """``fold_ascii`` of a column."""
    return _each_distinct(c, fold_ascii)


def initials(folded: Column, lone_to_letter: bool = True) -> Column:
    """First word as its letter: 'lionel messi' -> 'l messi'. A lone word becomes a letter too unless told otherwise."""
    words = F.split(folded, " ")
    many = F.concat_ws(" ", F.concat(F.array(F.substring(folded, 1, 1)), F.slice(words, 2, F.size(words))))
    return F.when(F.size(words) > 1, many).otherwise(F.substring(folded, 1, 1) if lone_to_letter else folded)


#: Words of a club's name that mean another, and words that say nothing. Fixed values.
CLUB_ALIASES = {"utd": "united", "inter": "internazionale", "wolves": "wolverhampton", "spurs": "tottenham", "psg": "paris"}
CLUB_STOPWORDS = ["fc", "afc", "cf", "sc", "ac", "as", "ss", "ssc", "us", "ud", "cd", "rc", "club", "calcio", "de", "of"]


def club_key(c: Column, aliases: Mapping[str, str] = CLUB_ALIASES, stopwords: Sequence[str] = CLUB_STOPWORDS) -> Column:
    """A club's folded name with aliases put in and empty words left out; '' for a name of such words alone, null for null."""
    words = F.filter(F.split(fold_name(c), " "), lambda w: w != "")
    meant = F.transform(words, lambda w: F.coalesce(mapped(w, aliases), w))
    return F.array_join(F.filter(meant, lambda w: ~w.isin(list(stopwords))), " ")


def nationality(c: Column, codes: Mapping[str, str], countries: Sequence[str], aliases: Mapping[str, str] | None = None) -> Column:
    """The canonical country of a code, a canonical name, an alias or another spelling, tried in that order; else null."""
    t = F.trim(c)
    tries = [mapped(t, codes), F.when(t.isin(list(countries)), t)]
    if aliases:
        tries.append(mapped(t, aliases))
    return F.coalesce(*tries, mapped(fold_country(t), {fold_compact(x): x for x in countries}))


def require_targets(codes: Mapping[str, str], countries: Sequence[str]) -> None:
    """ValueError where a code leads to a country that is none of ``countries``."""
    lost = sorted(set(codes.values()) - set(countries))
    if lost:
        raise ValueError(f"codes lead to unknown countries: {lost[:10]}")


def matches_text(c: Column, pattern: str) -> Column:
    """Whether a regular expression occurs in a text, whatever the case; null as False."""
    return flag(c.rlike("(?i)" + pattern))


def between_dates(c: Column, first: str, last: str) -> Column:
    """Dates from first to last, both included; null as False."""
    return flag(c.cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
