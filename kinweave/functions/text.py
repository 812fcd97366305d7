"""Text functions: normalisation, blocking keys, tokens, address parts, character trigrams. All but transliterate() and
strip_marks() are expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .indic import transliterate_text

# Words that say nothing about which business it is.
LEGAL = "private|pvt|limited|ltd|llc|l l c|inc|incorporated|corp|corporation|co|company|llp|plc|the|and|pc|pllc|lp|sarl|sas|sa|eurl|sci|gmbh"
# Letters that decomposition leaves whole, and what they become.
LIGATURES = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "’": "'"}


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ligatures(c: Column) -> Column:
    for one, more in LIGATURES.items():
        c = F.replace(c, F.lit(one), F.lit(more))
    return c


def plain(c: Column) -> Column:
    """The part of normalisation after transliteration and the removal of marks."""
    c = F.replace(F.lower(c), F.lit("&"), F.lit(" and "))
    c = F.regexp_replace(c, r"[^a-z0-9/ ,.-]", " ")
    return squeeze(F.regexp_replace(c, r"(?<![a-z0-9])[-.,/]+|[-.,/]+(?![a-z0-9])", " "))


def norm_latin(c: Column | str) -> Column:
    """Normalisation of text without marks or Indic script, in expressions alone; null becomes empty."""
    return plain(ligatures(text_or_empty(c)))


@F.pandas_udf(StringType())
def strip_marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks."""
    for s in batches:
        yield s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def transliterate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Runs of Indic script in Latin letters."""
    for s in batches:
        yield s.map(lambda t: t if t is None or t.isascii() else transliterate_text(t))


def norm(c: Column | str) -> Column:
    """Normalisation in full: null to empty, transliteration, ligatures, marks, case, punctuation, white space."""
    return plain(strip_marks(ligatures(transliterate(text_or_empty(c)))))


def without_legal(c: Column) -> Column:
    return F.regexp_replace(c, rf"\b({LEGAL})\b", " ")


def core_name(name: Column | str) -> Column:
    """A normalised name without legal words; other signs become spaces."""
    return squeeze(F.regexp_replace(without_legal(text_or_empty(name)), "[^a-z0-9 ]", " "))


def name_key(name: Column | str, addr: Column | str) -> Column:
    """Name (legal words out, signs deleted) and the address's last two tokens; empty if the name has under 3 characters."""
    own = squeeze(F.regexp_replace(without_legal(text_or_empty(name)), "[^a-z0-9 ]", ""))
    tokens = F.split(text_or_empty(addr), " ")
    tail = F.slice(tokens, F.greatest(F.size(tokens) - 1, F.lit(1)), F.lit(2))
    return F.when(F.length(own) >= 3, F.concat(own, F.lit("|"), F.array_join(tail, " "))).otherwise(F.lit(""))


def addr_key(addr: Column | str) -> Column:
    """Address with signs as spaces; empty under 12 characters."""
    own = squeeze(F.regexp_replace(text_or_empty(addr), "[^a-z0-9 ]", " "))
    return F.when(F.length(own) >= 12, own).otherwise(F.lit(""))


def tokens(c: Column | str) -> Column:
    """Distinct tokens between spaces."""
    return F.array_distinct(F.filter(F.split(text_or_empty(c), " "), lambda x: x != ""))


def numbers(c: Column | str) -> Column:
    """Distinct runs of digits, in the order of the text."""
    return F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit(r"\d+"), F.lit(0)))


def house(c: Column | str) -> Column:
    """The first run of digits, or empty."""
    return F.regexp_extract(text_or_empty(c), r"\d+", 0)


def address_parts(raw: Column | str) -> Column:
    """Parts of a raw address between commas, lowered, signs as spaces, of two characters or more."""
    parts = F.transform(F.split(F.lower(text_or_empty(raw)), ","), lambda p: squeeze(F.regexp_replace(p, r"[^\p{L}\p{N} ]", " ")))
    return F.filter(parts, lambda p: F.length(p) >= 2)


def region_keys(parts: Column) -> Column:
    """Of each part itself, its first and last token and its first and last two."""
    def of(p: Column) -> Column:
        t = F.split(p, " ")
        n = F.size(t)
        two = F.when(n >= 2, F.array(F.array_join(F.slice(t, F.lit(1), F.lit(2)), " "), F.array_join(F.slice(t, n - 1, F.lit(2)), " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(p, t[0], F.element_at(t, -1)), two)

    return F.array_distinct(F.flatten(F.transform(parts, of)))


def has_digit(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(r"\p{Nd}")


def non_latin(*raw: Column | str) -> Column:
    """Whether a raw text has characters of another script than Latin."""
    return F.concat_ws(" ", *[text_or_empty(c) for c in raw]).rlike(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]")


def crc(c: Column | str, seed: int) -> Column:
    """CRC-32 of an id with a seed."""
    return F.crc32(F.concat(F.lit(f"{seed}:"), F.col(c) if isinstance(c, str) else c).cast("binary"))


def unit_hash(c: Column | str, seed: int) -> Column:
    """A number in [0, 1) from an id: its CRC-32 with a seed."""
    return crc(c, seed) / F.lit(4294967296.0)


def record_text(name: Column | str, addr: Column | str) -> Column:
    return F.concat(text_or_empty(name), F.lit(", "), text_or_empty(addr))


def _words(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(text_or_empty(c)), r"\s+"), lambda w: w != "")


def word_bag(c: Column | str) -> Column:
    """The words of which word_trigrams() takes trigrams, in order, repeats included: one for all texts of the same words."""
    return F.array_join(F.array_sort(_words(c)), " ")


def word_trigrams(c: Column | str) -> Column:
    """Character trigrams of each word with a space on both sides, repeats included."""
    words = _words(c)

    def of(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.flatten(F.transform(words, of))
