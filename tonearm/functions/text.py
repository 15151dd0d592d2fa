"""Scalar functions on names, paths and tags, as column expressions. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEM = r"(?s)\A((?:.*/)?\.*[^./][^/]*)\.[^./]*\z"
#: cp1255 letters as they look when read as cp1252, and the Hebrew letters that they stand for, both by code point.
MOJIBAKE = "".join(map(chr, range(0xE0, 0xFB)))
HEBREW = "".join(map(chr, range(0x5D0, 0x5EB)))
TRACK_WORD = "רצועה"
#: Words that give an advertising genre away.
AD_WORDS = ("download", "advertisement", "promo")


def stem(path: Column) -> Column:
    """The path without its last extension; names that begin with dots have none for these."""
    return F.regexp_replace(path, STEM, "$1")


def extension(path: Column) -> Column:
    """The last extension with its dot, lower case; empty if there is none."""
    return F.lower(F.substring(path, F.length(stem(path)) + 1, F.length(path)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def parent_name(path: Column) -> Column:
    """Name of the directory that holds the path; null for a bare name."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}", "")


def letters_only(text: Column) -> Column:
    """Letters and numbers that are not digits, superscripts and subscripts left out too."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{Nl}\p{No}]", ""), "[²³¹⁰-⁹₀-₉]", "")


#: White space at either end of a text, of any kind, as a character class body.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends (`trim` takes blanks only)."""
    return F.regexp_replace(text, rf"\A[{BLANKS}]+|[{BLANKS}]+\z", "")


def contains_hebrew(text: Column) -> Column:
    return text.rlike("[֐-ת]")


def is_mojibake(text: Column) -> Column:
    """More characters of the Hebrew code page read as Latin than plain Latin letters, and no Hebrew."""
    odd = F.length(text) - F.length(F.translate(text, MOJIBAKE, ""))
    latin = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
    return (odd > latin) & ~contains_hebrew(text)


def fix_mojibake(text: Column) -> Column:
    return F.when(is_mojibake(text), F.translate(text, MOJIBAKE, HEBREW)).otherwise(text)


def replace_track_word(text: Column, keep_case: bool = False) -> Column:
    """`track` in Hebrew. keep_case: only lower-case `track` is found and the rest stays; else the whole text is lowered
    where the word occurs in any case."""
    if keep_case:
        return F.replace(text, F.lit("track"), F.lit(TRACK_WORD))
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("track")), F.replace(low, F.lit("track"), F.lit(TRACK_WORD))).otherwise(text)


def is_ad_genre(genre: Column) -> Column:
    return F.coalesce(F.lower(genre).rlike("|".join(AD_WORDS)), F.lit(False))


def repeating_name(name: Column) -> Column:
    """What stands before ` - Track N`; empty if nothing does."""
    return F.regexp_extract(name, r"(?i)\A(.*?)\s*-\s*Track\s*[0-9]+", 1)


def without_repeating_name(name: Column) -> Column:
    """name with every occurrence of its repeating part removed, any case, and blanks, dashes and underscores trimmed."""
    part = repeating_name(name)
    quoted = F.concat(F.lit(r"(?i)\Q"), part, F.lit(r"\E"))
    return F.when(part != "", F.btrim(F.regexp_replace(name, quoted, F.lit("")), F.lit(" -_")))


def bitrate_score(mean_kbps: Column, preferred: str = "high") -> Column:
    """0 to 1: `high` grows up to 320 kbps, `128` falls with the distance to 128, anything else scores nothing."""
    if preferred == "high":
        return F.least(mean_kbps / 320, F.lit(1.0))
    if preferred == "128":
        return F.greatest(F.lit(1.0) - F.abs(mean_kbps - 128) / 192, F.lit(0.0))
    return F.lit(0.0)


def present(text: Column) -> Column:
    """The text, or null if it is empty: an empty tag counts as missing."""
    return F.nullif(text, F.lit(""))


def tags_complete(title: Column, artist: Column, album: Column, garbled: bool = False) -> Column:
    """All three present and none garbled. garbled: garbled ones count as present."""
    good = [present(c).isNotNull() if garbled else F.coalesce(present(c).isNotNull() & ~is_mojibake(c), F.lit(False)) for c in (title, artist, album)]
    return good[0] & good[1] & good[2]


def required_similarity(text: Column, strict: bool = True) -> Column:
    """The longer a name, the less of it has to agree; loose falls twice as fast."""
    return F.lit(1.0) - F.length(F.replace(text, F.lit(" "), F.lit(""))) * (0.01 if strict else 0.02)
