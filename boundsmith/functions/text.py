"""Text normalisation of legal descriptions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike characters and the words that stand for marks.
LOOKALIKES = "‘’“”º˚–—"
_PLAIN = "''\"\"°°--"
_MARK_WORDS = ((r"(?iU)\bDEGREES?\b", "°"), (r"(?iU)\bMINUTES?\b", "'"), (r"(?iU)\bSECONDS?\b", '"'))
_TIGHT = ((r"(?U)(?<=\d)\s+°", "°"), (r"(?U)°\s+(?=\d)", "°"), (r"(?U)(?<=\d)\s+'", "'"), (r"(?U)'\s+(?=\d)", "'"), (r'(?U)(?<=\d)\s+"', '"'))

# Misread bearing marks and their repair, in the order they apply.
_REPAIRS = (
    (r"(?<!\d)'(?=\d{1,3}°)", ""),
    (r"(?<![\d°'])(\d{1,3})\"(?=\s*\d{1,2}\s*[°'\"!)¢*%])", "$1°"),
    (r"(\d{1,3}°\s*\d{1,2})\s*°", "$1'"),
    (r"(\d{1,3}°\s*\d{1,2})\s*\"", "$1'"),
    (r"(\d{1,3}°\s*\d{1,2})\s*[!)¢*]", "$1'"),
    (r"(\d{1,3}°\s*\d{1,2}\s*'\s*\d{1,2})\s*%", '$1"'),
    (r"(?i)(\d{1,4}),(\d{1,2})(?=\s*(?:feet|foot|ft)\b)", "$1.$2"),
)


def is_plain(text: Column) -> Column:
    """ASCII but for degree signs: there, patterns need no tables of Unicode classes."""
    return ~text.rlike(r"[^\x00-\x7F°]")


def _quick(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("(?sU)", "(?s)")


def extract(text: Column, pattern: str, group: int = 0, plain: Column | None = None) -> Column:
    """``regexp_extract``; with ``plain`` told, by the cheaper pattern where it gives the same."""
    full = F.regexp_extract(text, pattern, group)
    return full if plain is None else F.when(plain, F.regexp_extract(text, _quick(pattern), group)).otherwise(full)


def matches(text: Column, pattern: str, plain: Column | None = None) -> Column:
    full = text.rlike(pattern)
    return full if plain is None else F.when(plain, text.rlike(_quick(pattern))).otherwise(full)


def says(text: Column, word: str) -> Column:
    """Whether a text holds the capital words in any case; upper-casing a text with a degree sign costs far more than a search."""
    return text.rlike("(?iu)" + word)


def _chain(text: Column, steps: tuple, plain: bool = False) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, _quick(pattern) if plain else pattern, to)
    return text


def normalize(text: Column, plain: bool = False) -> Column:
    """Plain marks, degree words as marks, single spaces; null gives ''.

    ``plain`` tells that the text is plain once look-alikes are replaced.
    """
    text = F.translate(F.coalesce(text, F.lit("")), LOOKALIKES, _PLAIN)
    return F.trim(F.regexp_replace(_chain(text, _MARK_WORDS + _TIGHT, plain), r"\s+" if plain else r"(?U)\s+", " "))


def spans(text: Column, pattern: str) -> Column:
    """Structs ``start, end, value`` of all matches, from the lengths of them and of what lies between."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(done: Column, value: Column) -> Column:
        at = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)) + F.length(F.get(gaps, F.size(done)))
        return F.concat(done, F.array(F.struct(at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"))))

    return F.aggregate(found, F.array().cast("array<struct<start:int,end:int,value:string>>"), step)


def repair_bearings(text: Column) -> Column:
    """OCR repairs inside bearings; clean text stays as it is.

    Every repair needs a degree sign, a double quote, or a number with a comma.
    """
    marked = text.contains("°") | text.contains('"')
    return F.when(marked, _chain(text, _REPAIRS)).otherwise(F.when(text.contains(","), _chain(text, _REPAIRS[-1:])).otherwise(text))


def clean_label(text: Column) -> Column:
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.upper(F.trim(F.regexp_replace(text, r":+$", "")))


def normalize_loose(text: Column) -> Column:
    """Quotes, dashes and white space only, as the older dialect does first."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), LOOKALIKES, _PLAIN), r"(?U)\s+", " "))


def bearing_text(ns: Column, deg: Column, minute: Column, sec: Column, ew: Column) -> Column:
    return F.format_string("%s %d°%02d'%02d\" %s", ns, deg, minute, sec.cast("int"), ew)
