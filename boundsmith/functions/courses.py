"""Recognising courses in clauses: lines, curves, ties and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundsmith.functions.text import extract, matches, repair_bearings, says

# The pattern of a quadrant bearing and of a line course around it.
BEARING = r"(NORTH|SOUTH|N|S)\s*(\d{1,3})\s*°\s*(\d{1,2})\s*'\s*(?:(\d{1,2}(?:\.\d+)?)\s*\"?)?\s*,?\s*(EAST|WEST|E|W)\b"
CLEAN = r"(?iU)" + BEARING + r"\s*,?\s*(?:a\s+distance\s+of\s+)?(\d+(?:\.\d+)?)\s*(?:feet|foot|ft)?\b"
NARRATIVE = r"(?iU)" + BEARING + r"\s+[A-Za-z][^,]{0,160}?,?\s+(\d+(?:\.\d+)?)\s+(?:feet|foot|ft)\b"
DEED = r"(?iU)" + BEARING + r"\s*,?\s*[^;]{1,250}?(\d+(?:\.\d+)?)\s+(?:feet|foot|ft)\b"
TAIL = r"(?iU)(\d+(?:\.\d+)?)\s*(?:feet|foot|ft)?$"
FEET = r"(?iU)\d+(?:\.\d+)?\s*(?:feet|foot|ft)\b"
# Phrases of reference ties, beginnings and notes.
TIE_PHRASES = (
    r"\bFROM\s+THE\s+[A-Z]+(?:\s+[A-Z]+)?\s+CORNER\b|\bFROM\s+THE\s+POINT\s+OF\s+BEGINNING\b|\bDISTANT\b[^.;]{0,120}\bFROM\b"
    r"|\bMEASURED\s+ALONG\b[^.;]{0,120}\bFROM\b|\bBEING\b[^.;]{0,120}\bFROM\b"
)
POINT_OF_BEGINNING = r"(?iU)\bPOINT\s+OF\s+BEGINNING\b"
DIRECTION_ONLY = r"(?iU)\bTHENCE\s+(NORTH(?:EAST(?:ERLY)?|WEST(?:ERLY)?|ERLY)?|SOUTH(?:EAST(?:ERLY)?|WEST(?:ERLY)?|ERLY)?|EAST(?:ERLY)?|WEST(?:ERLY)?)\b"
BOILERPLATE = "COMMENCING|BEGINNING AT|POINT OF BEGINNING"
REFERENCE = "TRACT|RECORDED|OFFICIAL RECORDS|MAP|COUNTY|LOT|SECTION|BLOCK|RIGHT-OF-WAY|RIGHT OF WAY"
# The parts of a curve course.
CURVE_WORD = r"(?iU)\b(curve|radius|arc|central\s+angle|delta|tangent|concave)\b"
RADIUS = r"(?iU)\bRADIUS(?:\s+OF)?\s+(\d+(?:\.\d+)?)\s*(?:FEET|FOOT|FT)\b"
ARC = r"(?iU)\b(?:AN\s+)?ARC(?:\s+DISTANCE|\s+LENGTH)?(?:\s+OF)?\s+(\d+(?:\.\d+)?)\s*(?:FEET|FOOT|FT)\b"
DELTA = r"(?iU)\b(?:CENTRAL\s+ANGLE|DELTA)(?:\s+OF)?\s+(\d{1,3})\s*(?:°|DEGREES?)\s*(\d{1,2})?\s*(?:'|MINUTES?)?\s*(\d{1,2}(?:\.\d+)?)?\s*(?:\"|SECONDS?)?"
SIDE = r"(?iU)\b(?:TO\s+THE\s+)?(RIGHT|LEFT)\b"
CONCAVE = r"(?iU)\bCONCAVE\s+((?:NORTH|SOUTH)(?:EAST|WEST)?ERLY|(?:EAST|WEST)ERLY)\b"

LETTER = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "N": "N", "S": "S", "E": "E", "W": "W"}


#: The parts of a matched slice: bearing, then the distance at its end.
PARTS = r"(?iU)^" + BEARING + r"(?s:.*?)(\d+(?:\.\d+)?)\s*(?:feet|foot|ft)?$"


def _got(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _with_match(df: DataFrame, text: str, out: str, plain: Column | None) -> DataFrame:
    """Adds the slice of the tightest pattern that matches, null if none does.

    Each pattern has a projection of its own and runs only where the tighter ones
    failed; a text without degree sign is never searched.
    """
    t = F.col(text)
    df = df.withColumn(out, F.when(t.contains("°"), extract(t, CLEAN, 0, plain)))
    for pattern in (NARRATIVE, DEED):
        df = df.withColumn(out, F.when(F.col(out) == "", extract(t, pattern, 0, plain)).otherwise(F.col(out)))
    return df.withColumn(out, F.nullif(out, F.lit("")))


def with_line(df: DataFrame, text: str, out: str, plain: Column | None = None) -> DataFrame:
    """Adds struct ``raw, ns, deg, minute, sec, ew, dist, valid`` of the line course in ``text``, null if there is none.

    Patterns are tried on the text and then on the repaired text.  Matching, repairing
    and cutting the parts have projections of their own, so that no plan evaluates
    a pattern twice, and repairs run only where they are needed.
    """
    df = _with_match(df, text, "__plain", plain)
    df = df.withColumn("__fixed", F.when(F.col("__plain").isNull(), repair_bearings(F.col(text))))
    df = df.withColumn("__fixed", F.when(F.col("__fixed") != F.col(text), F.col("__fixed")))
    df = _with_match(df, "__fixed", "__again", plain)
    df = df.withColumn("__match", F.trim(F.coalesce("__plain", "__again")))
    told = F.col("__match")
    full = F.regexp_replace(told, PARTS, "$1|$2|$3|$4|$5|$6")
    cut = full if plain is None else F.when(plain, F.regexp_replace(told, PARTS.replace("(?iU)", "(?i)"), "$1|$2|$3|$4|$5|$6")).otherwise(full)
    df = df.withColumn("__parts", F.split(cut, r"\|"))
    part = lambda k: F.col("__parts")[k]
    letter = lambda k: F.upper(F.substring(part(k), 1, 1))
    df = df.withColumn(
        out,
        F.struct(
            told.alias("raw"), letter(0).alias("ns"), part(1).cast("int").alias("deg"), part(2).cast("int").alias("minute"),
            F.when(part(3) == "", 0.0).otherwise(part(3).cast("double")).alias("sec"), letter(4).alias("ew"), part(5).cast("double").alias("dist"),
        ),
    )
    got = F.col(out)
    valid = got["deg"].between(0, 360) & (got["minute"] < 60) & (got["sec"] < 60) & (got["dist"] > 0)
    return df.withColumn(out, F.when(told.isNotNull(), got.withField("valid", valid))).drop("__plain", "__fixed", "__again", "__match", "__parts")


def has_bearing(text: Column, plain: Column | None = None) -> Column:
    pattern = "(?iU)" + BEARING
    marked = text.contains("°") | text.contains('"')
    return marked & (matches(text, pattern, plain) | matches(repair_bearings(text), pattern, plain))


def curve_of(text: Column) -> Column:
    """Struct of a curve course; null without curve word, radius, and arc or angle."""
    radius, arc, delta = _got(text, RADIUS, 1), _got(text, ARC, 1), _got(text, DELTA, 1)
    concave = _got(text, CONCAVE, 1)
    return F.when(
        text.rlike(CURVE_WORD) & radius.isNotNull() & (arc.isNotNull() | delta.isNotNull()),
        F.struct(
            F.trim(text).alias("raw"),
            F.when(text.rlike(r"(?iU)\bTANGENT\b"), "tangent").otherwise("non_tangent").alias("curve_type"),
            radius.cast("double").alias("radius"),
            arc.cast("double").alias("arc"),
            delta.cast("int").alias("delta_deg"),
            F.when(delta.isNotNull(), F.coalesce(_got(text, DELTA, 2).cast("int"), F.lit(0))).alias("delta_min"),
            F.when(delta.isNotNull(), F.coalesce(_got(text, DELTA, 3).cast("double"), F.lit(0.0))).alias("delta_sec"),
            F.lower(_got(text, SIDE, 1)).alias("handedness"),
            F.concat(F.lit("CONCAVE "), F.upper(concave)).alias("along_feature"),
        ),
    )


def is_reference_tie(text: Column) -> Column:
    # Every phrase holds FROM, so most clauses aren't searched.
    return says(text, "FROM") & ~says(text, "^ *THENCE") & text.rlike("(?iU)" + TIE_PHRASES)


def has_tie_keyword(text: Column) -> Column:
    return says(text, "SAID POINT BEING|AS MEASURED ALONG")


def starts_before_beginning(text: Column) -> Column:
    """A COMMENCING preamble stands before the first THENCE."""
    preamble = F.split(text, r"(?iU)\bTHENCE\b", 2)[0]
    return says(text, "COMMENC") & preamble.rlike(r"(?iU)\bCOMMENCING\b")


def note_type(text: Column) -> Column:
    return (
        F.when(text.rlike(DIRECTION_ONLY), "Unresolved Direction-Only Call").when(F.upper(text).rlike(BOILERPLATE), "Boilerplate")
        .when(F.upper(text).rlike(REFERENCE), "Reference / Context").otherwise("Unknown / Unparsed")
    )


def note_direction(text: Column) -> Column:
    return F.upper(_got(text, DIRECTION_ONLY, 1))


def note_distance(text: Column) -> Column:
    stated = F.nullif(F.regexp_extract(text, r"(?iU)(\d+(?:\.\d+)?)\s*(?:feet|foot|ft)\b", 1), F.lit("")).cast("double")
    return F.when(text.rlike(DIRECTION_ONLY), stated)


def effective_distance(text: Column, direction: Column, dist: Column) -> Column:
    """Null where the stated distance locates the target point instead of the leg."""
    upper, word = F.upper(text), F.upper(direction)
    at = F.instr(upper, word)
    token = F.regexp_instr(upper, F.lit(r"(?U)\d+(?:\.\d+)?\s*(?:FEET|FOOT|FT)\b"))
    begin = at + F.length(word)
    between = F.when(token > begin, F.substring(upper, begin, token - begin)).otherwise(F.lit(""))
    offset = between.contains("DISTANT") | between.contains("TO A ") | between.contains("TO THE ")
    return F.when((at > 0) & (token > 0) & offset, None).otherwise(dist)
