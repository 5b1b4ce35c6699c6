"""The older dialect: cardinals, azimuths, compact calls, narratives, ties with parts, closing calls.

It never runs unless asked for; the default dialect is in ``clauses``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundsmith.functions import bearings as B
from boundsmith.functions.courses import LETTER
from boundsmith.functions.text import says, spans
from boundsmith.operators.tables import CARDINAL_AZIMUTH

# Look-alikes and marks that this dialect repairs.
_REPAIRS = (
    (r"\|", "1"), ("l00", "100"), ("I00", "100"), ("[Oo]°", "0°"),
    (r"(?i)\bDEGREES?\b", "°"), (r"(?i)\bMINUTES?\b", "'"), (r"(?i)\bSECONDS?\b", '"'),
    (r"(?<=\d)[^\S\n]+°", "°"), (r"°[^\S\n]+(?=\d)", "°"), (r"(?<=\d)[^\S\n]+'", "'"), (r"'[^\S\n]+(?=\d)", "'"), (r"(?<=\d)[^\S\n]+\"", '"'),
)
_UNIT = r"(?:feet|foot|ft)?\.?"
_NUM = r"(\d+(?:\.\d+)?)"
# The courses of this dialect.
CARDINAL = rf"(?i)^\s*(N|S|E|W)\s+{_NUM}\s*{_UNIT}\s*$"
QUADRANT = rf"(?i)(NORTH|SOUTH|N|S)\s*(\d{{1,3}})\s*°\s*(?:(\d{{1,2}})\s*'\s*)?(?:(\d{{1,2}}(?:\.\d+)?)\s*\"?)?\s*(EAST|WEST|E|W)\s*,?\s*(?:a\s+distance\s+of\s+)?{_NUM}\s*{_UNIT}"
AZIMUTH = rf"(?i)^\s*(\d{{1,3}})\s*°\s*(\d{{1,2}})\s*'\s*(\d{{1,2}}(?:\.\d+)?)\s*\"\s+{_NUM}\s*{_UNIT}\s*$"
CURVE = rf"(?i)\bCURVE(?:\s+TO\s+THE)?\s+(RIGHT|LEFT)\b.*?\bRADIUS\s+(?:OF\s+)?{_NUM}\s*(?:FEET|FOOT|FT)\b"
CURVE_ARC = rf"(?i)\bARC(?:\s+LENGTH)?(?:\s+OF)?\s+{_NUM}\s*(?:FEET|FOOT|FT)\b"
CURVE_ANGLE = r"(?i)\b(?:CENTRAL\s+ANGLE|DELTA)(?:\s+OF)?\s+(\d{1,3})\s*°\s*(\d{1,2})\s*'\s*(?:(\d{1,2}(?:\.\d+)?)\s*\"?)?"
_STATED = r"(?=\s+TO\b|[,;.]|$)"
WORDY = rf"(?i)^\s*(NORTH|SOUTH|EAST|WEST)\s*,?\s+{_NUM}\s*(?:FEET|FOOT|FT)?{_STATED}"
ARC_ONLY = rf"(?is)(?:ALONG\s+)?A\s+CURVE\s+TO\s+THE\s+(?:RIGHT|LEFT).*?\bARC(?:\s+LENGTH)?(?:\s+OF)?\s+{_NUM}\s+FEET{_STATED}"
PROSE_QUADRANT = rf"(?i)(?:THENCE|BEING|FROM|THEN)\s+(NORTH|SOUTH)\s+(\d+)\s*°\s*(?:(\d+)\s*'?\s*)?(?:(\d+)\s*['\"]?\s*)?(EAST|WEST).*?{_NUM}"
# The courses of prose, pass by pass.
PROSE_COURSE = rf"(?is)THENCE\s+(NORTH|SOUTH)\s+(\d{{1,3}})\s*(?:DEGREES?\s+|°)\s*(\d{{1,2}})\s*['\"]\s*(?:(\d{{1,2}}(?:\.\d+)?)\s*\"\s*)?(EAST|WEST).*?{_NUM}\s+FEET{_STATED}"
PROSE_POINT = rf"(?i)(NORTH|SOUTH)\s+(\d{{1,3}})\s*(?:DEGREES?\s+|°)\s*(\d{{1,2}})\s*['\"]\s*(\d{{1,2}}(?:\.\d+)?)\s*\"\s*(EAST|WEST)[,\s]+{_NUM}\s+FEET\s+TO\s+A\s+POINT"
PROSE_CARDINAL = rf"(?i)THENCE\s+(EAST|WEST|NORTH|SOUTH)\s+{_NUM}\s+FEET{_STATED}"
PROSE_CURVE = rf"(?is)THENCE\s+(?:ALONG\s+)?A\s+CURVE\s+TO\s+THE\s+(?:RIGHT|LEFT).*?\bARC(?:\s+LENGTH)?(?:\s+OF)?\s+{_NUM}\s+FEET{_STATED}"
PROSE_OTHER = r"(?i)\bTHENCE\b"
DESCRIBES = "FROM THE|AS MEASURED|ALONG"
SILENT = r"(?i)BEGINNING|COMMENCING|TRACT|RECORDED|OFFICIAL RECORDS|COUNTY|LOT|SECTION"
TO_BEGINNING = r"(?i)\bTO\s+THE\s+(?:TRUE\s+)?POINT\s+OF\s+BEGINNING\b"
TIE_BEARING = r"(?is)SAID\s+POINT\s+BEING\s+(NORTH|SOUTH)\s+(\d{1,3})\s*°\s*(\d{1,2})\s*['\"]\s*(\d{1,2}(?:\.\d+)?)\s*\"\s+(EAST|WEST)[,\s]+(\d+(?:\.\d+)?)\s+FEET?\s+FROM\s+(.+?)(?=;|\.|,\s*THENCE|$)"
TIE_ALONG = r"(?is)(\d+(?:\.\d+)?)\s+FEET?\s+((?:NORTH|SOUTH)(?:EAST|WEST)?ERLY|(?:EAST|WEST)ERLY)[,\s]+AS\s+MEASURED\s+ALONG\s+([^,]+?)\s+FROM\s+(.+?)(?=;|\.|,\s*SAID|\d+(?:\.\d+)?\s+FEET|$)"
CLOSE_TOLERANCE = 0.01
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029;]"
# Several compact calls in a piece are cut before each; a quadrant in words is narrative.
COMPACT_START = r"(?i)(?<!^)(?=\b(?:N|S)\s+\d{1,3}°|\b(?:EAST|WEST|NORTH|SOUTH)\s*,?\s*\d)"
WORDS_QUADRANT = r"(?is)\b(?:NORTH|SOUTH)\b.{0,80}\b(?:EAST|WEST)\b"
NARRATIVE_LINE = rf"(?i)(NORTH|SOUTH|N|S)\s*(\d{{1,3}})\s*°\s*(\d{{1,2}})\s*'\s*(\d{{1,2}}(?:\.\d+)?)\s*\"?\s*(EAST|WEST|E|W)\s+{_NUM}\s*(?:FEET|FOOT|FT)?"
NARRATIVE_CURVE = (
    rf"(?is)(?:\bTHENCE\b.*?)?\bALONG\s+(?:SAID\s+)?(?:A\s+)?CURVE\b.*?\b(?:TO\s+THE\s+)?(RIGHT|LEFT)\b.*?(?:\bHAVING\s+A\s+RADIUS\s+OF\b|\bRADIUS\s+OF\b|\bRADIUS\b)\s*{_NUM}\s*(?:FEET|FOOT|FT)\b"
    rf"(?:.*?\b(?:AN\s+)?ARC(?:\s+LENGTH)?(?:\s+OF)?\b\s*{_NUM}\s*(?:FEET|FOOT|FT)\b)?"
    r"(?:.*?\b(?:CENTRAL\s+ANGLE|DELTA)(?:\s+OF)?\b\s*(\d{1,3})\s*(?:DEGREES?|°)\s*(\d{1,2})?\s*(?:MINUTES?|')?\s*(\d{1,2}(?:\.\d+)?)?\s*(?:SECONDS?|\")?)?"
)


def cleaned(text: Column) -> Column:
    text = F.translate(F.coalesce(text, F.lit("")), "‘’“”º˚–—", "''\"\"°°--")
    for pattern, to in _REPAIRS:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"(\d{1,3})°(?![\d'])", "$1°00'00\"")


def _got(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def with_prose(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``prose``: the courses of a text in prose, one a line, in the order of the passes that find them.

    Bearings after THENCE, bearings to a point, cardinals, curves, and last whatever
    else follows a THENCE.  A later pass takes nothing that begins inside a course of the first.
    Each pass has a column of its own, so that no pattern is searched twice.
    """
    plain = F.when(says(F.col(text), "THENCE|TO A POINT"), F.trim(F.regexp_replace(text, r"\s+", " ")))
    passes = {"__courses": PROSE_COURSE, "__points": PROSE_POINT, "__cardinals": PROSE_CARDINAL, "__curves": PROSE_CURVE, "__others": PROSE_OTHER}
    docs = docs.withColumn("__t", plain).withColumns({name: spans(F.col("__t"), pattern) for name, pattern in passes.items()})
    t, courses, points, cardinals, curves, others = (F.col(c) for c in ("__t", *passes))

    def outside(m: Column, *known: Column) -> Column:
        inside = [F.exists(k, lambda c: (c["start"] <= m["start"]) & (m["start"] <= c["end"])) for k in known]
        return ~reduce(lambda a, b: a | b, inside)

    def bearing(pattern: str):
        def line(m: Column) -> Column:
            v, part = m["value"], lambda g: F.regexp_extract(m["value"], pattern, g)
            sec = F.coalesce(_got(v, pattern, 4), F.lit("0"))
            return F.concat(F.upper(F.substring(part(1), 1, 1)), part(2), F.lit("°"), part(3), F.lit("'"), sec, F.lit('" '), F.upper(F.substring(part(5), 1, 1)), F.lit(" "), part(6), F.lit(" FT"))

        return line

    def stands(m: Column) -> Column:
        """The clause around a bearing to a point states a course, and doesn't describe something else."""
        before = F.substring_index(F.substring(t, F.lit(1), m["start"]), ";", -1)
        clause = F.upper(F.concat(before, m["value"], F.substring_index(F.substring(t, m["end"] + 1, F.length(t)), ";", 1)))
        return ~clause.rlike(DESCRIBES) | clause.contains("SAID POINT BEING")

    def rest(m: Column) -> Column:
        after = F.substring(t, m["end"] + 1, F.length(t))
        return F.trim(F.substring_index(F.split(after, PROSE_OTHER, 2)[0], ";", 1))

    cardinal = lambda m: F.concat(F.upper(F.substring(F.regexp_extract(m["value"], PROSE_CARDINAL, 1), 1, 1)), F.lit(" "), F.regexp_extract(m["value"], PROSE_CARDINAL, 2), F.lit(" FT"))
    lines = F.filter(
        F.concat(
            F.transform(courses, bearing(PROSE_COURSE)),
            F.transform(F.filter(points, lambda m: outside(m, courses) & stands(m)), bearing(PROSE_POINT)),
            F.transform(F.filter(cardinals, lambda m: outside(m, courses)), cardinal),
            F.transform(F.filter(curves, lambda m: outside(m, courses)), lambda m: F.regexp_replace(m["value"], r"(?i)^THENCE\s+", "")),
            F.transform(F.filter(others, lambda m: outside(m, courses, cardinals, curves)), rest),
        ),
        lambda line: line != "",
    )
    return docs.withColumn("prose", lines).drop("__t", *passes)


def _texts(docs: DataFrame) -> DataFrame:
    """The rows of :func:`chunks`; behind them, as ``whole``, the text of a document that may be a narrative."""
    text = F.regexp_replace(cleaned(F.col("source_text")), r"\r\n", "\n")
    docs = with_prose(docs.select("doc_id", text.alias("t")), "t")

    def cut(piece: Column) -> Column:
        compact = piece.contains("°") & ~says(piece, "THENCE") & ~piece.rlike(WORDS_QUADRANT)
        return F.when(compact, F.split(piece, COMPACT_START)).otherwise(F.array(piece))

    lines = F.when(F.size("prose") > 0, F.flatten(F.transform("prose", lambda x: F.split(x, ";")))).otherwise(F.split("t", LINE_BREAK))
    pieces = F.filter(F.flatten(F.transform(lines, lambda piece: cut(F.trim(piece)))), lambda x: F.trim(x) != "")
    tells = F.col("t").contains("°") | says(F.col("t"), "CURVE")
    part = lambda raw, whole: F.struct(raw.alias("raw"), F.lit(whole).alias("whole"))
    parts = F.concat(F.transform(pieces, lambda x: part(x, False)), F.filter(F.array(part(F.col("t"), True)), lambda x: tells))
    parts = docs.select("doc_id", F.posexplode(parts).alias("pos", "p")).select("doc_id", (F.col("pos") + 1).alias("pos"), F.col("p.raw").alias("raw"), F.col("p.whole").alias("whole"))
    rows = parts.withColumn("told", F.when(F.col("whole"), F.col("raw")).otherwise(F.regexp_replace(F.trim("raw"), r"(?i)^thence ", "")))
    line = F.regexp_replace(F.trim("told"), r"[;,.]+$", "")
    line = F.when(~F.col("whole"), F.trim(F.regexp_replace(F.regexp_replace(line, r"(?i)\bTHENCE\b", ""), r"\s+", " ")))
    return rows.select("doc_id", "pos", line.alias("line"), "told", "whole").where("whole or line <> ''")


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, line, told``: lines, ``;`` pieces and compact calls, bare of THENCE and end marks.

    Where a text has courses in prose, those are its lines.  ``told`` still has what
    stands before a bearing.
    """
    return _texts(docs).where("not whole").drop("whole")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The first ``n`` groups of the first match in one search; groups that take no part are empty."""
    return F.split(F.regexp_replace(text, rf"^(?s:.*?){pattern}(?s:.*)\z", "\u0001".join(f"${k}" for k in range(1, n + 1))), "\u0001")


def parse(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, kind, id, azimuth, dist, radius, delta_deg, handedness, error``.

    Ordered cascade; an arc without radius follows the last bearing before it.  A
    document without any call gets those of its whole text read as a narrative.

    Each text is cleaned once, and its narrative searched only where no call was found;
    one shuffle by ``doc_id`` serves all windows.
    """
    c, told, whole = F.col("line"), F.col("told"), F.col("whole")
    marked, bent = c.contains("°"), says(c, "CURVE")
    kind = F.when(~whole, (
        F.when(c.rlike(CARDINAL), "cardinal").when(told.contains("°") & told.rlike(PROSE_QUADRANT), "prose").when(marked & c.rlike(QUADRANT), "quadrant").when(marked & c.rlike(AZIMUTH), "azimuth")
        .when(bent & c.rlike(CURVE), "curve").when(c.rlike(WORDY), "wordy").when(bent & c.rlike(ARC_ONLY), "arc_only").when(c.rlike(SILENT), "silent").otherwise("unknown")
    ))
    rows = _texts(docs).withColumn("kind", kind)
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    shapes = (("cardinal", c, CARDINAL, 2), ("prose", told, PROSE_QUADRANT, 6), ("quadrant", c, QUADRANT, 6), ("azimuth", c, AZIMUTH, 4), ("curve", c, CURVE, 2), ("wordy", c, WORDY, 2), ("arc_only", c, ARC_ONLY, 1))
    found = reduce(lambda w, x: w.when(is_(x[0]), _groups(*x[1:])), shapes, F.when(whole, None))
    rows = rows.withColumn("g", found).withColumn("angle", F.when(is_("curve") & c.rlike(CURVE_ANGLE), _groups(c, CURVE_ANGLE, 3)))
    g = lambda k: F.nullif(F.get("g", F.lit(k)), F.lit(""))
    angle = lambda k: F.nullif(F.get("angle", F.lit(k)), F.lit(""))
    bearing = B.dms(g(1), F.coalesce(g(2), F.lit("0")), F.coalesce(g(3), F.lit("0")))
    first = lambda k: F.upper(F.substring(g(k), 1, 1))
    rows = rows.withColumn(
        "own",
        F.when(is_("cardinal", "wordy"), B.lookup(F.upper(g(0)), {k: float(v) for k, v in CARDINAL_AZIMUTH.items()})).when(is_("quadrant", "prose"), B.quadrant_azimuth(first(0), first(4), bearing))
        .when(is_("azimuth"), B.dms(g(0), g(1), g(2))),
    )
    dist = F.when(is_("cardinal", "wordy"), g(1)).when(is_("quadrant", "prose"), g(5)).when(is_("azimuth"), g(3)).when(is_("arc_only"), g(0)).cast("double")
    radius, arc = g(1).cast("double"), _got(c, CURVE_ARC, 1).cast("double")
    delta = F.coalesce(B.dms(angle(0), angle(1), F.coalesce(angle(2), F.lit("0"))), F.degrees(arc / radius))
    rows = rows.withColumns({"dist": dist, "radius": F.when(is_("curve"), radius), "delta_deg": F.when(is_("curve"), delta), "handedness": F.when(is_("curve"), F.lower(g(0))), "arc": F.when(is_("curve"), arc)})
    rows = rows.withColumn("kind", F.when(is_("curve") & F.col("angle").isNull() & F.col("arc").isNull(), "bad_curve").otherwise(F.col("kind"))).drop("g", "angle", "arc")
    of_doc = Window.partitionBy("doc_id").orderBy("pos")
    # Short cardinals and azimuths don't set the bearing that arcs follow.
    carried = F.last(F.when(is_("quadrant", "prose", "wordy"), F.col("own")), True).over(of_doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("carried", carried)
    rows = rows.withColumn("kind", F.when(is_("arc_only") & F.col("carried").isNull(), F.when(c.rlike(SILENT), "silent").otherwise("unknown")).otherwise(F.col("kind")))
    error = (
        F.when(is_("bad_curve"), F.concat(F.lit("CURVE_INCOMPLETE: line "), "pos", F.lit(": '"), c, F.lit("'")))
        .when(is_("unknown"), F.concat(F.lit("UNKNOWN_ELEMENT: line "), "pos", F.lit(": '"), c, F.lit("'")))
    )
    rows = rows.withColumn("error", error).where(whole | (F.col("kind") != "silent"))
    every = of_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("called", F.max(~whole & F.col("error").isNull()).over(every)).withColumn("story", F.when(whole & ~F.col("called"), _narrative(told)))
    rows = rows.withColumn("tells", F.coalesce(F.max(F.size("story") > 0).over(every), F.lit(False)))
    curve = is_("curve")
    own = {
        "pos": F.col("pos"), "kind": F.col("kind"), "id": F.when(F.col("error").isNull(), F.concat(F.when(curve, "C").otherwise("L"), F.col("pos"))),
        "azimuth": F.coalesce("own", F.when(is_("arc_only"), F.col("carried"))), "dist": F.when(~is_("unknown"), F.col("dist")), "radius": F.when(curve, F.col("radius")),
        "delta_deg": F.when(curve, F.col("delta_deg")), "handedness": F.when(curve, F.col("handedness")), "error": F.col("error"),
    }
    line = F.array(F.struct(*[v.alias(k) for k, v in own.items()]))
    return rows.select("doc_id", F.explode(F.when(whole, F.col("story")).when(F.col("called") | ~F.col("tells"), line)).alias("r")).select("doc_id", "r.*")


def _narrative(text: Column) -> Column:
    """The columns of :func:`parse` as structs for every line, then every curve, of the whole text."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    lines, curves = F.regexp_extract_all(t, F.lit(NARRATIVE_LINE), F.lit(0)), F.regexp_extract_all(t, F.lit(NARRATIVE_CURVE), F.lit(0))
    no = {t: F.lit(None).cast(t) for t in ("double", "string")}

    def delta(m: Column) -> Column:
        return B.dms(_got(m, NARRATIVE_CURVE, 4), _got(m, NARRATIVE_CURVE, 5), F.coalesce(_got(m, NARRATIVE_CURVE, 6), F.lit("0")))

    def arc(m: Column) -> Column:
        return F.nullif(_got(m, NARRATIVE_CURVE, 3).cast("double"), F.lit(0.0))

    def line(m: Column, n: Column) -> Column:
        az = B.quadrant_azimuth(
            B.lookup(F.upper(_got(m, NARRATIVE_LINE, 1)), LETTER), B.lookup(F.upper(_got(m, NARRATIVE_LINE, 5)), LETTER),
            B.dms(_got(m, NARRATIVE_LINE, 2), _got(m, NARRATIVE_LINE, 3), _got(m, NARRATIVE_LINE, 4)),
        )
        return F.struct(
            (n + 1).alias("pos"), F.lit("narrative").alias("kind"), F.concat(F.lit("L"), n + 1).alias("id"), az.alias("azimuth"), _got(m, NARRATIVE_LINE, 6).cast("double").alias("dist"),
            no["double"].alias("radius"), no["double"].alias("delta_deg"), no["string"].alias("handedness"), no["string"].alias("error"),
        )

    def curve(m: Column, n: Column) -> Column:
        radius = _got(m, NARRATIVE_CURVE, 2).cast("double")
        return F.struct(
            (F.size(lines) + n + 1).alias("pos"), F.lit("curve").alias("kind"), F.concat(F.lit("C"), n + 1).alias("id"), no["double"].alias("azimuth"), no["double"].alias("dist"),
            radius.alias("radius"), F.coalesce(delta(m), F.degrees(arc(m) / radius)).alias("delta_deg"), F.lower(_got(m, NARRATIVE_CURVE, 1)).alias("handedness"), no["string"].alias("error"),
        )

    whole = F.filter(curves, lambda m: F.coalesce(delta(m), arc(m)).isNotNull())
    return F.concat(F.transform(lines, line), F.transform(whole, curve))


def _monument(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[.,]+$", "")


def reference_ties(docs: DataFrame) -> DataFrame:
    """Both kinds of ties with their parts; each text gives all of its ties."""
    text = F.regexp_replace(cleaned(F.col("source_text")), r"\s+", " ")
    rows = docs.select("doc_id", text.alias("t"))
    m = F.col("m")
    bearing = rows.select("doc_id", F.posexplode(F.regexp_extract_all("t", F.lit(TIE_BEARING), F.lit(0))).alias("n", "m")).select(
        "doc_id", "n", F.lit("bearing_from_monument").alias("kind"),
        B.quadrant_azimuth(F.substring(F.upper(_got(m, TIE_BEARING, 1)), 1, 1), F.substring(F.upper(_got(m, TIE_BEARING, 5)), 1, 1), B.dms(_got(m, TIE_BEARING, 2), _got(m, TIE_BEARING, 3), _got(m, TIE_BEARING, 4))).alias("azimuth"),
        _got(m, TIE_BEARING, 6).cast("double").alias("dist"), F.lit(None).cast("string").alias("direction_word"), F.lit(None).cast("string").alias("along_feature"), _monument(_got(m, TIE_BEARING, 7)).alias("from_monument"),
    )
    along = rows.select("doc_id", F.posexplode(F.regexp_extract_all("t", F.lit(TIE_ALONG), F.lit(0))).alias("n", "m")).select(
        "doc_id", "n", F.lit("linear_along_line").alias("kind"), F.lit(None).cast("double").alias("azimuth"), _got(m, TIE_ALONG, 1).cast("double").alias("dist"),
        F.upper(_got(m, TIE_ALONG, 2)).alias("direction_word"), F.trim(_got(m, TIE_ALONG, 3)).alias("along_feature"), _monument(_got(m, TIE_ALONG, 4)).alias("from_monument"),
    )
    return bearing.unionByName(along)


def _rounded_quadrant(az: Column) -> Column:
    """Struct ``ns, deg, minute, sec, ew`` with seconds to two places; a full minute or degree is carried."""
    theta = F.when(az <= 90, az).when(az <= 180, 180 - az).when(az <= 270, az - 180).otherwise(360 - az)
    deg = F.floor(theta)
    minute = F.floor((theta - deg) * 60)
    sec = F.round(((theta - deg) * 60 - minute) * 60, 2)
    full = sec >= 59.9995
    up = minute + full.cast("int")
    return F.struct(
        F.when((az <= 90) | (az > 270), "N").otherwise("S").alias("ns"), (deg + (up >= 60).cast("int")).cast("int").alias("deg"), (up % 60).cast("int").alias("minute"),
        F.when(full, 0.0).otherwise(sec).alias("sec"), F.when(az <= 180, "E").otherwise("W").alias("ew"),
    )


def closing_calls(docs: DataFrame, calls: DataFrame) -> DataFrame:
    """The derived call back to the start, where the text says that it returns there.

    Curves don't count in the end point; a gap within ``CLOSE_TOLERANCE`` needs no call.
    """
    dx, dy = B.offsets(F.col("azimuth"), F.col("dist"))
    ends = calls.where("error is null").groupBy("doc_id").agg(F.coalesce(F.sum(dx), F.lit(0.0)).alias("x"), F.coalesce(F.sum(dy), F.lit(0.0)).alias("y"), F.count(F.lit(1)).alias("n"))
    says = docs.where(F.col("source_text").rlike(TO_BEGINNING)).select("doc_id")
    gap = ends.join(says, "doc_id").withColumn("dist", F.hypot("x", "y")).where(F.col("dist") > CLOSE_TOLERANCE)
    gap = gap.withColumn("azimuth", F.pmod(F.degrees(F.atan2(-F.col("x"), -F.col("y"))), F.lit(360.0))).withColumn("q", _rounded_quadrant(F.col("azimuth")))
    q = F.col("q")
    bearing = F.concat(F.lit("[DERIVED] "), q["ns"], F.lit(" "), q["deg"], F.lit("°"), q["minute"], F.lit("'"), q["sec"], F.lit('" '), q["ew"])
    return gap.select(
        "doc_id", F.concat(F.lit("L"), F.col("n") + 1, F.lit("_CLOSURE")).alias("id"), "azimuth", "dist", F.lit("assumed").alias("basis"), F.lit(0.5).alias("confidence"),
        bearing.alias("bearing_text"), F.concat(F.lit("[DERIVED] "), F.round("dist", 4).cast("string"), F.lit(" FT TO THE POINT OF BEGINNING")).alias("raw_text"), "q.ns", "q.deg", "q.minute", "q.sec", "q.ew",
    )


