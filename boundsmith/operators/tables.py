"""Rows that people edit: manual courses, audits, styles, neighbours, OCR words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundsmith.functions.bearings import lookup
from boundsmith.functions.courses import with_line
from boundsmith.functions.text import normalize

# Words for sides and cardinal directions.
SIDES = {"L": "left", "LEFT": "left", "LH": "left", "CCW": "left", "R": "right", "RIGHT": "right", "RH": "right", "CW": "right"}
CARDINAL_AZIMUTH = {"N": 0, "NORTH": 0, "S": 180, "SOUTH": 180, "E": 90, "EAST": 90, "W": 270, "WEST": 270}
_DELTA = r"^\s*(\d+(?:\.\d+)?)\s*°?\s*(?:(\d{1,2}(?:\.\d+)?)\s*'?\s*)?(?:(\d{1,2}(?:\.\d+)?)\s*\"?\s*)?$"
CELLS = ("id", "type", "direction", "distance", "radius", "delta")
# The palette of boundary courses, and the kinds' colours and tints.
PALETTE = ("#2563eb", "#dc2626", "#059669", "#d97706", "#7c3aed", "#0891b2", "#be185d", "#65a30d", "#ea580c", "#0d9488", "#4f46e5", "#b91c1c")
TIE_COLOR, UNRESOLVED_COLOR = "#94a3b8", "#f59e0b"
SUGGESTED_TINT, TIE_TINT, UNRESOLVED_TINT = "#fef9c3", "#f1f5f9", "#fffbeb"


def cell(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _number(text: Column, label: str) -> tuple[Column, Column]:
    value = text.try_cast("double")
    error = (
        F.when(text == "", f"missing {label}").when(value.isNull(), F.concat(F.lit(f"{label} not numeric: '"), text, F.lit("'")))
        .when(value <= 0, F.concat(F.lit(f"{label} must be positive: "), value.cast("string")))
    )
    return value, error


def manual_line(direction: Column, distance: Column, line: Column) -> Column:
    """Struct ``azimuth, ns, deg, minute, sec, ew, dist, error`` of typed cells.

    ``line`` is the course parsed from both cells.
    """
    word = F.upper(normalize(direction))
    azimuth = lookup(word, CARDINAL_AZIMUTH)
    dist, wrong = _number(distance, "distance")
    error = F.when(direction == "", "missing direction").otherwise(
        F.coalesce(wrong, F.when(azimuth.isNull() & line.isNull(), F.concat(F.lit("could not parse bearing: '"), direction, F.lit("'"))))
    )
    ok = error.isNull()
    parts = [F.when(ok & azimuth.isNull(), line[c]).alias(c) for c in ("ns", "deg", "minute", "sec", "ew")]
    return F.struct(F.when(ok, azimuth).alias("azimuth"), *parts, F.when(ok, dist).alias("dist"), error.alias("error"))


def delta_parts(text: Column) -> Column:
    """The typed degrees, minutes and seconds as strings, null where left out."""
    return F.struct(*[F.nullif(F.regexp_extract(text, _DELTA, g), F.lit("")).alias(n) for g, n in ((1, "d"), (2, "m"), (3, "s"))])


def delta_angle(text: Column, parts: Column | None = None) -> Column:
    """Struct ``deg, minute, sec, error``: degrees alone may be decimal."""
    parts = delta_parts(text) if parts is None else parts
    deg, minute, sec = parts["d"].cast("double"), parts["m"], parts["s"]
    decimal = minute.isNull() & sec.isNull() & parts["d"].contains(".")
    total = F.round(deg * 3600, 6)
    whole = F.floor(total / 3600).cast("int")
    m = F.floor((total - whole * 3600) / 60).cast("int")
    d2 = F.floor(deg).cast("int")
    m2 = F.floor(F.coalesce(minute, F.lit("0")).cast("double")).cast("int")
    s2 = F.coalesce(sec, F.lit("0")).cast("double")
    error = (
        F.when(text == "", "missing delta").when(deg.isNull(), F.concat(F.lit("could not parse delta angle: '"), text, F.lit("'")))
        .when(~decimal & (d2 > 360), F.concat(F.lit("delta degrees out of range: "), d2.cast("string")))
        .when(~decimal & (m2 >= 60), F.concat(F.lit("delta minutes out of range: "), m2.cast("string")))
        .when(~decimal & (s2 >= 60), F.concat(F.lit("delta seconds out of range: "), s2.cast("string")))
    )
    pick = lambda a, b: F.when(error.isNull(), F.when(decimal, a).otherwise(b))
    return F.struct(pick(whole, d2).alias("deg"), pick(m, m2).alias("minute"), pick(total - whole * 3600 - m * 60, s2).alias("sec"), error.alias("error"))


def manual_curve(direction: Column, radius: Column, delta: Column, arc: Column, angle: Column | None = None) -> Column:
    """Struct ``handedness, radius, deg, minute, sec, arc, error`` of typed cells.

    ``angle`` is the parsed delta, where a column holds it already.
    """
    key = F.upper(direction)
    side = lookup(key, SIDES)
    r, bad_r = _number(radius, "radius")
    a, bad_a = _number(arc, "arc length")
    d = delta_angle(delta) if angle is None else angle
    error = F.coalesce(
        F.when(key == "", "missing handedness (LEFT or RIGHT)"),
        F.when(side.isNull(), F.concat(F.lit("unknown handedness '"), direction, F.lit("' (expected LEFT, RIGHT, L, R, CW, or CCW)"))),
        bad_r,
        F.when(delta != "", d["error"]),
        F.when(arc != "", bad_a),
        F.when((delta == "") & (arc == ""), "missing delta or arc length (at least one required)"),
    )
    ok = error.isNull()
    parts = [F.when(ok, d[c]).alias(c) for c in ("deg", "minute", "sec")]
    return F.struct(F.when(ok, side).alias("handedness"), F.when(ok, r).alias("radius"), *parts, F.when(ok, a).alias("arc"), error.alias("error"))


def is_blank(cells: tuple[str, ...] = CELLS) -> Column:
    return reduce(lambda a, b: a & b, [cell(c) == "" for c in cells])


def calls_from_rows(rows: DataFrame, all_or_nothing: bool = False) -> DataFrame:
    """Typed rows ``doc_id, row_no, <cells>`` to calls or ``Row n: …`` messages.

    Blank rows are skipped.  With ``all_or_nothing`` one error empties a document, a row
    is blank whatever its id and type, and a blank type is a line.
    """
    rows = rows.where(~is_blank(CELLS[2:] if all_or_nothing else CELLS)).withColumns({c: cell(c) for c in CELLS})
    kind = F.lower("type")
    if all_or_nothing:
        kind = F.when(kind == "", "line").otherwise(kind)
    number = F.coalesce(F.nullif(F.col("row_no").try_cast("int"), F.lit(0)), F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no")))
    rows = rows.withColumns({"kind": kind, "number": number})
    # Parsed pieces get projections of their own, so that no expression repeats them.
    rows = rows.withColumn("__text", F.when(F.col("kind") == "line", F.concat(normalize(F.col("direction")), F.lit(" "), "distance")))
    rows = with_line(rows, "__text", "__line").withColumn("__parts", F.when(F.col("kind") == "curve", delta_parts(F.col("delta"))))
    rows = rows.withColumn("__angle", delta_angle(F.col("delta"), F.col("__parts")))
    rows = rows.withColumns(
        {
            "line": F.when(F.col("kind") == "line", manual_line(F.col("direction"), F.col("distance"), F.col("__line"))),
            "curve": F.when(F.col("kind") == "curve", manual_curve(F.col("direction"), F.col("radius"), F.col("delta"), F.col("distance"), F.col("__angle"))),
        }
    )
    other = F.when(~F.col("kind").isin("line", "curve"), F.concat(F.lit("type '"), F.col("kind"), F.lit("' not supported (use 'Line' or 'Curve')")))
    error = F.coalesce(F.col("line.error"), F.col("curve.error"), other)
    rows = rows.withColumn("error", F.when(error.rlike("(?i)^row "), error).otherwise(F.concat(F.lit("Row "), F.col("number").cast("string"), F.lit(": "), error)))
    if all_or_nothing:
        rows = rows.withColumn("__bad", F.max(F.col("error").isNotNull()).over(Window.partitionBy("doc_id")))
        rows = rows.where(~F.col("__bad") | F.col("error").isNotNull()).drop("__bad")
    return rows.select("doc_id", "row_no", F.col("number").alias("row_number"), F.col("kind").alias("call_type"), "line", "curve", "error")


# Audits, keyed by row index. ------------------------------------------------

def audit_insert(audits: DataFrame, index: int, audit: DataFrame) -> DataFrame:
    """Later rows move down; ``audit`` is one row without ``row_index``."""
    moved = audits.withColumn("row_index", F.col("row_index") + F.when(F.col("row_index") >= index, 1).otherwise(0))
    return moved.unionByName(audit.withColumn("row_index", F.lit(index)), allowMissingColumns=True)


def audit_append(audits: DataFrame, audit: DataFrame, by: str = "doc_id") -> DataFrame:
    """``audit`` has at most one row per document; it goes behind the last row."""
    last = audits.groupBy(by).agg(F.max("row_index").alias("__last"))
    new = audit.join(last, by, "left").withColumn("row_index", F.coalesce(F.col("__last") + 1, F.lit(0))).drop("__last")
    return audits.unionByName(new, allowMissingColumns=True)


def audit_remove(audits: DataFrame, index: int, by: str = "doc_id") -> DataFrame:
    """Later rows move up; a document without that row stays as it is."""
    there = F.max(F.col("row_index") == index).over(Window.partitionBy(by))
    rows = audits.withColumn("__there", there).where(F.col("row_index") != index)
    return rows.withColumn("row_index", F.col("row_index") - F.when(F.col("__there") & (F.col("row_index") > index), 1).otherwise(0)).drop("__there")


def audit_swap(audits: DataFrame, a: int, b: int) -> DataFrame:
    i = F.col("row_index")
    return audits.withColumn("row_index", F.when(i == a, b).when(i == b, a).otherwise(i))


def with_audit(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows without an audit are ``Legal``."""
    return rows.join(audits, ["doc_id", "row_index"], "left").withColumn("source", F.coalesce("source", F.lit("Legal")))


def audit_detail(row: dict[str, Column]) -> Column:
    """Lines ``Label: value`` of the fields that are set."""
    lines = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in row.items()]
    return F.concat_ws("\n", *lines)


def renumbered(rows: DataFrame) -> DataFrame:
    """Ids ``L1, L2, …`` in row order, for every row."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("row_index"))
    return rows.withColumn("id", F.concat(F.lit("L"), n)).withColumn("row_index", n - 1)


# Styles. ----------------------------------------------------------------------

def normal_kind(kind: Column) -> Column:
    k = F.regexp_replace(F.lower(F.trim(kind)), "[- ]", "_")
    return (
        F.when(k.isin("legal", "suggested", "reference_tie", "unresolved"), k).when(k.isin("tie", "ref_tie", "referencetie", "reference"), "reference_tie")
        .when(k.isin("unresolved_direction_only_call", "direction_only", "missing"), "unresolved").when(k.isin("suggest", "suggestion", "proposed"), "suggested").otherwise("legal")
    )


def boundary_color(index: Column) -> Column:
    return F.when(index >= 0, F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.pmod(index, F.lit(len(PALETTE))) + 1).cast("int")))


def course_styles(rows: DataFrame) -> DataFrame:
    """``doc_id, row_index, course_id, kind, boundary_index, color, drawable, dashed, row_tint``.

    Only drawable courses advance the colours.
    """
    rows = rows.withColumn("kind", normal_kind(F.col("kind"))).withColumn("drawable", F.col("kind").isin("legal", "suggested"))
    run = F.sum(F.col("drawable").cast("int")).over(Window.partitionBy("doc_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("boundary_index", F.when(F.col("drawable"), run - 1).otherwise(-1).cast("int"))
    tie, free = F.col("kind") == "reference_tie", F.col("kind") == "unresolved"
    return rows.select(
        "doc_id", "row_index", "course_id", "kind", "boundary_index",
        F.when(tie, TIE_COLOR).when(free, UNRESOLVED_COLOR).otherwise(boundary_color(F.col("boundary_index"))).alias("color"),
        "drawable", F.col("kind").isin("unresolved", "suggested").alias("dashed"),
        F.when(tie, TIE_TINT).when(free, UNRESOLVED_TINT).when(F.col("kind") == "suggested", SUGGESTED_TINT).alias("row_tint"),
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """Previous and next course with wrap-around."""
    w = Window.partitionBy("doc_id").orderBy("row_index")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({"prev_index": F.coalesce(F.lag("row_index").over(w), F.last("row_index").over(whole)), "next_index": F.coalesce(F.lead("row_index").over(w), F.first("row_index").over(whole))})


def ignored_title(total: Column, unresolved: Column) -> Column:
    return F.when(unresolved > 0, F.format_string("Ignored Text (%d) — %d unresolved", total, unresolved)).otherwise(F.format_string("Ignored Text (%d)", total))


# OCR words. -------------------------------------------------------------------

def words_to_lines(words: DataFrame) -> DataFrame:
    """Words of one (block, paragraph, line) form a line: text, mean confidence, bounding box."""
    conf = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    rows = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("c", conf)
    rows = rows.withColumns({c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ("left", "top", "width", "height")})
    out = rows.groupBy("image", "block_num", "par_num", "line_num").agg(
        F.min("word_idx").alias("line_no"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", F.trim("text").alias("w")))), lambda s: s["w"]), " ").alias("text"),
        F.avg(F.when(F.col("c") >= 0, F.col("c"))).alias("confidence"),
        F.min("left").alias("x"),
        F.min("top").alias("y"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"),
        (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
    )
    return out.select("image", "line_no", "text", "confidence", "x", "y", "width", "height")


def reading_order(lines: DataFrame) -> DataFrame:
    """One text per image: lines by (y, x), blank ones dropped."""
    rows = lines.where(F.trim("text") != "")
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", "line_no", "text")))
    return rows.groupBy("image").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))
