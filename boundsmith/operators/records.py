"""Records around typed rows: audits, their JSON, suggested rows, labels and summaries.

Audits are rows ``doc_id, row_index`` and the fields of ``AUDIT``; a document's rows
count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundsmith.functions.text import bearing_text
from boundsmith.sources.readers import COURSE_ROW, OCR_LINE

# The sources of a row, the fields of an audit and of a typed row.
SOURCES = ("Legal", "Manual", "Suggested")
AUDIT = ("source", "original_text", "method", "confidence", "reason", "residual", "bearing_text", "distance_text", "direction_word", "timestamp")
ROW = ("id", "type", "direction", "distance", "radius", "delta", "source")
_NUMBERS = ("residual",)


def _text(value: Column | None) -> Column:
    return F.lit("") if value is None else F.coalesce(value.cast("string"), F.lit(""))


def audit(source: Column, **known: Column) -> Column:
    """A whole audit: text fields that aren't given are empty, the residual null."""
    fields = {"source": source, **known}
    return F.struct(*[(fields[n].cast("double") if n in fields else F.lit(None).cast("double")).alias(n) if n in _NUMBERS else _text(fields.get(n)).alias(n) for n in AUDIT])


def legal_audit() -> Column:
    return audit(F.lit("Legal"))


def manual_audit() -> Column:
    return audit(F.lit("Manual"))


def suggested_audit(suggestion: dict[str, Column], bearing: Column, distance: Column, at: Column) -> Column:
    """``at`` is a timestamp (given, so that a run can be repeated), told in UTC to the second."""
    told = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return audit(F.lit("Suggested"), **suggestion, bearing_text=bearing, distance_text=distance, timestamp=told)


def detail_text(a: Column) -> Column:
    """What an audit says to its reader, in lines."""
    def named(field: str, none: str) -> Column:
        return F.when(a[field] == "", none).otherwise(a[field])

    suggested = F.concat(
        F.lit("Source: Suggested (technician-approved)\nMethod: "), named("method", "(unknown)"), F.lit("\nConfidence: "), named("confidence", "(unknown)"),
        F.lit("\nSuggested bearing: "), a["bearing_text"], F.lit("\nSuggested distance: "), a["distance_text"], F.lit("\nDirection word: "), named("direction_word", "-"), F.lit("\n"),
        F.when(a["residual"].isNotNull(), F.concat(F.lit("Fit residual: "), a["residual"].cast("string"), F.lit("°\n"))).otherwise(""),
        F.when(a["timestamp"] != "", F.concat(F.lit("Applied at: "), a["timestamp"], F.lit("\n"))).otherwise(""),
        F.lit("\nOriginal unresolved text:\n"), named("original_text", "(none recorded)"), F.lit("\n\nReason:\n"), named("reason", "(none recorded)"),
    )
    return (
        F.when(a["source"] == "Legal", "Source: Legal\nRow was parsed directly from the legal description.")
        .when(a["source"] == "Manual", "Source: Manual\nRow was added by the technician via Add Row.").otherwise(suggested)
    )


# JSON of audits, OCR lines and typed rows. -------------------------------------

def audits_to_json(audits: DataFrame) -> DataFrame:
    """``doc_id, value``: the audits of a document's rows in order, one JSON list; a missing row is ``Legal``."""
    rows = audits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("row_index", F.struct(*AUDIT).alias("a")))).alias("held"))
    every = F.transform(F.sequence(F.lit(0), F.size("held") - 1), lambda i: F.coalesce(F.try_element_at("held", i), legal_audit()))
    return rows.select("doc_id", F.to_json(every, {"ignoreNullFields": "false"}).alias("value"))


def audits_from_json(texts: DataFrame) -> DataFrame:
    """Audits from ``doc_id, value``: unknown fields go, an unknown source is ``Legal``."""
    shape = "array<struct<" + ",".join(f"{n}:{'double' if n in _NUMBERS else 'string'}" for n in AUDIT) + ">>"
    rows = texts.select("doc_id", F.posexplode(F.from_json("value", shape)).alias("row_index", "a"))
    fields = [F.col(f"a.{n}") if n in _NUMBERS else _text(F.col(f"a.{n}")).alias(n) for n in AUDIT[1:]]
    source = F.col("a.source")
    return rows.select("doc_id", "row_index", F.when(source.isin(*SOURCES), source).otherwise("Legal").alias("source"), *fields)


def ocr_lines_from_json(value: Column) -> Column:
    """Lines with empty texts and zeros where a field is left out; the confidence may be null."""
    kept = F.from_json(value, f"array<{OCR_LINE}>")
    numbers = lambda x: [F.coalesce(x[n], F.lit(0)).alias(n) for n in ("x", "y", "width", "height")]
    return F.transform(kept, lambda x: F.struct(_text(x["text"]).alias("text"), x["confidence"].alias("confidence"), *numbers(x)))


def ocr_lines_to_json(lines: Column) -> Column:
    return F.to_json(lines, {"ignoreNullFields": "false"})


def rows_from_json(value: Column) -> Column:
    """Typed rows, every value a string, the source ``Legal`` where it is left out."""
    rows = F.from_json(value, f"array<{COURSE_ROW}>")
    return F.transform(rows, lambda x: F.struct(*[(F.coalesce(x[n], F.lit("Legal")) if n == "source" else _text(x[n])).alias(n) for n in ROW]))


def snapshot(rows: DataFrame) -> DataFrame:
    """``doc_id, rows``: the seven cells of each row as strings, in order."""
    cells = F.struct(*[_text(F.col(n) if n in rows.columns else None).alias(n) for n in ROW])
    held = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row_index", cells.alias("cells")))).alias("held"))
    return held.select("doc_id", F.transform("held", lambda x: x["cells"]).alias("rows"))


# Edits. --------------------------------------------------------------------------

def all_legal(counts: DataFrame) -> DataFrame:
    """``counts (doc_id, n)`` as audits: n rows, each ``Legal``; a document with none has no audits."""
    rows = counts.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("row_index"))
    return rows.withColumn("a", legal_audit()).select("doc_id", "row_index", "a.*")


def cleared(audits: DataFrame, docs: DataFrame) -> DataFrame:
    """Without the audits of ``docs (doc_id)``."""
    return audits.join(docs.select("doc_id"), "doc_id", "left_anti")


def approved(rows: DataFrame, audits: DataFrame, suggestions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Rows and audits with each suggestion behind its document's last row.

    ``suggestions``: ``doc_id, span_start, text, direction, ns, deg, minute, sec, ew,
    distance, method, confidence, reason, residual``; several are appended in order.
    """
    bearing = bearing_text(*[F.col(c) for c in ("ns", "deg", "minute", "sec", "ew")])
    stated = F.format_string("%.2f", F.col("distance").cast("double"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("span_start"))
    new = suggestions.withColumns({"bearing": bearing, "stated": stated, "k": order})

    def placed(of: DataFrame) -> DataFrame:
        last = of.groupBy("doc_id").agg(F.max("row_index").alias("last"))
        return new.join(last, "doc_id", "left").withColumn("row_index", F.coalesce("last", F.lit(-1)) + F.col("k"))

    added = placed(rows)
    added = added.select(
        "doc_id", "row_index", F.concat(F.lit("L"), F.col("row_index") + 1).alias("id"), F.lit("Line").alias("type"), F.col("bearing").alias("direction"),
        F.col("stated").alias("distance"), F.lit("").alias("radius"), F.lit("").alias("delta"), F.lit("Suggested").alias("source"),
    )
    told = {"original_text": F.col("text"), "direction_word": F.col("direction")} | {n: F.col(n) for n in ("method", "confidence", "reason", "residual")}
    noted = placed(audits).withColumn("a", suggested_audit(told, F.col("bearing"), F.col("stated"), at)).select("doc_id", "row_index", "a.*")
    return rows.select(*added.columns).unionByName(added), audits.select(*noted.columns).unionByName(noted)


# Labels and summaries. ------------------------------------------------------------

def _decimal(value: Column) -> Column:
    return F.coalesce(value.cast("double").cast("string"), F.lit(""))


def line_label(bearing: Column, dist: Column) -> Column:
    return F.concat(bearing, F.lit(" / "), _decimal(dist))


def curve_label(handedness: Column, radius: Column, deg: Column, minute: Column, sec: Column) -> Column:
    """``RIGHT R=50.0 Δ=90°00'00"``; parts that are unknown are left empty."""
    angle = F.when(deg.isNotNull(), F.format_string("%d°%02d'%02d\"", deg, minute, sec.cast("int"))).otherwise("")
    return F.concat(F.upper(_text(handedness)), F.lit(" R="), _decimal(radius), F.lit(" Δ="), angle)


def start_point(x: Column, y: Column) -> Column:
    """Struct ``x, y, error`` of typed coordinates."""
    a, b = F.trim(x).try_cast("double"), F.trim(y).try_cast("double")
    bad = a.isNull() | b.isNull()
    return F.struct(F.when(~bad, a).alias("x"), F.when(~bad, b).alias("y"), F.when(bad, "Start X and Start Y must be numeric.").alias("error"))


def form_document(legal: Column) -> Column:
    """A posted form as a description: the field ``legal``, starting at the origin."""
    return F.struct(_text(legal).alias("source_text"), F.lit(0.0).alias("start_x"), F.lit(0.0).alias("start_y"))


def highlight(x: Column, y: Column, width: Column, height: Column, scale_x: Column, scale_y: Column) -> Column:
    """A box of an image in whole pixels of the view that shows it."""
    scaled = (("x", x, scale_x), ("y", y, scale_y), ("width", width, scale_x), ("height", height, scale_y))
    return F.struct(*[(v * s).cast("int").alias(n) for n, v, s in scaled])


def summary(status: DataFrame, report: DataFrame, vertices: DataFrame) -> DataFrame:
    """:func:`summarised` of parts that come apart."""
    points = vertices.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_points"))
    return summarised(status.join(report.select("doc_id", "misclosure", "n_hits", "curve_errors"), "doc_id", "left").join(points, "doc_id", "left"))


def summarised(rows: DataFrame) -> DataFrame:
    """``doc_id, n_points, misclosure, n_intersections, n_curve_error_groups, has_errors`` from rows as of ``validate.line_report``.

    A document with a parse error, or a call out of range, isn't built: its numbers are null.
    """
    bad = (F.col("n_errors") > 0) | (F.col("parse_status") != "OK")
    groups = F.coalesce(F.size("curve_errors"), F.lit(0))
    built = lambda c, name: F.when(~bad, c).alias(name)
    return rows.select(
        "doc_id", built(F.col("n_points"), "n_points"), built(F.col("misclosure"), "misclosure"), built(F.col("n_hits"), "n_intersections"),
        built(F.when(groups < 0, 0).otherwise(groups).cast("long"), "n_curve_error_groups"), bad.alias("has_errors"),
    )
