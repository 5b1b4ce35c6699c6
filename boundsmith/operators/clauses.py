"""From descriptions to classified clauses, calls, ties and notes.

Input: ``doc_id, source_text``.  Everything up to the clauses is row-local; one
shuffle by ``doc_id`` serves all windows after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boundsmith.functions import courses as C
from boundsmith.functions.text import LOOKALIKES, is_plain, matches, normalize, says


def _by_doc():
    return Window.partitionBy("doc_id").orderBy("seg", "part")


def _starts(pieces: Column, gap: int) -> Column:
    lens = F.transform(pieces, lambda p: F.length(p) + gap)
    return F.transform(pieces, lambda p, i: F.aggregate(F.slice(lens, F.lit(1), i), F.lit(0), lambda a, x: a + x))


def split_clauses(docs: DataFrame) -> DataFrame:
    """``doc_id, before_pob, plain, seg, part, clause, span_start, span_end`` (into normalised text)."""
    raw = docs.select("doc_id", "source_text", is_plain(F.translate("source_text", LOOKALIKES, "")).alias("plain"))
    source = F.col("source_text")
    norm = raw.select("doc_id", "plain", F.when(F.col("plain"), normalize(source, True)).otherwise(normalize(source)).alias("norm"))
    segs = norm.select("doc_id", "plain", C.starts_before_beginning(F.col("norm")).alias("before_pob"), F.split("norm", ";").alias("pieces"))
    segs = segs.select("doc_id", "before_pob", "plain", F.posexplode(F.arrays_zip("pieces", _starts(F.col("pieces"), 1).alias("at"))).alias("seg", "p"))
    segs = segs.select("doc_id", "before_pob", "plain", "seg", F.col("p.pieces").alias("raw"), F.col("p.at").alias("at"))
    segs = segs.withColumn("body", F.trim(F.regexp_replace(F.trim("raw"), r"\.+$", ""))).where("body <> ''")
    segs = segs.withColumn("at", F.col("at") + F.instr("raw", F.col("body")) - 1)
    # Only a THENCE behind the first character cuts anything.
    inner = says(F.col("body"), "(?<!^)THENCE")
    cut = F.when(F.col("plain"), F.split("body", r"(?i)(?=\bTHENCE\b)")).otherwise(F.split("body", r"(?iU)(?=\bTHENCE\b)"))
    segs = segs.withColumn("parts", F.when(inner, cut).otherwise(F.array("body")))
    parts = segs.select(
        "doc_id", "before_pob", "plain", "seg", "at", F.size("parts").alias("n"), F.posexplode(F.arrays_zip("parts", _starts(F.col("parts"), 0).alias("off"))).alias("part", "p")
    )
    raw = F.col("p.parts")
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), ",+$", ""), r"\.+$", ""), ";+$", ""))
    out = parts.withColumn("clause", F.when(F.col("n") > 1, tidy).otherwise(raw)).where("clause <> ''")
    start = F.col("at") + F.col("p.off") + F.instr(raw, F.col("clause")) - 1
    out = out.select("doc_id", "before_pob", "plain", "seg", "part", "clause", start.alias("span_start"))
    return out.withColumn("span_end", F.col("span_start") + F.length("clause"))


def rejoin_fragments(clauses: DataFrame) -> DataFrame:
    """A bearing whose distance fell behind a stray ``;`` gets it back; adds ``line``."""
    plain = F.col("plain")
    rows = C.with_line(clauses, "clause", "line", plain)
    rows = rows.withColumn("__b", F.col("line").isNotNull() | C.has_bearing(F.col("clause"), plain))

    def after(c: str) -> Column:
        return F.lead(c).over(_by_doc())

    rows = rows.withColumns({"__next": after("clause"), "__nb": after("__b"), "__ne": after("span_end")})
    next_ = F.col("__next")
    wants = F.col("line").isNull() & F.col("__b") & ~F.col("__nb")
    rows = rows.withColumn("__joined", F.when(wants, F.when(~matches(next_, r"(?iU)\bTHENCE\b", plain) & matches(next_, C.FEET, plain), F.concat_ws(" ", "clause", "__next"))))
    rows = C.with_line(rows, "__joined", "__line", plain).withColumn("__merged", F.col("__line").isNotNull())
    rows = rows.withColumn("__eaten", F.coalesce(F.lag("__merged").over(_by_doc()), F.lit(False))).where(~F.col("__eaten"))
    return rows.select(
        "doc_id", "before_pob", "plain", "seg", "part",
        F.when(F.col("__merged"), F.col("__joined")).otherwise(F.col("clause")).alias("clause"),
        "span_start",
        F.when(F.col("__merged"), F.col("__ne")).otherwise(F.col("span_end")).alias("span_end"),
        F.when(F.col("__merged"), F.col("__line")).otherwise(F.col("line")).alias("line"),
        F.col("__merged").alias("rejoined"),
    )


def classify(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, clause, span_start, span_end, kind, line, curve, rejoined``."""
    rows = rejoin_fragments(split_clauses(docs))
    text = F.col("clause")
    rows = rows.withColumn("tie", C.has_tie_keyword(text) | C.is_reference_tie(text))
    rows = rows.withColumns(
        {
            "curve": F.when(F.col("line").isNull(), C.curve_of(text)),
            "pob": says(text, "BEG") & text.rlike(C.POINT_OF_BEGINNING),
            "feet": F.when(F.col("tie"), text.rlike(C.FEET)),
        }
    )
    flipped = F.coalesce(F.max(F.col("pob") & ~F.col("tie")).over(_by_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    parsed = F.col("line").isNotNull() | F.col("curve").isNotNull()
    kind = (
        F.when(F.col("tie") & (F.col("line").isNotNull() | F.col("feet")), "REFERENCE_TIE").when(F.col("tie") | ~parsed, "NOTE")
        .when(F.col("before_pob") & ~flipped, "COMMENCEMENT").otherwise("BOUNDARY")
    )
    return rows.select("doc_id", (F.row_number().over(_by_doc()) - 1).alias("pos"), "clause", "span_start", "span_end", kind.alias("kind"), "line", F.when(~F.col("tie"), F.col("curve")).alias("curve"), "rejoined")


def shared(classified: DataFrame) -> DataFrame:
    """The rows of ``classify`` for several readers: behind one shuffle of whole documents, in order.

    Spark reads a shuffle again only if it is the same for each reader.  Columns and filters
    of a reader would be moved below a shuffle of rows and make it another; they stop at the list.
    It has one partition more than others, as Spark leaves out a shuffle that would move nothing.
    """
    n = int(classified.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    docs = classified.groupBy("doc_id").agg(F.collect_list(F.struct("pos", *[c for c in classified.columns if c not in ("doc_id", "pos")])).alias("rows")).repartition(n, "doc_id")
    return docs.select("doc_id", F.inline(F.sort_array("rows")))


def _order():
    return Window.partitionBy("doc_id").orderBy("pos")


def boundary_calls(classified: DataFrame) -> DataFrame:
    """``doc_id, seq, id, call_type, clause, span_start, span_end, line, curve``."""
    rows = classified.where("kind = 'BOUNDARY'").withColumn("call_type", F.when(F.col("line").isNotNull(), "line").otherwise("curve"))
    per_type = Window.partitionBy("doc_id", "call_type").orderBy("pos")
    name = F.concat(F.when(F.col("call_type") == "line", "L").otherwise("C"), F.row_number().over(per_type))
    return rows.select("doc_id", F.row_number().over(_order()).alias("seq"), name.alias("id"), "call_type", "clause", "span_start", "span_end", "line", "curve")


def ties(classified: DataFrame) -> DataFrame:
    rows = classified.where("kind in ('COMMENCEMENT', 'REFERENCE_TIE')")
    kind = F.when(F.col("kind") == "COMMENCEMENT", "commencement").otherwise("reference_tie")
    return rows.select("doc_id", F.concat(F.lit("RT"), F.row_number().over(_order())).alias("id"), kind.alias("kind"), F.col("clause").alias("raw_text"), "line", "curve", "span_start", "span_end")


def ignored(classified: DataFrame) -> DataFrame:
    text = F.col("clause")
    return classified.where("kind = 'NOTE'").select(
        "doc_id", "pos", C.note_type(text).alias("type"), text.alias("text"), C.note_direction(text).alias("direction"), C.note_distance(text).alias("distance"), "span_start", "span_end"
    )


def errors(classified: DataFrame) -> DataFrame:
    return ignored(classified).where("type = 'Unknown / Unparsed'").select("doc_id", "pos", F.concat(F.lit("UNKNOWN_ELEMENT: '"), "text", F.lit("'")).alias("message"))


def status_columns() -> list[Column]:
    """Counters of a parse, and its status, as aggregates: a call out of range invalidates the document."""
    note = F.when(F.col("kind") == "NOTE", C.note_type(F.col("clause")))
    invalid = F.coalesce(~F.col("line.valid"), F.lit(False)) | F.coalesce(F.col("curve.radius") <= 0, F.lit(False))
    return [
        F.count_if(F.col("kind") == "BOUNDARY").alias("n_calls"),
        F.count_if(F.col("kind").isin("COMMENCEMENT", "REFERENCE_TIE")).alias("n_ties"),
        F.count_if(F.col("kind") == "NOTE").alias("n_ignored"),
        F.count_if(note == "Unknown / Unparsed").alias("n_errors"),
        F.count_if(note == "Unresolved Direction-Only Call").alias("n_unresolved"),
        F.when(F.coalesce(F.bool_or(invalid), F.lit(False)), "VALIDATION_ERROR").otherwise("OK").alias("parse_status"),
    ]


def document_status(classified: DataFrame) -> DataFrame:
    """The :func:`status_columns` of each document."""
    return classified.groupBy("doc_id").agg(*status_columns())
