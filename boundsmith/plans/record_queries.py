"""Registered queries over typed rows, audits, suggestions, labels, single formulas and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from boundsmith.functions import bearings as B
from boundsmith.functions import courses as C
from boundsmith.functions.text import normalize_loose
from boundsmith.operators import clauses as K
from boundsmith.operators import geometry as G
from boundsmith.operators import older, records, resolve, tables, validate
from boundsmith.plans import synth
from boundsmith.plans.queries import CLEAR, _C, _CV, _SEG, _audits, _cells, flat_lines, parsed, query, r, synth_window
from boundsmith.sources import writers

_ROW = "SELECT l_orderkey AS doc_id, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS DOUBLE) AS q FROM lineitem"


def _rows(spark, sf_dir, **columns):
    rows = synth.lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("double").alias("q"))
    return rows.withColumns(columns) if columns else rows


def _docs(spark, sf_dir):
    return synth.lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id")).distinct()


def p():
    return F.col("p")


def s():
    return F.col("s")


def q():
    return F.col("q")


# Single formulas. -------------------------------------------------------------

@query(
    f"SELECT doc_id, p, s, CASE WHEN az <= 360 THEN round(CASE WHEN az = 360 THEN 0 ELSE az END, 6) + 0.0 END AS azimuth, CASE WHEN az > 360 THEN 'BAD_BEARING_FORMAT' END AS error FROM (SELECT *, p % 364 + CASE WHEN p % 364 = 360 THEN 0 ELSE (s % 60) / 60.0 END AS az FROM ({_ROW}))"
)
def azimuth_values(spark, sf_dir):
    got = B.azimuth_value(p() % 364, F.when(p() % 364 == 360, 0).otherwise(s() % 60), F.lit(0.0))
    return _rows(spark, sf_dir, g=got).select("doc_id", "p", "s", r("azimuth", 6, F.col("g.azimuth")), "g.error")


@query(f"SELECT doc_id, p, s, round(radians((p % 1440 + 180) % 360 - 180), 6) + 0.0 AS theta FROM ({_ROW})")
def half_turns(spark, sf_dir):
    return _rows(spark, sf_dir).select("doc_id", "p", "s", r("theta", 6, B.half_turn(F.radians((p() % 1440).cast("double") + 1e-9))))


@query(f"SELECT doc_id, p, s, CASE WHEN d > 0 THEN round(d * sin(radians(p % 360)), 6) + 0.0 END AS x, CASE WHEN d > 0 THEN round(d * cos(radians(p % 360)), 6) + 0.0 END AS y, CASE WHEN d <= 0 THEN 'Distance must be positive for line computation' END AS error FROM (SELECT *, q - s % 9 AS d FROM ({_ROW}))")
def line_ends(spark, sf_dir):
    got = B.line_end(F.lit(0.0), F.lit(0.0), (p() % 360).cast("double"), q() - s() % 9)
    return _rows(spark, sf_dir, g=got).select("doc_id", "p", "s", r("x", 6, F.col("g.x")), r("y", 6, F.col("g.y")), "g.error")


@query(
    "SELECT doc_id, p, s, CASE WHEN e IS NULL THEN round(CASE WHEN dl IS NOT NULL THEN radians(dl) WHEN arc IS NOT NULL THEN arc / rad ELSE 2 * asin(ch / (2 * rad)) END, 8) + 0.0 END AS delta, e AS error FROM (SELECT *, CASE WHEN kind = 'spiral' THEN 'UNKNOWN_ELEMENT' WHEN kind = 'tangent' AND inc IS NULL THEN 'NEEDS_REFERENCE_GEOMETRY' "
    "WHEN rad IS NULL OR side IS NULL THEN 'CURVE_INCOMPLETE' WHEN dl IS NOT NULL THEN CASE WHEN dl <= 0 THEN 'CURVE_INCOMPLETE' END WHEN arc IS NOT NULL THEN NULL WHEN ch IS NULL THEN 'CURVE_INCOMPLETE' WHEN ch > 2 * rad THEN 'CURVE_PARAM_MISMATCH' END AS e0, "
    "CASE WHEN e0 IS NOT NULL THEN e0 WHEN kind = 'non_tangent' AND p % 5 = 0 THEN 'NON_TANGENT_AMBIGUITY' END AS e FROM (SELECT *, CASE WHEN p % 7 = 6 THEN 'spiral' WHEN p % 2 = 0 THEN 'tangent' ELSE 'non_tangent' END AS kind, CASE WHEN s % 11 <> 0 THEN 10 END AS inc, CASE WHEN s % 13 <> 0 THEN q END AS rad, "
    f"CASE WHEN p % 17 <> 0 THEN 'left' END AS side, CASE WHEN s % 4 = 0 THEN p % 90 END AS dl, CASE WHEN s % 4 = 1 THEN p % 20 + 1 END AS arc, CASE WHEN s % 4 = 2 THEN p % 60 + 1 END AS ch FROM ({_ROW})))"
)
def curve_outcomes(spark, sf_dir):
    got = B.curve_outcome(
        F.when(p() % 7 == 6, "spiral").when(p() % 2 == 0, "tangent").otherwise("non_tangent"), F.when(s() % 11 != 0, 10.0), F.when(s() % 13 != 0, q()), F.when(p() % 17 != 0, "left"),
        F.when(s() % 4 == 0, (p() % 90).cast("double")), F.when(s() % 4 == 1, (p() % 20 + 1).cast("double")), F.when(s() % 4 == 2, (p() % 60 + 1).cast("double")), p() % 5 != 0,
    )
    return _rows(spark, sf_dir, g=got).select("doc_id", "p", "s", r("delta", 8, F.col("g.delta")), "g.error")


@query(
    "SELECT doc_id, p, s, CASE WHEN az <= 90 OR az > 270 THEN 'N' ELSE 'S' END AS ns, CAST(floor(th) AS INT) AS deg, CAST(s % 60 AS INT) AS minute, CASE WHEN az <= 180 THEN 'E' ELSE 'W' END AS ew "
    f"FROM (SELECT *, CASE WHEN az <= 90 THEN az WHEN az <= 180 THEN 180 - az WHEN az <= 270 THEN az - 180 ELSE 360 - az END + 1e-7 AS th FROM (SELECT *, CASE WHEN b < 90 THEN b + t WHEN b < 180 THEN 180 - (b - 90) - t WHEN b < 270 THEN 180 + (b - 180) + t ELSE 360 - (b - 270) - t END AS az FROM (SELECT *, p % 360 AS b, (s % 60) / 60.0 + 0.5 / 60 AS t FROM ({_ROW}))))"
)
def quadrants(spark, sf_dir):
    b, t = p() % 360, (s() % 60) / 60.0 + 0.5 / 60
    az = F.when(b < 90, b + t).when(b < 180, 270 - b - t).when(b < 270, b + t).otherwise(630 - b - t)
    q = older._rounded_quadrant(F.col("az"))
    return _rows(spark, sf_dir, az=az).withColumn("k", q).select("doc_id", "p", "s", "k.ns", "k.deg", "k.minute", "k.ew")


@query(f"SELECT doc_id, p, s, CASE p % 4 WHEN 0 THEN 'NORTH' WHEN 1 THEN 'SOUTHWEST' WHEN 2 THEN 'EAST' ELSE '' END AS short, CASE WHEN s % 3 = 0 THEN 'Ignored Text (' || p % 50 || ')' ELSE 'Ignored Text (' || p % 50 || ') — ' || s % 3 || ' unresolved' END AS title FROM ({_ROW})")
def titles(spark, sf_dir):
    word = F.when(p() % 4 == 0, "NORTHERLY").when(p() % 4 == 1, "SOUTHWESTERLY").when(p() % 4 == 2, "EASTERLY").otherwise("LY")
    return _rows(spark, sf_dir).select("doc_id", "p", "s", resolve.short_word(word).alias("short"), tables.ignored_title((p() % 50).cast("int"), (s() % 3).cast("int")).alias("title"))


@query(
    f"SELECT doc_id, p, s, CASE WHEN p % 2 = 0 THEN 'N ' || p % 90 || '° E / ' || q ELSE (CASE WHEN s % 3 = 0 THEN '' ELSE 'RIGHT' END) || ' R=' || q || ' Δ=' || CASE WHEN s % 2 = 0 THEN p % 90 || '°' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '''09\"' ELSE '' END END AS label FROM ({_ROW})"
)
def call_labels(spark, sf_dir):
    line = records.line_label(F.concat(F.lit("N "), p() % 90, F.lit("° E")), q())
    curve = records.curve_label(F.when(s() % 3 != 0, "right"), q(), F.when(s() % 2 == 0, (p() % 90).cast("int")), (s() % 60).cast("int"), F.lit(9.75))
    return _rows(spark, sf_dir).select("doc_id", "p", "s", F.when(p() % 2 == 0, line).otherwise(curve).alias("label"))


@query(
    f"SELECT doc_id, p, s, CASE WHEN p % 3 <> 0 THEN q END AS x, CASE WHEN p % 3 <> 0 THEN -q END AS y, CASE WHEN p % 3 = 0 THEN 'Start X and Start Y must be numeric.' END AS error, CASE WHEN s % 2 = 0 THEN 'deed ' || p ELSE '' END AS source_text, 0.0::DOUBLE AS start_x, CAST(floor(p % 100 * 0.5) AS INT) AS box_x, CAST(floor(s % 100 * 0.25) AS INT) AS box_height FROM ({_ROW})"
)
def start_points(spark, sf_dir):
    at = records.start_point(F.concat(F.lit(" "), q().cast("string")), F.when(p() % 3 == 0, "abc").otherwise((-q()).cast("string")))
    form = records.form_document(F.when(s() % 2 == 0, F.concat(F.lit("deed "), p())))
    box = records.highlight(p() % 100, p() % 100, s() % 100, s() % 100, F.lit(0.5), F.lit(0.25))
    rows = _rows(spark, sf_dir, a=at, f=form, b=box)
    return rows.select("doc_id", "p", "s", "a.x", "a.y", "a.error", "f.source_text", "f.start_x", F.col("b.x").alias("box_x"), F.col("b.height").alias("box_height"))


@query(f"SELECT doc_id, p, s, '\"' || p || '\" - ''A''  B' AS loose0, replace('\"' || p || '\" - ''A''  B', '  ', ' ') AS loose, '1 100 100 0°00''00\" A ' || p % 90 || '°00''00\" B ' || s % 90 || '°5''' AS cleaned FROM ({_ROW})")
def loose_texts(spark, sf_dir):
    raw = F.concat(F.lit(" “"), p(), F.lit("” – ‘A’ \n B "))
    dirty = F.concat(F.lit("| l00 I00 O° A "), p() % 90, F.lit(" degrees B "), s() % 90, F.lit(" ° 5 minutes"))
    return _rows(spark, sf_dir).select("doc_id", "p", "s", F.concat(F.lit('"'), p(), F.lit("\" - 'A'  B")).alias("loose0"), normalize_loose(raw).alias("loose"), F.trim(older.cleaned(dirty)).alias("cleaned"))


# Clauses. -----------------------------------------------------------------------

@query(
    "WITH d AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem), t AS (SELECT doc_id, 'ALONG SAID LINE ' || doc_id AS a, 'THENCE N 1°0''0\" E 5.00 FEET ' AS b, 'thence WEST 2.00 FEET' AS c FROM d) "
    "SELECT doc_id, 0 AS part, a AS clause, 0 AS span_start, length(a) AS span_end FROM t UNION ALL SELECT doc_id, 1, trim(b), length(a) + 1, length(a) + length(b) FROM t UNION ALL SELECT doc_id, 2, c, length(a) + 1 + length(b), length(a) + 1 + length(b) + length(c) FROM t"
)
def inner_thence(spark, sf_dir):
    text = F.concat(F.lit("ALONG SAID LINE "), "doc_id", F.lit(" THENCE N 1°0'0\" E 5.00 FEET thence WEST 2.00 FEET."))
    return K.split_clauses(_docs(spark, sf_dir).select("doc_id", text.alias("source_text"))).select("doc_id", "part", "clause", "span_start", "span_end")


_TIE_CASES = (
    ("THENCE SAID POINT BEING 5.00 FEET", True), ("as measured along the line", True), ("25 FEET FROM THE NORTHEAST CORNER", True), ("THENCE N 1°0'0\" E 5 FEET FROM THE NORTH CORNER", False),
    ("BEING 3 FEET FROM IT", True), ("DISTANT 4 FEET; FROM IT", False), ("MEASURED ALONG A LINE FROM IT", True), ("ALONG THE LINE", False), ("FROM THE POINT OF BEGINNING", True),
)


@query(f"SELECT doc_id, p, s, CASE p % {len(_TIE_CASES)} " + " ".join(f"WHEN {k} THEN {str(t).lower()}" for k, (_, t) in enumerate(_TIE_CASES)) + f" END AS tie FROM ({_ROW})")
def tie_phrases(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(c) for c, _ in _TIE_CASES]), (p() % len(_TIE_CASES) + 1).cast("int"))
    rows = _rows(spark, sf_dir, t=text)
    return rows.select("doc_id", "p", "s", (C.has_tie_keyword(F.col("t")) | C.is_reference_tie(F.col("t"))).alias("tie"))


# Typed rows. ----------------------------------------------------------------------

@query(
    _C + ", m AS (SELECT doc_id, seq, CASE WHEN seq % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 AND seq = 2 THEN 'Row 2: distance not numeric: ''abc''' ELSE '' END AS e, dist FROM c), b AS (SELECT doc_id, max(CASE WHEN e <> '' THEN 1 ELSE 0 END) AS bad FROM m GROUP BY doc_id) "
    "SELECT m.doc_id, CAST(seq AS INT) AS row_no, CASE WHEN e = '' THEN dist END AS dist, nullif(e, '') AS error FROM m JOIN b USING (doc_id) WHERE e IS NOT NULL AND (bad = 0 OR e <> '')"
)
def rows_all_or_nothing(spark, sf_dir):
    """One error empties a document; rows with only an id and type are blank."""
    n = F.col("n")
    rows = synth.courses(spark, sf_dir).withColumn("n", F.row_number().over(synth_window()))
    blank = lambda c: F.when(n % 4 == 0, "").otherwise(c)
    wrong = F.when((F.col("l_orderkey") % 3 == 0) & (n == 2), "abc").otherwise(F.col("dist").cast("string"))
    cells = rows.select(
        F.col("l_orderkey").alias("doc_id"), n.alias("row_no"), F.concat(F.lit("L"), n).alias("id"), F.when(n % 2 == 0, "").otherwise("Line").alias("type"),
        blank(F.lit("EAST")).alias("direction"), blank(wrong).alias("distance"), F.lit("").alias("radius"), F.lit(" ").alias("delta"),
    )
    return tables.calls_from_rows(cells, all_or_nothing=True).select("doc_id", "row_no", "line.dist", "error")


@query(_C + "SELECT doc_id, CAST(seq AS INT) AS row_no, p % 3 = 0 AND s % 3 = 0 AS blank, p % 3 = 0 AS blank_cells FROM c")
def blank_rows(spark, sf_dir):
    empty = F.lit(" ")
    rows = synth.courses(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(synth_window()).alias("row_no"), F.when(F.col("l_suppkey") % 3 == 0, empty).otherwise("L1").alias("id"), F.lit(None).cast("string").alias("type"),
        F.when(F.col("l_partkey") % 3 == 0, empty).otherwise("EAST").alias("direction"), empty.alias("distance"), empty.alias("radius"), empty.alias("delta"),
    )
    return rows.select("doc_id", "row_no", tables.is_blank().alias("blank"), tables.is_blank(tables.CELLS[2:]).alias("blank_cells"))


@query(_C + "SELECT doc_id, CAST(seq - 1 AS INT) AS row_index, 'L' || seq AS id, p FROM c")
def renumbered_rows(spark, sf_dir):
    rows = synth.lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), (F.row_number().over(synth_window()) * 3 + 5).alias("row_index"), F.lit("C9").alias("id"), F.col("l_partkey").alias("p"))
    return tables.renumbered(rows)


@query(_C + "SELECT doc_id, CAST(seq - 1 AS INT) AS row_index, CASE WHEN seq % 2 = 0 THEN 'Legal' ELSE 'S' || seq END AS source FROM c")
def audited_rows(spark, sf_dir):
    audits = _audits(spark, sf_dir)
    return tables.with_audit(audits.select("doc_id", "row_index"), audits.where("row_index % 2 = 0"))


@query("SELECT doc_id, CAST(unnest(range(n)) AS INT) AS row_index, 'Legal' AS source, '' AS reason FROM (SELECT l_orderkey AS doc_id, count(*) - 1 AS n FROM lineitem GROUP BY 1) WHERE doc_id % 5 <> 0")
def audits_reset(spark, sf_dir):
    counts = synth.lineitem(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc_id")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return records.cleared(records.all_legal(counts), counts.where("doc_id % 5 = 0")).select("doc_id", "row_index", "source", "reason")


@query(
    _C + "SELECT doc_id, CAST(seq - 1 AS INT) AS row_index, CASE p % 4 WHEN 0 THEN 'Legal' WHEN 1 THEN 'Manual' WHEN 2 THEN 'Suggested' ELSE 'Legal' END AS source, CASE WHEN p % 4 = 2 THEN 'why ' || s ELSE '' END AS reason, CASE WHEN p % 4 = 2 THEN dist END AS residual FROM c"
)
def audits_json(spark, sf_dir):
    """To JSON and back, with a field that nobody knows and a source that there isn't."""
    rows = synth.courses(spark, sf_dir).withColumn("row_index", F.row_number().over(synth_window()) - 1)
    p = F.col("l_partkey") % 4
    told = records.audit(F.lit("Suggested"), reason=F.concat(F.lit("why "), F.col("l_suppkey")), residual=F.col("dist"))
    audits = rows.withColumn("a", F.when(p == 1, records.manual_audit()).when(p == 2, told).when(p == 3, records.audit(F.lit("Elsewhere"))).otherwise(records.legal_audit()))
    texts = records.audits_to_json(audits.select(F.col("l_orderkey").alias("doc_id"), "row_index", "a.*"))
    texts = texts.withColumn("value", F.regexp_replace("value", r'\{"source"', '{"unknown":1,"source"'))
    return records.audits_from_json(texts).select("doc_id", "row_index", "source", "reason", "residual")


@query(
    f"SELECT doc_id, p, s, CASE p % 3 WHEN 0 THEN 'Source: Legal' || chr(10) || 'Row was parsed directly from the legal description.' WHEN 1 THEN 'Source: Manual' || chr(10) || 'Row was added by the technician via Add Row.' ELSE 'Source: Suggested (technician-approved)' || chr(10) || 'Method: closure_bracket' || chr(10) || "
    f"'Confidence: (unknown)' || chr(10) || 'Suggested bearing: N' || chr(10) || 'Suggested distance: ' || q || chr(10) || 'Direction word: -' || chr(10) || 'Fit residual: ' || q || '°' || chr(10) || 'Applied at: 2024-01-02T03:04:05+00:00' || chr(10) || chr(10) || 'Original unresolved text:' || chr(10) || '(none recorded)' || chr(10) || chr(10) || 'Reason:' || chr(10) || 'because' END AS detail FROM ({_ROW})"
)
def audit_details(spark, sf_dir):
    at = F.to_timestamp(F.lit("2024-01-02 03:04:05.678"))
    told = records.suggested_audit({"method": F.lit("closure_bracket"), "reason": F.lit("because"), "residual": q()}, F.lit("N"), q().cast("string"), at)
    a = F.when(p() % 3 == 0, records.legal_audit()).when(p() % 3 == 1, records.manual_audit()).otherwise(told)
    return _rows(spark, sf_dir, a=a).select("doc_id", "p", "s", records.detail_text(F.col("a")).alias("detail"))


@query(
    f"SELECT doc_id, p, s, 'w' || p AS text, CASE WHEN s % 2 = 0 THEN q END AS confidence, CAST(p % 100 AS INT) AS x, 0 AS height, CAST(p AS VARCHAR) AS row_id, CASE WHEN s % 3 = 0 THEN 'Legal' ELSE 'Manual' END AS row_source, '' AS row_delta FROM ({_ROW})"
)
def records_json(spark, sf_dir):
    """OCR lines and typed rows from JSON that leaves fields out."""
    confidence = F.when(s() % 2 == 0, q().cast("string")).otherwise("null")
    line = F.concat(F.lit('[{"text":"w'), p(), F.lit('","confidence":'), confidence, F.lit(',"x":'), p() % 100, F.lit("}]"))
    row = F.concat(F.lit('[{"id":'), p(), F.when(s() % 3 == 0, "").otherwise(',"source":"Manual"'), F.lit(',"other":[1]}]'))
    lines = records.ocr_lines_from_json(records.ocr_lines_to_json(records.ocr_lines_from_json(F.col("l"))))
    got = _rows(spark, sf_dir, l=line, w=row).withColumn("l", lines[0]).withColumn("w", records.rows_from_json(F.col("w"))[0])
    return got.select("doc_id", "p", "s", "l.text", "l.confidence", "l.x", "l.height", F.col("w.id").alias("row_id"), F.col("w.source").alias("row_source"), F.col("w.delta").alias("row_delta"))


@query(_C + "SELECT doc_id, CAST(count(*) AS INT) AS n, string_agg('L' || seq || '|' || CASE WHEN p % 10 = 9 THEN 'Spiral' WHEN p % 2 = 0 THEN 'Line' ELSE 'Curve' END || '|', ',' ORDER BY seq) AS cells FROM c GROUP BY doc_id")
def row_snapshots(spark, sf_dir):
    rows = _cells(spark, sf_dir).withColumn("row_index", F.col("row_no") - 1).withColumn("id", F.concat(F.lit("L"), "row_no"))
    cells = F.transform("rows", lambda x: F.concat_ws("|", x["id"], x["type"], x["source"]))
    return records.snapshot(rows).select("doc_id", F.size("rows").alias("n"), F.array_join(cells, ",").alias("cells"))


# Suggestions. ---------------------------------------------------------------------

@query(
    f"SELECT doc_id, p, s, CASE WHEN s % 3 = 0 THEN m || ': the unresolved call has no numeric distance.' WHEN p % 3 = 0 THEN m || ': direction word ''UPWARD'' is not in the cardinal or intercardinal table.' ELSE m || '.' END AS message FROM (SELECT *, 'No safe automatic suggestion. Manual resolution required' AS m FROM ({_ROW}))"
)
def unsuggestable(spark, sf_dir):
    word = F.when(p() % 3 == 0, "upward").when(p() % 3 == 1, "").otherwise("NORTH")
    return _rows(spark, sf_dir).select("doc_id", "p", "s", resolve.why_not(word, F.when(s() % 3 != 0, q())).alias("message"))


_SUGGESTED = (
    _C + ", z AS (SELECT doc_id, -sum(dx) AS tx, -sum(dy) AS ty, count(*) AS n, min(p) AS mp FROM v GROUP BY doc_id), y2 AS (SELECT *, fmod(degrees(atan2(tx, ty)) + 360, 360) AS az, sqrt(tx * tx + ty * ty) AS d FROM z), "
    "g AS (SELECT doc_id, n, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN n >= 2 AND d >= 1e-6 THEN 'closure_bracket' END ELSE 'direction_distance' END AS method, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN n >= 2 AND d >= 1e-6 THEN round(d, 2) + 0.0 END ELSE 52.0 END AS distance, az FROM y2) "
)


def _open_deeds(spark, sf_dir):
    """The courses; after the first a direction-only call, with its length in two of three documents."""
    p = F.col("doc_id")
    text = F.when(p % 3 == 0, "THENCE WESTERLY TO A POINT IN SAID LINE").otherwise("THENCE WESTERLY 52.00 FEET")
    docs = synth.bracket_deeds(spark, sf_dir)
    return docs.withColumn("source_text", F.replace("source_text", F.lit("THENCE WESTERLY TO A POINT IN SAID LINE"), text))


def _suggested(spark, sf_dir):
    classified = K.shared(K.classify(_open_deeds(spark, sf_dir)))  # read several times
    return classified, resolve.suggestions(K.boundary_calls(classified), K.ignored(classified))


@query(_SUGGESTED + "SELECT doc_id, 'WESTERLY' AS direction, method, distance, CASE WHEN method = 'direction_distance' THEN 270.0 WHEN method IS NULL THEN 270.0 ELSE round(az, 4) + 0.0 END AS azimuth FROM g")
def suggestions(spark, sf_dir):
    _, out = _suggested(spark, sf_dir)
    return out.select("doc_id", "direction", "method", r("distance", 2), r("azimuth"))


@query(
    _SUGGESTED + "SELECT doc_id, CAST(n AS INT) AS row_index, 'L' || (n + 1) AS id, 'Line' AS type, 'N 90°00''00\" W' AS direction, '52.00' AS distance, 'Suggested' AS source, 'direction_distance' AS method, 'medium' AS confidence, 'THENCE WESTERLY 52.00 FEET' AS original_text, '2024-01-02T03:04:05+00:00' AS timestamp FROM g WHERE method = 'direction_distance'"
)
def approved_rows(spark, sf_dir):
    """The rows that approving each suggestion by word appends, with their audits."""
    classified, found = _suggested(spark, sf_dir)
    lines = K.boundary_calls(classified)
    rows = lines.select("doc_id", (F.col("seq") - 1).alias("row_index"), "id", F.lit("Line").alias("type"), *[F.lit("").alias(c) for c in ("direction", "distance", "radius", "delta")], F.lit("Legal").alias("source"))
    audits = records.all_legal(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    notes = K.ignored(classified).select("doc_id", "span_start", "text")
    taken = found.where("method = 'direction_distance'").join(notes, ["doc_id", "span_start"])
    taken = taken.select("*", F.lit("N").alias("ns"), F.lit(90).alias("deg"), F.lit(0).alias("minute"), F.lit(0.0).alias("sec"), F.lit("W").alias("ew"))
    rows, audits = records.approved(rows, audits, taken, F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    new = rows.where("source = 'Suggested'").join(audits.select("doc_id", "row_index", "method", "confidence", "original_text", "timestamp"), ["doc_id", "row_index"])
    return new.select("doc_id", F.col("row_index").cast("int").alias("row_index"), "id", "type", "direction", "distance", "source", "method", "confidence", "original_text", "timestamp")


# Reports. ---------------------------------------------------------------------------

_HITS = (
    _SEG + ", hit AS (SELECT doc_id, string_agg(i || '-' || j, ',' ORDER BY i, j) AS hits, count(*) AS n_hits FROM cr WHERE (o1 > 0) <> (o2 > 0) AND (o3 > 0) <> (o4 > 0) AND least(abs(o1), abs(o2), abs(o3), abs(o4)) > 1e-6 GROUP BY doc_id), "
    "t3 AS (SELECT doc_id, count(*) AS n, sqrt(sum(dx)^2 + sum(dy)^2) AS mis FROM v GROUP BY doc_id) "
)


@query(_HITS + "SELECT doc_id, coalesce(hits, '') AS hits, round(mis, 3) + 0.0 AS misclosure, 0 AS curve_errors, 'OK' AS shape FROM t3 LEFT JOIN hit USING (doc_id)")
def report_files(spark, sf_dir):
    """The indented JSON of each document's report, read again."""
    report = validate.line_report(K.classify(synth.deeds(spark, sf_dir)), CLEAR)
    texts = writers.report_json(report.where("n_points is not null"))
    got = texts.select("doc_id", F.when(F.col("value").contains("\n  \""), "OK").alias("shape"), F.from_json("value", "closure struct<misclosure:double>, intersections array<struct<i:int,j:int>>, curve_errors map<string,array<string>>").alias("g"))
    return got.select("doc_id", F.array_join(F.transform("g.intersections", lambda x: F.concat_ws("-", x["i"], x["j"])), ",").alias("hits"), r("misclosure", 3, F.col("g.closure.misclosure")), F.size("g.curve_errors").alias("curve_errors"), "shape")


@query(
    _CV + "SELECT doc_id, string_agg(k2 || ':' || 'CURVE_INCOMPLETE', ',' ORDER BY k2) AS problems FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS k2 FROM g WHERE cv) WHERE p % 80 = 70 GROUP BY doc_id"
)
def report_curve_errors(spark, sf_dir):
    """Documents whose curves have problems, by the index of the curve: those without any angle."""
    calls = parsed(synth.curve_deeds(spark, sf_dir))
    curve = F.col("curve")
    flat = (F.col("call_type") == "curve") & (curve["delta_deg"] == 80)
    verts = G.vertices(G.build_geometry(calls))
    calls = calls.withColumn("curve", F.when(flat, curve.withField("delta_deg", F.lit(None).cast("int")).withField("delta_min", F.lit(None).cast("int"))).otherwise(curve))
    report = validate.validation_report(verts, calls)
    rows = report.where("curve_errors is not null").select("doc_id", F.map_entries("curve_errors").alias("e"))
    return rows.select("doc_id", F.array_join(F.transform("e", lambda x: F.concat(x["key"].cast("string"), F.lit(":"), F.array_join(x["value"], "+"))), ",").alias("problems"))


@query(
    _HITS + "SELECT doc_id, CASE WHEN doc_id % 19 <> 0 THEN n + 1 END AS n_points, CASE WHEN doc_id % 19 <> 0 THEN round(mis, 3) + 0.0 END AS misclosure, CASE WHEN doc_id % 19 <> 0 THEN coalesce(n_hits, 0) END AS n_intersections, CASE WHEN doc_id % 19 <> 0 THEN 0::BIGINT END AS n_curve_error_groups, doc_id % 19 = 0 AS has_errors FROM t3 LEFT JOIN hit USING (doc_id)"
)
def run_summary(spark, sf_dir):
    report = validate.line_report(K.classify(synth.deeds(spark, sf_dir)), CLEAR)
    return records.summarised(report).withColumn("misclosure", F.round("misclosure", 3) + F.lit(0.0))


@query(
    _C + ", q AS (SELECT doc_id, seq AS vtx, x, y FROM w UNION ALL SELECT DISTINCT doc_id, 0, 0.0, 0.0 FROM c), b AS (SELECT doc_id, min(x) AS x0, min(y) AS y0, least(920 / greatest(max(x) - min(x), 1.0), 620 / greatest(max(y) - min(y), 1.0)) AS k FROM q GROUP BY doc_id) "
    "SELECT doc_id, CAST(vtx AS INT) AS vtx, round(40 + (x - x0) * k, 3) + 0.0 AS px, round(660 - (y - y0) * k, 3) + 0.0 AS py FROM q JOIN b USING (doc_id)"
)
def viewport_points(spark, sf_dir):
    verts = G.walk_lines(flat_lines(parsed(synth.plain_deeds(spark, sf_dir))))
    return G.projected(verts).select("doc_id", "vtx", r("px", 3), r("py", 3))
