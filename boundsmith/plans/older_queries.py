"""Registered queries over the older dialect: each branch of its cascade, prose, narratives, ties, closing calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from boundsmith.operators import older
from boundsmith.plans import synth
from boundsmith.plans.queries import _C, query, r

_DOCS = "SELECT DISTINCT l_orderkey AS doc_id, CAST(l_orderkey % 90 AS INT) AS k FROM lineitem"


def _docs(spark, sf_dir, text):
    docs = synth.lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("k", (F.col("doc_id") % 90).cast("int"))
    return docs.select("doc_id", text.alias("source_text"))


def k():
    return F.col("k")



def _branch_deeds(spark, sf_dir):
    """One course a line, of every kind that the cascade knows."""
    p = F.col("l_partkey")
    dms = F.format_string("%d°%d'%d\"", F.col("deg"), F.col("minute"), F.col("sec").cast("int"))
    north = F.when(F.col("ns") == "N", "NORTH").otherwise("SOUTH")
    east = F.when(F.col("ew") == "E", "EAST").otherwise("WEST")
    feet = F.format_string("%.2f", "dist")
    text = (
        F.when(p % 10 == 0, F.concat_ws(" ", "ew", feet)).when(p % 10 == 1, F.concat(F.lit("BEING "), north, F.lit(" "), dms, F.lit(" "), east, F.lit(", "), feet, F.lit(" FEET")))
        .when(p % 10 == 2, F.concat_ws(" ", "ns", dms, "ew", feet, F.lit("feet"))).when(p % 10 == 3, F.concat_ws(" ", F.format_string("%d°%d'%d\"", (p % 360).cast("int"), F.col("minute"), F.col("sec").cast("int")), feet, F.lit("feet")))
        .when(p % 10 == 4, F.concat(F.lit("CURVE TO THE RIGHT RADIUS 50.00 FEET ARC "), feet, F.lit(" FEET"))).when(p % 10 == 5, "CURVE TO THE LEFT RADIUS 50.00 FEET")
        .when(p % 10 == 6, F.concat(north, F.lit(", "), feet, F.lit(" FEET"))).when(p % 10 == 7, F.concat(F.lit("A CURVE TO THE RIGHT, ARC "), feet, F.lit(" FEET")))
        .when(p % 10 == 8, "RECORDED IN SAID COUNTY").otherwise(F.concat(F.lit("JUNK "), p))
    )
    return synth._deed(synth.courses(spark, sf_dir), text, F.lit(""), F.lit(""), "\n")


_BRANCHES = (
    _C + ", b AS (SELECT *, p % 10 AS b, CASE p % 10 WHEN 0 THEN CASE WHEN ew = 'E' THEN 90.0 ELSE 270.0 END WHEN 1 THEN az WHEN 2 THEN az WHEN 3 THEN p % 360 + mi / 60.0 + sec / 3600.0 WHEN 6 THEN CASE WHEN ns = 'N' THEN 0.0 ELSE 180.0 END END AS oz FROM a), "
    "l AS (SELECT *, last_value(CASE WHEN b IN (1, 2, 6) THEN oz END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM b), "
    "n AS (SELECT *, CASE b WHEN 0 THEN 'cardinal' WHEN 1 THEN 'prose' WHEN 2 THEN 'quadrant' WHEN 3 THEN 'azimuth' WHEN 4 THEN 'curve' WHEN 5 THEN 'bad_curve' WHEN 6 THEN 'wordy' WHEN 7 THEN CASE WHEN carried IS NULL THEN 'unknown' ELSE 'arc_only' END WHEN 8 THEN 'silent' ELSE 'unknown' END AS kind FROM l) "
)


@query(
    _BRANCHES + "SELECT doc_id, CAST(seq AS INT) AS pos, kind, CASE WHEN kind IN ('bad_curve', 'unknown') THEN NULL WHEN kind = 'curve' THEN 'C' || seq ELSE 'L' || seq END AS id, round(CASE WHEN kind = 'arc_only' THEN carried ELSE oz END, 6) + 0.0 AS azimuth, "
    "CASE WHEN kind NOT IN ('bad_curve', 'unknown', 'curve') THEN dist END AS dist, CASE WHEN kind = 'curve' THEN 50.0 END AS radius, CASE WHEN kind = 'curve' THEN round(degrees(dist / 50), 6) END AS delta_deg, "
    "CASE WHEN kind = 'bad_curve' THEN 'CURVE_INCOMPLETE: line ' || seq || ': ''CURVE TO THE LEFT RADIUS 50.00 FEET''' WHEN b = 9 THEN 'UNKNOWN_ELEMENT: line ' || seq || ': ''JUNK ' || p || '''' WHEN kind = 'unknown' THEN 'UNKNOWN_ELEMENT: line ' || seq || ': ''A CURVE TO THE RIGHT, ARC ' || printf('%.2f', dist) || ' FEET''' END AS error FROM n WHERE kind <> 'silent'"
)
def legacy_branches(spark, sf_dir):
    out = older.parse(_branch_deeds(spark, sf_dir))
    return out.select("doc_id", "pos", "kind", "id", r("azimuth", 6), "dist", "radius", r("delta_deg", 6), "error")


@query(
    f"WITH d AS ({_DOCS}) SELECT doc_id, 1 AS pos, 'quadrant' AS kind, round(k + 20 / 60.0 + 30 / 3600.0, 6) + 0.0 AS azimuth, 17.0 AS dist, NULL AS error FROM d UNION ALL SELECT doc_id, 2, 'quadrant', round(360 - (1 + 2 / 60.0 + 3 / 3600.0), 6) + 0.0, 7.0, NULL FROM d "
    "UNION ALL SELECT doc_id, 3, 'cardinal', 90.0, k + 0.5, NULL FROM d UNION ALL SELECT doc_id, 4, 'arc_only', round(360 - (1 + 2 / 60.0 + 3 / 3600.0), 6) + 0.0, 9.0, NULL FROM d UNION ALL SELECT doc_id, 5, 'unknown', NULL, NULL, 'UNKNOWN_ELEMENT: line 5: ''SOUTHERLY ' || k || '''' FROM d"
)
def legacy_prose(spark, sf_dir):
    """A deed in prose, whose courses come in the order of the passes that find them."""
    text = F.concat(
        F.lit("A tract, beginning at a stone; THENCE EAST "), k(), F.lit(".5 FEET TO A POINT; thence\nalong a curve to the right, having an ARC LENGTH OF 9.00 FEET; "),
        F.lit("NORTH 1 DEGREES 2 MINUTES 3 SECONDS WEST, 7.00 FEET TO A POINT; NORTH 5°6'7\" EAST, 8.00 FEET TO A POINT ALONG IT; THENCE NORTH "), k(),
        F.lit("°20'30\" EAST along the line\nof said lot 17.00 FEET TO A POINT; THENCE SOUTHERLY "), k(),
    )
    return older.parse(_docs(spark, sf_dir, text)).select("doc_id", "pos", "kind", r("azimuth", 6), "dist", "error")


@query(
    f"WITH d AS ({_DOCS}) SELECT doc_id, 1 AS pos, 'L1' AS id, 'quadrant' AS kind, k + 0.5 AS azimuth, 17.0 AS dist FROM d UNION ALL SELECT doc_id, 2, 'L2', 'quadrant', 200.0, k + 1.25 FROM d UNION ALL SELECT doc_id, 3, 'L3', 'wordy', 90.0, 5.0 FROM d"
)
def legacy_compact(spark, sf_dir):
    """Three calls on one line."""
    text = F.concat(F.lit("N "), k(), F.lit("°30'0\" E 17.00 S 20°0'0\" W "), k() + 1, F.lit(".25 EAST 5.00"))
    return older.parse(_docs(spark, sf_dir, text)).select("doc_id", "pos", "id", "kind", r("azimuth", 6), "dist")


@query(
    f"WITH d AS ({_DOCS}) SELECT doc_id, 1 AS pos, 'C1' AS id, 'curve' AS kind, k + 10.0 AS radius, CASE WHEN k % 2 = 0 THEN round(degrees(10.0 / (k + 10)), 6) ELSE round(30 + 15 / 60.0 + 10 / 3600.0, 6) END AS delta_deg, 'right' AS handedness FROM d"
)
def legacy_narrative(spark, sf_dir):
    """A text without any call, read as a whole."""
    measure = F.when(k() % 2 == 0, "AN ARC LENGTH OF 10.00 FEET").otherwise("A CENTRAL ANGLE OF 30 DEGREES 15 MINUTES 10 SECONDS")
    text = F.concat(F.lit("RUNNING ALONG SAID CURVE, BENT TO THE RIGHT, HAVING A RADIUS OF "), k() + 10, F.lit(".00 FEET, "), measure)
    return older.parse(_docs(spark, sf_dir, text)).select("doc_id", "pos", "id", "kind", "radius", r("delta_deg", 6), "handedness")


@query(
    f"WITH d AS ({_DOCS}) SELECT doc_id, 0 AS n, k + 5.5 AS dist, 'SOUTHEASTERLY' AS direction_word, 'THE NORTH LINE' AS along_feature, 'THE CORNER' AS from_monument FROM d UNION ALL SELECT doc_id, 1, 7.25, 'WESTERLY', 'THE SOUTH LINE', 'A STONE ' || k FROM d"
)
def legacy_tie_pairs(spark, sf_dir):
    """Two ties in one sentence: the first monument ends where the next distance begins."""
    text = F.concat(k() + 5, F.lit(".5 FEET SOUTHEASTERLY, AS MEASURED ALONG THE NORTH LINE FROM THE CORNER 7.25 FEET WESTERLY, AS MEASURED ALONG THE SOUTH LINE FROM A STONE "), k(), F.lit(",."))
    return older.reference_ties(_docs(spark, sf_dir, text)).select("doc_id", "n", "dist", "direction_word", "along_feature", "from_monument")


@query(
    f"WITH d AS ({_DOCS}) SELECT doc_id, 'L3_CLOSURE' AS id, 225.0 AS azimuth, round((k + 1) * sqrt(2), 4) AS dist, 'S' AS ns, 45 AS deg, 0 AS minute, 0.0 AS sec, 'W' AS ew, '[DERIVED] S 45°0''0.0\" W' AS bearing_text, '[DERIVED] ' || CAST(round((k + 1) * sqrt(2), 4) AS VARCHAR) || ' FT TO THE POINT OF BEGINNING' AS raw_text FROM d WHERE k % 2 = 0"
)
def legacy_closing(spark, sf_dir):
    end = F.when(k() % 2 == 0, "\nTO THE TRUE POINT OF BEGINNING").otherwise("")
    docs = _docs(spark, sf_dir, F.concat(F.lit("N "), k() + 1, F.lit(".00\nE "), k() + 1, F.lit(".00"), end))
    return older.closing_calls(docs, older.parse(docs)).select("doc_id", "id", r("azimuth", 6), r("dist"), "ns", "deg", "minute", "sec", "ew", "bearing_text", "raw_text")


@query(f"WITH d AS ({_DOCS}) SELECT doc_id, 2 AS pos, 'UNKNOWN_ELEMENT: line 2: ''JUNK ' || k || '''' AS error FROM d")
def legacy_silent(spark, sf_dir):
    """A line with a word that names no course is dropped, another is an error."""
    text = F.concat(F.lit("BEGINNING AT A STONE\nJUNK "), k(), F.lit("\nOFFICIAL RECORDS\nA TRACT IN THE COUNTY"))
    return older.parse(_docs(spark, sf_dir, text)).select("doc_id", "pos", "error")
