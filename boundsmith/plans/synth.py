"""Descriptions rendered from ``lineitem``: one deed per order, one course per row.

The tables hold no descriptions, so texts are made from columns; SQL can compute
what parsing them must give straight from the same columns.  Rows are ordered by
``l_linenumber, l_partkey, l_suppkey, l_shipdate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *_KEY, "l_quantity")


def parts() -> dict[str, Column]:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return {
        "ns": F.when(p % 2 == 0, "N").otherwise("S"),
        "ew": F.when(s % 2 == 0, "E").otherwise("W"),
        "deg": (p % 90).cast("int"),
        "minute": (s % 60).cast("int"),
        "sec": (p % 60).cast("double"),
        "dist": F.col("l_quantity").cast("double"),
    }


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).withColumns(parts())


def _course_text() -> Column:
    deg, minute, sec = F.col("deg"), F.col("minute"), F.col("sec").cast("int")
    long_ns = F.when(F.col("ns") == "N", "NORTH").otherwise("SOUTH")
    long_ew = F.when(F.col("ew") == "E", "EAST").otherwise("WEST")
    plain = F.format_string("THENCE %s %d°%d'%d\" %s", "ns", deg, minute, sec, "ew")
    feet = F.format_string("%.2f FEET", "dist")
    style = F.col("l_orderkey") % 5
    return (
        F.when(style == 0, F.concat(plain, F.lit(" "), feet))
        .when(style == 1, F.concat(F.format_string("THENCE %s %d DEGREES %d MINUTES %d SECONDS %s, A DISTANCE OF ", long_ns, deg, minute, sec, long_ew), feet))
        .when(style == 2, F.concat(plain, F.lit(" ALONG THE LINE OF SAID TRACT "), feet))
        .when(style == 3, F.concat(plain, F.lit(" PARALLEL TO THE LINE OF LOT 24, "), feet))
        .otherwise(F.concat(F.format_string("THENCE %s '%d°%d\"%d\" %s ", "ns", deg, minute, sec, "ew"), F.translate(feet, ".", ",")))
    )


def _deed(rows: DataFrame, text: Column, before: Column, after: Column, glue: str = "; ") -> DataFrame:
    """The rows of an order, in order, as one text."""
    rows = rows.select(F.col("l_orderkey").alias("doc_id"), F.struct(*_KEY, text.alias("t")).alias("c"))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return rows.select("doc_id", F.concat(before, F.array_join(F.transform("c", lambda c: c["t"]), glue), after).alias("source_text"))


def deeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line courses in five styles, some with preamble, tie, direction-only call, note or junk."""
    k = F.col("doc_id")
    add = lambda n, t: F.when(k % n == 0, t).otherwise("")
    before = F.concat(
        add(7, "COMMENCING AT A MONUMENT; THENCE N 10°0'0\" E 5.00 FEET TO THE POINT OF BEGINNING; "), add(11, "BEING S 5°0'0\" W 25.00 FEET FROM THE NORTHEAST CORNER; ")
    )
    after = F.concat(add(13, "; THENCE WESTERLY 52.00 FEET"), add(17, "; AS SHOWN ON MAP"), add(19, "; THIS IS JUNK"), F.lit("."))
    return _deed(courses(spark, sf_dir), _course_text(), before, after)


def _line_text() -> Column:
    return F.format_string("THENCE %s %d°%d'%d\" %s %.2f FEET", "ns", F.col("deg"), F.col("minute"), F.col("sec").cast("int"), "ew", "dist")


def plain_deeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every course in the plainest style."""
    return _deed(courses(spark, sf_dir), _line_text(), F.lit(""), F.lit("."))


def split_deeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distance stands behind a stray semicolon."""
    text = F.format_string("THENCE %s %d°%d'%d\" %s ALONG SAID LINE; %.2f FEET", "ns", F.col("deg"), F.col("minute"), F.col("sec").cast("int"), "ew", "dist")
    return _deed(courses(spark, sf_dir), text, F.lit(""), F.lit("."))


def curve_deeds(spark: SparkSession, sf_dir: str, concave: bool = False) -> DataFrame:
    """Every third line number is a tangent curve; with ``concave`` its side is a concavity."""
    p = F.col("l_partkey")
    side = F.when(p % 2 == 0, "RIGHT").otherwise("LEFT")
    where = F.concat(F.lit("CONCAVE "), F.when(p % 4 == 0, "EASTERLY").when(p % 4 == 1, "NORTHERLY").when(p % 4 == 2, "WESTERLY").otherwise("SOUTHERLY"))
    how = F.concat(F.lit(" "), where) if concave else F.concat(F.lit(" TO THE "), side)
    curve = F.concat(
        F.lit("THENCE ALONG A TANGENT CURVE"), how,
        F.format_string(", RADIUS OF %.2f FEET, A CENTRAL ANGLE OF %d°%d'%d\"", F.col("dist") + 10, 10 + p % 80, F.col("minute"), F.col("sec").cast("int")),
    )
    line = _line_text()
    return _deed(courses(spark, sf_dir), F.when(F.col("l_linenumber") % 3 == 0, curve).otherwise(line), F.lit(""), F.lit("."))


def bracket_deeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The courses, with one direction-only call after the first of them."""
    text = _line_text()
    rows = courses(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.struct(*_KEY, text.alias("t")).alias("c")).groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    texts = F.transform("c", lambda c: c["t"])
    open_call = F.array(F.lit("THENCE WESTERLY TO A POINT IN SAID LINE"))
    return rows.select("doc_id", F.array_join(F.concat(F.slice(texts, 1, 1), open_call, F.slice(texts, F.lit(2), F.size(texts))), "; ").alias("source_text"))


def older_deeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One course a line: cardinals, azimuths, quadrants and wordy ones by line number."""
    n = F.col("l_linenumber") % 4
    text = (
        F.when(n == 0, F.format_string("%s %.2f", "ew", "dist")).when(n == 1, F.format_string("%d°%d'%d\" %.2f feet", (F.col("l_partkey") % 360).cast("int"), F.col("minute"), F.col("sec").cast("int"), "dist"))
        .when(n == 2, F.format_string("%s %d°%d'%d\" %s %.2f feet", "ns", F.col("deg"), F.col("minute"), F.col("sec").cast("int"), "ew", "dist"))
        .otherwise(F.format_string("%s %.2f feet", F.when(F.col("ns") == "N", "NORTH").otherwise("SOUTH"), "dist"))
    )
    return _deed(courses(spark, sf_dir), text, F.lit(""), F.when(F.col("doc_id") % 2 == 0, "\nTO THE POINT OF BEGINNING").otherwise(""), "\n")
