"""GeoJSON, DXF, reports and projects as text columns, written by Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_closed(points: Column, tolerance: float | None = None) -> Column:
    """First point equals last, exactly unless a tolerance is given."""
    a, b = points[0], F.element_at(points, -1)
    same = (a["x"] == b["x"]) & (a["y"] == b["y"]) if tolerance is None else F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= tolerance
    return (F.size(points) >= 2) & same


def geojson(points: Column, commencement: Column | None = None, properties: Column | None = None, tolerance: float | None = None) -> Column:
    """A FeatureCollection: a polygon if closed, else a line; and the path to the beginning, if given."""
    coords = lambda p: F.to_json(F.transform(p, lambda q: F.array(q["x"], q["y"])))
    props = F.lit("{}") if properties is None else F.to_json(properties)
    shape = F.when(is_closed(points, tolerance), F.concat(F.lit('{"type":"Polygon","coordinates":['), coords(points), F.lit("]}"))).otherwise(
        F.concat(F.lit('{"type":"LineString","coordinates":'), coords(points), F.lit("}"))
    )
    boundary = F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), props, F.lit("}"))
    more = F.lit("")
    if commencement is not None:
        path = F.concat(F.lit(',{"type":"Feature","geometry":{"type":"LineString","coordinates":'), coords(commencement), F.lit('},"properties":{"type":"commencement_path"}}'))
        more = F.when(F.size(commencement) >= 2, path).otherwise("")
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), boundary, more, F.lit("]}"))


def dxf(points: Column, layer: str = "PARCEL") -> Column:
    """A minimal ASCII drawing with one light polyline; null with fewer than two points.

    A closed outline sets the flag and leaves out the repeated last point.
    """
    closed = is_closed(points)
    kept = F.when(closed, F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)
    head = ["0", "SECTION", "2", "ENTITIES", "0", "LWPOLYLINE", "100", "AcDbEntity", "8", layer, "100", "AcDbPolyline", "90"]
    rows = F.concat_ws(
        "\n",
        F.lit("\n".join(head)), F.size(kept).cast("string"), F.lit("70"), F.when(closed, "1").otherwise("0"),
        F.array_join(F.transform(kept, lambda p: F.format_string("10\n%.8f\n20\n%.8f", p["x"], p["y"])), "\n"),
        F.lit("0\nENDSEC\n0\nEOF\n"),
    )
    return F.when(F.size(points) >= 2, rows)


def report_json(report: DataFrame) -> DataFrame:
    """``doc_id, value``: each document's report as indented JSON: closure, crossings, curve errors."""
    closure = F.struct("dx", "dy", "misclosure", "perimeter", "precision")
    curves = F.coalesce("curve_errors", F.create_map().cast("map<int,array<string>>"))
    return report.select("doc_id", F.to_json(F.struct(closure.alias("closure"), F.col("hits").alias("intersections"), curves.alias("curve_errors")), {"pretty": "true"}).alias("value"))


def projects(docs: DataFrame) -> DataFrame:
    """Rows with the project columns as project files of version 1, one JSON text each."""
    fields = ["legal_text", "start_x", "start_y", "ocr_draft", "reference_image_path", "ocr_lines", "course_rows", "row_audits", "closure"]
    have = [F.col(c) if c in docs.columns else F.lit(None).alias(c) for c in fields]
    return docs.select("doc_id", F.to_json(F.struct(F.lit(1).alias("version"), *have), {"ignoreNullFields": "false"}).alias("value"))


def write_text(rows: DataFrame, path: str, column: str = "value") -> None:
    rows.select(F.col(column).alias("value")).write.text(path)


def write_shapefile(*_: object) -> None:
    raise NotImplementedError("shapefiles have no defined content")
