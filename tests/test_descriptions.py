"""Golden values for parsing, geometry, checks, suggestions, sections and tables."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boundsmith.functions import bearings as B
from boundsmith.functions import courses as C
from boundsmith.functions.text import normalize, repair_bearings
from boundsmith.operators import clauses as K
from boundsmith.operators import geometry as G
from boundsmith.operators import older, resolve, sections, tables, validate
from boundsmith.sources import readers, writers

# Eight courses with their end points.
TRACT = [
    ("S 03°25'14\" E", "3.17", 0.189136, -3.164353),
    ("N 86°35'46\" E", "4.00", 4.182080, -2.926856),
    ("S 03°25'14\" E", "6.00", 4.540067, -8.916167),
    ("S 86°34'46\" W", "4.00", 0.547193, -9.154825),
    ("S 03°25'14\" E", "18.42", 1.646213, -27.542010),
    ("S 86°34'46\" W", "57.73", -55.980940, -30.986441),
    ("N 01°21'30\" W", "27.60", -56.635203, -3.394197),
    ("N 86°34'46\" E", "56.74", 0.003714, -0.008833),
]


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, source_text string")


def calls(spark, text):
    return K.boundary_calls(K.classify(docs(spark, text)))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tract(spark):
    text = "COMMENCING at a stone; THENCE S 87°30'01\" W 14.60 feet to the POINT OF BEGINNING; " + "; ".join(f"THENCE {b} {d} feet" for b, d, _, _ in TRACT) + "."
    classified = K.classify(docs(spark, text))
    got = K.boundary_calls(classified)
    assert [r.id for r in got.orderBy("seq").collect()] == [f"L{i}" for i in range(1, 9)]
    norm = value(spark, normalize(F.lit(text)))
    for r in got.collect():
        assert norm[r.span_start : r.span_end] == r.clause
    tie = K.ties(classified).collect()
    assert [(t.id, t.kind, t.line.dist) for t in tie] == [("RT1", "commencement", 14.60)]
    verts = G.vertices(G.build_geometry(got)).orderBy("vtx").collect()
    for v, (_, _, x, y) in zip(verts[1:], TRACT, strict=True):
        assert v.x == pytest.approx(x, abs=1e-6) and v.y == pytest.approx(y, abs=1e-6)
    report = validate.closure(G.vertices(G.build_geometry(got))).first()
    assert report.misclosure == pytest.approx(0.009582175, abs=1e-8)
    assert report.perimeter == pytest.approx(177.66)
    assert report.precision == pytest.approx(18540.676, abs=1)
    assert [n.type for n in K.ignored(classified).collect()] == ["Boilerplate"]
    assert K.document_status(classified).first().parse_status == "OK"


REPAIRS = [
    ("South '50°00°00\" East", "South 50°00'00\" East"),
    ("North 44°05\" 00\" East", "North 44°05' 00\" East"),
    ("NORTH 31°11\" EAST", "NORTH 31°11' EAST"),
    ("65\" 36) 12\"", "65° 36' 12\""),
    ("16°35¢ 20%", "16°35' 20\""),
    ("53°38! 00\"", "53°38' 00\""),
    ("56°22* 00\"", "56°22' 00\""),
    ("20,00 feet", "20.00 feet"),
    ("1,234 feet", "1,234 feet"),
    ("SOUTH 45°30'10\" EAST 100.00 FEET", "SOUTH 45°30'10\" EAST 100.00 FEET"),
]


def test_repairs_are_idempotent(spark):
    df = spark.createDataFrame(REPAIRS, "dirty string, clean string")
    once = repair_bearings(F.col("dirty"))
    for r in df.select("clean", once.alias("a"), repair_bearings(once).alias("b")).collect():
        assert r.a == r.clean == r.b


@pytest.mark.parametrize("word", ["Fast", "Bast", "Eagt", "EACH"])
def test_typos_are_no_course(spark, word):
    assert calls(spark, f"THENCE SOUTH 45°30'10\" {word} 100.00 FEET").count() == 0


def test_line_patterns_and_traps(spark):
    one = lambda t: calls(spark, t).collect()
    assert one("S 47° W 200 FEET") == []
    assert one("S 47°10' W 200 FEET")[0].line.sec == 0.0
    assert one("N 1°2'3\" E PARALLEL TO THE LINE OF SAID LOT 24, 244.61 FEET")[0].line.dist == 244.61
    assert one("IN 45°30'10\" E 100")[0].line.ns == "N"
    lines = one("N 1°0'0\" E 10\nN 2°0'0\" E 20")  # line ends don't separate
    assert len(lines) == 1 and lines[0].line.dist == 10
    assert K.document_status(K.classify(docs(spark, "N 10°75'00\" E 5 FEET"))).first().parse_status == "VALIDATION_ERROR"
    assert K.document_status(K.classify(docs(spark, "this is junk"))).first().n_errors == 1


def test_rejoin_and_ties(spark):
    text = "THENCE S 34°39'40\" W ALONG SAID LOT; 113.31 FEET TO A STONE; BEGINNING S 5°0'0\" W 25.00 FEET FROM THE NORTHEAST CORNER, THENCE S 5°18'0\" W 200 FEET"
    classified = K.classify(docs(spark, text))
    assert [(r.line.deg, r.line.dist) for r in K.boundary_calls(classified).orderBy("seq").collect()] == [(34, 113.31), (5, 200.0)]
    assert [t.kind for t in K.ties(classified).collect()] == ["reference_tie"]


SIDES = [
    ("EAST", 0, "right"), ("WEST", 0, "left"), ("SOUTH", 90, "right"), ("NORTH", 90, "left"), ("WEST", 180, "right"), ("EAST", 180, "left"),
    ("NORTH", 270, "right"), ("SOUTH", 270, "left"), ("NORTHEASTERLY", 270, "right"), ("SOUTHWESTERLY", 90, "right"),
    ("NORTH", 0, None), ("SOUTH", 0, None), ("EAST", 90, None), ("WEST", 270, None), ("DIAGONAL", 0, None),
]


def test_concavity(spark):
    df = spark.createDataFrame([(f"CONCAVE {w}", float(a), s) for w, a, s in SIDES] + [("EAST", 0.0, None), ("", 0.0, None), (None, 0.0, None)], "f string, az double, side string")
    for r in df.withColumn("got", B.concave_side(F.col("f"), F.col("az"))).collect():
        assert r.got == r.side, r


@pytest.mark.parametrize(
    ("text", "x", "y"),
    [
        ("N 0°0'0\" E 100 FEET; THENCE ALONG A CURVE CONCAVE EASTERLY, RADIUS OF 50 FEET, AN ARC DISTANCE OF 78.5398 FEET", 50, 150),
        ("N 0°0'0\" E 100 FEET; THENCE ALONG A CURVE CONCAVE WESTERLY, RADIUS OF 50 FEET, AN ARC DISTANCE OF 78.5398 FEET", -50, 150),
        ("N 90°0'0\" E 100 FEET; THENCE ALONG A CURVE CONCAVE SOUTHERLY, RADIUS 50 FEET, CENTRAL ANGLE OF 90°00'00\"", 150, -50),
        ("N 90°0'0\" E 100 FEET; THENCE ALONG A CURVE TO THE LEFT, RADIUS 50 FEET, DELTA 90°", 150, 50),
        ("N 0°0'0\" E 100 FEET; THENCE ALONG A CURVE CONCAVE NORTHERLY, RADIUS 50 FEET, DELTA 90°", 0, 100),
    ],
)
def test_arcs(spark, text, x, y):
    g = G.build_geometry(calls(spark, text)).first()
    assert g.points[-1].x == pytest.approx(x, abs=1e-3) and g.points[-1].y == pytest.approx(y, abs=1e-3)
    assert len(g.points) in (2, 91, 92)


def test_non_tangent_and_strict_bearings(spark):
    arc = value(spark, F.element_at(G.radial_arc_points(F.lit(0.0), F.lit(0.0), F.lit(270.0), F.lit(50.0), F.radians(F.lit(90.0)), F.lit(1.0), F.lit(12)), -1))
    assert (round(arc.x, 6), round(arc.y, 6)) == (50.0, 50.0)
    assert value(spark, B.strict_azimuth(F.lit("N"), F.lit("E"), F.lit(95.0))) is None
    assert value(spark, B.quadrant_azimuth(F.lit("N"), F.lit("W"), F.lit(0.0))) == 360.0
    assert value(spark, B.derived_delta(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(100.0), F.lit(50.0))) == pytest.approx(math.pi)


def vertices(spark, *points):
    return spark.createDataFrame([("d", i, float(x), float(y)) for i, (x, y) in enumerate(points)], "doc_id string, vtx int, x double, y double")


def test_checks(spark):
    square = vertices(spark, (0, 0), (100, 0), (100, 100), (0, 100), (0, 0))
    assert validate.closure(square).first().precision is None
    assert validate.self_intersections(square).count() == 0
    assert validate.closure(vertices(spark, (0, 0))).first().error
    assert validate.closure(vertices(spark, (0, 0), (3, 4))).first().misclosure == 5.0
    bow = vertices(spark, (0, 0), (10, 10), (0, 10), (10, 0), (0, 0))
    assert [(r.i, r.j) for r in validate.self_intersections(bow).collect()] == [(0, 2)]
    none = F.lit(None).cast("double")
    assert value(spark, validate.curve_problems(F.lit("tangent"), F.lit(10.0), none, none, F.lit(50.0))) == ["CURVE_PARAM_MISMATCH"]
    assert "CURVE_INCOMPLETE" in value(spark, validate.curve_problems(F.lit("non_tangent"), none, none, F.lit(5.0), none))


def test_brackets(spark):
    text = "N 90°0'0\" E 100 FEET; S 0°0'0\" E 50 FEET; THENCE WESTERLY TO A POINT IN SAID LINE; N 0°0'0\" E 50 FEET"
    classified = K.classify(docs(spark, text))
    got = resolve.suggestions(K.boundary_calls(classified), K.ignored(classified)).first()
    assert (got.method, got.distance, got.residual, got.confidence) == ("closure_bracket", 100.0, 0.0, "medium")
    assert got.azimuth == pytest.approx(270) and "Solved from closure bracket: 2 known call(s) before and 1 after" in got.reason
    two = K.classify(docs(spark, text + "; THENCE NORTHERLY TO A POINT"))
    assert {r.method for r in resolve.suggestions(K.boundary_calls(two), K.ignored(two)).collect()} == {None}
    paired = K.classify(docs(spark, "S 00°24'19\" W 60 FEET; THENCE WESTERLY TO A POINT DISTANT SOUTHERLY 52 FEET FROM SAID LINE; THENCE NORTHERLY 52 FEET; S 89°35'41\" E 120 FEET TO THE POINT OF BEGINNING"))
    rows = {r.direction: r for r in resolve.suggestions(K.boundary_calls(paired), K.ignored(paired)).collect()}
    assert rows["WESTERLY"].method == "paired_bracket" and rows["WESTERLY"].distance == pytest.approx(119.9, abs=0.5) and rows["WESTERLY"].residual == pytest.approx(4.23)
    assert rows["NORTHERLY"].method == "direction_distance" and rows["NORTHERLY"].distance == 52


def test_sections(spark):
    texts = [
        "Preface here. PARCEL 1: A piece of PARCEL 2 land.\nEXHIBIT A map. EASEMENT PARCEL NO. 3 over", "THE TRUE POINT OF BEGINNING OF THE BOUNDARY. PARCEL TWO: x", "\n\n PARCEL A: y", "no header", "  ", "",
    ]
    got = {}
    for r in sections.split_sections(docs(spark, *texts)).orderBy("doc_id", "sec_no").collect():
        got.setdefault(int(r.doc_id[1:]), []).append(r)
    for i, t in enumerate(texts):
        if t.strip():
            assert "".join(s.text for s in got[i]) == t
            assert all(t[s.start : s.end] == s.text for s in got[i])
        else:
            assert i not in got
    assert [(s.label, s.section_type) for s in got[0]] == [("BOILERPLATE", "boilerplate"), ("PARCEL 1", "parcel"), ("EXHIBIT A", "exhibit"), ("EASEMENT PARCEL NO. 3", "easement")]
    assert [s.section_type for s in got[1]] == ["commencement", "parcel"]
    assert [s.label for s in got[2]] == ["PARCEL A"]
    assert [s.section_type for s in got[3]] == ["boilerplate"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="PARCEL 1.:;\nXbEHI", max_size=40), min_size=1, max_size=8))
def test_sections_concatenate(spark, texts):
    joined = sections.split_sections(docs(spark, *texts)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sec_no", "text"))).alias("s"))
    for r in joined.collect():
        assert "".join(s.text for s in r.s) == texts[int(r.doc_id[1:])]


def test_tables(spark):
    rows = spark.createDataFrame(
        [("d", 1, "L1", "Line", "N 00°00'00\" E", "100.00", "", ""), ("d", 2, "", "", " ", "", None, ""), ("d", 3, "C1", "Curve", "RIGHT", "78.54", "50.00", "90°00'00\""), ("d", 4, "x", "Spiral", "", "", "", ""), ("d", 5, "", "Line", "W", "-3", "", "")],
        "doc_id string, row_no int, id string, type string, direction string, distance string, radius string, delta string",
    )
    got = {r.row_no: r for r in tables.calls_from_rows(rows).collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert got[1].line.dist == 100.0 and got[3].curve.deg == 90 and got[3].curve.arc == 78.54
    assert got[4].error == "Row 4: type 'spiral' not supported (use 'Line' or 'Curve')"
    assert got[5].error == "Row 5: distance must be positive: -3.0"
    assert tables.calls_from_rows(rows, all_or_nothing=True).where("error is null").count() == 0
    for text, want in (("45.5", (45, 30, 0.0)), ("45°30'", (45, 30, 0.0)), ("90", (90, 0, 0.0)), ("10°70'", (None, None, None))):
        d = value(spark, tables.delta_angle(F.lit(text)))
        assert (d.deg, d.minute, d.sec) == want
    styles = spark.createDataFrame([("d", i, f"L{i}", k) for i, k in enumerate(["legal", "tie", "suggest", None])], "doc_id string, row_index int, course_id string, kind string")
    got = tables.course_styles(styles).orderBy("row_index").collect()
    assert [s.boundary_index for s in got] == [0, -1, 1, 2] and got[2].color == tables.PALETTE[1]
    assert value(spark, tables.ignored_title(F.lit(5), F.lit(2))) == "Ignored Text (5) — 2 unresolved"


def test_ocr(spark):
    words = spark.createDataFrame(
        [("i", 0, 1, 1, 1, "THENCE", "90", "10", "5", "50", "20"), ("i", 1, 1, 1, 1, "NORTH", "80", "70", "5", "60", "20"), ("i", 2, 1, 1, 2, "46.68", "90", "10", "40", "30", "20"), ("i", 3, 1, 1, 2, "FEET", "-1", "45", "40", "30", "20"), ("i", 4, 1, 1, 3, " ", "9", "1", "1", "1", "1")],
        "image string, word_idx int, block_num int, par_num int, line_num int, text string, conf string, left string, top string, width string, height string",
    )
    lines = tables.words_to_lines(words)
    got = lines.orderBy("line_no").collect()
    assert [(r.text, r.confidence, r.x, r.y, r.width, r.height) for r in got] == [("THENCE NORTH", 85.0, 10, 5, 120, 20), ("46.68 FEET", 90.0, 10, 40, 65, 20)]
    assert tables.reading_order(lines).first().text == "THENCE NORTH\n46.68 FEET"
    assert readers.resolve_ocr_binary({"TESSERACT_CMD": "/x"}, lambda p: p == "/x", lambda n: None) == "/x"
    assert readers.resolve_ocr_binary({}, lambda p: False, lambda n: None) is None


def test_older_dialect(spark):
    df = docs(spark, "E 100\nN 0°0'0\" E 50 feet\nALONG A CURVE TO THE LEFT, AN ARC LENGTH OF 10 FEET\n90°0'0\" 20 feet\nCURVE TO THE RIGHT RADIUS OF 50 FEET ARC LENGTH OF 25 FEET\nRECORDED IN BOOK 3\njunk\nTO THE POINT OF BEGINNING")
    got = older.parse(df).orderBy("pos").collect()
    assert [r.kind for r in got] == ["cardinal", "quadrant", "arc_only", "azimuth", "curve", "unknown"]
    assert [r.azimuth for r in got[:4]] == [90.0, 0.0, 0.0, 90.0]
    assert got[4].delta_deg == pytest.approx(math.degrees(0.5))
    close = older.closing_calls(df, older.parse(df)).first()
    assert close.dist == pytest.approx(math.hypot(120, 60)) and close.basis == "assumed"


def test_older_dialect_compact_and_narrative(spark):
    df = docs(
        spark, "N 10°0'0\" E 100 N 80°0'0\" E 50 EAST 20 feet", "E 100\r\nN 5\rW 7", "N 10°0'0\"\nE\n100 FEET ALONG A\nCURVE TO THE RIGHT HAVING A\nRADIUS OF 50 FEET AN\nARC LENGTH OF 25 FEET",
        "NORTH 10°0'0\" EAST 100 feet", "junk",
    )
    got = {}
    for r in older.parse(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r)
    compact, breaks, told, words, junk = (got[k] for k in sorted(got))
    assert [(r.id, r.kind, r.azimuth, r.dist) for r in compact] == [("L1", "quadrant", 10.0, 100.0), ("L2", "quadrant", 80.0, 50.0), ("L3", "wordy", 90.0, 20.0)]
    assert [(r.id, r.azimuth, r.dist) for r in breaks] == [("L1", 90.0, 100.0), ("L2", 0.0, 5.0), ("L3", 270.0, 7.0)]
    assert [(r.id, r.kind, r.azimuth, r.dist, r.radius, r.handedness) for r in told] == [("L1", "narrative", 10.0, 100.0, None, None), ("C1", "curve", None, None, 50.0, "right")]
    assert told[1].delta_deg == pytest.approx(math.degrees(0.5))
    assert [(r.kind, r.dist) for r in words] == [("quadrant", 100.0)] and junk[0].error.startswith("UNKNOWN_ELEMENT: line 1")


def test_older_dialect_prose(spark):
    """Where prose has courses, they are all the lines there are."""
    df = docs(
        spark, "E 100; THENCE N 10°0'0\"\nE\n100 FEET ALONG A CURVE; W 5", "THENCE NORTH 10 DEGREES 20 MINUTES EAST, ALONG IT, 30.5 FEET; THENCE EAST, 12 FEET TO A POINT",
        "FROM NORTH 10°20'30 WEST to it 100.00", None, "",
    )
    got = {}
    for r in older.parse(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.kind, round(r.azimuth, 4), r.dist))
    assert got == {
        "d0": [(1, "quadrant", 10.0, 100.0)], "d1": [(1, "quadrant", 10.3333, 30.5), (2, "wordy", 90.0, 12.0)], "d2": [(1, "prose", round(360 - 10 - 20.5 / 60, 4), 100.0)],
    }


def test_exports(spark, tmp_path):
    g = G.build_geometry(calls(spark, "N 0°0'0\" E 10 FEET; N 90°0'0\" E 10 FEET"))
    assert '"LineString"' in g.select(writers.geojson(F.col("points")).alias("v")).first().v
    drawing = g.select(writers.dxf(F.col("points")).alias("v")).first().v
    assert drawing.count("\n10\n") == 3 and drawing.endswith("EOF\n")
    path = tmp_path / "a.txt"
    path.write_text("N 0°0'0\" E 10 FEET", encoding="utf-8")
    got = readers.read_descriptions(spark, str(path))
    assert K.boundary_calls(K.classify(got)).count() == 1
    (tmp_path / "p.json").write_text('{"version": 1, "legal_text": "x", "course_rows": [], "extra": 5}')
    assert readers.read_projects(spark, str(tmp_path / "p.json")).first().legal_text == "x"
    with pytest.raises(NotImplementedError):
        writers.write_shapefile()


def test_stream(spark, tmp_path):
    from boundsmith.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("N 0°0'0\" E 10 FEET; THIS IS JUNK", encoding="utf-8")
    stream = watch.description_stream(spark, str(tmp_path / "in"))
    q = watch.each_batch(stream, lambda df: K.classify(df).select("doc_id", "pos", "kind"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["BOUNDARY", "NOTE"]


def test_empty_tables(spark):
    none = docs(spark).limit(0) if False else spark.createDataFrame([], "doc_id string, source_text string")
    assert K.classify(none).count() == 0 and sections.split_sections(none).count() == 0
    assert G.build_geometry(K.boundary_calls(K.classify(none))).count() == 0
    assert K.classify(docs(spark, None, "")).count() == 0


def test_effective_distance(spark):
    d = lambda t: value(spark, C.effective_distance(F.lit(t), C.note_direction(F.lit(t)), C.note_distance(F.lit(t))))
    assert d("THENCE WESTERLY ALONG THE LINE 52 FEET") == 52
    assert d("THENCE WESTERLY TO A POINT 52 FEET FROM") is None
    assert d("THENCE WESTERLY") is None


# OCR ---------------------------------------------------------------------------

def test_images_are_recognised_or_say_why_not(spark):
    from boundsmith.operators import tables
    from boundsmith.sources import ocr

    class FakeProgram:
        """Gives the words that stand in the bytes of the image, one a line."""

        def text(self, content):
            if content == b"broken":
                raise RuntimeError("no image")
            return content.decode()

        def words(self, content):
            found = self.text(content).split()
            n = len(found)
            return {"block_num": [1] * n, "par_num": [1] * n, "line_num": list(range(n)), "text": found, "conf": ["90"] * n, "left": [5] * n, "top": [20 * k for k in range(n)], "width": [30] * n, "height": [9] * n}

    images = spark.createDataFrame([("a", b"THENCE NORTH"), ("b", b"broken"), ("c", b"")], "image string, content binary")
    got = {r.image: (r.status, r.text) for r in ocr.image_texts(images, FakeProgram).collect()}
    assert got == {"a": ("OK", "THENCE NORTH"), "b": ("OCR_FAILED: no image", None), "c": ("OK", "")}
    words = ocr.image_words(images, FakeProgram)
    assert {r.status for r in words.where("image = 'b'").collect()} == {"OCR_FAILED: no image"}
    lines = tables.words_to_lines(words)
    assert [(r.text, r.confidence, r.x, r.y, r.width, r.height) for r in lines.orderBy("line_no").collect()] == [("THENCE", 90.0, 5, 0, 30, 9), ("NORTH", 90.0, 5, 20, 30, 9)]

    def none(name):
        raise ImportError(name)

    class Binding:
        class pytesseract:  # noqa: N801
            tesseract_cmd = ""

    for load, resolve, status in ((none, lambda: "x", "OCR_LIBRARY_MISSING"), (lambda name: Binding, lambda: None, "OCR_NOT_AVAILABLE")):
        found = ocr.image_texts(images, lambda load=load, resolve=resolve: ocr.Program(load, resolve)).collect()
        assert {(r.status, r.text) for r in found} == {(status, None)}
