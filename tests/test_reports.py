"""Reports, summaries and approved rows read the classified clauses once, and give what their parts give."""

import pytest

from boundsmith.operators import clauses as K
from boundsmith.operators import geometry as G
from boundsmith.operators import records, validate
from boundsmith.plans import queries as Q

SF = "/root/testdata/sf0.001"

LINE = "THENCE {} {}°0'0\" {} {} FEET"
BOW = "; ".join(LINE.format(*x) for x in (("N", 45, "E", 10), ("N", 90, "W", 12), ("S", 45, "E", 20), ("N", 80, "E", 9), ("N", 10, "W", 30), ("S", 30, "W", 25)))
CURVE = "THENCE ALONG A TANGENT CURVE TO THE RIGHT, RADIUS OF 20.00 FEET, {}"
TEXTS = {
    1: BOW, 2: BOW + "; THIS IS JUNK", 3: "THIS IS JUNK", 4: "", 5: None, 6: LINE.format("N", 5, "E", 1), 7: LINE.format("N", 95, "E", "7.5"),
    8: f"{LINE.format('N', 1, 'E', 5)}; {CURVE.format('A CENTRAL ANGLE OF 0°0')}; {BOW}; {CURVE.format('AN ARC OF 9.00 FEET')}", 9: CURVE.format("AN ARC OF 0.00 FEET"),
    10: "COMMENCING AT A MONUMENT; THENCE N 10°0'0\" E 5.00 FEET TO THE POINT OF BEGINNING; " + BOW, 11: LINE.format("N", 10, "E", 5) + "; " + LINE.format("S", 10, "W", 5), None: BOW, 12: "N 10°75'00\" E 5 FEET",
}


@pytest.mark.parametrize("clear", [None, Q.CLEAR])
def test_line_report_is_its_parts(spark, clear):
    docs = spark.createDataFrame([*TEXTS.items(), (1, BOW), (13, "; ".join([BOW] * 6))], "doc_id int, source_text string")
    classified = K.classify(docs)
    calls = K.boundary_calls(classified)
    verts = G.walk_lines(Q.flat_lines(calls))
    parts = validate.validation_report(verts, calls, clear)
    got = validate.line_report(classified, clear)

    def told(df, names):
        rows = [{n: r[n] for n in names} for r in df.collect()]
        return {r["doc_id"]: {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) and k != "precision" else None if k == "precision" else v for k, v in r.items()} for r in rows}

    names = ["doc_id", "dx", "dy", "misclosure", "perimeter", "n_hits", "hits"]
    want = told(parts, names)
    assert told(got.where("n_points is not null"), names) == want and want[1]["n_hits"] > 0 and want[13]["n_hits"] > 100 and want[None]["n_hits"] == 0
    errors = {r.doc_id: r.curve_errors for r in parts.where("doc_id is not null").collect()}
    assert {r.doc_id: r.curve_errors for r in got.where("n_points is not null and doc_id is not null").collect()} == errors and errors[8]
    order = lambda df: sorted(map(str, df.where("doc_id is not null").withColumn("misclosure", Q.r("misclosure", 6)).collect()))
    assert order(records.summarised(got)) == order(records.summary(K.document_status(classified), parts, verts))


@pytest.mark.parametrize("name", ["report_files", "run_summary", "approved_rows"])
def test_clauses_are_made_once(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Generate posexplode(arrays_zip(pieces") == 1
