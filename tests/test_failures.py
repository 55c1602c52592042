"""The whole analysis of failures: all its parts, for models with and without failing samples."""

from __future__ import annotations

import duckdb

from evalframe.functions.vocab import TAXONOMY
from evalframe.queries import failures as Q
from evalframe.queries.fixtures import Views

PREDS = "model_id string, sample_id long, group_id string, true_class int, pred_class int"


def test_an_analysis_has_all_its_parts(spark, tmp_path):
    cells = {("a", 1, "x"): [(0, 0)] * 3 + [(2, 1)], ("a", 2, None): [(2, 1), (2, 3), (1, 1)], ("a", 3, ""): [(3, 0)], ("a", 10, "x"): [(0, 0)] * 3 + [(0, 1)], ("a", 4, "x"): [(1, 1)], ("b", 1, "x"): [(0, 0), (1, 1)]}
    rows = [(*k, t, p) for k, cell in cells.items() for t, p in cell]
    views = Views(spark, str(tmp_path))
    views._made["preds"] = spark.createDataFrame(rows, PREDS)
    out = Q.analysis(views)
    got = [tuple(r) for r in out.collect()]

    con = duckdb.connect()
    con.sql("CREATE TABLE preds (model_id VARCHAR, sample_id BIGINT, group_id VARCHAR, true_class INT, pred_class INT)")
    con.executemany("INSERT INTO preds VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(map(repr, got)) == sorted(map(repr, con.sql(Q.WHOLE_ANALYSIS).fetchall()))

    of = lambda model, section: [dict(zip(out.columns, r)) for r in got if r[:2] == (model, section)]
    assert {r["item"]: r["rank"] for r in of("a", "sample")} == {"3": 1, "2": 2, "1": 3, "10": 4} and not of("b", "sample")
    assert {r["item"]: (r["errors"], r["sample_count"], r["severities"]) for r in of("a", "class_summary")} == {
        "clear": (1, 1, "MEDIUM:1"), "thick_cloud": (0, 0, ""), "thin_cloud": (3, 2, "MEDIUM:1,HIGH:1"), "cloud_shadow": (1, 1, "CRITICAL:1")}
    # as the matrix of a has them: cells of 2 to 1 (twice), 2 to 3, 3 to 0 and 0 to 1; of each row the largest is its dominant confusion
    assert {r["item"]: (r["errors"], r["sample_count"]) for r in of("a", "error_type_summary")} == {"false_positive": (5, 4), "false_negative": (5, 4), "class_confusion": (4, 4)}
    assert {r["item"]: (r["errors"], r["sample_count"]) for r in of("b", "error_type_summary")} == {"false_positive": (0, 0), "false_negative": (0, 0), "class_confusion": (0, 0)}
    assert {r["item"]: (r["errors"], r["value"], r["sample_count"], r["severities"]) for r in of("a", "group_summary")} == {"x": (2, 0.25, 2, "MEDIUM:2"), "_ungrouped": (3, 0.75, 2, "HIGH:1,CRITICAL:1")}
    for model in "ab":
        assert {(r["item"], r["detail"]) for r in of(model, "taxonomy")} == set(TAXONOMY)
        topics = {"real_data", "edge_error", "small_object_failure", "high_confidence_error", "low_confidence_error"}
        assert {r["item"] for r in of(model, "limitation")} == topics | ({"samples"} if model == "b" else set())
