"""Files of a run, copies of results, sorted tables and constants of conditions."""

import json

import pytest
from pyspark.sql import functions as F

from geoaccord.fixtures import fixture
from geoaccord.functions import geometry
from geoaccord.functions.scalars import literal
from geoaccord.operators import catalog, matching
from geoaccord.plans import engine
from geoaccord.sources import readers, sinks


def test_geometry_run(spark, sf, tmp_path):
    layers = {k: matching.rectangles(fixture(spark, sf, n)) for k, n in (("a", "poly_a"), ("b", "poly_b"))}
    config = {"category_mappings": [(str(k), f"C{k}", f"class {k}") for k in range(6)], "cell": 32.0, "bandwidth": 30.0}
    result = engine.run("geometry", config, **layers)
    files = sinks.write_geometry_run(result, config, str(tmp_path / "run"), 1.5)
    assert set(files) == {"category_summary", "overall_summary", "matches", "smoothed", "run_metadata", "report"}
    overall = readers.read_csv(spark, files["overall_summary"]).collect()
    want = {r["threshold"]: r["matched"] for r in result.envelope["thresholds"]}
    assert {float(r["threshold"]): int(r["matched"]) for r in overall} == want and len(want) == 9
    assert readers.read_csv(spark, files["matches"]).count() == sum(want.values())
    metadata = json.loads(open(files["run_metadata"]).read())
    assert metadata["elapsed_seconds"] == 1.5 and metadata["metrics"] == result.envelope["metrics"] and metadata["quality"][0]["processed"] == layers["a"].count()
    report = open(files["report"]).read()
    assert "class 5: 5 and C5" in report and f"recommended threshold is {result.envelope['metrics']['recommended_threshold']}" in report and report.count("## ") == 6


def test_copies(spark, tmp_path):
    """A shapefile goes with the files that belong to it; missing ones are left out."""
    shape = geometry.rectangle(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0))
    sinks.write_shapefile(spark.range(2).select("id", shape.alias("rings")), str(tmp_path / "a.shp"), ["id"])
    (tmp_path / "b.txt").write_text("b")
    (tmp_path / "out").mkdir()
    got = sinks.copy_files(spark, [str(tmp_path / "a.shp"), str(tmp_path / "b.txt"), str(tmp_path / "none.csv")], str(tmp_path / "out"))
    assert sorted(p.rsplit("/", 1)[1] for p in got) == ["a.cpg", "a.dbf", "a.shp", "a.shx", "b.txt"]
    assert all((tmp_path / "out" / n).read_bytes() == (tmp_path / n).read_bytes() for n in ("a.shp", "a.dbf", "b.txt"))


def test_sorted_table(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["10", "9", None, "b", " ", "a", "-1.5", "9"])], "k long, v string")
    rising = [(r["v"], r["k"]) for r in catalog.sorted_table(df, "v", ties=["k"]).collect()]
    assert rising[:6] == [("-1.5", 6), ("9", 1), ("9", 7), ("10", 0), ("a", 5), ("b", 3)] and {v for v, _ in rising[6:]} == {None, " "}
    falling = [(r["v"], r["k"]) for r in catalog.sorted_table(df, "v", True, ["k"]).collect()]
    assert falling[:6] == [("b", 3), ("a", 5), ("10", 0), ("9", 1), ("9", 7), ("-1.5", 6)] and {v for v, _ in falling[6:]} == {None, " "}
    with pytest.raises(ValueError, match="no column"):
        catalog.sorted_table(df, "w")


def test_literals(spark):
    values = [3, "3.0", "2.5", "a'b", "", None, "nan", "1e3", 10**30]
    got = spark.range(1).select(*[literal(v).alias(f"c{k}") for k, v in enumerate(values)])
    assert tuple(got.first()) == (3, 3, 2.5, "a'b", "", "None", "nan", 1000, 1e30)
    assert [t for _, t in got.dtypes] == ["int", "int", "double", "string", "string", "string", "string", "int", "double"]
