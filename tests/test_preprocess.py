"""The alignment of rasters to files, its manifest and what it refuses."""

import json

import numpy as np

from geoaccord.plans import preprocess
from geoaccord.sources import sinks, tiff


def test_alignment(spark, tmp_path):
    cells = np.arange(60.0).reshape(6, 10)
    own = {"a.tif": (cells, (0.0, 60.0), 10.0), "b.tif": (np.repeat(np.repeat(cells, 2, 0), 2, 1), (0.0, 60.0), 5.0), "c.tif": (cells, (20.0, 60.0), 10.0)}
    for name, (values, origin, cell) in own.items():
        (tmp_path / name).write_bytes(tiff.encode(values, origin, cell, 32650))
    sources = [{"name": n, "path": str(tmp_path / p)} for n, p in (("one", "a.tif"), ("one", "b.tif"), ("far", "c.tif"), ("text", "d.csv"))]
    registry = sinks.Registry(spark, str(tmp_path / "project"))
    result = preprocess.run("raster_align", spark, sources, str(tmp_path / "out"), factors=(2,), tile=16, registry=registry)
    assert result["status"] == "success", result
    assert json.loads((tmp_path / "out" / "manifest.json").read_text()) == result and len(result["processed"]) == 3
    assert result["checks"] == ["one: on the grid of the reference already", "one: cells of the reference", "far: extent of the reference"]
    assert {r["name"] for r in registry.sources().collect()} == {"aligned_one", "aligned_far"} and registry.sources().count() == 3
    for made, (first, shift) in zip(result["processed"], ((0, 0), (0, 0), (2, 2))):
        assert tiff.read_info(spark, made["aligned_path"])["extent"] == [0.0, 0.0, 100.0, 60.0]
        got = {(r["r"], r["c"]): r["value"] for r in tiff.read_tiff(spark, made["aligned_path"]).collect()}
        assert all(got[r, c] == (cells[r, c - shift] if c >= first else None) for r in range(6) for c in range(10)), made
        assert tiff.read_tiff(spark, made["aligned_path"], level=1).count() == 15
    assert [p.rsplit("/", 1)[1] for p in (m["aligned_path"] for m in result["processed"])] == ["aligned_one.tif", "aligned_one_1.tif", "aligned_far.tif"]


def test_refusals(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff.encode(np.ones((2, 2)), (0.0, 2.0), 1.0, 32650))
    (tmp_path / "aligned_a.tif").write_bytes((tmp_path / "a.tif").read_bytes())
    one, two = ({"name": n, "path": str(tmp_path / f"{n}.tif")} for n in ("a", "aligned_a"))
    message = lambda *args, **kw: preprocess.run(*args, **kw)["message"]
    assert "unknown tool" in message("clip", spark, [one], str(tmp_path))
    assert "two rasters" in message("raster_align", spark, [one, two], str(tmp_path), selected=[one["path"]])
    assert "source itself" in message("raster_align", spark, [one, two], str(tmp_path), tile=16, factors=(2,))
    assert "none of the rasters" in message("raster_align", spark, [one, two], str(tmp_path), reference="x")


def test_unique_names():
    assert preprocess.unique_names(["a b", "a_b", "a_b_1", "", "//", "a.b"]) == ["a_b", "a_b_2", "a_b_1", "raster", "raster_1", "a_b_3"]
