"""Two layers side by side: each read, brought to one reference system, classified or stretched, with its bounds."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaccord.functions import crs
from geoaccord.operators import classify, layers, raster
from geoaccord.scratch import written
from geoaccord.sources import readers, tiff


@dataclass
class Side:
    """``rows`` to draw (shapes with a class, or grey cells), the ``legend`` of shapes, the ``bounds`` (xmin, ymin, xmax, ymax),
    and the reference system where it is known."""

    kind: str
    rows: DataFrame
    legend: DataFrame | None
    bounds: tuple
    crs: object = None


def sides(spark: SparkSession, one: dict, two: dict) -> tuple[Side, Side]:
    """The sides of a comparison. A spec has a ``path``; for shapes the ``field`` to classify, with ``method`` and
    ``classes``; ``crs`` names the system of the first side where it is not that of its file. Equal specs are refused. The
    second side is brought to the system of the first: shapes by their vertices, a raster by its cells, on the grid of the
    first side where that is a raster."""
    if one == two:
        raise ValueError("the sides are the same")
    first, grid = _side(spark, one, one.get("crs"))
    return first, _side(spark, two, first.crs, grid)[0]


def _raster(path: str) -> bool:
    return path.lower().endswith((".tif", ".tiff"))


def _file_system(spark: SparkSession, path: str) -> str | None:
    """The WKT beside a shapefile, where it describes a system that can be read."""
    beside = re.sub(r"\.shp$", ".prj", path, flags=re.I)
    text = readers.first_bytes(spark, beside, 1 << 16).decode("utf-8", "replace") if readers.present(spark, beside) else ""
    try:
        return text if text.strip() and crs.system(text) else None
    except ValueError:
        return None


def _side(spark: SparkSession, spec: dict, target=None, grid: dict | None = None) -> tuple[Side, dict | None]:
    if _raster(spec["path"]):
        own, cells = tiff.read_info(spark, spec["path"]), tiff.read_tiff(spark, spec["path"])
        if grid is None and target is not None and own["epsg"] is not None and crs.system(target) != crs.system(own["epsg"]):
            grid = raster.grid_in(spark, own, target)
        if grid is not None:
            cells, own = raster.align(cells, own, grid, spec.get("method", "bilinear")), grid
        return Side("raster", raster.stretch(cells, "value"), None, tuple(own["extent"]), own.get("crs") or own["epsg"]), own
    features, named = readers.read_shapefile(spark, spec["path"]), _file_system(spark, spec["path"])
    moved = {"crs": target, "source": named or 4326} if target is not None and (named or spec.get("crs")) else {}
    shapes = written(layers.measured(features, spec["field"], **moved).where(layers.used()), "shapes")  # repaired once
    legend = classify.classify(features, spec["field"], spec.get("method", "natural"), spec.get("classes", 5))
    box = shapes.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    return Side("shapes", shapes, legend, tuple(box), target if moved else named), None
