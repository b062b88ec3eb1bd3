"""From the features of a file to a measured polygon layer: filter, validity, projection, measures and quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoaccord.functions import arrangement, geometry
from geoaccord.functions.crs import transform
from geoaccord.operators.matching import normal_category
from geoaccord.scratch import spread


#: Fixed names: types of features that are polygons, of one part or of several.
POLYGONS = ("polygon", "multipolygon")


def measured(features: DataFrame, category: str, values: list[str] | None = None, crs=None, source=4326, keep: list[str] = ()) -> DataFrame:
    """(feature_id, category, ``keep``, state, rings, minx, miny, maxx, maxy, area, perimeter, cx, cy) of polygon features.

    ``features`` are rows (feature_id, geometry, attributes) of a reader; ``values`` keeps rows of these categories and
    ``crs`` moves shapes from the system ``source`` to another one (:func:`geoaccord.functions.crs.system`). Outer rings are made to turn left and holes right, whatever the file's turns, by how the
    rings lie in one another. ``state`` is ok; repaired where edges crossed, lay along each other or a ring met itself (the
    rings are those of the even-odd region); null, empty (no polygon, or no ring of three vertices) or invalid (nothing
    left after repair), with measures null.
    """
    key = normal_category(F.col(f"`{category}`"))
    rows = features if values is None else features.where(key.isin([str(v) for v in values]))
    rows = rows.select("feature_id", key.alias("category"), *keep, "geometry.type", F.when(F.col("geometry.type").isin(*POLYGONS), geometry.polygon(F.col("geometry.parts"))).alias("rings"))
    rows = spread(rows, "feature_id").withColumn("made", arrangement.cleaned(F.when(F.size("rings") > 0, F.col("rings"))))
    state = F.when(F.col("type").isNull() | (F.col("type") == "null"), "null").when(F.coalesce(F.size("rings"), F.lit(0)) <= 0, "empty").otherwise(F.col("made.state"))
    rows = rows.select("feature_id", "category", *keep, state.alias("state"), F.when(F.col("made.state").isin(*USED), F.coalesce("made.rings", "rings")).alias("rings"))
    if crs is not None:
        moved = lambda v: (lambda x, y: F.struct(x.alias("x"), y.alias("y")))(*transform(source, crs, v["x"], v["y"]))
        rows = rows.withColumn("rings", F.transform("rings", lambda r: F.transform(r, moved)))
    rings = F.col("rings")
    box = dict(zip(("minx", "miny", "maxx", "maxy"), geometry.bounds(rings)))
    centre = dict(zip(("cx", "cy"), geometry.centroid(rings)))
    return rows.withColumns(box | {"area": geometry.area(rings), "perimeter": geometry.perimeter(rings)} | centre)


#: States of shapes that take part in an analysis.
USED = ("ok", "repaired")


def used() -> Column:
    return F.col("state").isin(*USED)


def quality(layer: DataFrame, min_area: float = 0.0) -> DataFrame:
    """One row of counts: input, null, empty and invalid shapes, those of the invalid ones that were repaired, those too
    small, and those processed, repaired ones among them."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).alias
    small = used() & (F.col("area") < min_area)
    states = [count(F.col("state").isin(*of))(f"{s}_shapes") for s, of in (("null", ["null"]), ("empty", ["empty"]), ("invalid", ["repaired", "invalid"]))]
    return layer.agg(F.count("*").alias("input"), *states, count(F.col("state") == "repaired")("repaired"), count(small)("too_small"), count(used() & ~small)("processed"))
