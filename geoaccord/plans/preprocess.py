"""Tools that prepare sources for an analysis, by name: each takes sources and a folder, and gives a result envelope."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from geoaccord.operators import raster
from geoaccord.sources import pyramid, ranges, sinks, tiff

TOOLS: dict = {}
SUFFIXES = (".tif", ".tiff")


def tool(name: str):
    def register(f):
        TOOLS[name] = f
        return f

    return register


def run(name: str, spark: SparkSession, sources: list[dict], folder: str, **options) -> dict:
    """The envelope of a tool; any error, an unknown tool too, becomes an error envelope."""
    try:
        if name not in TOOLS:
            raise ValueError(f"unknown tool {name}; there are {sorted(TOOLS)}")
        return TOOLS[name](spark, sources, folder, **options)
    except Exception as e:
        return sinks.failure(name, e)


def unique_names(names: list[str], default: str = "raster") -> list[str]:
    """Names for files: other characters than letters, digits, ``_`` and ``-`` become ``_``, and a repeated name gets the
    first number that makes it new, so that no name is taken twice whatever the names are."""
    plain, taken, out = [re.sub(r"[^A-Za-z0-9_-]+", "_", n).strip("_") or default for n in names], set(), []
    for name in plain:
        free, k = name, 0
        while free in taken or k and free in plain:
            k += 1
            free = f"{name}_{k}"
        taken.add(free)
        out.append(free)
    return out


@tool("raster_align")
def raster_align(spark: SparkSession, sources: list[dict], folder: str, reference: str | None = None, selected: list[str] | None = None, method: str = "bilinear", factors=pyramid.FACTORS, tile: int = pyramid.TILE, registry: sinks.Registry | None = None) -> dict:
    """Every raster of ``sources`` (name, path), or of those with a ``selected`` path, on the grid of the ``reference`` (its
    path; else the first): reference system, cells and extent. Each becomes a tiled GeoTIFF with overviews below ``folder``,
    named ``aligned_`` and its name; ``manifest.json`` says what was made. Sources are never written, and other files than
    rasters are left out; fewer than two rasters, several bands and a missing reference system are errors. Results go to
    the catalog of ``registry``."""
    chosen = [s for s in sources if s["path"].lower().endswith(SUFFIXES) and (selected is None or s["path"] in selected)]
    infos = [tiff.read_info(spark, s["path"]) for s in chosen]
    raster.preflight(infos)
    own = {s["path"]: info for s, info in zip(chosen, infos)}
    if reference is not None and reference not in own:
        raise ValueError(f"the reference {reference} is none of the rasters")
    target = own[reference or chosen[0]["path"]]
    base, made, checks = folder.rstrip("/"), [], []
    for source, name in zip(chosen, unique_names([s["name"] for s in chosen])):
        path, info = f"{base}/aligned_{name}.tif", own[source["path"]]
        if path in own:
            raise ValueError(f"{path} is a source itself")
        cells = raster.align(ranges.read_tiff(spark, source["path"]), info, target, method)
        pyramid.write_pyramid(cells, path, target, factors=factors, tile=tile, packing="lzw")
        changed = [word for word, differs in (("reference system", info["epsg"] != target["epsg"]), ("cells", any(abs(a - b) > 1e-12 for a, b in zip(info["cell"], target["cell"]))), ("extent", info["extent"] != target["extent"])) if differs]
        checks.append(f"{source['name']}: " + (", ".join(changed) + " of the reference" if changed else "on the grid of the reference already"))
        made.append({"name": source["name"], "source_path": source["path"], "aligned_path": path, "epsg": target["epsg"], "width": target["width"], "height": target["height"], "resolution": list(target["cell"]), "bounds": target["extent"], "dtype": "float32", "nodata": -9999.0})
    result = sinks.success("raster_align", {"aligned": len(made)}, reference=reference or chosen[0]["path"], selected_sources=[s["path"] for s in chosen], processed=made, checks=checks, output_dir=base)
    sinks.write_bytes(spark, f"{base}/manifest.json", json.dumps(result, ensure_ascii=False, indent=2).encode())
    for one in made if registry else ():
        registry.add_source({"name": f"aligned_{one['name']}", "data_type": "raster", "path": one["aligned_path"], "extent": ",".join(map(str, one["bounds"])), "crs": f"EPSG:{one['epsg']}", "status": "ready", "records": str(one["width"] * one["height"]), "reader": "tiff"})
    return result
