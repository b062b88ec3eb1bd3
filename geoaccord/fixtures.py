"""Deterministic paired sources over the test tables, as the same select lists for Spark and for other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, {column: expression in Spark SQL}, filter)
FIXTURES: dict[str, tuple[str, dict[str, str], str | None]] = {
    "sites": (
        "customer",
        {
            "feature_id": "c_custkey",
            "px": "cast(c_custkey % 40 as double) * 100",
            "py": "cast(c_custkey div 40 as double) * 100",
            "v_a": "case when c_custkey % 101 = 7 then null else cast(c_acctbal as double) end",
            "v_b": "case when c_custkey % 97 = 0 then cast(0.0 as double) else cast(c_acctbal as double) * cast(0.9 as double) + cast(c_custkey % 11 as double) * 25 end",
            "v_c": "cast(c_acctbal as double) * cast(1.1 as double) + cast(c_custkey % 40 as double) * 10 - cast(c_custkey % 7 as double) * 30",
        },
        None,
    ),
    "grid": (
        "events",
        {
            "r": "cast(event_id div 100 as int)",
            "c": "cast(event_id % 100 as int)",
            "left_v": "case when event_id % 13 = 5 then null else cast(value as double) end",
            "right_v": "case when event_id % 17 = 3 then null else cast(value as double) * cast(0.95 as double) + cast(event_id % 5 as double) end",
        },
        None,
    ),
    "poly_a": (
        "part",
        {
            "feature_id": "p_partkey",
            "category": "cast(p_size % 6 as string)",
            "minx": "cast(p_partkey % 50 as double) * 10",
            "miny": "cast(p_partkey div 50 as double) * 10",
            "w": "cast(14 as double) + cast(p_size as double) / 5",
            "h": "cast(12 as double) + cast(p_partkey % 7 as double) * cast(1.5 as double)",
        },
        None,
    ),
    "poly_b": (
        "part",
        {
            "feature_id": "p_partkey",
            "category": "concat('C', cast(p_size % 6 as string))",
            "minx": "cast(p_partkey % 50 as double) * 10 + cast(p_partkey % 9 as double) * cast(1.1 as double)",
            "miny": "cast(p_partkey div 50 as double) * 10 + cast(p_partkey % 5 as double) * cast(0.9 as double)",
            "w": "cast(14.5 as double) + cast(p_size as double) / 6",
            "h": "cast(12 as double) + cast(p_partkey % 6 as double) * cast(1.8 as double)",
        },
        "p_partkey % 19 <> 4",
    ),
    "catalog": (
        "nation",
        {
            "name": "n_name",
            "data_type": "case n_nationkey % 3 when 0 then 'attribute' when 1 then 'geometry' else 'raster' end",
            "crs": "case when n_nationkey % 4 = 1 then 'EPSG:4326' else 'EPSG:32650' end",
            "resolution": "case when n_nationkey % 3 = 2 then cast(10 + 20 * (n_nationkey % 2) as double) end",
            "format": "case n_nationkey % 5 when 0 then 'CSV' when 1 then 'GeoTIFF' when 2 then 'SHP' when 3 then 'Excel' else 'GeoJSON' end",
            "xmin": "cast(n_nationkey * 2 as double)",
            "ymin": "cast(n_nationkey * 3 as double)",
            "xmax": "cast(100 + n_nationkey as double)",
            "ymax": "cast(120 + n_nationkey * 2 as double)",
        },
        None,
    ),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, where = FIXTURES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = rows.where(where) if where else rows
    return rows.selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def fixture_sql(name: str) -> str:
    """The fixture as a parenthesised query in the oracle's dialect."""
    table, columns, where = FIXTURES[name]
    body = ", ".join(f"{e} as {c}" for c, e in columns.items()).replace(" div ", " // ").replace("as string)", "as varchar)")
    return f"(select {body} from {table}{' where ' + where if where else ''})"
