"""Exact nearest-site search on a pyramid of grid cells.

Sites are first reduced to distinct coordinates and then rolled up into cells of three to six sizes, each with its
bounding box.  A point starts with the (few) top cells and descends: per level it keeps only the cells whose box can still hold
something nearer than the best site already guaranteed.  Every further step is an equi-join on a cell key, so neither
side is compared with everything on the other side, and dense cells are split by the next level.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackplume.functions.geo import bounding_box, box_gap_km, haversine_km
from stackplume.session import ensure_checkpoint_dir

# Powers of two, so that the cells nest exactly.  16 degrees gives at most 23 * 12 top cells on the whole globe.
CELL_DEGREES = (16.0, 2.0, 1 / 4, 1 / 32, 1 / 256, 1 / 2048)
FEWEST_LEVELS = 3
CROWDED_CELL = 256
SLACK_KM = 1e-6
EVERYWHERE = "*"


def _cell(lat: str, lon: str, size: float):
    row = F.floor((F.col(lat) + 90.0) / size).cast("bigint")
    col = F.floor((F.col(lon) + 180.0) / size).cast("bigint")
    return row * F.lit(1 << 20).cast("bigint") + col


def _rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box per cell, and the coordinates of one real site in it (the southernmost)."""
    return df.groupBy(*keys).agg(
        F.min("min_lat").alias("min_lat"),
        F.max("max_lat").alias("max_lat"),
        F.min("min_lon").alias("min_lon"),
        F.max("max_lon").alias("max_lon"),
        F.min_by("any_lon", "min_lat").alias("any_lon"),
    )


def _levels(spots: DataFrame) -> int:
    """Grid sizes to use: finer ones only while some cell of the last one is crowded with distinct coordinates."""
    for depth in range(FEWEST_LEVELS, len(CELL_DEGREES)):
        cell = _cell("site_lat", "site_lon", CELL_DEGREES[depth - 1])
        fullest = spots.groupBy("scope", cell).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if fullest is None or fullest <= CROWDED_CELL:
            return depth
    return len(CELL_DEGREES)


def nearest_spots(points: DataFrame, sites: DataFrame, scoped: bool) -> DataFrame:
    """Nearest site for every distinct point.

    ``points`` has scope, lat, lon; ``sites`` has scope, site_lat, site_lon, site_key.  Only sites of the point's scope
    count.  Returns scope, lat, lon, distance_km, site_key; equal distances go to the smallest site_key.
    """
    wanted = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("scope", "lat", "lon").distinct()
    spots = (
        sites.where(F.col("site_lat").isNotNull() & F.col("site_lon").isNotNull())
        .groupBy("scope", "site_lat", "site_lon")
        .agg(F.min("site_key").alias("site_key"))
    )
    depth = _levels(spots)
    cell_columns = [f"c{i}" for i in range(depth)]
    spots = spots.select(
        "*", *[_cell("site_lat", "site_lon", size).alias(c) for c, size in zip(cell_columns, CELL_DEGREES)]
    )
    table = spots.select(
        "scope", *cell_columns,
        F.col("site_lat").alias("min_lat"), F.col("site_lat").alias("max_lat"),
        F.col("site_lon").alias("min_lon"), F.col("site_lon").alias("max_lon"), F.col("site_lon").alias("any_lon"),
    )
    pyramid = []
    for level in range(depth, 0, -1):
        table = _rollup(table, ["scope", *cell_columns[:level]])
        pyramid.insert(0, table)
    top = pyramid[0]

    # First level: at most 276 cells per scope, so they travel as one array and are judged inside the row.
    listed = F.collect_list(F.struct("c0", "min_lat", "max_lat", "min_lon", "max_lon", "any_lon")).alias("cells")
    if scoped:
        start = wanted.join(top.groupBy("scope").agg(listed), "scope")
    else:
        start = wanted.withColumn("cells", top.agg(listed).scalar())
    judged = start.withColumn(
        "cells",
        F.transform(
            "cells",
            lambda c: F.struct(
                c["c0"].alias("c0"),
                box_gap_km("lat", "lon", c["min_lat"], c["max_lat"], c["min_lon"], c["max_lon"]).alias("gap"),
                haversine_km("lat", "lon", c["min_lat"], c["any_lon"]).alias("reach"),
            ),
        ),
    ).withColumn("best", F.array_min(F.transform("cells", lambda c: c["reach"])))
    candidates = judged.select(
        "scope", "lat", "lon",
        F.explode(F.transform(F.filter("cells", lambda c: c["gap"] <= F.col("best") + SLACK_KM), lambda c: c["c0"])).alias("c0"),
    )

    point = Window.partitionBy("scope", "lat", "lon")
    for level in range(1, depth):
        measured = candidates.join(pyramid[level], ["scope", *cell_columns[:level]]).withColumns(
            {
                "gap": box_gap_km("lat", "lon", "min_lat", "max_lat", "min_lon", "max_lon"),
                "reach": haversine_km("lat", "lon", "min_lat", "any_lon"),
            }
        )
        candidates = (
            measured.withColumn("best", F.min("reach").over(point))
            .where(F.col("gap") <= F.col("best") + SLACK_KM)
            .select("scope", "lat", "lon", *cell_columns[: level + 1])
        )
    return (
        candidates.join(spots, ["scope", *cell_columns])
        .withColumn("distance_km", haversine_km("lat", "lon", "site_lat", "site_lon"))
        .groupBy("scope", "lat", "lon")
        .agg(F.min(F.struct("distance_km", "site_key")).alias("hit"))
        .select("scope", "lat", "lon", "hit.distance_km", "hit.site_key")
    )


def nearest_site_join(
    readings: DataFrame, sites: DataFrame, site_key: str = "factory_id", keep_stations: bool = False
) -> DataFrame:
    """Every reading with all columns of its nearest site and ``distance_to_nearest_station``.

    Readings without coordinates drop out.  Where both sides have a column, the site's value wins.  With
    ``keep_stations`` the small station-to-site table is checkpointed, for jobs that read the result several times.
    """
    stations = readings.select(
        F.lit(EVERYWHERE).alias("scope"), F.col("station_lat").alias("lat"), F.col("station_lon").alias("lon")
    )
    spots = sites.select(
        F.lit(EVERYWHERE).alias("scope"), F.col("latitude").alias("site_lat"), F.col("longitude").alias("site_lon"),
        F.col(site_key).alias("site_key"),
    )
    nearest = nearest_spots(stations, spots, scoped=False)
    # One row per distinct station, so the site columns are attached before the wide readings are touched.
    attached = (
        nearest.withColumnRenamed("site_key", site_key)
        .join(sites, site_key)
        .select(
            F.col("lat").alias("station_lat"), F.col("lon").alias("station_lon"), *sites.columns,
            F.col("distance_km").alias("distance_to_nearest_station"),
        )
    )
    if keep_stations:
        ensure_checkpoint_dir(readings.sparkSession)
        attached = attached.checkpoint()
    own = [c for c in readings.columns if c not in sites.columns]
    return readings.select(*own).join(attached, ["station_lat", "station_lon"])


def nearest_distance_in_city(
    readings: DataFrame, sites: DataFrame, threshold_km: float | None = 50.0, site_key: str = "factory_id"
) -> DataFrame:
    """Distance to the nearest site of the reading's own city; cities without sites look at all sites.

    Adds ``nearest_factory_distance_km`` and keeps readings within the threshold (all of them if it is None).
    """
    located = sites.select(
        F.col("latitude").alias("site_lat"), F.col("longitude").alias("site_lon"), F.col(site_key).alias("site_key"), "city"
    )
    # Each site counts for its city and for the cities that have none of their own.
    spots = located.select(
        F.explode(F.array(F.col("city"), F.lit(EVERYWHERE))).alias("scope"), "site_lat", "site_lon", "site_key"
    ).where(F.col("scope").isNotNull())
    served = sites.select("city").where(F.col("city").isNotNull()).distinct().withColumn("served", F.lit(True))
    stations = (
        readings.where(F.col("station_lat").isNotNull() & F.col("station_lon").isNotNull())
        .select("city", "station_lat", "station_lon")
        .distinct()
        .join(served, "city", "left")
        .select(
            "city", F.col("station_lat").alias("lat"), F.col("station_lon").alias("lon"),
            F.when(F.col("served"), F.col("city")).otherwise(F.lit(EVERYWHERE)).alias("scope"),
        )
    )
    nearest = nearest_spots(stations, spots, scoped=True)
    distances = stations.join(nearest, ["scope", "lat", "lon"]).select(
        F.col("city").alias("_city"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"),
        F.col("distance_km").alias("nearest_factory_distance_km"),
    )
    if threshold_km is not None:
        distances = distances.where(F.col("nearest_factory_distance_km") <= threshold_km)
    same = (
        F.col("city").eqNullSafe(F.col("_city"))
        & (F.col("station_lat") == F.col("_lat"))
        & (F.col("station_lon") == F.col("_lon"))
    )
    return readings.join(distances, same).drop("_city", "_lat", "_lon")


def radius_search(points: DataFrame, lat, lon, radius_km, lat_column: str, lon_column: str) -> DataFrame:
    """Rows within a radius of one centre: a box that reaches the file statistics, then the exact distance."""
    cosine = math.cos(math.radians(lat))
    if abs(cosine) < 1e-6:
        cosine = math.copysign(1e-6, cosine)
    d_lat, d_lon = radius_km / 111.0, radius_km / (111.0 * cosine)
    inside = (
        F.col(lat_column).between(lat - d_lat, lat + d_lat) & F.col(lon_column).between(lon - d_lon, lon + d_lon)
    )
    return points.where(inside).where(haversine_km(float(lat), float(lon), lat_column, lon_column) <= radius_km)


def box_columns(points: DataFrame, lat_column: str, lon_column: str, radius_km: float) -> DataFrame:
    """Adds the search box of every row."""
    box = bounding_box(lat_column, lon_column, radius_km)
    return points.withColumns(box)


def city_centres(sites: DataFrame, static_centres: DataFrame) -> DataFrame:
    """Mean coordinates per city of the sites, plus the static centres of cities that have none."""
    known = (
        sites.where(F.col("city").isNotNull())
        .groupBy("city")
        .agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    )
    return known.unionByName(static_centres.select("city", "lat", "lon").join(known, "city", "left_anti"))


def urban_rural(sites: DataFrame, centres: DataFrame) -> DataFrame:
    """Distance class of a site from its city centre (centres: city, centre_lat, centre_lon; a fixed short list)."""
    distance = haversine_km("latitude", "longitude", "centre_lat", "centre_lon")
    flag = (
        F.when(F.col("centre_lat").isNull(), F.lit("unknown"))
        .when(distance < 15, F.lit("urban"))
        .when(distance <= 40, F.lit("peri-urban"))
        .otherwise(F.lit("rural"))
    )
    return (
        sites.join(centres.select("city", "centre_lat", "centre_lon"), "city", "left")
        .withColumn("urban_rural", flag)
        .select(*sites.columns, "urban_rural")
    )
