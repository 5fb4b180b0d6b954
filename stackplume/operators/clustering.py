"""Density clustering of sites by great-circle distance, without comparing all pairs.

The plane is cut into cells whose diagonal is at most the search radius, so all sites of a cell are neighbours of each
other.  A cell with at least ``min_samples`` sites is therefore one connected block of core sites and needs no pair at
all.  Distances are only computed for sites of thin cells, and between blocks that are close to each other.  Clusters
are the connected components of the core cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackplume.functions.geo import EARTH_RADIUS_KM, box_gap_km, boxes_gap_km, boxes_span_km, haversine_km
from stackplume.operators.nearest import nearest_spots
from stackplume.session import ensure_checkpoint_dir

SLACK_KM = 1e-9
_EXTREMES = ("north", "south", "east", "west")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest vertex of the component for every vertex of ``edges`` (a, b): columns vertex, component.

    Alternates the large-star and small-star steps until every vertex has one parent and no parent has a parent; the
    number of rounds grows with the logarithm of the graph, and the edge list is checkpointed every round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    oriented = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    for _ in range(max_rounds):
        if _all_stars(oriented):
            break
        both = oriented.unionByName(oriented.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = (
            both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        )
        parent = large.groupBy("a").agg(F.min("b").alias("root"))
        oriented = (
            large.join(parent, "a")
            .where("b <> root")
            .select(F.col("b").alias("a"), F.col("root").alias("b"))
            .unionByName(parent.select("a", F.col("root").alias("b")))
            .where("a <> b")
            .distinct()
            .checkpoint()
        )
    else:
        if not _all_stars(oriented):
            raise RuntimeError("connected components did not settle")
    return oriented.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
        oriented.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    )


def _all_stars(oriented: DataFrame) -> bool:
    """Whether every vertex of the distinct edges (a, b) has one parent b and no parent has a parent."""
    ends = oriented.select(F.col("a").alias("vertex"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        oriented.select(F.col("b").alias("vertex"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("vertex").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()


def dense_numbers(keys: DataFrame, key: str, number: str) -> DataFrame:
    """0, 1, 2, ... for distinct keys in key order, without sorting them in one task."""
    ensure_checkpoint_dir(keys.sparkSession)
    placed = (
        keys.select(key)
        .distinct()
        .repartitionByRange(key)
        .sortWithinPartitions(key)
        .select(
            key,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        )
        .checkpoint()
    )
    # One row per partition.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").select(key, (F.col("_offset") + F.col("_place")).cast("bigint").alias(number))


def density_clusters(
    sites: DataFrame,
    key: str = "factory_id",
    lat: str = "latitude",
    lon: str = "longitude",
    eps_degrees: float = 0.05,
    min_samples: int = 2,
) -> DataFrame:
    """``key``, ``cluster_id`` for every site: 0, 1, ... in the order of each cluster's smallest core key, -1 for noise.

    A border site joins the lowest-numbered cluster in reach.  Sites without coordinates are noise.
    """
    ensure_checkpoint_dir(sites.sparkSession)
    eps_km = math.radians(eps_degrees) * EARTH_RADIUS_KM
    side = eps_degrees / math.sqrt(2.0) * (1 - 1e-9)
    columns = math.ceil(360.0 / side)
    width = 360.0 / columns

    located = sites.select(
        F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    row = F.floor((F.col("lat") + 90.0) / side).cast("bigint")
    col = F.pmod(F.floor((F.col("lon") + 180.0) / width).cast("bigint"), F.lit(columns).cast("bigint"))
    spots = (
        located.groupBy("lat", "lon")
        .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))
        .select("*", row.alias("row"), col.alias("col"), (row * (1 << 31) + col).alias("cell"))
        .checkpoint()
    )
    cells = spots.groupBy("cell", "row", "col").agg(
        F.sum("n").alias("sites"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.max_by(F.struct("lat", "lon"), "lat").alias("north"),
        F.min_by(F.struct("lat", "lon"), "lat").alias("south"),
        F.max_by(F.struct("lat", "lon"), "lon").alias("east"),
        F.min_by(F.struct("lat", "lon"), "lon").alias("west"),
    ).withColumn("crowded", F.col("sites") >= min_samples)

    # Cells that can hold a neighbour: two rows up and down, and as many columns as the radius spans at that latitude.
    cosine = F.least(F.cos(F.radians("min_lat")), F.cos(F.radians("max_lat")))
    sine = math.sin(math.radians(eps_degrees))
    reach = F.when(
        cosine > sine, F.ceil(F.degrees(F.asin(F.least(F.lit(sine) / cosine, F.lit(1.0)))) / width)
    ).otherwise(F.lit(columns // 2 + 1)).cast("bigint")
    reach = F.least(reach, F.lit(columns // 2 + 1).cast("bigint"))
    around = (
        cells.select(F.struct(*cells.columns).alias("a"), "row", "col", reach.alias("reach"))
        .withColumn("row", F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)))
        .withColumn(
            "col",
            F.explode(
                F.array_distinct(
                    F.transform(
                        F.sequence(F.col("col") - F.col("reach"), F.col("col") + F.col("reach")),
                        lambda c: F.pmod(c, F.lit(columns).cast("bigint")),
                    )
                )
            ),
        )
        .select("a", (F.col("row") * (1 << 31) + F.col("col")).alias("b_cell"))
    )
    others = cells.select(F.col("cell").alias("b_cell"), F.struct(*cells.columns).alias("b"))
    edge = ("min_lat", "max_lat", "min_lon", "max_lon")
    box_a = {e: F.col(f"a.{e}") for e in edge}
    box_b = {e: F.col(f"b.{e}") for e in edge}
    near = (
        around.join(others, "b_cell")
        .where((F.col("a.cell") == F.col("b.cell")) | (boxes_gap_km(box_a, box_b) <= eps_km + SLACK_KM))
        .select("a", "b")
        .checkpoint()
    )

    # Neighbours of the sites in thin cells: at most min_samples - 1 sites per cell.
    thin = near.where(~F.col("a.crowded")).select(
        F.col("a.cell").alias("cell"), F.col("b.cell").alias("b_cell"), F.col("b.crowded").alias("b_crowded"),
        *[F.col(f"b.{e}").alias(e) for e in edge],
    )
    reachable = (
        spots.select("cell", "lat", "lon", "first_key")
        .join(thin, "cell")
        .where(box_gap_km("lat", "lon", *edge) <= eps_km + SLACK_KM)
        .select("cell", "lat", "lon", "first_key", "b_cell", "b_crowded")
    )
    targets = spots.select(
        F.col("cell").alias("b_cell"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"),
        F.col("n").alias("b_n"),
    )
    pairs = (
        reachable.join(targets, "b_cell")
        .where(haversine_km("lat", "lon", "b_lat", "b_lon") <= eps_km)
        .checkpoint()
    )
    thin_core = (
        pairs.groupBy("lat", "lon", "cell", "first_key")
        .agg(F.sum("b_n").alias("neighbours"))
        .where(F.col("neighbours") >= min_samples)
        .select("lat", "lon", "cell", "first_key")
    )
    core_spots = (
        spots.join(cells.where("crowded").select("cell"), "cell", "left_semi")
        .select("lat", "lon", "cell", "first_key")
        .unionByName(thin_core)
    )
    core_cells = core_spots.groupBy("cell").agg(F.min("first_key").alias("first_key")).checkpoint()

    # Links from thin core sites, and between two crowded cells.
    core_marks = thin_core.select("lat", "lon", F.lit(True).alias("core"))
    b_marks = thin_core.select(F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.lit(True).alias("b_thin_core"))
    marked = (
        pairs.join(core_marks, ["lat", "lon"], "left")
        .join(b_marks, ["b_lat", "b_lon"], "left")
        .withColumn("core", F.coalesce("core", F.lit(False)))
        .withColumn("b_core", F.col("b_crowded") | F.coalesce("b_thin_core", F.lit(False)))
    )
    thin_links = marked.where("core AND b_core").select(F.col("cell").alias("a"), F.col("b_cell").alias("b"))
    blocks = near.where(F.col("a.crowded") & F.col("b.crowded") & (F.col("a.cell") < F.col("b.cell")))
    touching = boxes_span_km(box_a, box_b) <= eps_km
    for one in _EXTREMES:
        for two in _EXTREMES:
            touching = touching | (
                haversine_km(F.col(f"a.{one}.lat"), F.col(f"a.{one}.lon"), F.col(f"b.{two}.lat"), F.col(f"b.{two}.lon"))
                <= eps_km
            )
    judged = blocks.withColumn("touching", touching).checkpoint()
    block_links = judged.where("touching").select(F.col("a.cell").alias("a"), F.col("b.cell").alias("b"))
    links = thin_links.unionByName(block_links)
    unclear = judged.where("NOT touching")
    if not unclear.isEmpty():
        links = links.unionByName(_closest_links(spots, unclear, eps_km))

    components = connected_components(links)
    labelled = (
        core_cells.join(components, core_cells["cell"] == components["vertex"], "left")
        .select("cell", "first_key", F.coalesce("component", "cell").alias("component"))
    )
    roots = labelled.groupBy("component").agg(F.min("first_key").alias("root"))
    numbers = dense_numbers(roots, "root", "cluster_id")
    cell_cluster = (
        labelled.join(roots, "component").join(numbers, "root").select("cell", "cluster_id").checkpoint()
    )

    core_clusters = core_spots.join(cell_cluster, "cell").select("lat", "lon", "cluster_id")
    border_clusters = (
        marked.where("NOT core AND b_core")
        .join(cell_cluster.withColumnRenamed("cell", "b_cell"), "b_cell")
        .groupBy("lat", "lon")
        .agg(F.min("cluster_id").alias("cluster_id"))
    )
    spot_clusters = core_clusters.unionByName(border_clusters)
    return (
        sites.select(F.col(key), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
        .join(spot_clusters, ["lat", "lon"], "left")
        .select(key, F.coalesce("cluster_id", F.lit(-1)).cast("bigint").alias("cluster_id"))
    )


def _closest_links(spots: DataFrame, unclear: DataFrame, eps_km: float) -> DataFrame:
    """Links between crowded cells whose nearest two sites are within the radius.

    Only the strips facing the other cell take part, and the nearest pair is found by descent, not by comparing all.
    """
    edge = ("min_lat", "max_lat", "min_lon", "max_lon")
    scope = F.concat_ws("|", F.col("a.cell").cast("string"), F.col("b.cell").cast("string"))

    def strip(mine: str, other: str) -> DataFrame:
        sides = unclear.select(
            F.col(f"{mine}.cell").alias("cell"), scope.alias("scope"), *[F.col(f"{other}.{e}").alias(e) for e in edge]
        )
        return (
            spots.select("cell", "lat", "lon")
            .join(sides, "cell")
            .where(box_gap_km("lat", "lon", *edge) <= eps_km + SLACK_KM)
            .select("scope", "lat", "lon")
        )

    targets = strip("b", "a").select(
        "scope", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), F.lit(0).alias("site_key")
    )
    nearest = nearest_spots(strip("a", "b"), targets, scoped=True).where(F.col("distance_km") <= eps_km)
    cells = F.split("scope", r"\|")
    return nearest.select(cells[0].cast("bigint").alias("a"), cells[1].cast("bigint").alias("b")).distinct()
