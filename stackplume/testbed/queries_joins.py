"""C, G, M: joins, set operations and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.operators import matching as mt
from stackplume.operators import nearest as nr
from stackplume.operators.clustering import density_clusters
from stackplume.operators.windows import first_per_key
from stackplume.sources import payloads, scan
from stackplume.testbed.catalog import Inputs, query, r6
from stackplume.testbed.queries_sources import _BACKFILL
from stackplume.testbed.sqltext import case_sql, hav, r6 as s6, sql, values_sql

PS = " ".join(C.POLLUTANTS)


@query(
    "C1_nearest_site_join",
    sql("joined", "SELECT event_id, factory_id, industry_type, city, round(distance_to_nearest_station,6) AS km FROM joined"),
)
def nearest_site_join(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = nr.nearest_site_join(t.readings, t.factories)
    return out.select("event_id", "factory_id", "industry_type", "city", F.round("distance_to_nearest_station", 6).alias("km"))


@query(
    "C2_nearest_distance_in_city",
    sql("near_city", "SELECT event_id, city, round(nearest_factory_distance_km,6) AS km FROM near_city"),
)
def nearest_distance(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = nr.nearest_distance_in_city(t.readings, t.factories)
    return out.select("event_id", "city", F.round("nearest_factory_distance_km", 6).alias("km"))


@query(
    "C3_radius_search",
    sql("readings", f"SELECT event_id, station_name FROM readings WHERE {hav('19.0760e0', '72.8777e0', 'station_lat', 'station_lon')}<=140"),
)
def radius_search(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    return nr.radius_search(r, 19.0760, 72.8777, 140.0, "station_lat", "station_lon").select("event_id", "station_name")


@query("C4_match_reading", sql("matched", f"SELECT factory_id, match_tier, {s6(PS)} FROM matched"))
def match_reading(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return mt.match_nearest(t.factories, t.near_city).select("factory_id", "match_tier", *r6(*C.POLLUTANTS))


@query("C4_match_reading_close", sql("matched_tight", f"SELECT factory_id, match_tier, {s6(PS)} FROM matched_tight"))
def match_reading_close(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return mt.match_nearest(t.factories, t.near_city, max_km=2.0).select("factory_id", "match_tier", *r6(*C.POLLUTANTS))


@query("C5_match_reading_first", sql("matched_first", f"SELECT factory_id, match_tier, {s6(PS)} FROM matched_first"))
def match_reading_first(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return mt.match_first(t.factories, t.near_city).select("factory_id", "match_tier", *r6(*C.POLLUTANTS))


@query("C5_tier_counts", sql("matched_tight", "SELECT match_tier, count(*) AS sites FROM matched_tight GROUP BY match_tier"))
def tier_counts(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return mt.tier_counts(mt.match_nearest(t.factories, t.near_city, max_km=2.0))


_RECS = (
    "recs AS (SELECT factory_id, k AS seq, 'rec '||k AS recommendation, city FROM keyed WHERE k%5<>0 UNION ALL "
    "SELECT factory_id, k+1000000, 'late '||k, 'elsewhere' FROM keyed WHERE k%4=0)"
)


def _recommendations(spark, sf_dir):
    k = Inputs(spark, sf_dir).keyed_sites
    first = k.where("k % 5 <> 0").select("factory_id", F.col("k").alias("seq"), F.concat(F.lit("rec "), "k").alias("recommendation"), "city")
    late = k.where("k % 4 = 0").select(
        "factory_id", (F.col("k") + 1_000_000).alias("seq"), F.concat(F.lit("late "), "k").alias("recommendation"), F.lit("elsewhere").alias("city")
    )
    return first.unionByName(late)


@query(
    "C6_attach_first_recommendation",
    sql("keyed", "SELECT f.factory_id, f.city, r.city AS city_rec, r.recommendation FROM factories f LEFT JOIN "
        "(SELECT *, row_number() OVER (PARTITION BY factory_id ORDER BY seq) AS rn FROM recs) r ON r.factory_id=f.factory_id AND r.rn=1", _RECS),
)
def attach_recommendation(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = mt.attach_first_recommendation(t.factories, _recommendations(spark, sf_dir), ["seq"])
    return out.select("factory_id", "city", "city_rec", "recommendation")


@query(
    "C7_site_detail",
    sql("keyed", "SELECT f.factory_id, f.factory_name, r.recommendation FROM factories f LEFT JOIN (SELECT factory_id, arg_min(recommendation, seq) AS recommendation "
        "FROM recs GROUP BY factory_id) r USING (factory_id) WHERE f.factory_id='OSM_relation_8'", _RECS),
)
def site_detail(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    out = mt.site_detail(t.factories, _recommendations(spark, sf_dir), "OSM_relation_8", ["seq"])
    return out.select("factory_id", "factory_name", "recommendation")


@query(
    "C8_bulk_lookup",
    sql("keyed", "SELECT w.factory_id, f.city, CASE WHEN f.factory_id IS NULL THEN concat('Factory ''',w.factory_id,''' not found') END AS error FROM "
        "(SELECT CASE WHEN k%6=0 THEN concat('missing_',k) ELSE factory_id END AS factory_id FROM keyed) w LEFT JOIN factories f ON f.factory_id=w.factory_id"),
)
def bulk_lookup(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    wanted = t.keyed_sites.select(
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("missing_"), "k")).otherwise(F.col("factory_id")).alias("factory_id")
    )
    found, missing = mt.bulk_lookup(t.factories, wanted)
    return found.select("factory_id", "city").unionByName(missing, allowMissingColumns=True)


@query(
    "C9_backfill_suppress",
    sql("readings", "SELECT event_id, station_name FROM backfill WHERE NOT EXISTS (SELECT 1 FROM readings r WHERE lower(trim(r.station_name))=lower(trim(backfill.station_name)) "
        "AND date_trunc('second',r.timestamp)=date_trunc('second',backfill.timestamp))", _BACKFILL),
)
def backfill_suppress(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    return mt.backfill_suppress(payloads.normalise_backfill(t.backfill), t.readings).select("event_id", "station_name")


@query(
    "C10_lookup_enrich",
    sql("factories", f"SELECT factory_id, {case_sql('lower(industry_type)', {k.lower(): v for k, v in C.INDUSTRY_GROWTH.items()}, '1.5e0')} AS industry_growth, "
        f"{case_sql('city', C.CITY_URBANISATION, '1.02e0')} AS city_urbanization FROM factories"),
)
def lookup_enrich(spark, sf_dir):
    out = mt.growth_and_urbanisation(Inputs(spark, sf_dir).factories)
    return out.select("factory_id", "industry_growth", "city_urbanization")


@query(
    "C11_city_centres",
    sql("factories", "SELECT city, round(lat,6) AS lat, round(lon,6) AS lon FROM (SELECT city, avg(latitude) AS lat, avg(longitude) AS lon FROM factories GROUP BY city "
        "UNION ALL SELECT city, lat, lon FROM fixed WHERE city NOT IN (SELECT city FROM factories))", "fixed AS " + values_sql(C.READING_CITY_CENTRES, "city, lat, lon", "t")),
)
def city_centres(spark, sf_dir):
    fixed = spark.createDataFrame(C.READING_CITY_CENTRES, "city string, lat double, lon double")
    return nr.city_centres(Inputs(spark, sf_dir).factories, fixed).select("city", *r6("lat", "lon"))


@query(
    "C12_overlay_latest_on_cached",
    sql("matched", "SELECT factory_id, " + ", ".join(f"round(coalesce(CASE WHEN city IN ('Pune','Delhi') THEN {p}+1 END, {p}),6) AS {p}" for p in C.POLLUTANTS) + " FROM matched"),
)
def overlay_latest(spark, sf_dir):
    t = Inputs(spark, sf_dir)
    cached = mt.match_nearest(t.factories, t.near_city).select("factory_id", "city", *C.POLLUTANTS)
    live = cached.select(
        "factory_id", *[F.when(F.col("city").isin("Pune", "Delhi"), F.col(p) + 1).alias(p) for p in C.POLLUTANTS]
    )
    return mt.overlay_latest(cached, live).select("factory_id", *r6(*C.POLLUTANTS))


@query(
    "G1_concat",
    sql("readings", "SELECT event_id, round(pm25,6) AS pm25, CAST(NULL AS DOUBLE) AS o3 FROM readings WHERE source='view' UNION ALL "
        "SELECT event_id, CAST(NULL AS DOUBLE), round(o3,6) FROM readings WHERE source<>'view'"),
)
def concat(spark, sf_dir):
    r = Inputs(spark, sf_dir).readings
    one = r.where("source = 'view'").select("event_id", *r6("pm25"))
    return one.unionByName(r.where("source <> 'view'").select("event_id", *r6("o3")), allowMissingColumns=True)


@query(
    "G2_augment_below_threshold",
    sql("keyed", "SELECT factory_id, city, CASE WHEN industry_type IN ('steel','cement') THEN 'base' ELSE 'extra' END AS origin FROM keyed "
        "WHERE industry_type IN ('steel','cement') OR (SELECT count(*) FROM keyed WHERE industry_type IN ('steel','cement'))<1000000000"),
)
def augment(spark, sf_dir):
    f = Inputs(spark, sf_dir).factories.select("factory_id", "city", "industry_type")
    base = f.where("industry_type IN ('steel', 'cement')").withColumn("origin", F.lit("base"))
    extra = f.withColumn("origin", F.lit("extra"))
    return scan.stack_sources(base, extra, 1_000_000_000, "factory_id", ["factory_id"]).drop("industry_type")


@query(
    "G2_augment_not_needed",
    sql("keyed", "SELECT factory_id, 'base' AS origin FROM keyed WHERE industry_type IN ('steel','cement')"),
)
def augment_not_needed(spark, sf_dir):
    f = Inputs(spark, sf_dir).factories.select("factory_id", "industry_type")
    base = f.where("industry_type IN ('steel', 'cement')").withColumn("origin", F.lit("base"))
    return scan.stack_sources(base, f.withColumn("origin", F.lit("extra")), 1, "factory_id", ["factory_id"]).drop("industry_type")


@query(
    "G3_distinct_stations",
    sql("readings", "SELECT station_name, round(station_lat,6) AS station_lat, round(station_lon,6) AS station_lon, min(event_id) AS event_id FROM readings GROUP BY ALL"),
)
def distinct_stations(spark, sf_dir):
    first = first_per_key(Inputs(spark, sf_dir).readings, ["station_name", "station_lat", "station_lon"], ["event_id"])
    return first.select("station_name", *r6("station_lat", "station_lon"), "event_id")


CLUSTERS = (
    f"pairs AS (SELECT a.factory_id AS a, b.factory_id AS b FROM factories a JOIN factories b ON {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}<=radians(0.05e0)*6371), "
    "cores AS (SELECT a AS id FROM pairs GROUP BY a HAVING count(*)>=2), "
    "links AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)), "
    "reach AS (SELECT id AS a, id AS b FROM cores UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a=reach.b), "
    "roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a), "
    "numbered AS (SELECT id, dense_rank() OVER (ORDER BY root)-1 AS cluster FROM roots), "
    "clustered AS (SELECT f.factory_id, coalesce(n.cluster, (SELECT min(m.cluster) FROM pairs p JOIN numbered m ON m.id=p.b WHERE p.a=f.factory_id), -1) AS cluster_id "
    "FROM factories f LEFT JOIN numbered n ON n.id=f.factory_id)"
)


@query("M1_density_cluster", sql("factories", "SELECT factory_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM clustered", CLUSTERS))
def density_cluster(spark, sf_dir):
    return density_clusters(Inputs(spark, sf_dir).factories)
