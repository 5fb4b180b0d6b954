"""Input views over the generated tables, as SQL that both engines read unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions.aqi import naive_aqi
from stackplume.functions.numeric import lookup
from stackplume.operators.aggregates import composite_target
from stackplume.operators.matching import add_risk
from stackplume.operators.nearest import nearest_distance_in_city, nearest_site_join
from stackplume.plans.features import build_dataset, monthly_history
from stackplume.plans.scoring import recommend, scored_sites
from stackplume.session import ensure_checkpoint_dir

TABLES = ["supplier", "events"]

_CITIES = """cities AS (SELECT * FROM (VALUES (0,'Pune','Maharashtra',18.5204e0,73.8567e0),
  (1,'Mumbai','Maharashtra',19.0760e0,72.8777e0),
  (2,'Chennai','Tamil Nadu',13.0827e0,80.2707e0),
  (3,'Hyderabad','Telangana',17.3850e0,78.4867e0),
  (4,'Bengaluru','Karnataka',12.9716e0,77.5946e0),
  (5,'Delhi','Delhi',28.6139e0,77.2090e0),
  (6,'Kolkata','West Bengal',22.5726e0,88.3639e0),
  (7,'Nagpur','Maharashtra',21.1458e0,79.0882e0)) AS t(cid,city,state,clat,clon))"""

FACTORIES = f"""WITH {_CITIES},
inds AS (SELECT * FROM (VALUES (0,'steel'),
  (1,'cement'),
  (2,'chemical'),
  (3,'textile'),
  (4,'automotive'),
  (5,'power'),
  (6,'pharmaceutical'),
  (7,'food'),
  (8,'general_industrial'),
  (9,'unknown')) AS t(iid,industry_type))
SELECT concat('OSM_',
  CASE s_suppkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END, '_', CAST(s_suppkey AS VARCHAR(20))) AS factory_id,
  s_name AS factory_name,
  industry_type,
  clat + CAST((s_suppkey*7919) % 4001 - 2000 AS DOUBLE)/1e4 AS latitude,
  clon + CAST((s_suppkey*104729) % 4001 - 2000 AS DOUBLE)/1e4 AS longitude, city, state,
  'India' AS country
FROM supplier
JOIN cities ON cid = s_nationkey % 8
JOIN inds ON iid = s_suppkey % 10"""

READINGS = f"""WITH {_CITIES}
SELECT event_id,
  ts AS timestamp,
  concat(coalesce(city,'Remote'),' Station ',CAST(user_id % 48 AS VARCHAR(20))) AS station_name,
  CASE WHEN event_id % 211 = 0 THEN NULL ELSE coalesce(clat,25.0e0) + CAST(((user_id % 48)*3571) % 3001 - 1500 AS DOUBLE)/1e4 END AS station_lat,
  coalesce(clon,85.0e0) + CAST(((user_id % 48)*2741) % 3001 - 1500 AS DOUBLE)/1e4 AS station_lon,
  coalesce(city,'Remote') AS city,
  'India' AS country,
  event_type AS source,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 101 = 1 THEN value*20e0 + 500e0 ELSE value END AS pm25,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE value*1.5e0 END AS pm10,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id % 200 AS DOUBLE)/10e0 END AS co,
  CAST((event_id*37) % 450 AS DOUBLE) AS no2,
  CAST((event_id*53) % 900 AS DOUBLE) AS so2,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST((event_id*11) % 320 AS DOUBLE) END AS o3
FROM events
LEFT JOIN cities ON cid = (user_id % 48) % 9"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def factories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        FACTORIES.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier")
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READINGS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def _key(column: str = "factory_id"):
    """Number inside a site id."""
    return F.regexp_extract(column, "([0-9]+)", 1).cast("bigint")


def readings_aqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).withColumn("aqi_index", naive_aqi())


def readings_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with every tenth one repeated under a new id."""
    base = readings(spark, sf_dir)
    again = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1_000_000_000))).otherwise(F.array(F.lit(0)))
    return base.withColumn("_shift", F.explode(again)).withColumn("event_id", F.col("event_id") + F.col("_shift")).drop("_shift")


def keyed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factories(spark, sf_dir).withColumn("k", _key())


def site_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements as JSON texts: seq, city, payload.  Every 25th has no position, every 10th id comes twice, and
    every 15th site reappears under another id at the same place.
    """
    copies = F.array(
        F.struct(F.lit(0).alias("shift"), F.lit(0).alias("renumber")),
        F.when(F.col("k") % 10 == 0, F.struct(F.lit(1_000_000).alias("shift"), F.lit(0).alias("renumber"))),
        F.when(F.col("k") % 15 == 0, F.struct(F.lit(2_000_000).alias("shift"), F.lit(500_000).alias("renumber"))),
    )
    base = keyed_sites(spark, sf_dir).withColumn("c", F.explode(F.array_compact(copies)))
    k = F.col("k")
    none = F.lit(None).cast("string")
    tag = lambda cases: F.element_at(F.array(*[none if c is None else F.lit(c) if isinstance(c, str) else c for c in cases]), (k % 7 + 1).cast("int"))
    label = F.concat(F.lit("acme  STEEL-works (unit "), k, F.lit(")"))
    tags = F.struct(
        tag(["Steel mill", "refinery", None, None, None, "garment", None]).alias("industrial"),
        tag(["industrial", None, "industrial", None, None, None, None]).alias("landuse"),
        tag([None, None, None, "works", None, None, None]).alias("man_made"),
        tag([None, None, None, None, "factory", None, None]).alias("amenity"),
        tag([None, None, None, None, None, "industrial", None]).alias("building"),
        tag([label, None, None, "", "??", "Textile's 3m", None]).alias("name"),
        tag([None, "bharat_chem", None, None, None, None, None]).alias("operator"),
    )
    placed = k % 25 != 0
    inline = placed & (k % 2 == 0)
    center = F.when(placed & (k % 2 == 1), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))
    payload = F.to_json(
        F.struct(
            F.element_at(F.array(F.lit("node"), F.lit("way"), F.lit("rel/ation")), (k % 3 + 1).cast("int")).alias("type"),
            (k + F.col("c.renumber")).alias("id"),
            F.when(inline, F.col("latitude")).alias("lat"), F.when(inline, F.col("longitude")).alias("lon"),
            center.alias("center"), tags.alias("tags"),
        )
    )
    return base.select((k + F.col("c.shift")).alias("seq"), "city", payload.alias("payload"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long readings: seq, event_id, station columns, timestamp text, parameter, value.  PM2.5 of every tenth reading is
    measured again later with a value one higher.
    """
    base = readings(spark, sf_dir)
    items = [
        F.struct((F.col("event_id") * 6 + i).alias("seq"), F.lit(p).alias("parameter"), F.col(p).alias("value"))
        for i, p in enumerate(C.POLLUTANTS)
    ]
    again = F.when(
        F.col("event_id") % 10 == 0,
        F.struct(
            (F.col("event_id") * 6 + 1_000_000_000).alias("seq"), F.lit("pm25").alias("parameter"),
            (F.col("pm25") + 1).alias("value"),
        ),
    )
    return base.withColumn("m", F.explode(F.array_compact(F.array(*items, again)))).select(
        "m.seq", "event_id", "station_name", "station_lat", "station_lon", "city", F.col("timestamp").cast("string").alias("timestamp"),
        "m.parameter", "m.value",
    )


def measurement_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements as JSON texts in three shapes; some without a time, some of an unknown pollutant."""
    m = measurements(spark, sf_dir)
    shape, odd = F.col("event_id") % 3, F.col("event_id") % 50
    moment = F.when(odd != 7, F.col("timestamp"))
    name = F.when(odd == 8, F.lit("bc")).otherwise(F.col("parameter"))
    place = F.struct(F.col("station_lat").alias("latitude"), F.col("station_lon").alias("longitude")).alias("coordinates")
    shared = [F.col("station_name").alias("location"), F.col("value"), place]
    plain = F.to_json(F.struct(
        name.alias("parameter"), F.struct(moment.alias("utc")).alias("date"), F.col("city"), F.lit("India").alias("country"), *shared
    ))
    nested = F.to_json(F.struct(
        F.struct(F.upper(name).alias("name")).alias("parameter"), moment.alias("datetime"), F.lit("").alias("city"),
        F.struct(F.lit("India").alias("name")).alias("country"), *shared
    ))
    period = F.to_json(F.struct(
        name.alias("parameter"), F.struct(F.struct(moment.alias("utc")).alias("datetimeFrom")).alias("period"),
        F.lit("Unknown").alias("city"), *shared
    ))
    payload = F.when(shape == 0, plain).when(shape == 1, nested).otherwise(period)
    return m.select("seq", F.col("city").alias("asked_city"), payload.alias("payload"))


def open_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-data records as JSON texts with odd spellings, bad numbers and bad times."""
    m = measurements(spark, sf_dir)
    e = F.col("event_id")
    spelled = lookup({"pm25": " pm2.5", "pm10": "PM10", "co": "co", "no2": "NO2 ", "so2": "SO2"}, F.col("parameter"))
    spelled = F.coalesce(spelled, F.when(e % 2 == 0, F.lit("OZONE")).otherwise(F.lit("o3")))
    spelled = F.when(e % 50 == 8, F.lit("NH3")).otherwise(spelled)
    number = F.when(e % 13 == 0, F.lit("NA")).otherwise(F.col("value").cast("string"))
    payload = F.to_json(F.struct(
        F.when(e % 4 != 3, spelled).alias("pollutant_id"), F.when(e % 4 == 3, spelled).alias("parameter"),
        F.when(e % 5 != 0, number).alias("pollutant_avg"), F.when(e % 5 == 0, number).alias("value"),
        F.concat(F.lit(" "), F.col("station_name")).alias("station"),
        F.when(e % 6 != 0, F.col("city")).alias("city"), F.when(e % 6 == 0, F.lit("Somewhere")).alias("state"),
        F.when(e % 50 == 7, F.lit("soon")).otherwise(F.col("timestamp")).alias("last_update"),
    ))
    return m.select("seq", payload.alias("payload"))


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide backfill with odd headers and texts for numbers: a quarter of the readings, upper-cased and padded, and one
    unseen station in eight.
    """
    r = readings(spark, sf_dir).where("event_id % 4 = 0")
    e = F.col("event_id")
    station = F.when(e % 8 == 0, F.concat(F.lit("New "), "station_name")).otherwise(F.concat(F.lit(" "), F.upper("station_name"), F.lit(" ")))
    text = lambda c: F.when(e % 13 == 0, F.lit("n/a")).otherwise(F.col(c).cast("string"))
    return r.select(
        "event_id", station.alias("Station"), F.when(e % 52 == 8, F.lit("never")).otherwise(F.col("timestamp").cast("string")).alias("Date"),
        text("pm25").alias("PM2.5"), text("pm10").alias("pm_10"), text("o3").alias("Ozone"),
        F.col("station_lat").alias("lat"), F.col("station_lon").alias("lng"), F.col("city").alias("City"),
    )


def near_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings near enough to a site of their city, with the distance: the stored table the scoring jobs read."""
    ensure_checkpoint_dir(spark)
    return nearest_distance_in_city(readings_aqi(spark, sf_dir), factories(spark, sf_dir)).checkpoint()


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with nearest site and target (one target per reading)."""
    return composite_target(nearest_site_join(readings(spark, sf_dir), factories(spark, sf_dir), keep_stations=True))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly history per factory.  The data spans one month, so the month number is taken from the event number."""
    return monthly_history(dataset(spark, sf_dir), F.col("event_id") % 36)


GENERATED_AT = "2024-02-01T00:00:00+00:00"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested site reports: the stored table the list and plan jobs read."""
    ensure_checkpoint_dir(spark)
    return recommend(factories(spark, sf_dir), near_city(spark, sf_dir), GENERATED_AT).checkpoint()


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored sites (nearest-reading variant), stored."""
    ensure_checkpoint_dir(spark)
    return scored_sites(factories(spark, sf_dir), near_city(spark, sf_dir)).checkpoint()


def ml_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training dataset, stored."""
    ensure_checkpoint_dir(spark)
    return build_dataset(readings(spark, sf_dir), factories(spark, sf_dir)).checkpoint()


def scored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every located reading with its site's industry and its own risk scores."""
    return add_risk(nearest_site_join(readings(spark, sf_dir), factories(spark, sf_dir), keep_stations=True))
