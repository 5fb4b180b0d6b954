"""Explicit schemas of the stored tables and landed payloads; nothing is inferred."""

FACTORIES = (
    "factory_id string, factory_name string, industry_type string, latitude double, longitude double, city string, "
    "state string, country string, source string, osm_id string, last_updated string"
)
READINGS = (
    "pm25 double, pm10 double, co double, no2 double, so2 double, o3 double, aqi_index double, timestamp string, "
    "station_name string, station_lat double, station_lon double, city string, country string, source string, "
    "nearest_factory_distance_km double"
)
RECOMMENDATIONS = (
    "factory_id string, factory_name string, industry_type string, latitude double, longitude double, city string, "
    "state string, country string, pollution_impact_score double, latest_pm25 double, latest_pm10 double, "
    "risk_level string, recommendation string"
)
SITE_ELEMENT = (
    "type string, id string, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>"
)
MEASUREMENT = (
    "parameter string, value double, location string, date struct<utc: string>, datetime string, "
    "period struct<datetimeFrom: struct<utc: string>, datetimeTo: struct<utc: string>>, "
    "coordinates struct<latitude: double, longitude: double>, city string, country string"
)
OPEN_RECORD = (
    "pollutant_id string, parameter string, pollutant_avg string, value string, station string, station_name string, "
    "city string, state string, last_update string, timestamp string"
)
