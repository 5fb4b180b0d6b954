"""The pyramid search against brute force."""

import numpy as np
import pandas as pd
import pytest

from stackplume.operators import nearest as nr


def brute(points, sites):
    la, lo = np.radians(points["lat"].to_numpy())[:, None], np.radians(points["lon"].to_numpy())[:, None]
    sa, so = np.radians(sites["latitude"].to_numpy()), np.radians(sites["longitude"].to_numpy())
    arc = np.sin((sa - la) / 2) ** 2 + np.cos(la) * np.cos(sa) * np.sin((so - lo) / 2) ** 2
    return 2 * 6371.0 * np.arctan2(np.sqrt(arc), np.sqrt(1 - arc))


@pytest.mark.parametrize("seed, centre, spread", [(1, (20, 78), 8), (2, (0, 179.5), 3), (3, (86, 10), 3.9), (4, (-30, -60), 25), (5, (19, 73), 0.02)])
def test_matches_brute_force(spark, seed, centre, spread):
    rng = np.random.default_rng(seed)

    def cloud(n):
        lat = np.clip(centre[0] + rng.uniform(-spread, spread, n), -90, 90)
        lon = (centre[1] + rng.uniform(-spread, spread, n) + 180) % 360 - 180
        return lat.round(4), lon.round(4)

    lat, lon = cloud(400)
    lat[:130], lon[:130] = lat[0], lon[0]  # a third of the sites on one spot
    sites = pd.DataFrame({"factory_id": [f"s{i:04d}" for i in range(400)], "latitude": lat, "longitude": lon, "city": "c"})
    plat, plon = cloud(60)
    readings = pd.DataFrame({"event_id": range(60), "station_lat": plat, "station_lon": plon})
    distance = brute(readings.rename(columns={"station_lat": "lat", "station_lon": "lon"}), sites)
    out = (
        nr.nearest_site_join(spark.createDataFrame(readings), spark.createDataFrame(sites))
        .select("event_id", "factory_id", "distance_to_nearest_station").orderBy("event_id").toPandas()
    )
    assert np.allclose(out["distance_to_nearest_station"], distance.min(axis=1), atol=1e-7)
    expected = [sites["factory_id"].to_numpy()[np.isclose(d, d.min(), atol=1e-9)].min() for d in distance]
    assert list(out["factory_id"]) == expected


def test_cities_without_sites_look_everywhere(spark):
    sites = spark.createDataFrame([("a", 19.0, 73.0, "X"), ("b", 25.0, 80.0, "Y")], "factory_id string, latitude double, longitude double, city string")
    readings = spark.createDataFrame(
        [(1, 25.0, 80.0, "X"), (2, 25.1, 80.0, "Z"), (3, None, 80.0, "Z"), (4, 25.1, 80.0, None)],
        "event_id int, station_lat double, station_lon double, city string",
    )
    out = {r["event_id"]: r["nearest_factory_distance_km"] for r in nr.nearest_distance_in_city(readings, sites, None).collect()}
    assert set(out) == {1, 2, 4}
    assert out[1] > 900
    assert out[2] == pytest.approx(11.12, abs=0.01) and out[4] == out[2]
    assert {r["event_id"] for r in nr.nearest_distance_in_city(readings, sites, 50.0).collect()} == {2, 4}


def test_no_sites_gives_no_rows(spark):
    sites = spark.createDataFrame([], "factory_id string, latitude double, longitude double, city string")
    readings = spark.createDataFrame([(1, 20.0, 80.0)], "event_id int, station_lat double, station_lon double")
    assert nr.nearest_site_join(readings, sites).count() == 0
