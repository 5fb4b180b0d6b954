"""Density clustering against the textbook procedure."""

import numpy as np
import pandas as pd
import pytest

from stackplume.operators.clustering import connected_components, density_clusters, dense_numbers


def textbook(lat, lon, eps_degrees, min_samples):
    la, lo = np.radians(lat), np.radians(lon)
    arc = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    near = 2 * 6371.0 * np.arctan2(np.sqrt(arc), np.sqrt(1 - arc)) <= np.radians(eps_degrees) * 6371.0
    core = near.sum(1) >= min_samples
    labels, cluster = -np.ones(len(lat), int), 0
    for i in range(len(lat)):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i], stack = cluster, [i]
        while stack:
            j = stack.pop()
            if core[j]:
                for q in np.where(near[j])[0]:
                    if labels[q] == -1:
                        labels[q] = cluster
                        stack.append(q)
        cluster += 1
    return labels


@pytest.mark.parametrize("seed, n, min_samples, spread, centre", [(1, 300, 2, 0.5, (20, 77)), (2, 350, 3, 0.45, (20, 77)), (3, 300, 4, 0.3, (65, 179.9)), (4, 300, 5, 0.4, (-3, 10))])
def test_matches_textbook(spark, seed, n, min_samples, spread, centre):
    rng = np.random.default_rng(seed)
    lat = (centre[0] + rng.uniform(-spread, spread, n)).round(3)
    lon = ((centre[1] + rng.uniform(-spread, spread, n) + 180) % 360 - 180).round(3)
    third = n // 3  # a dense third, with repeated coordinates
    lat[:third] = (lat[0] + rng.normal(0, 0.01, third)).round(3)
    lon[:third] = (lon[0] + rng.normal(0, 0.01, third)).round(3)
    frame = pd.DataFrame({"factory_id": np.arange(n), "latitude": lat, "longitude": lon})
    out = density_clusters(spark.createDataFrame(frame), min_samples=min_samples).orderBy("factory_id").toPandas()
    assert list(out["cluster_id"]) == list(textbook(lat, lon, 0.05, min_samples))


def test_missing_coordinates_and_tiny_tables_are_noise(spark):
    sites = spark.createDataFrame([("a", None, 70.0), ("b", 20.0, 70.0)], "factory_id string, latitude double, longitude double")
    assert {r["cluster_id"] for r in density_clusters(sites).collect()} == {-1}
    twins = spark.createDataFrame([("a", 20.0, 70.0), ("b", 20.0, 70.0)], "factory_id string, latitude double, longitude double")
    assert {r["cluster_id"] for r in density_clusters(twins).collect()} == {0}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 100)]
    edges = spark.createDataFrame(path + star, "a long, b long")
    out = {r["vertex"]: r["component"] for r in connected_components(edges).collect()}
    assert len(out) == 301
    assert all(out[i] == 0 for i in range(201)) and all(out[1000 + i] == 1000 for i in range(100))


def test_dense_numbers(spark):
    keys = spark.createDataFrame([(f"k{i % 37:03d}",) for i in range(100)], "key string")
    out = dense_numbers(keys, "key", "n").orderBy("key").collect()
    assert [r["n"] for r in out] == list(range(37))
