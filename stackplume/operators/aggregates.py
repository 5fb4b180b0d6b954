"""Aggregations and global statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions.numeric import clamp, total
from stackplume.operators.quantiles import exact_medians, exact_quantiles
from stackplume.session import ensure_checkpoint_dir


def scalars(one_row: DataFrame, *names: str):
    """Columns of a one-row aggregate as a scalar subquery inside the same query."""
    return one_row.select(F.struct(*[F.col(n) for n in (names or one_row.columns)]).alias("s")).scalar()


def attach(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """The one-row aggregate as a constant struct column.

    Only that one row of statistics reaches the driver.  Later steps then plan against constants instead of repeating
    the whole lineage of the statistic at every use.
    """
    row = one_row.first()
    fields = [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema.fields]
    return df.withColumn(name, F.struct(*fields))


def impute_medians(df: DataFrame, columns: list[str] | None = None, key: str = "station_name") -> DataFrame:
    """NULL to the station's median; what is still NULL to the median of the column after that fill.

    The station medians (one row per station) are checkpointed, since both fills read them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    columns = columns or [c for c in [*C.POLLUTANTS, "aqi_index"] if c in df.columns]
    medians = exact_medians(df, columns, [key]).checkpoint()
    renamed = medians.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    filled = df.join(renamed, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns})
    filled = filled.drop(*[f"_{c}" for c in columns])
    overall = attach(filled, exact_medians(filled, columns), "_overall")
    return overall.withColumns({c: F.coalesce(F.col(c), F.col(f"_overall.{c}")) for c in columns}).select(*df.columns)


def city_stats(df: DataFrame) -> DataFrame:
    """Per city: mean PM2.5 and PM10, highest index, number of readings."""
    return (
        df.where(F.col("city").isNotNull())
        .groupBy("city")
        .agg(
            F.bround(F.avg("pm25"), 2).alias("avg_pm25"),
            F.bround(F.avg("pm10"), 2).alias("avg_pm10"),
            F.bround(F.max("aqi_index"), 2).alias("max_aqi"),
            F.count(F.lit(1)).alias("reading_count"),
        )
    )


def column_means(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    means = [F.avg(c).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*means) if keys else df.agg(*means)


def weighted_target() -> "F.Column":
    return total([F.col(p) * F.lit(C.TARGET_WEIGHTS[p]) for p in ("pm25", "pm10", "no2", "so2", "co", "o3")])


def composite_target(df: DataFrame, name: str = "pollution_impact_score") -> DataFrame:
    """Weighted pollutant sum over its 95th percentile, times ten, limited to [0, 10]; NULL if any part is NULL."""
    summed = df.withColumn("_sum", weighted_target())
    known = attach(summed, _one(exact_quantiles(summed, ["_sum"], [0.95]), 1), "_stats")
    return known.withColumn(name, clamp(F.try_divide("_sum", "_stats.q0") * 10, 0, 10)).drop("_sum", "_stats")


def spike_flag(df: DataFrame, column: str = "pm25", name: str = "pollution_spike_flag", limit: float = 2.5) -> DataFrame:
    """1 where the z-score over the whole table exceeds the limit; a zero spread counts as one."""
    known = attach(df, df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("spread")), "_stats")
    spread = F.col("_stats.spread")
    spread = F.when(F.coalesce(spread, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(spread)
    z = (F.col(column) - F.col("_stats.mean")) / spread
    return known.withColumn(name, F.coalesce((z > limit).cast("int"), F.lit(0))).drop("_stats")


def _one(quantiles: DataFrame, count: int) -> DataFrame:
    """Exactly one row of quantiles, NULL when there was no value at all."""
    return quantiles.select(*[F.max(f"q{i}").alias(f"q{i}") for i in range(count)])


def intensity_column(df: DataFrame) -> str:
    for name in ("aqi_index", "pm25", "pm10", "no2", "so2", "co"):
        if name in df.columns:
            return name
    raise ValueError("no supported intensity column")


def coordinate_columns(df: DataFrame) -> tuple[str, str]:
    lat = next((c for c in ("station_lat", "latitude") if c in df.columns), None)
    lon = next((c for c in ("station_lon", "longitude") if c in df.columns), None)
    if lat is None or lon is None:
        raise ValueError("no coordinate columns")
    return lat, lon


def minmax_intensity(df: DataFrame, column: str | None = None) -> DataFrame:
    """Adds ``intensity_normalized``: NULL becomes the median, then min-max to [0, 1]; a constant column is 1."""
    column = column or intensity_column(df)
    known = attach(df, _one(exact_quantiles(df, [column], [0.0, 0.5, 1.0]), 3), "_stats")
    low, middle, high = (F.coalesce(F.col(f"_stats.{n}"), F.lit(0.0)) for n in ("q0", "q1", "q2"))
    value = F.coalesce(F.col(column), middle)
    scaled = F.when(high == low, F.lit(1.0)).otherwise(F.try_divide(value - low, high - low))
    return known.withColumn("intensity_normalized", scaled).drop("_stats")


def top_polluted_cities(df: DataFrame, k: int = 10) -> DataFrame:
    lat, lon = coordinate_columns(df)
    valid = df.where(
        F.col("city").isNotNull() & F.col("aqi_index").isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()
    )
    means = valid.groupBy("city").agg(F.avg("aqi_index").alias("avg_aqi"))
    centres = exact_medians(valid, [lat, lon], ["city"]).select("city", F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return means.join(centres, "city").orderBy(F.col("avg_aqi").desc(), "city").limit(k)


def map_center(df: DataFrame) -> DataFrame:
    """Median coordinates; the default centre when there are none."""
    lat, lon = coordinate_columns(df)
    return exact_medians(df, [lat, lon]).select(
        F.coalesce(lat, F.lit(C.DEFAULT_CENTRE[0])).alias("lat"), F.coalesce(lon, F.lit(C.DEFAULT_CENTRE[1])).alias("lon")
    )


def mean_center(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.agg(
        F.coalesce(F.avg(lat), F.lit(C.DEFAULT_CENTRE[0])).alias("lat"),
        F.coalesce(F.avg(lon), F.lit(C.DEFAULT_CENTRE[1])).alias("lon"),
    )


def site_quality_summary(sites: DataFrame) -> DataFrame:
    """Counts overall and by city, industry and state, with coordinate coverage in percent, from one pass."""
    covered = F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    rows = F.count(F.lit(1))
    empty = F.lit(None).cast("string")
    return (
        sites.select(
            "latitude", "longitude",
            F.explode(
                F.array(
                    F.struct(F.lit("total").alias("dimension"), empty.alias("value")),
                    F.struct(F.lit("city").alias("dimension"), F.col("city").alias("value")),
                    F.struct(F.lit("industry_type").alias("dimension"), F.col("industry_type").alias("value")),
                    F.struct(F.lit("state").alias("dimension"), F.col("state").alias("value")),
                )
            ).alias("g"),
        )
        .where((F.col("g.dimension") == "total") | F.col("g.value").isNotNull())
        .groupBy(F.col("g.dimension").alias("dimension"), F.col("g.value").alias("value"))
        .agg(rows.alias("sites"), F.bround(100.0 * covered / rows, 2).alias("coordinate_coverage"))
    )


def report_stats(reports: DataFrame) -> DataFrame:
    level = F.coalesce("risk_level", F.lit("Low"))
    return reports.agg(
        F.count(F.lit(1)).alias("total_factories"),
        *[F.count_if(level == name).alias(name.lower()) for name in ("Critical", "High", "Medium", "Low")],
        F.max("generated_at").alias("last_generated"),
    )


def top_pollutants(reports: DataFrame, k: int = 5) -> DataFrame:
    return (
        reports.where(F.coalesce("dominant_pollutant", F.lit("")) != "")
        .groupBy(F.col("dominant_pollutant").alias("pollutant"))
        .agg(F.count(F.lit(1)).alias("reports"))
        .orderBy(F.col("reports").desc(), "pollutant")
        .limit(k)
    )


def pivot_measurements(long: DataFrame, sequence: str = "seq") -> DataFrame:
    """One row per station and time: the last value of each pollutant, descriptive columns of the first row."""
    described = [c for c in ("station_lat", "station_lon", "city", "country") if c in long.columns]

    def first(c: str):
        # Packed, so that a NULL in the first row is kept instead of being skipped.
        return F.min_by(F.struct(c), sequence)[c].alias(c)

    def last(p: str):
        mine = F.col("parameter") == p
        return F.max_by(F.struct("value"), F.when(mine, F.col(sequence)))["value"].alias(p)

    return long.groupBy("station_name", "timestamp").agg(*[first(c) for c in described], *[last(p) for p in C.POLLUTANTS])


def latest_per_parameter(long: DataFrame, keys: list[str], sequence: str = "seq") -> DataFrame:
    """First valid (present, not negative) value per pollutant and location."""
    parameter = F.regexp_replace(F.lower(F.trim("parameter")), r"\.", "")
    valid = long.withColumn("parameter", parameter).where((F.col("value") >= 0) & ~F.isnan("value"))
    wanted = [*C.POLLUTANTS, "aqi_index"]
    return valid.groupBy(*keys).agg(
        *[F.min_by("value", F.when(F.col("parameter") == p, F.col(sequence))).alias(p) for p in wanted]
    )


def yearly_rollup(monthly: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean per year with an interval that widens with the spread of the months."""
    width = 0.5 + F.col("_spread") * 0.8
    return (
        monthly.groupBy(*keys, "year")
        .agg(F.avg(score).alias("predicted_score"), F.stddev_pop(score).alias("_spread"))
        .select(
            *keys, "year", "predicted_score",
            clamp(F.col("predicted_score") - width, 0, 10).alias("confidence_lower"),
            clamp(F.col("predicted_score") + width, 0, 10).alias("confidence_upper"),
        )
    )


def trend_summary(yearly: DataFrame, keys: list[str]) -> DataFrame:
    """Direction and risk course of each yearly series."""
    folded = yearly.groupBy(*keys).agg(
        F.min_by("predicted_score", "year").alias("first_score"),
        F.max_by("predicted_score", "year").alias("last_score"),
        F.avg("predicted_score").alias("mean_score"),
        F.count(F.lit(1)).alias("points"),
    )
    change = F.col("last_score") - F.col("first_score")
    single = F.col("points") < 2
    return folded.select(
        *keys, "first_score", "last_score",
        F.when(single, "stable").when(change > 0.5, "increasing").when(change < -0.5, "decreasing")
        .otherwise("stable").alias("trend"),
        F.when(single, "stable").when((F.col("mean_score") >= 7) | (change > 1), "worsening")
        .when((F.col("mean_score") <= 4) | (change < -1), "improving").otherwise("stable").alias("risk_trajectory"),
    )


def regression_metrics(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", keys: list[str] | None = None) -> DataFrame:
    error = F.col(truth) - F.col(predicted)
    # Same guard against tiny denominators as the usual definition of the percentage error.
    relative = F.abs(error) / F.greatest(F.abs(F.col(truth)), F.lit(2.220446049250313e-16))
    metrics = [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(relative).alias("mape"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(truth) * F.count(truth))).alias("r2"),
        F.count(F.lit(1)).alias("rows"),
    ]
    known = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return known.groupBy(*keys).agg(*metrics) if keys else known.agg(*metrics)


def classification_metrics(df: DataFrame, truth: str = "true_class", predicted: str = "pred_class") -> DataFrame:
    """One row per class present in the truth, and rows for accuracy, macro and weighted averages.

    The rows are reduced to (truth, prediction, count) first; everything else works on that handful.
    """
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    by_truth = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_prediction = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.try_divide(F.col("hits"), F.col("support"))
    per_class = (
        by_truth.join(by_prediction, "label", "left")
        .select("label", precision.alias("precision"), recall.alias("recall"), "support", "hits")
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
            ),
        )
    )
    names = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in names], F.sum("support").alias("support")
    )
    accuracy = per_class.agg((F.sum("hits") / F.sum("support")).alias("a"), F.sum("support").alias("support")).select(
        *[F.col("a").alias(m) for m in names], "support"
    )
    tagged = [
        per_class.select("label", *names, "support"),
        accuracy.select(F.lit("accuracy").alias("label"), *names, "support"),
        macro.select(F.lit("macro avg").alias("label"), *names, "support"),
        weighted.select(F.lit("weighted avg").alias("label"), *names, "support"),
    ]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out


def class_distribution(df: DataFrame, truth: str = "true_class", predicted: str = "pred_class") -> DataFrame:
    """label, true_rows, predicted_rows for every class that is true or predicted somewhere."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.col("t").alias("label"), F.col("n").alias("true_rows"), F.lit(0).alias("predicted_rows")).unionByName(
        cells.select(F.col("p").alias("label"), F.lit(0).alias("true_rows"), F.col("n").alias("predicted_rows"))
    )
    return both.where("label IS NOT NULL").groupBy("label").agg(
        F.sum("true_rows").alias("true_rows"), F.sum("predicted_rows").alias("predicted_rows")
    )


def confusion_matrix(df: DataFrame, labels: list[str], truth: str = "true_class", predicted: str = "pred_class") -> DataFrame:
    """Counts per true and predicted class; classes absent from the truth are left out of both axes' rows."""
    cells = df.groupBy(truth).pivot(predicted, labels).count()
    return cells.select(F.col(truth).alias("true_class"), *[F.coalesce(F.col(c), F.lit(0)).alias(f"pred_{c.lower()}") for c in labels])


def confidence_stats(df: DataFrame, column: str = "confidence") -> DataFrame:
    stats = df.agg(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")
    )
    middle = scalars(_one(exact_quantiles(df, [column], [0.5]), 1))
    return stats.withColumn("median", middle["q0"])


def timestamp_range(df: DataFrame, name: str = "timestamp") -> DataFrame:
    low, high = F.min(name), F.max(name)
    label = F.concat(F.date_format(low, "yyyy-MM-dd"), F.lit(" to "), F.date_format(high, "yyyy-MM-dd"))
    return df.agg(F.coalesce(label, F.lit("N/A")).alias("timestamp_range"))


def heatmap_metadata(source: DataFrame, points: DataFrame) -> DataFrame:
    """Rows before the point filter, points returned and their extent."""
    rows = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    return points.agg(
        F.count(F.lit(1)).alias("returned_points"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    ).withColumn("row_count", rows)


def stage_counts(raw: DataFrame, cleaned: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows per stage, distinct cities and the sorted industries of the result."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return processed.agg(
        F.count(F.lit(1)).alias("processed_rows"),
        F.count_distinct("city").alias("cities"),
        F.array_join(F.array_sort(F.collect_set("industry_type")), ",").alias("industries"),
    ).withColumns({"raw_rows": count(raw), "cleaned_rows": count(cleaned)})


def site_impact_view(dataset: DataFrame) -> DataFrame:
    """Mean target and particulate values per factory; rows with a NULL key column are left out."""
    keys = ["factory_id", "factory_name", "industry_type", "latitude", "longitude", "city", "state", "country"]
    complete = dataset.dropna(subset=keys)
    return complete.groupBy(*keys).agg(
        F.avg("pollution_impact_score").alias("pollution_impact_score"),
        F.avg("pm25").alias("latest_pm25"),
        F.avg("pm10").alias("latest_pm10"),
    )


def quantile_bins(df: DataFrame, column: str, name: str = "bin", parts: int = 5) -> DataFrame:
    """Right-closed quantile bins 0..parts-1; equal edges are merged; NULL stays NULL."""
    inner = [i / parts for i in range(1, parts)]
    known = attach(df, _one(exact_quantiles(df, [column], [0.0, *inner]), parts), "_edges")
    edges = [F.col(f"_edges.q{i}") for i in range(parts)]
    # An edge equal to the one before it is merged away.
    above = [((edges[i] > edges[i - 1]) & (F.col(column) > edges[i])).cast("int") for i in range(1, parts)]
    number = total(above)
    return known.withColumn(name, F.when(F.col(column).isNotNull(), number)).drop("_edges")


def time_split(df: DataFrame, index: str = "time_index", held_out: int = 6) -> DataFrame:
    """Adds ``split``: the last ``held_out`` steps of the whole table are validation."""
    last = scalars(df.agg(F.max(index).alias("last")))["last"]
    return df.withColumn("split", F.when(F.col(index) <= last - held_out, F.lit("train")).otherwise(F.lit("val")))


def dataset_info(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


