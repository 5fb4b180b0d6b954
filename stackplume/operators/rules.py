"""Control actions from risk scores.

The rule table is a fixed few dozen rows, so it becomes one array of conditional literals: a narrow pass over the
sites, no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackplume import constants as C
from stackplume.functions.numeric import lookup, total
from stackplume.operators.windows import first_per_key

ACTION_FIELDS = ["category", "priority", "action", "pollutant", "estimated_reduction", "cost_category", "timeline"]
HIGH_SCORE = 6


def priority_rank(priority) -> Column:
    p = F.col(priority) if isinstance(priority, str) else priority
    return F.when(p == "Immediate", 0).when(p == "Short-term", 1).when(p == "Long-term", 2).otherwise(3)


def flags() -> dict[str, Column]:
    """Whether each rule condition holds for a scored site; a missing score holds none."""
    def high(name: str) -> Column:
        return F.coalesce(F.col(name) > HIGH_SCORE, F.lit(False))

    held = {p: high(f"{p}_score") for p in C.SCORED_POLLUTANTS}
    several = total([f.cast("int") for f in held.values()]) > 1
    group = lookup(C.INDUSTRY_RULE_GROUPS, F.lower(F.coalesce("industry_type", F.lit(""))), "other")
    held["pm"] = held["pm25"] | held["pm10"]
    held["multiple"] = several | high("composite_score")
    for condition in {row[0] for row in C.RULES if ":" in row[0]}:
        kind, name = condition.split(":")
        held[condition] = F.col("risk_level") == name if kind == "level" else group == name
    return held


def _weight_order(row: tuple) -> tuple:
    rank = {"Immediate": 0, "Short-term": 1, "Long-term": 2}.get(row[2], 3)
    return (-C.RULE_WEIGHT * (10 - rank), rank, row[3])


def rule_actions(ranked: bool = False) -> Column:
    """Array of the rule actions that apply, in rule order or in rank order."""
    held = flags()
    rows = sorted(C.RULES, key=_weight_order) if ranked else C.RULES
    return F.array_compact(
        F.array(*[
            F.when(held[row[0]], F.struct(*[F.lit(v).alias(n) for n, v in zip(C.RULE_COLUMNS[1:], row[1:])])) for row in rows
        ])
    )


def learned_actions(categories: Column, dominant: Column) -> Column:
    """Array of actions for learned category names."""
    def action(category: Column) -> Column:
        return F.struct(
            F.lit("ML Suggested").alias("category"),
            F.lit("Short-term").alias("priority"),
            F.concat(F.lit("Apply data-driven intervention plan for category: "), category).alias("action"),
            dominant.alias("pollutant"),
            F.lit("Data-driven estimate pending site audit").alias("estimated_reduction"),
            F.lit("Medium").alias("cost_category"),
            F.lit("2-6 months").alias("timeline"),
        )

    names = F.array_sort(F.array_distinct(F.coalesce(categories, F.array().cast("array<string>"))))
    return F.transform(names, action)


def merged_actions(categories: Column | None = None) -> Column:
    """Rule actions and learned actions of a scored site by weight, then priority, then text, each once.

    The lowest rule weight (0.7 * 7) is above the highest learned weight (0.3 * 10), so the learned actions follow the
    ranked rules; the rule table holds no action twice.
    """
    ranked = rule_actions(ranked=True)
    if categories is None:
        return ranked
    return F.concat(ranked, learned_actions(categories, F.col("dominant_pollutant")))


def merge_rank(actions: DataFrame) -> DataFrame:
    """Rank of every action row of a site.  ``actions`` has ``origin`` (rule or learned) beside the action fields."""
    rank = priority_rank("priority")
    weight = F.when(F.col("origin") == "rule", F.lit(C.RULE_WEIGHT)).otherwise(F.lit(C.LEARNED_WEIGHT)) * (10 - rank)
    order = Window.partitionBy("factory_id").orderBy(F.col("weight").desc(), "priority_rank", "action")
    # A site has at most one row per rule and learned label.
    return actions.withColumns({"weight": weight, "priority_rank": rank}).withColumn("position", F.row_number().over(order))


def apply_rules(scored: DataFrame) -> DataFrame:
    """One row per site and triggered action."""
    return scored.select("factory_id", F.explode(rule_actions()).alias("r")).select(
        "factory_id", *[F.col(f"r.{f}").alias(f) for f in ACTION_FIELDS]
    )


def dedupe_actions(actions: DataFrame, order: list) -> DataFrame:
    return first_per_key(actions, ["factory_id", "category", "priority", "action"], order)


def action_labels() -> Column:
    """Action families a scored site needs, joined by a bar: the training label of the action recommender."""
    held = flags()
    pairs = [
        ("so2", "SO2_Control"), ("pm", "PM_Control"), ("no2", "NOx_Control"), ("co", "CO_Control"),
        ("o3", "O3_Control"), ("multiple", "Audit"),
    ]
    return F.array_join(
        F.array_compact(F.array(*[F.when(held[c], F.lit(label)) for c, label in pairs])), "|"
    )


def split_labels(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """0/1 column per label of a bar-separated text."""
    parts = F.split(F.coalesce(F.col(column), F.lit("")), r"\|")
    return df.withColumns({f"label_{name}": F.array_contains(parts, name).cast("int") for name in labels})
