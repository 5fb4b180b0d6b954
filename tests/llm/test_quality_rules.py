"""Cutoffs of the quality rules learn from every labelled row."""

from pyspark.sql import functions as F

from stackplume.llm import quality_rules
from stackplume.llm.common import held_out


def test_cutoffs_are_certified_on_all_labelled_rows(spark, monkeypatch):
    """More good rows than the 40,000 that the holdout once had; texts repeat, so that measuring them is cheap."""
    seen = {}

    def spied(measured, *settings):
        seen["rows"] = measured.groupBy("y").count().collect()
        return certified(measured, *settings)

    certified = quality_rules.certified_cutoffs
    monkeypatch.setattr(quality_rules, "certified_cutoffs", spied)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a few plain words, eleven or so, and no rule minds them").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 57_000, 1).otherwise(0).alias("quality"))
    learned = {r["quality"]: r["count"] for r in labels.where(~held_out()).groupBy("quality").count().collect()}
    assert learned[1] > 40_000
    quality_rules.apply_rules(docs, labels)
    assert {r["y"]: r["count"] for r in seen["rows"]} == learned


NAMES = (
    "doc_id long, y int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_capitals long, n_lone_marks long"
)


def planted(per_rule: int, good: int = 12_000, bad: int = 400) -> tuple[list[tuple], list[tuple]]:
    """Good rows of which every rule's measure is high in its own ``per_rule`` of a thousand, and bad rows high in one each.

    Rows are (doc_id, y, base measures); of 100 words and 1 000 characters, the high values are 19 of what is counted.
    """
    places = (4, 5, 6, 3, 8, 9)

    def row(doc_id: int, y: int, high: int | None) -> tuple:
        values = [doc_id, y, 100, 1000, 0, 0, 0, 100, 0, 0]
        if high is not None:
            values[places[high]] += 19 if high != 4 else 190
        return tuple(values)

    rule_of = lambda i: i % 1000 // per_rule if i % 1000 < 6 * per_rule else None
    return [row(i, 1, rule_of(i)) for i in range(good)], [row(good + i, 0, i % 6) for i in range(bad)]


def turned_away(rows: list[tuple], cutoffs: list) -> float:
    names = [c.split()[0] for c in NAMES.split(", ")]
    reads = {
        "symbols_per_word": lambda r: r["n_symbols"] / r["n_words"], "repeated_lines": lambda r: r["n_dup_lines"] / r["n_lines"],
        "repeated_words": lambda r: r["n_repeat_words"] / r["n_words"], "word_length": lambda r: r["word_chars"] / r["n_words"],
        "capitals": lambda r: r["n_capitals"] / r["word_chars"], "lone_marks": lambda r: r["n_lone_marks"] / r["n_words"],
    }
    records = [dict(zip(names, r)) for r in rows]
    return sum(any(reads[c["rule"]](r) > c["cutoff"] for c in cutoffs) for r in records) / len(records)


def test_all_rules_together_keep_the_risk(spark):
    """Each rule alone turns away 0.4 % of the good rows, all six 2.4 %: as many are taken as 1 % allows."""
    good, bad = planted(per_rule=4)
    cutoffs = quality_rules.certified_cutoffs(spark.createDataFrame(good + bad, NAMES)).collect()
    assert {c["stratum"] for c in cutoffs} == {"middle"} and 1 <= len(cutoffs) <= 2
    assert turned_away(good, cutoffs) <= 0.01 and turned_away(bad, cutoffs) >= 1 / 7


def test_rules_add_up_where_the_risk_allows(spark):
    good, bad = planted(per_rule=1, good=12_000)
    cutoffs = quality_rules.certified_cutoffs(spark.createDataFrame(good + bad, NAMES)).collect()
    assert len(cutoffs) == 6 and turned_away(good, cutoffs) <= 0.01 and turned_away(bad, cutoffs) == 1
