"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Every rule has a measure that is large for bad texts and a grid of cutoffs, one for each level.  On labelled holdout
rows, per stratum, rules are taken together: at each level those that catch bad texts form a sequence, the best first,
and each of its beginnings is a set of cutoffs.  A set is certified when the exact binomial tail rejects the hypothesis
that it turns away more than ``risk`` of the good texts: with k of n good texts above any of its cutoffs,
P(Binomial(n, risk) <= k) must be at most the error level.  The error level ``delta`` is shared evenly among all strata,
levels and beginnings (Bonferroni), so with probability 1 - delta the verdict of no stratum breaks its risk.  A stratum
without a certified set has no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackplume.llm.common import all_training_labels, materialise, whole_text

#: Measures (large is bad) by name, over the base columns.
MEASURES: dict[str, str] = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "lone_marks": "n_lone_marks / greatest(n_words, 1)",
}
#: Cutoffs are taken at these shares of the good texts in the first half of the holdout.
GRID = (0.5, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 1.0)

WORD_CLASS = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value found once per row, however often it is used.

    Inside a function over an array the outer expressions are found again for every element; a variable is not.
    """
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column, window: int = 5) -> Column:
    """Words that lie in a window of ``window`` words found at least twice among ``words``."""

    def covered(w: Column, n: Column) -> Column:
        starts = F.sequence(F.lit(1), n - (window - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(window)]))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered_by_repeats(h, window)))

    return _let(words, lambda w: _let(F.size(w), lambda n: F.when(n < window + 1, F.lit(0)).otherwise(covered(w, n))))


def _covered_by_repeats(hashes: Column, window: int) -> Column:
    """Positions covered by the windows whose hash is not unique.

    Windows sorted by (hash, position) stand next to their equals; their positions, sorted again, each add what the
    next one leaves uncovered.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        equal_before = lambda x, j: F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False))
        equal_after = lambda x, j: F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))
        marked = F.filter(p, lambda x, j: equal_before(x, j) | equal_after(x, j))
        return F.array_sort(F.transform(marked, lambda x: x["i"]))

    def summed(at: Column) -> Column:
        gaps = F.transform(at, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - x, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    return _let(_let(placed, repeated), summed)


def _duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_measures(documents: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the counts of every whole text; NULL counts as the empty text."""
    text = F.col("_text")
    words = F.filter(F.split(text, WORD_CLASS, -1), lambda w: w != "")
    blanks = F.col("_n_chars") - F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))
    rows = documents.select(*keep, whole_text().alias("_text"))
    rows = rows.select(
        *keep,
        text,
        F.length(text).cast("bigint").alias("_n_chars"),
        words.alias("_words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        _duplicate_lines(text).cast("bigint").alias("n_dup_lines"),
    )
    return rows.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        blanks.cast("bigint").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        _repeat_words(F.col("_words")).cast("bigint").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"[^\n]+")).cast("bigint").alias("n_lines"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("bigint").alias("n_capitals"),
        F.size(F.filter("_words", lambda w: (F.length(w) == 1) & w.rlike(r"[^\w]"))).cast("bigint").alias("n_lone_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum() -> Column:
    """Short, middle and long texts; a good cutoff for one need not be good for another."""
    return F.when(F.col("n_words") < 100, "short").when(F.col("n_words") < 1000, "middle").otherwise("long")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly from the term of k downwards in logarithms.

    ln C(n, k) is the sum of its k logarithms; every further term follows from the last one.
    """
    odds = F.lit((1.0 - p) / p)
    log_choose = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))),
        F.lit(0.0),
        lambda total, i: total + F.when(i <= k, F.log((n - k + i) / i)).otherwise(0.0),
    )
    top = log_choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        # From term i to term i - 1: times i / (n - i + 1) * (1 - p) / p.
        term = F.when(i > 0, state["term"] * i / (n - i + 1) * odds).otherwise(0.0)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    downwards = F.sequence(k, F.lit(0).cast("bigint"))
    return F.when(k >= n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * F.aggregate(downwards, start, add)["sum"]))


def certified_cutoffs(measured: DataFrame, risk: float = 0.01, delta: float = 0.05, least_gain: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff: a set of cutoffs for every stratum that has one certified as a whole.

    ``measured`` has doc_id, y (1 good, 0 bad) and the base measures.  One half of the good rows (by a hash of the id)
    proposes the cutoffs and the other half tests them; bad rows order the rules, so the test is not biased.  Rows that
    the base rules turn away are not counted, since they never reach these rules.  Of the certified sets that turn away
    95 % as many bad rows as the best one, the laxest level and there the fewest rules are taken; a rule that catches
    less than ``least_gain`` of the bad rows is in no set.
    """
    names = list(MEASURES)
    proposes = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    rows = measured.where(~base_failed()).select(
        stratum().alias("stratum"),
        F.when(F.col("y") == 0, "bad").when(proposes, "proposes").otherwise("tests").alias("role"),
        F.array(*[F.expr(m).cast("double") for m in MEASURES.values()]).alias("values"),
    )
    shares = f"array({', '.join(map(str, GRID))})"
    proposed = rows.where("role = 'proposes'").groupBy("stratum").agg(
        F.array(*[F.expr(f"percentile_approx(values[{i}], {shares}, 10000)") for i in range(len(names))]).alias("cutoffs")
    )
    levels = proposed.select("stratum", "cutoffs", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("level")).select(
        "stratum", "level", F.transform("cutoffs", lambda of_rule: F.get(of_rule, F.col("level"))).alias("cutoffs")
    )
    # A row for each stratum and level: at most three times the length of the grid.
    caught = rows.where("role = 'bad'").join(F.broadcast(levels), "stratum").groupBy("stratum", "level").agg(
        F.first("cutoffs").alias("cutoffs"),
        F.array(*[F.avg((F.col("values")[i] > F.col("cutoffs")[i]).cast("double")) for i in range(len(names))]).alias("shares"),
    )
    ordered = F.array_sort(F.transform("cutoffs", lambda c, i: F.struct((-F.get("shares", i)).alias("share"), i.alias("rule"), c.alias("cutoff"))))
    sets = materialise(
        caught.select("stratum", "level", F.filter(ordered, lambda x: x["share"] <= -least_gain).alias("rules")).where("size(rules) > 0")
    )
    hits = F.transform("rules", lambda x, place: F.when(F.get("values", x["rule"]) > x["cutoff"], place + 1))
    # The first rule of the sequence that turns a row away tells which of its beginnings do.
    counted = (
        rows.where("role <> 'proposes'").join(F.broadcast(sets), "stratum")
        .select("stratum", "level", "role", F.size("rules").alias("rules"), F.array_min(hits).alias("first"))
        .groupBy("stratum", "level", "rules", "first")
        .agg(F.count_if(F.col("role") == "tests").alias("good"), F.count_if(F.col("role") == "bad").alias("bad"))
    )
    within = F.coalesce(F.col("first") <= F.col("taken"), F.lit(False))
    tested = (
        counted.withColumn("taken", F.explode(F.sequence(F.lit(1), "rules"))).groupBy("stratum", "level", "taken")
        .agg(
            F.sum("good").alias("n"), F.sum(F.when(within, F.col("good")).otherwise(0)).alias("k"),
            (F.sum(F.when(within, F.col("bad")).otherwise(0)) / F.sum("bad")).alias("caught"),
        )
    )
    tests = len(GRID) * len(MEASURES) * 3
    # From the mean upwards the tail is far above any error level, and its sum would only be long.
    certified = tested.where((F.col("k") < risk * F.col("n")) & (binomial_tail(F.col("k"), F.col("n"), risk) <= delta / tests))
    best = certified.groupBy("stratum").agg(F.max("caught").alias("best"))
    taken = certified.join(best, "stratum").where("caught >= 0.95 * best").groupBy("stratum").agg(
        F.max(F.struct("level", (-F.col("taken")).alias("less"))).alias("set")
    )
    return (
        taken.select("stratum", "set.level", (-F.col("set.less")).alias("taken")).join(sets, ["stratum", "level"])
        .select("stratum", F.explode(F.slice("rules", F.lit(1), F.col("taken"))).alias("r"))
        .select("stratum", F.element_at(F.array(*map(F.lit, names)), F.col("r.rule") + 1).alias("rule"), "r.cutoff")
    )


def apply_rules(documents: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the names of the failed rules of every row of ``documents``.

    NULL and empty texts count nothing and fail the base rule; repeated rows are judged alike; a NULL doc_id is judged
    but never learned from; an empty table gives no rows, and without labels only the base rules judge.  Other columns
    are ignored.  The holdout is all labelled rows that training may see, joined to the documents' measures by id.
    ``risk`` holds for all rules together in each stratum.
    """
    judged = materialise(base_measures(documents, "doc_id"))
    measured = materialise(judged.join(all_training_labels(labels, "quality"), "doc_id"))
    cutoffs = materialise(certified_cutoffs(measured, risk, delta))
    # At most one number for each rule and stratum, so they are written into the plan.
    bounds: dict[str, dict[str, float]] = {name: {} for name in MEASURES}
    for row in cutoffs.collect():
        bounds[row["rule"]][row["stratum"]] = row["cutoff"]
    checks = []
    for name, of_stratum in bounds.items():
        above = F.lit(False)
        for where, cutoff in sorted(of_stratum.items()):
            above = above | ((stratum() == where) & (F.expr(MEASURES[name]).cast("double") > cutoff))
        checks.append(F.when(above, F.lit(name)))
    failed = F.filter(F.array(*checks), lambda name: name.isNotNull())
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (F.size(failed) == 0)).alias("kept"),
        F.when(base_failed(), F.array().cast("array<string>")).otherwise(failed).alias("failed_rules"),
    )
