"""Secret scan: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two first-order Markov models over characters are trained: one on values that the fixed patterns found in labelled rows
(random strings), one on the other long words of these rows (ordinary identifiers).  A candidate, a long run of the
characters that keys are made of, is a secret when the log-likelihood ratio of the two models per transition is large
enough and its characters vary.  Everything is DataFrame expressions; positions are code points.

An expression splits a text at its matches; the lengths of the pieces between and of the matches add up to positions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackplume.llm.common import free_name, labelled_texts, training_labels, whole_text

# The patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: What the method looks at: long runs of key characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of the models; all others, and the ends of a string, count as one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1


def _zipped(**arrays: Column) -> Column:
    """Array of structs of the elements of several arrays; the first is the longest."""
    names = list(arrays)
    return F.transform(
        F.arrays_zip(*arrays.values()),
        lambda x: F.struct(*[x[str(i)].alias(name) for i, name in enumerate(names)]),
    )


def _matches(text: Column, pattern: str, least: int, value: Column | None = None) -> Column:
    """Array of (start, end) of the leftmost matches that do not overlap and have ``least`` characters.

    ``value``: the strings whose length counts, in the order of the matches; the matches themselves if not given.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = _zipped(gap=between, hit=found, value=found if value is None else value)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ok:boolean>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(x["gap"])
        end = first + F.coalesce(F.length(x["hit"]), F.lit(0))
        ok = F.coalesce(F.length(x["value"]) >= least, F.lit(False))
        span = F.struct(first.cast("int").alias("start"), end.cast("int").alias("end"), ok.alias("ok"))
        return F.struct(end.cast("int").alias("at"), F.when(ok, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(zipped, start, add)["spans"]
    nothing = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    # Most texts have no match at all, which one search tells.
    return F.when(text.rlike(pattern), spans).otherwise(nothing)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds of a text without NULL."""
    # For a run of one class the leftmost whole runs of at least that length are the same with the length in the pattern.
    return {
        "assign": _matches(text, ASSIGN, LEAST["assign"], F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))),
        "access": _matches(text, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", LEAST["access"]),
        "hex": _matches(text, f"[0-9a-f]{{{LEAST['hex']},}}", LEAST["hex"]),
    }


def _transitions(word: Column) -> Column:
    """Numbers of the character pairs of a word: row by the first, column by the second character, from 0."""
    characters = F.filter(F.split(word, ""), lambda c: c != "")
    # instr is 0 for a character that is not in the alphabet, which makes 0 the state of all others.
    states = F.transform(characters, lambda c: F.instr(F.lit(ALPHABET), c))
    fewer = F.greatest(F.size(states) - 1, F.lit(0))
    return F.zip_with(F.slice(states, 1, fewer), F.slice(states, 2, fewer), lambda a, b: a * STATES + b)


def train(documents: DataFrame, labels: DataFrame, per_class: int = 2000, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of the STATES * STATES character pairs, by number.

    The training text is that of at most ``per_class`` labelled rows of each class.  In it the values found by the base
    patterns, and digests in base 64, are labelled random, and words of eight or more letters, digits and marks outside of them ordinary.
    Without any training row every ratio is 0, and the method adds nothing.
    """
    sample = training_labels(labels, "quality", per_class)
    texts = labelled_texts(documents, sample).select(whole_text().alias("text"))
    text = F.col("text")
    secret = F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 20),
        F.regexp_extract_all(text, F.lit(r"AKIA[A-Z0-9]{16,}"), F.lit(0)),
        F.regexp_extract_all(text, F.lit(r"[0-9a-f]{24,}"), F.lit(0)),
        F.array(F.base64(F.unhex(F.sha2(text.cast("binary"), 256)))),
    )
    without = F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", " ")
    words = F.regexp_extract_all(without, F.lit(r"[A-Za-z0-9_-]{8,}"), F.lit(0))
    labelled = F.array(
        F.struct(F.lit(1).alias("random"), secret.alias("found")), F.struct(F.lit(0).alias("random"), words.alias("found"))
    )
    strings = texts.select(F.explode(labelled).alias("s")).select("s.random", F.explode("s.found").alias("word"))
    pairs = strings.select("random", F.explode(_transitions(F.col("word"))).alias("pair"))
    counts = pairs.groupBy("pair").agg(
        F.sum("random").cast("double").alias("random"), F.sum(1 - F.col("random")).cast("double").alias("plain")
    ).withColumn("before", F.floor(F.col("pair") / STATES))
    totals = counts.groupBy("before").agg(F.sum("random").alias("all_random"), F.sum("plain").alias("all_plain"))

    def share(of: str, whole: str) -> Column:
        return (F.col(of) + smoothing) / (F.col(whole) + smoothing * STATES)

    ratio = F.log(share("random", "all_random")) - F.log(share("plain", "all_plain"))
    rated = counts.join(totals, "before").select("pair", ratio.alias("ratio"))
    ratios = [0.0] * (STATES * STATES)
    for row in rated.collect():
        ratios[row["pair"]] = round(row["ratio"], 6)
    return ratios


def random_spans(text: Column, ratios: list[float], least_ratio: float, least_kinds: int = 8) -> Column:
    """Candidates whose mean log-likelihood ratio per transition is at least ``least_ratio``.

    A pair that was never seen says nothing.  At least ``least_kinds`` different characters and one digit are asked for.
    """
    between = F.split(text, CANDIDATE, -1)
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ok:boolean>>").alias("spans"))

    def looks_random(word: Column) -> Column:
        pairs = _transitions(word)
        total = F.aggregate(pairs, F.lit(0.0), lambda sum_, pair: sum_ + F.coalesce(F.get(model, pair), F.lit(0.0)))
        varied = F.size(F.array_distinct(F.split(word, ""))) >= least_kinds
        return word.isNotNull() & varied & word.rlike("[0-9]") & (total >= least_ratio * F.size(pairs))

    def add(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(x["gap"])
        end = first + F.coalesce(F.length(x["hit"]), F.lit(0))
        ok = F.coalesce(looks_random(x["hit"]), F.lit(False))
        span = F.struct(first.cast("int").alias("start"), end.cast("int").alias("end"), ok.alias("ok"))
        return F.struct(end.cast("int").alias("at"), F.when(ok, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(_zipped(gap=between, hit=found), start, add)["spans"]
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast("array<struct<start:int,end:int,ok:boolean>>"))


def scan(documents: DataFrame, model: list[float], least_ratio: float = 0.5) -> DataFrame:
    """All columns of ``documents`` with _base_spans and _spans: arrays of (start, kind, end), by start and kind.

    Kinds are numbered as in KINDS.  A random string that a base span overlaps is not added.  NULL texts count as
    empty and have no spans; repeated rows get equal spans; an empty table gives no rows; columns with these
    names are replaced.
    """
    kept = documents.drop("_spans", "_base_spans")
    names = {kind: free_name(kept, f"_{kind}") for kind in ("text", *KINDS, "base", "added")}
    text = F.col(names["text"])
    rows = kept.withColumn(names["text"], whole_text())
    based = rows.withColumns({
        **{names[kind]: spans for kind, spans in base_spans(text).items()},
        names["random"]: random_spans(text, model, least_ratio),
    })

    def listed(kind: str) -> Column:
        number = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(names[kind], lambda s: F.struct(s["start"].alias("start"), number, s["end"].alias("end")))

    base = F.concat(*[listed(kind) for kind in KINDS if kind != "random"])
    overlaps = lambda r, b: (b["start"] < r["end"]) & (r["start"] < b["end"])
    more = based.withColumn(names["base"], base)
    more = more.withColumn(
        names["added"], F.filter(listed("random"), lambda r: ~F.exists(names["base"], lambda b: overlaps(r, b)))
    )
    every = F.concat(names["base"], names["added"])
    return more.select(*kept.columns, F.array_sort(names["base"]).alias("_base_spans"), F.array_sort(every).alias("_spans"))


def _printed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, the number of spans per base kind, the digest of the base spans, and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("_base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")

    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_printed("_base_spans").cast("binary"), 256).alias("base_sha256"), _printed("_spans").alias("spans"),
    )


def redact(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The columns of the scanned documents, with every span replaced by ``mark``; overlapping spans by one."""
    names = [c for c in scanned.columns if c not in ("_spans", "_base_spans")]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def cut(text: Column):
        def add(state: Column, s: Column) -> Column:
            before = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
            piece = F.when(s["start"] >= state["at"], F.concat(before, F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["done"], piece).alias("done"))

        return add

    done = free_name(scanned, "_cut")
    redone = scanned.withColumn(done, F.aggregate("_spans", start, cut(F.col("text"))))
    rest = F.expr(f"substring(text, `{done}`.at + 1)")
    text = F.when(F.size("_spans") == 0, F.col("text")).otherwise(F.concat(F.col(f"{done}.done"), rest))
    return redone.withColumn("text", text).select(*names)
