"""Every operator and stage on NULLs, empty and long texts, repeats, empty tables and clashing extra columns."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stackplume.llm import (
    chunk_dedup, decontaminate, fm_quality, html_extract, mixing, quality_rules, secrets_scan, simhash, suffix_dedup, toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 5000}" for i in range(20_000))
ROWS = [
    (1, "plain words in a short text, nothing special about it at all today", "en", "a", 66),
    (1, "plain words in a short text, nothing special about it at all today", "en", "a", 66),
    (2, "plain words in a short text, nothing special about it at all today", "en", "a", 66),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", None, 4),
    (None, "a text without an id, token = 'abcdef0123456789abcdef0123456789'", None, "b", None),
    (6, LONG, "en", "c", len(LONG)),
    (7, "é🙂 " * 300, "fr", "c", 900),
]
CLASHING = ["score", "predicted", "_print", "_row", "_text", "_spans", "_items", "_hex", "core", "k", "size", "_order", "print"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 8)] + [(None, 1, 1), (2, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "nothing special about it"), (2, None), (None, "plain words"), (3, "!!"), (4, "word1 word2")], "item_id long, text string")


def applied(name, documents, labels, benchmark):
    if name == "toxicity":
        return toxicity.score(documents, toxicity.train(documents, labels))
    if name == "rules":
        return quality_rules.apply_rules(documents, labels)
    if name == "suffixes":
        return suffix_dedup.remove_repeats(documents)
    if name == "decontamination":
        return decontaminate.digest(decontaminate.find_contamination(documents, benchmark))
    if name == "cut":
        return decontaminate.remove_spans(decontaminate.find_contamination(documents, benchmark))
    if name == "simhash":
        return simhash.near_duplicates(documents)
    if name == "classifier":
        return fm_quality.score(documents, fm_quality.train(documents, labels))
    if name == "secrets":
        return secrets_scan.digest(secrets_scan.scan(documents, secrets_scan.train(documents, labels)))
    if name == "redact":
        return secrets_scan.redact(secrets_scan.scan(documents, secrets_scan.train(documents, labels)))
    if name == "chunks":
        return chunk_dedup.dedupe(documents)
    return mixing.mix(documents)


NAMES = ["toxicity", "rules", "suffixes", "decontamination", "cut", "simhash", "classifier", "secrets", "redact", "chunks", "mix"]


def printed(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_rows(docs, clashing, none, labels, benchmark, name):
    """One row for each row, extra columns do not matter, equal rows get equal results, empty tables stay empty."""
    found = applied(name, docs, labels, benchmark)
    rows = found.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    first, second = (r for r in rows if r["doc_id"] == 1)
    assert first == second or name == "mix"
    again = applied(name, clashing, labels, benchmark).select(*found.columns).collect()
    assert printed(rows) == printed(again)
    assert applied(name, none, labels.limit(0), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, clashing, none, labels, benchmark, tmp_path, stage):
    folder = str(tmp_path / uuid.uuid4().hex)
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    function = dict(corpus_pipeline.STAGES)[stage]
    last = stage == corpus_pipeline.STAGES[-1][0]
    found = function(spark, clashing, folder)
    assert last or found.columns == corpus_pipeline.COLUMNS
    assert found.count() >= 1
    assert function(spark, none, folder).count() == 0


def test_near_duplicates_keep_exactly_one(docs, clashing):
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    assert {r["_row"] for r in kept.select("_row").collect()} == {"x"}
    assert kept.count() == simhash.near_duplicates(docs).select("component_id").distinct().count()


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, paths string"
    rows = [
        (1, "http://a.example/1", "<html><body><nav>menu</nav><article><h1>T</h1><p>One,\n two.</p><p>A &amp; B</p></article><footer>f</footer>", "x", "y"),
        (1, "http://a.example/1", "<html><body><nav>menu</nav><article><h1>T</h1><p>One,\n two.</p><p>A &amp; B</p></article><footer>f</footer>", "x", "y"),
        (2, None, None, None, None),
        (3, "no url", "", "x", None),
        (None, "http://a.example/2", "just text <b", "x", None),
        (4, "http://b.example", "<p>loose <i>text</i></p>" * 3000, "x", None),
    ]
    found = html_extract.extract(spark.createDataFrame(rows, schema))
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    assert by_id[1] == [("T One, two. A & B", 17)] * 2
    assert by_id[2] == [("", 0)] and by_id[3] == [("", 0)]
    assert by_id[None] == [("just text", 9)]
    assert by_id[4] == [(" ".join(["loose text"] * 3000), 11 * 3000 - 1)]
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


def test_defined_results(docs, labels, benchmark):
    empty = hashlib.sha256(b"").hexdigest()
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    rules = by_id(quality_rules.apply_rules(docs, labels))
    assert rules[3]["n_words"] == rules[4]["n_words"] == rules[5]["n_words"] == 0 and rules[3]["base_failed"]
    prints = by_id(simhash.near_duplicates(docs))
    assert prints[3]["fingerprint"] == "0" * 16 and {prints[i]["component_id"] for i in (3, 4, 5)} == {3}
    assert prints[2]["component_id"] == 1 and prints[None]["component_id"] is None
    cut = by_id(suffix_dedup.remove_repeats(docs))
    assert (cut[3]["n_bytes"], cut[3]["kept_sha256"]) == (0, empty)
    assert cut[7]["n_removed"] == cut[7]["n_bytes"]
    hits = by_id(decontaminate.digest(decontaminate.find_contamination(docs, benchmark)))
    assert (hits[1]["n_hit"], hits[1]["n_items"]) == (4, 1) and hits[3]["items_sha256"] == empty
    assert hits[6]["n_hit"] == 8
    mixed = by_id(mixing.mix(docs))
    assert mixed[3]["size"] == mixed[5]["taken"] == 0
