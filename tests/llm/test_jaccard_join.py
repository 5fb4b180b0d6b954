import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackplume.llm import jaccard_join
from stackplume.llm.common import table

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").encode().lower().split()
    size = min(4, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_force(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, tokens in enumerate(sets):
        shared = Counter(j for t in tokens for j in holders[t])
        for j, n in shared.items():
            if 100 * n >= 85 * (len(tokens) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for t in tokens:
            holders[t].append(i)
    lowest = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            lowest[root(i)] = min(lowest.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), lowest.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def edited():
    """Groups of copies edited here and there at all sizes, and short texts that share most of their words."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words * 20)]
    for _ in range(15):
        base = [draw.choice(words) for _ in range(draw.choice([7, 9, 12, 15, 20, 40, 80, 200, 500]))]
        for _ in range(15):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 6])):
                at = draw.randrange(len(copy))
                if draw.random() < 0.4 and len(copy) > 3:
                    copy.pop(at)
                else:
                    copy.insert(at, draw.choice(words))
            texts.append(" ".join(copy))
    line = " ".join(draw.choice(words) for _ in range(12))
    texts += [line + "".join(f" u{i}_{k}" for k in range(draw.choice([1, 2, 2, 3, 8]))) for i in range(150)]
    return list(enumerate(texts, 10))


def test_edited_copies(spark, edited):
    odd = [(None, "a b c"), (1, "A b c"), (2, None), (3, ""), (3, " "), (4, "a"), (4, "a"), (5, "a")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in odd + edited], f"{SCHEMA}, vertex long, n long").repartition(3)
    assert got(jaccard_join.similar_documents(frame)) == brute_force(odd + edited)


def test_allocated_look_ups_alone_find_every_link(spark, edited, monkeypatch):
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    assert got(jaccard_join.similar_documents(spark.createDataFrame(edited, SCHEMA))) == brute_force(edited)


def test_whole_table(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(jaccard_join.similar_documents(documents)) == brute_force(docs)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "a b"), (2, "c")]])
def test_nothing_to_link(spark, docs):
    assert got(jaccard_join.similar_documents(spark.createDataFrame(docs, SCHEMA))) == brute_force(docs)


def test_neighbourhoods_alone_find_every_link(spark, edited, monkeypatch):
    """Every band asks for one-deletion neighbourhoods, and no neighbours in shuffled orders are compared before."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "DEAR", -1.0)
    plan = jaccard_join._planned
    monkeypatch.setattr(jaccard_join, "_planned", lambda nodes, percent: plan(nodes, percent).withColumn("bare", F.lit(True)).withColumn("dear", F.lit(True)))
    assert got(jaccard_join.similar_documents(spark.createDataFrame(edited, SCHEMA))) == brute_force(edited)


def test_all_tokens_in_one_segment(spark):
    """Subsets agree in empty segments only; the link is one deletion away."""
    band = jaccard_join.band_of(7)
    for start in range(5000):
        words = [f"q{start}x{i}" for i in range(10)]
        if len(set(jaccard_join.subset_hashes(jaccard_join.shingles(" ".join(words)), band)[3])) == 1:
            break
    docs = [(1, " ".join(words)), (2, " ".join(words[:9])), (3, "other words that are not alike at all in any way")]
    assert brute_force(docs)[1] == (2, 6, 1)
    assert got(jaccard_join.similar_documents(spark.createDataFrame(docs, SCHEMA))) == brute_force(docs)


def test_pairs_at_the_bound_agree_in_all_but_their_budget():
    """The pigeonhole itself, in the band of the smaller set."""
    draw = np.random.default_rng(2)
    for size in [7, 8, 13, 20, 57, 150, 700]:
        for _ in range(30):
            larger = draw.integers(0, 1 << 63, size, np.uint64) << np.uint64(1)
            smaller = larger[: -(-85 * size // 100)]
            band = jaccard_join.band_of(len(smaller))
            one, other = (jaccard_join.subset_hashes(x, band)[2] for x in (larger, smaller))
            budget = min(jaccard_join.budget_in(len(x), band) for x in (larger, smaller))
            assert 0 < budget and (one == other).sum() >= len(one) - budget > jaccard_join.SPARE


def test_allocation_is_worth_what_is_needed_and_the_cheapest():
    draw = np.random.default_rng(3)
    for _ in range(200):
        count = int(draw.integers(1, 6))
        first, second = draw.integers(0, 9, count), draw.integers(0, 9, count)
        needed = int(draw.integers(1, 2 * count + 1))
        worth = jaccard_join.allocate(first, second, needed)
        assert worth.sum() == needed and worth.max() <= 2


def test_neighbourhoods_are_indexed_where_they_save_much(spark):
    """A row of a neighbourhood costs what many met rows do, since those are dropped in the join."""
    rows = [(1, 5, 500, True, False), (2, 5, 20_000, True, False), (3, 5, 0, False, True), (4, 5, 20_000, False, False)]
    plans = spark.createDataFrame([(b, n * 100, cost, dear, bare, True) for b, n, cost, dear, bare in rows], "band long, n long, cost long, dear boolean, bare boolean, own boolean")
    assert sorted(r.band for r in jaccard_join.neighbourhood_bands(plans).collect()) == [2, 3]


@pytest.mark.parametrize("near", [False, True])
def test_look_ups_drop_sets_whose_sketches_are_far(spark, edited, monkeypatch, near):
    """Folded parities in neighbourhoods as well, and whole ones for large sets, which may differ in more than folded ones tell."""
    kept, keep, plan = {}, jaccard_join.Store.keep, jaccard_join._planned

    def remembered(store, frame, name):
        kept[name] = keep(store, frame, name)
        return kept[name]

    monkeypatch.setattr(jaccard_join.Store, "keep", remembered)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    if near:
        monkeypatch.setattr(jaccard_join, "DEAR", -1.0)
        monkeypatch.setattr(jaccard_join, "_planned", lambda nodes, percent: plan(nodes, percent).withColumn("bare", F.lit(True)).withColumn("dear", F.lit(True)))
    half = " ".join(f"h{i}" for i in range(500))
    docs = edited if near else [(i, half + "".join(f" u{i}_{k}" for k in range(500))) for i in range(12)] + [(20, half), (21, half + " h500")]
    assert got(jaccard_join.similar_documents(spark.createDataFrame(docs, SCHEMA))) == brute_force(docs)
    sets = {r.vertex: (len(r.tokens), r.sketch, r.parities) for r in kept["sets"].withColumn("sketch", jaccard_join.sketch("parities")).collect()}
    candidates = kept["candidates"].collect()
    assert candidates
    for a, b in ((sets[r.a], sets[r.b]) for r in candidates):
        whole = not near and min(a[0], b[0]) > 512
        apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(*((a[2], b[2]) if whole else (a[1], b[1]))))
        assert apart <= jaccard_join.may_differ(a[0] + b[0])


def test_sketches_never_differ_in_more_bits_than_the_sets(spark):
    draw = np.random.default_rng(4)
    pairs = []
    for size in [1, 7, 40, 300, 2000]:
        for _ in range(20):
            one = draw.integers(0, 1 << 63, size, np.uint64) << np.uint64(1)
            other = np.concatenate([one[int(draw.integers(0, size)):], draw.integers(0, 1 << 63, int(draw.integers(0, size)), np.uint64)])
            apart = len(np.setxor1d(one, other))
            pairs.append((apart, *(jaccard_join.parities(x).view(np.int64).tolist() for x in (one, other))))
    frame = spark.createDataFrame(pairs, "apart long, a array<long>, b array<long>")
    bits = frame.select("apart", jaccard_join.sketch("a").alias("a"), jaccard_join.sketch("b").alias("b")).collect()
    for row in bits:
        assert len(row.a) * 64 == jaccard_join.SKETCH_BITS
        assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(row.a, row.b)) <= row.apart


@pytest.mark.parametrize("most", [2, 1 << 18])
def test_links_are_contracted_by_bounded_tasks(spark, edited, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "STARRED", most)
    assert got(jaccard_join.similar_documents(spark.createDataFrame(edited, SCHEMA).repartition(3))) == brute_force(edited)


def test_no_search_for_components_of_few_links(spark, edited, monkeypatch):
    """Each search was dozens of shuffles, however few the links."""
    monkeypatch.setattr(jaccard_join, "connected_components", None)
    assert got(jaccard_join.similar_documents(spark.createDataFrame(edited, SCHEMA))) == brute_force(edited)


def test_sets_of_equal_numbers_are_told_apart(spark, edited, monkeypatch):
    """The first salt gives all sets one number."""
    number = jaccard_join.vertex_of
    monkeypatch.setattr(jaccard_join, "vertex_of", lambda salt: number(salt) if salt else F.lit(7).cast("bigint"))
    assert got(jaccard_join.similar_documents(spark.createDataFrame(edited, SCHEMA))) == brute_force(edited)


@pytest.mark.parametrize("few", [False, True])
def test_few_bare_nodes_do_not_index_their_band(spark, monkeypatch, few):
    """One set whose tokens lie in one segment asks for neighbourhoods in that segment only; the link needs them."""
    kept, keep = {}, jaccard_join.Store.keep

    def remembered(store, frame, name):
        kept[name] = keep(store, frame, name)
        return kept[name]

    monkeypatch.setattr(jaccard_join.Store, "keep", remembered)
    monkeypatch.setattr(jaccard_join, "FEW", 1 if few else 1 << 30)
    band = jaccard_join.band_of(7)
    for start in range(5000):
        words = [f"q{start}x{i}" for i in range(10)]
        if len(set(jaccard_join.subset_hashes(jaccard_join.shingles(" ".join(words)), band)[3])) == 1:
            break
    docs = [(1, " ".join(words)), (2, " ".join(words[:9]))] + [(3 + i, f"a{i} b c d e f g h i") for i in range(20)]
    assert (2, 6, 1) in brute_force(docs)
    assert got(jaccard_join.similar_documents(spark.createDataFrame(docs, SCHEMA))) == brute_force(docs)
    assert ("subsets" in kept) != few and ("lacking" in kept) == few


def test_texts_are_looked_up_by_a_map_of_wanted_ones(spark):
    rows, wanted = spark.range(20000).selectExpr("id * 8589934592 as place"), spark.range(50).selectExpr("id * 8589934592 * 7 as place")
    likely = {r.place for r in jaccard_join.likely(rows, wanted, "place").collect()}
    assert {r.place for r in wanted.collect()} <= likely and len(likely) < 100


def test_first_of_a_subset_meets_every_other():
    import pyarrow as pa

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["subset", "vertex", "n", "component"])

    batches = [batch([(1, 10, 5, 10), (1, 11, 5, 11)]), batch([(1, 12, 5, 12), (1, 13, 5, 10), (2, 14, 5, 14)]), batch([(2, 15, 5, 15)])]
    pairs = sorted((x, y) for out in jaccard_join._neighbours(iter(batches)) for x, y in zip(out["x"].to_pylist(), out["y"].to_pylist()))
    assert pairs == [(10, 11), (10, 12), (11, 12), (12, 13), (14, 15)]


def test_pipeline_stage_keeps_one_of_each_class(spark):
    import corpus_pipeline
    from stackplume.llm import simhash

    documents = table(spark, "/root/testdata/sf0.001", "documents")
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    prints = [simhash.fingerprint(t) & (1 << 64) - 1 for _, t in docs]
    component = list(range(len(docs)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    lowest = {}
    for (doc_id, _), c in zip(docs, component):
        lowest[c] = min(lowest.get(c, doc_id), doc_id)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents, "").collect())
    assert kept == sorted(lowest.values())
