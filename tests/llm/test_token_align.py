import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackplume.llm import token_align
from stackplume.llm.common import table

SCHEMA = "doc_id long, text string"
ODD = [
    (1, "<|endoftext|> hi </s> <s>"), (2, None), (3, ""), (4, "▁x"), (5, "  a  b\n\n\tc  "), (None, "ñ日本語🙂 é ﬁ ²"),
    (7, " "), (7, " "), (8, "a" * 5000), (9, "　 x​"), (10, "the the the"),
]


@pytest.fixture(scope="module")
def encoders():
    """Both tokenizers straight from their own libraries: text to (id, bytes)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{token_align.VOCABULARIES}/{token_align.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{token_align.VOCABULARIES}/{token_align.B_FILE}")
    letters = token_align.byte_letters()

    def encode_a(text):
        found = a.encode(f" {text}", add_special_tokens=False)
        return [(i, bytes(letters[c] for c in t)) for i, t in zip(found.ids, found.tokens)]

    def encode_b(text):
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]

    return encode_a, encode_b


def brute_force(docs, encoders):
    rows, links, counts = [], [], Counter()
    for doc_id, text in docs:
        sides = [encode(text) if text else [] for encode in encoders]
        if any(b"".join(t for _, t in side) != f" {text}".encode() for side in sides):
            sides = [[], []]
        ends = []
        for side in sides:
            at, here = 0, []
            for i, token in side:
                at += len(token)
                here.append((at, i))
            ends.append(here)
        by_end = defaultdict(list)
        for at, i in ends[1]:
            by_end[at].append(i)
        mine = [(a, b) for at, a in ends[0] for b in by_end[at]]
        groups, i, j = [], 0, 0
        for cut in sorted({at for at, _ in ends[0]} & {at for at, _ in ends[1]}):
            of_a, of_b = [], []
            while i < len(ends[0]) and ends[0][i][0] <= cut:
                of_a.append(str(ends[0][i][1]))
                i += 1
            while j < len(ends[1]) and ends[1][j][0] <= cut:
                of_b.append(str(ends[1][j][1]))
                j += 1
            groups.append(f"{','.join(of_a)}|{','.join(of_b)}")
        counts.update(mine)
        links.append(mine)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if sides[0] else ""
        rows.append((doc_id, len(sides[0]), len(sides[1]), len(groups), len(mine), digest))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (
            (*row[:5], sum(counts[x] == best[x[1]] for x in mine), sum(counts[x] for x in mine), row[5])
            for row, mine in zip(rows, links)
        ),
        key=str,
    )


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_odd_texts(spark, encoders):
    frame = spark.createDataFrame([(*d, 1, 2) for d in ODD], f"{SCHEMA}, pair long, n_a long")
    assert got(token_align.align_public(spark, frame)[0]) == brute_force(ODD, encoders)


def test_whole_table_in_small_blocks_and_pieces(spark, encoders, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_BYTES", 5000)
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(token_align.align_public(spark, documents)[0]) == brute_force(docs, encoders)


def test_pair_counts(spark):
    found, pairs = token_align.align_public(spark, spark.createDataFrame(ODD, SCHEMA))
    assert pairs.agg(F.sum("count")).first()[0] == found.agg(F.sum("n_links")).first()[0]
    assert pairs.groupBy("a", "b").count().where("count > 1").isEmpty()


def test_empty_table(spark):
    assert got(token_align.align_public(spark, spark.createDataFrame([], SCHEMA))[0]) == []


def test_merge_path_pieces_agree_with_sets():
    draw = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.sort(draw.integers(0, 30, draw.integers(0, 40))) for _ in range(2))
        work = int(draw.integers(1, 9))
        i, j = token_align.crossings(a, b, work)
        assert (np.diff(i + j) <= work).all() and i[-1] == len(a) and j[-1] == len(b)
        ends, of_a, of_b = token_align.common_ends(a, b, work)
        both = sorted({*a.tolist()} & {*b.tolist()})
        assert ends.tolist() == both
        assert of_a.tolist() == [int((a == v).sum()) for v in both] and of_b.tolist() == [int((b == v).sum()) for v in both]


def test_ranks_and_merges_give_the_same_ids(spark):
    from tokenizers import Tokenizer

    definition = token_align.read_vocabulary(token_align.VOCABULARIES, token_align.A_FILE)
    slow = Tokenizer.from_str(definition.decode())
    slow.encode_special_tokens = True
    fast = token_align.byte_bpe(definition)
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()] + [t for _, t in ODD]
    for text in texts:
        assert fast.encode(f" {text}") == slow.encode(f" {text}", add_special_tokens=False).ids
