"""Alignment of two tokenizations of the same texts by the byte offsets at which tokens of both end.

The sorted token ends of A and of B are merged along their merge path: diagonals at equal distances are crossed by
binary search, which cuts the merge into pieces of equal work, however the tokens are spread over documents.  A piece
finds the ends that both sides have and emits how many tokens of each end there; an end whose tokens fall into two
pieces is stitched together from both.  Texts are merged in blocks of whole documents behind one another, so that a
long document is many pieces and many short ones share one.

A linked pair of ids is known by its code ``a << 32 | b``.  Of two tokens that end together one's bytes are a suffix of
the other's, so there are at most as many different pairs as the two vocabularies have bytes: the table of counts is
small whatever the corpus, and is sent to the tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackplume.llm.common import Store

VOCABULARIES = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Token ends that a piece of the merge path covers.
PIECE_ENDS = 1 << 16
#: UTF-8 bytes of texts that are encoded and merged at once; one longer text is a block of its own.
BLOCK_BYTES = 1 << 18

# The split pattern of byte-level BPE, and the bytes that its vocabulary writes as themselves.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class Encoder:
    """Texts to token ids, and the bytes of every id."""

    def __init__(self, encode: Callable[[str], list[int]], token_bytes: list[bytes]):
        self.encode = encode
        self.token_bytes = token_bytes


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary to byte; bytes that are not plain take the letters from U+0100 on."""
    plain = set(PLAIN_BYTES)
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_bpe(definition: bytes) -> Encoder:
    """A byte-level BPE from its JSON definition; special tokens are plain text.

    Where merges stand in the order of the ids that they make and the words are split by ``SPLIT_PATTERN``, ids are
    ranks, and a faster encoder that works on ranks gives the same ids.
    """
    described = json.loads(definition)
    vocabulary, letters = described["model"]["vocab"], byte_letters()
    special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
    token_bytes = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
    for token, i in vocabulary.items():
        token_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    for token, i in special.items():
        token_bytes[i] = token.encode()
    merges = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    splitter = described.get("pre_tokenizer") or {}
    ranked = (
        made == sorted(set(made))
        and {i for t, i in vocabulary.items() if t not in special} == {vocabulary[c] for c in letters} | set(made)
        and max(vocabulary[c] for c in letters) < made[0]
        and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
        and not described.get("normalizer") and not described["model"].get("dropout") and not described["model"].get("ignore_merges")
    )
    if ranked:
        import tiktoken

        ranks = {token_bytes[i]: i for t, i in vocabulary.items() if t not in special}
        fast = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Encoder(fast.encode_ordinary, token_bytes)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition.decode())
    tokenizer.encode_special_tokens = True
    return Encoder(lambda text: tokenizer.encode(text, add_special_tokens=False).ids, token_bytes)


def piece_bpe(definition: bytes) -> Encoder:
    """A sentence-piece model; U+2581 stands for a space and byte pieces for their byte.  It adds the space in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=definition)
    token_bytes = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]
    return Encoder(lambda text: model.encode(text[1:], num_threads=1), token_bytes)


def crossings(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two sorted arrays crosses diagonals ``work`` apart: how many of a and of b lie before.

    Of equal values those of a come first.  All diagonals are searched at once, each by halving.
    """
    total = len(a) + len(b)
    diagonals = np.minimum(np.arange(0, total + work, work), total)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at, other = np.where(open_, middle, 0), np.where(open_, diagonals - middle - 1, 0)
        before = open_ & (a[at] <= b[other]) if len(a) and len(b) else open_ & False
        low = np.where(before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low, diagonals - low


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.nonzero(np.diff(values))[0] + 1]) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def common_ends(a: np.ndarray, b: np.ndarray, work: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values that both sorted arrays hold, and how often each does; pieces of ``work`` values are merged on their own."""
    i, j = crossings(a, b, work)
    found = []
    for a0, a1, b0, b1 in zip(i[:-1], i[1:], j[:-1], j[1:]):
        mine, other = a[a0:a1], b[b0:b1]
        (sa, na), (sb, nb) = _runs(mine), _runs(other)
        va, vb = mine[sa], other[sb]
        at = np.searchsorted(vb, va)
        both = np.zeros(len(va), bool)
        inside = at < len(vb)
        both[inside] = vb[at[inside]] == va[inside]
        # The first and last values of a piece may go on in a neighbour; they are kept even if only one side has them.
        at_edge_a, at_edge_b = np.zeros(len(va), bool), np.zeros(len(vb), bool)
        edges = [*mine[:1], *mine[-1:], *other[:1], *other[-1:]]
        if edges:
            low, high = min(edges), max(edges)
            at_edge_a |= (va == low) | (va == high)
            at_edge_b |= (vb == low) | (vb == high)
        keep = both | at_edge_a
        count_b = np.where(both, nb[np.minimum(at, max(len(nb) - 1, 0))] if len(nb) else 0, 0)
        only_b = at_edge_b & ~np.isin(vb, va)
        piece = np.concatenate([np.stack([va[keep], na[keep], count_b[keep]]), np.stack([vb[only_b], 0 * nb[only_b], nb[only_b]])], axis=1)
        found.append(piece[:, np.argsort(piece[0], kind="stable")])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    ends, of_a, of_b = np.concatenate(found, axis=1).astype(np.int64)
    starts, _ = _runs(ends)
    if len(starts):
        ends, of_a, of_b = ends[starts], np.add.reduceat(of_a, starts), np.add.reduceat(of_b, starts)
    shared = (of_a > 0) & (of_b > 0)
    return ends[shared], of_a[shared], of_b[shared]


class Printer:
    """Ids as decimal texts with the character that follows them."""

    def __init__(self, largest: int):
        self.width = len(str(largest)) + 1
        texts = [f"{i}{mark}".encode() for i in range(largest + 1) for mark in ",|;"]
        table = np.zeros((len(texts), self.width), np.uint8)
        for row, text in enumerate(texts):
            table[row, : len(text)] = np.frombuffer(text, np.uint8)
        self.table, self.lengths = table, (table != 0).sum(1)

    def print(self, codes: np.ndarray) -> np.ndarray:
        flat = self.table[codes].ravel()
        return flat[flat != 0]


def _texts_of_groups(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray, printer: Printer) -> tuple[np.ndarray, np.ndarray]:
    """Printed groups of a block of documents, and the printed length of every token in the order of print."""
    last_a, last_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
    group_a = np.repeat(np.arange(len(cuts)), np.diff(last_a, prepend=0))
    group_b = np.repeat(np.arange(len(cuts)), np.diff(last_b, prepend=0))
    first_b = np.concatenate([[0], last_b])
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a[np.diff(last_a, prepend=0) > 0] - 1] = 1
    mark_b[last_b[np.diff(last_b, prepend=0) > 0] - 1] = 2
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + first_b[group_a]] = 3 * a + mark_a
    codes[np.arange(len(b)) + last_a[group_b]] = 3 * b + mark_b
    return printer.print(codes), printer.lengths[codes]


def _linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and number of the group of every linked pair of token occurrences."""
    last_a, last_b = np.searchsorted(ends_a, cuts, "right") - 1, np.searchsorted(ends_b, cuts, "right") - 1
    if not len(cuts) or (of_a.max() == 1 and of_b.max() == 1):
        return a[last_a].astype(np.int64) << 32 | b[last_b], np.arange(len(cuts))
    times = of_a * of_b
    group = np.repeat(np.arange(len(cuts)), times)
    within = np.arange(len(group)) - np.repeat(np.cumsum(times) - times, times)
    return a[last_a[group] - within // of_b[group]].astype(np.int64) << 32 | b[last_b[group] - within % of_b[group]], group


class Aligner:
    """Aligns blocks of texts; made once in a task."""

    def __init__(self, a: Encoder, b: Encoder):
        self.a, self.b = a, b
        self.size_a = np.array([len(t) for t in a.token_bytes], np.int64)
        self.size_b = np.array([len(t) for t in b.token_bytes], np.int64)
        self.printer = Printer(max(len(a.token_bytes), len(b.token_bytes)) - 1)

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides; none where the bytes of either differ from those of the text behind a space."""
        if not text:
            return [], []
        spaced = f" {text}"
        whole = spaced.encode("utf-8", "replace")
        ids_a, ids_b = self.a.encode(spaced), self.b.encode(spaced)
        for ids, token_bytes in ((ids_a, self.a.token_bytes), (ids_b, self.b.token_bytes)):
            if b"".join(map(token_bytes.__getitem__, ids)) != whole:
                return [], []
        return ids_a, ids_b

    def block(self, texts: list[str | None]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, groups_sha256, codes of distinct linked pairs and how often, for every text."""
        ids = [self.tokens(t) for t in texts]
        n_a, n_b = np.array([len(x) for x, _ in ids]), np.array([len(x) for _, x in ids])
        a = np.concatenate([np.asarray(x, np.int64) for x, _ in ids])
        b = np.concatenate([np.asarray(x, np.int64) for _, x in ids])
        # Documents lie behind one another; where one ends, tokens of both sides end.
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts, of_a, of_b = common_ends(ends_a, ends_b)
        until = np.cumsum(n_a)
        doc_end = np.where(until > 0, ends_a[np.maximum(until, 1) - 1], 0) if len(a) else 0 * until
        groups = np.searchsorted(cuts, doc_end, "right")
        printed, lengths = _texts_of_groups(a, b, ends_a, ends_b, cuts, self.printer)
        printed_to = np.concatenate([[0], np.cumsum(lengths)])[until + np.cumsum(n_b)]
        codes, group = _linked(a, b, ends_a, ends_b, cuts, of_a, of_b)
        linked_to = np.searchsorted(group, groups, "left")
        out, text_from, group_from, link_from = [], 0, 0, 0
        for k in range(len(texts)):
            pairs, times = np.unique(codes[link_from : linked_to[k]], return_counts=True)
            digest = hashlib.sha256(printed[text_from : printed_to[k] - 1]).hexdigest() if n_a[k] else ""
            out.append((int(n_a[k]), int(n_b[k]), int(groups[k] - group_from), int(linked_to[k] - link_from), digest, pairs, times))
            text_from, group_from, link_from = printed_to[k], groups[k], linked_to[k]
        return out


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
_TYPES = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _blocks(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > chars:
            yield start, at
            start, held = at, 0
        held += size
    if sizes:
        yield start, len(sizes)


def read_vocabulary(folder: str, name: str) -> bytes:
    """A vocabulary file of the machine that submits the job; its bytes go to the tasks, which need no such file."""
    with open(os.path.join(folder, name), "rb") as file:
        return file.read()


def aligned(documents: DataFrame, a_definition: bytes, b_definition: bytes) -> DataFrame:
    """doc_id and, for every text, numbers of tokens, groups and links, digest of its groups, distinct pairs and times.

    NULL and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens.
    """
    context = documents.sparkSession.sparkContext
    sent = context.broadcast((a_definition, b_definition))

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for rows in batches:
            if not rows.num_rows:
                continue
            aligner = aligner or Aligner(byte_bpe(sent.value[0]), piece_bpe(sent.value[1]))
            texts = rows.column(1)
            for start, end in _blocks(texts, BLOCK_BYTES):
                columns = zip(*aligner.block(texts.slice(start, end - start).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).slice(start, end - start), *(pa.array(c, t) for c, t in zip(columns, _TYPES))], ["doc_id", *_COLUMNS]
                )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(computed, f"doc_id long, {_SCHEMA}")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, its count over all documents, and whether no pair with the same B id has a higher one."""
    counts = (
        found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    )
    # The pairs of a B id are at most the tokens of A.
    highest = F.max("count").over(Window.partitionBy(F.expr("pair & 4294967295L")))
    return counts.withColumn("best", F.col("count") == highest)


def align(documents: DataFrame, a_definition: bytes, b_definition: bytes) -> tuple[DataFrame, DataFrame]:
    """The alignment of every document, and the counts of all linked pairs (a, b, count, best).

    One row for every row of ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the
    highest of their B id, ties included), count_sum (counts summed over links), groups_sha256.  Repeated rows and rows
    without a doc_id count like any other; an empty table gives no rows; other columns are ignored.
    """
    store = Store(documents.sparkSession, "token-align")
    found = store.keep(aligned(documents, a_definition, b_definition).withColumn("row", F.monotonically_increasing_id()), "found")
    counts = store.keep(pair_counts(found), "counts")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    # Bounded by the bytes of both vocabularies, see above.
    sent = F.broadcast(counts)
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    summed = each.join(sent, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    whole = found.select("row", *columns).join(summed, "row", "left").fillna(0, ["n_best", "count_sum"])
    pairs = counts.select(F.shiftright("pair", 32).alias("a"), F.expr("pair & 4294967295L").alias("b"), "count", "best")
    return whole.select(*columns[:-1], "n_best", "count_sum", "groups_sha256"), pairs


def align_public(spark: SparkSession, documents: DataFrame, folder: str = VOCABULARIES, a_file: str = A_FILE, b_file: str = B_FILE) -> tuple[DataFrame, DataFrame]:
    """``align`` with the vocabulary files of a folder."""
    return align(documents, read_vocabulary(folder, a_file), read_vocabulary(folder, b_file))
