"""Benchmark decontamination with an FM-index per shard of the training documents.

A task turns its documents, one shard of bounded size after the other, into symbols (the vocabulary of the benchmark;
all other words are separators, since no benchmark phrase contains them), sorts the suffixes and keeps the last column
of that order as a wavelet tree with ranks, and a sample of the suffix positions.  All phrases are searched backwards
together, symbol by symbol, through the ranks of the tree.  Occurrences are located by walking to the next sampled
position, and the words they cover are merged into removal spans per document.

The benchmark is dealt with in blocks of bounded size; each block is sent to the tasks and all documents are read
against it, so neither its size nor that of the documents is limited.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Words of a shard, at least one document.
SHARD_WORDS = 400_000
#: Benchmark items and characters of a block.
BLOCK_ITEMS = 5_000
#: Every so many suffix positions one is kept.
SAMPLE = 8

# Bytes that are in words (digits, lower-case letters, all beyond ASCII), with A-Z lower-cased.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


class BitRanks:
    """A bit array with the number of ones before every position."""

    def __init__(self, bits: np.ndarray):
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        return self.before[at]


class WaveletTree:
    """Ranks of symbols in a sequence: one bit array per bit of the symbols, highest first.

    Level by level the sequence is split stably into zeros and ones, so a rank follows one bit of the symbol per level.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.levels: list[BitRanks] = []
        self.zeros: list[int] = []
        current = symbols
        for level in range(bits - 1, -1, -1):
            ones = (current >> level) & 1
            self.levels.append(BitRanks(ones))
            self.zeros.append(int(len(ones) - ones.sum()))
            current = np.concatenate([current[ones == 0], current[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, stop = np.zeros_like(at), at
        for depth, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = (symbol >> (self.bits - 1 - depth)) & 1
            first, last = level.ones(start), level.ones(stop)
            start = np.where(bit == 1, zeros + first, start - first)
            stop = np.where(bit == 1, zeros + last, stop - last)
        return stop - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it occurs before."""
        symbol, start, place = np.zeros_like(at), np.zeros_like(at), at
        for level, zeros in zip(self.levels, self.zeros):
            bit = level.ones(place + 1) - level.ones(place)
            first, last = level.ones(start), level.ones(place)
            symbol = symbol * 2 + bit
            start = np.where(bit == 1, zeros + first, start - first)
            place = np.where(bit == 1, zeros + last, place - last)
        return symbol, place - start


class FMIndex:
    """Full-text index of runs of symbols, each run ended by a separator 0.

    Separators are ordered by position and before all symbols, so suffixes differ within their run at the latest.
    Sampled are every ``sample``-th position and every beginning of a run; no step back ever crosses a separator.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE):
        self.n = len(symbols)
        order = self._suffix_order(symbols)
        last = symbols[order - 1]
        self.tree = WaveletTree(last.astype(np.int32), max(1, int(alphabet).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=alphabet + 1))])
        self.sampled = (order % sample == 0) | (last == 0)
        self.positions = order[self.sampled]
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])

    @staticmethod
    def _suffix_order(symbols: np.ndarray) -> np.ndarray:
        """Suffixes in order: ranks by their first 1, 2, 4, ... symbols until all differ."""
        n = len(symbols)
        separators = symbols == 0
        rank = np.where(separators, np.cumsum(separators) - 1, int(separators.sum()) - 1 + symbols)
        length = 1
        while True:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -length)
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if int(rank[order[-1]]) == n - 1:
                return order
            length *= 2

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the suffixes that begin with each phrase; phrases are rows, padded at the end."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for step in range(int(lengths.max(initial=0)) - 1, -1, -1):
            active = np.nonzero((lengths > step) & (low < high))[0]
            if not len(active):
                continue
            symbol = phrases[active, step]
            low[active] = self.first[symbol] + self.tree.rank(symbol, low[active])
            high[active] = self.first[symbol] + self.tree.rank(symbol, high[active])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by stepping back to sampled positions."""
        at, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        found = np.full(len(rows), -1, np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            here = at[open_rows]
            done = self.sampled[here]
            ended = open_rows[done]
            found[ended] = self.positions[self.sampled_before[at[ended]]] + steps[ended]
            open_rows = open_rows[~done]
            symbol, rank = self.tree.symbol_and_rank(at[open_rows])
            at[open_rows] = self.first[symbol] + rank
            steps[open_rows] += 1
        return found


@dataclass
class Phrases:
    """A block of the benchmark: distinct windows as symbols, and the items of each window."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    items_from: np.ndarray
    items: list[str]


def phrases_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """The windows of (item_id, text) rows; shorter texts are one window, wordless ones none."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        if item is None:
            continue
        symbols = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for i in range(max(1, len(symbols) - window + 1) if symbols else 0):
            owners.setdefault(tuple(symbols[i : i + window]), set()).add(str(item))
    windows = np.zeros((len(owners), window), np.int64)
    for row, phrase in enumerate(owners):
        windows[row, : len(phrase)] = phrase
    lengths = np.array([len(p) for p in owners], np.int64)
    listed = [sorted(s) for s in owners.values()]
    return Phrases(
        vocabulary, windows, lengths, np.cumsum([0] + [len(s) for s in listed]), [item for s in listed for item in s]
    )


def search_shard(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[np.ndarray, set[str]]]:
    """For each document of a shard: the removal spans (rows of first word, end word) and the items that occur in it.

    Runs of benchmark words that are shorter than every phrase cannot hold one and are not indexed.
    """
    known = phrases.vocabulary.get
    nothing: list[tuple[np.ndarray, set[str]]] = [(np.zeros((0, 2), np.int64), set()) for _ in texts]
    if not len(phrases.lengths):
        return nothing
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    whole = np.zeros(int(sizes.sum()), np.int64)
    for start, words in zip(starts, texts):
        whole[start : start + len(words)] = [known(w, 0) for w in words]
    edges = np.diff(np.concatenate([[0], (whole > 0).astype(np.int8), [0]]))
    runs = np.stack([np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]], 1)
    runs = runs[runs[:, 1] - runs[:, 0] >= phrases.lengths.min()]
    if not len(runs):
        return nothing
    spans = runs[:, 1] - runs[:, 0] + 1
    offsets = np.cumsum(spans) - spans
    symbols = np.zeros(int(spans.sum()), np.int64)
    origin = np.repeat(runs[:, 0] - offsets, spans) + np.arange(len(symbols))
    inside = np.ones(len(symbols), bool)
    inside[offsets + spans - 1] = False
    symbols[inside] = whole[origin[inside]]

    index = FMIndex(symbols, len(phrases.vocabulary))
    low, high = index.search(phrases.windows, phrases.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low, counts) + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = origin[index.locate(rows)]
    document = np.searchsorted(starts, first, side="right") - 1
    # Merge what overlaps or touches: +1 where an occurrence begins, -1 where it ends.
    change = np.zeros(len(whole) + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + phrases.lengths[which], -1)
    hit = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    bounds = np.diff(hit)
    merged = np.stack([np.nonzero(bounds == 1)[0], np.nonzero(bounds == -1)[0]], 1)
    span_document = np.searchsorted(starts, merged[:, 0], side="right") - 1
    found = nothing
    for d in np.unique(document):
        mine = merged[span_document == d] - starts[d]
        items: set[str] = set()
        for w in np.unique(which[document == d]):
            items.update(phrases.items[phrases.items_from[w] : phrases.items_from[w + 1]])
        found[d] = (mine, items)
    return found


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[Phrases]:
    """Blocks of at most ``block_items`` distinct (item_id, text) rows, one at a time."""
    rows = benchmark.select("item_id", "text").where("item_id IS NOT NULL").distinct()
    blocks = -(-rows.count() // block_items)
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    for number in range(blocks):
        items = dealt.where(F.col("_block") == number).orderBy("item_id", "text").select("item_id", "text").collect()
        yield phrases_of([(r["item_id"], r["text"]) for r in items])


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_items: int = BLOCK_ITEMS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """All columns of ``documents`` with _n_words, _spans (array of first and end word) and _items (item ids as text).

    NULL and wordless texts have nothing; repeated rows get equal results; items with NULL id or no words are left
    out, items with equal windows are all found; an empty benchmark finds nothing and an empty table gives no rows.
    Columns with these names are replaced.
    """
    kept = documents.drop("_n_words", "_spans", "_items")
    at = kept.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    schema = f"{fields}, _n_words long, _spans array<struct<first:long,end:long>>, _items array<string>"

    def against(phrases: Phrases):
        shared = documents.sparkSession.sparkContext.broadcast(phrases)

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                first = 0
                texts: list[list[bytes]] = []
                size = 0
                listed = rows.column(at)
                for i in range(rows.num_rows):
                    texts.append(words_of(listed[i].as_py()))
                    size += len(texts[-1])
                    if size >= shard_words or i == rows.num_rows - 1:
                        part = rows.slice(first, len(texts))
                        found = search_shard(texts, shared.value)
                        spans = [[{"first": int(a), "end": int(b)} for a, b in s] for s, _ in found]
                        yield pa.RecordBatch.from_arrays(
                            [
                                *part.columns,
                                pa.array([len(t) for t in texts], pa.int64()),
                                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                                pa.array([sorted(s) for _, s in found], pa.list_(pa.string())),
                            ],
                            [*part.schema.names, "_n_words", "_spans", "_items"],
                        )
                        first, texts, size = i + 1, [], 0

        return searched

    found = kept
    for number, phrases in enumerate(_blocks(benchmark, block_items)):
        if number == 0:
            found = kept.mapInArrow(against(phrases), schema)
            continue
        # A further block: search again and merge with what is known of the row.
        more = found.withColumnsRenamed({"_n_words": "_w", "_spans": "_s", "_items": "_i"})
        at_more = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in more.schema.fields)
        more_schema = f"{at_more}, _n_words long, _spans array<struct<first:long,end:long>>, _items array<string>"
        merged = more.mapInArrow(against(phrases), more_schema)
        found = merged.select(
            *kept.columns, "_n_words", _merge_spans(F.concat("_s", "_spans")).alias("_spans"),
            F.array_distinct(F.concat("_i", "_items")).alias("_items"),
        )
    if found is kept:
        found = kept.mapInArrow(against(phrases_of([])), schema)
    return found


def _merge_spans(spans):
    """Overlapping and touching spans as one."""
    nothing = F.array().cast("array<struct<first:bigint,end:bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["first"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), nothing, add)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of searched documents."""
    hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["first"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def remove_spans(found: DataFrame) -> DataFrame:
    """The columns of the searched documents, with the words of all removal spans cut out of the texts.

    Words are counted as the search counts them; what stands between two removed words goes with them.  Texts without
    a span stay as they are.
    """
    names = [c for c in found.columns if c not in ("_n_words", "_spans", "_items")]
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    at = found.columns.index("text")
    spans_at = found.columns.index("_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = re.compile(word).finditer
        for rows in batches:
            texts = []
            for text, spans in zip(rows.column(at).to_pylist(), rows.column(spans_at).to_pylist()):
                if spans:
                    bounds = [(m.start(), m.end()) for m in places(text)]
                    pieces, upto = [], 0
                    for span in spans:
                        pieces.append(text[upto : bounds[span["first"]][0]])
                        upto = bounds[span["end"] - 1][1]
                    text = "".join([*pieces, text[upto:]])
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(rows.columns)]
            yield pa.RecordBatch.from_arrays([c for c, n in zip(columns, rows.schema.names) if n in names], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name in names)
    return found.mapInArrow(cut, fields)

