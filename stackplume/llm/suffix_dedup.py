"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Suffixes are ordered only through ``depth`` bytes, so suffixes that are equal to that depth form one group, and a group
of two or more is exactly a repeated window.  The digits of a suffix are functions of its first ``depth`` bytes: first
the anchor (the window's smallest k-gram, and where it lies), then the bytes that a block of neighbouring windows has in
common, last the complete window.  A pass deals suffixes out by one digit; groups of one are finished, and only groups
of two or more go on to the next digit.

Neighbouring suffixes that agree in a digit travel as one row (a run), so a pass moves rows and not bytes: runs around
one anchor in the first pass, blocks of ``BLOCK`` windows in the second, single windows in the third, which only sees
the edges of repeated passages.  Runs that are equal as a whole repeat in every window and are settled where they
stand; of each such class one run goes on, to be compared with runs that are equal to it in part.

Digests have 128 bits where they decide and 64 where they only deal out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackplume.llm.common import Store

DEPTH = 400
ANCHOR_BYTES = 64
BLOCK = 32

_MASK = (1 << 64) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _halves(data: bytes) -> tuple[int, int]:
    """A 128-bit digest as two signed numbers."""
    value = xxhash.xxh3_128_intdigest(data)
    return _signed(value >> 64), _signed(value & _MASK)


def kgram_hashes(data: np.ndarray, k: int = ANCHOR_BYTES) -> np.ndarray:
    """Hashes of all strings of k bytes (a power of two), by joining hashes of halves."""
    hashes = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)
    hashes ^= hashes >> np.uint64(29)
    size, factor = 1, 0xBF58476D1CE4E5B9
    while size < k:
        hashes = hashes[:-size] * np.uint64(factor) + hashes[size:]
        hashes ^= hashes >> np.uint64(31)
        factor = (factor * 0x94D049BB133111EB + 2) & _MASK | 1
        size *= 2
    return hashes


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored_runs(data: bytes, depth: int = DEPTH, k: int = ANCHOR_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, end, position of the anchor, hash of the anchor.

    The anchor of a window is its k-gram with the smallest hash, the leftmost of equal ones, so equal windows have
    equal anchors in equal places.
    """
    hashes = kgram_hashes(np.frombuffer(data, np.uint8), k)
    placed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (sliding_minimum(placed, depth - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(anchors))[0] + 1])
    end = np.concatenate([first[1:], [len(anchors)]])
    return first, end, anchors[first], hashes[anchors[first]]


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


RUN = "core long, f1 long, f2 long, k1 long, k2 long, first int, windows int, anchor int"


def _first_digit(documents: DataFrame, depth: int) -> DataFrame:
    """One row per run of windows with one anchor.  k1, k2: digest of the text it stands in."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, 256):
                columns: list[list[np.ndarray]] = [[] for _ in range(8)]
                for text in rows.column(0).slice(start, 256).to_pylist():
                    data = (text or "").encode("utf-8", "replace")
                    if len(data) < depth:
                        continue
                    first, end, anchor, hashes = anchored_runs(data, depth)
                    view = memoryview(data)
                    whole = [xxhash.xxh3_128_digest(view[a : b + depth - 1]) for a, b in zip(first.tolist(), end.tolist())]
                    digests = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
                    k1, k2 = _halves(data)
                    n = len(first)
                    for column, values in zip(columns, (
                        hashes.view(np.int64), digests[:, 0], digests[:, 1], np.full(n, k1), np.full(n, k2),
                        first.astype(np.int32), (end - first).astype(np.int32), (anchor - first).astype(np.int32),
                    )):
                        column.append(values)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in columns], [f.split()[0] for f in RUN.split(", ")]
                    )

    return documents.select("text").mapInArrow(dealt, RUN)


def _settle(runs: DataFrame, store: Store, name: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The spans of runs that are equal as a whole, and the runs that go on to the next digit.

    A group (core) goes on if it holds runs that differ; each class of equal runs then sends one.
    """
    place = F.struct("k1", "k2", "first", "windows", *extra)
    classes = store.keep(
        runs.groupBy("core", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")), f"{name}-classes"
    )
    equal = classes.where("n > 1").select("core", "f1", "f2")
    settled = runs.join(equal, ["core", "f1", "f2"], "left_semi").select("k1", "k2", "first", (F.col("first") + F.col("windows")).alias("end")).distinct()
    split = store.keep(
        classes.groupBy("core").agg(F.count(F.lit(1)).alias("_classes")).where("_classes > 1").select("core"), f"{name}-split"
    )
    onward = classes.join(split, "core", "left_semi").select("core", (F.col("n") > 1).alias("settled"), "place.*")
    return settled, onward


BLOCK_ROW = "core long, f1 long, f2 long, k1 long, k2 long, first int, windows int, c2 long, skip int, flank binary"


def _second_digit(onward: DataFrame, texts: DataFrame, depth: int) -> DataFrame:
    """Blocks of windows that lie in one place around their anchor.

    ``core`` and ``c2``: digest of the bytes that all windows of a block have in common and of the place of the block;
    ``flank``: the bytes to the left and right of them that the block's windows also cover; ``skip``: how many of the
    block's first windows the run does not have.
    """
    runs = onward.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "windows", "anchor")).alias("runs"))
    read = runs.join(texts, ["k1", "k2"]).select("k1", "k2", "runs", "packed")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for k1, k2, runs, packed in zip(*(rows.column(i).to_pylist() for i in range(4))):
                data = _unpack(packed)
                for run in runs:
                    first, end = run["first"], run["first"] + run["windows"]
                    anchor = first + run["anchor"]
                    # Block b holds the windows that begin anchor - (b + 1) * BLOCK + 1 ... anchor - b * BLOCK.
                    for b in range((anchor - end + 1) // BLOCK, (anchor - first) // BLOCK + 1):
                        last_start = anchor - b * BLOCK
                        begin = last_start - BLOCK + 1
                        a, z = max(first, begin), min(end - 1, last_start)
                        common = data[last_start : begin + depth]
                        c1, c2 = _halves(b"%d:" % b + common)
                        flank = data[a:last_start] + data[begin + depth : z + depth]
                        f1, f2 = _halves(b"%d:%d:%d:%d:" % (c1, c2, a - begin, z - begin) + flank)
                        out.append((c1, f1, f2, k1, k2, a, z - a + 1, c2, a - begin, flank))
                if len(out) > 20_000:
                    yield _batch(out, BLOCK_ROW)
                    out = []
            if out:
                yield _batch(out, BLOCK_ROW)

    return read.mapInArrow(blocked, BLOCK_ROW)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, _ARROW[kind]) for column, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields]
    )


WINDOW_ROW = "w1 long, w2 long, k1 long, k2 long, first int, open int"


def _third_digit(onward: DataFrame, depth: int) -> DataFrame:
    """Single windows of the blocks that go on.  A window is its block's common bytes and its part of the flanks."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            columns = (rows.column(n).to_pylist() for n in ("core", "settled", "k1", "k2", "first", "windows", "c2", "skip", "flank"))
            for core, settled, k1, k2, first, windows, c2, skip, flank in zip(*columns):
                left = BLOCK - 1 - skip
                for i in range(windows):
                    place = skip + i
                    covered = flank[i:left] + flank[left : left + place]
                    w1, w2 = _halves(b"%d:%d:%d:" % (core, c2, place) + covered)
                    out.append((w1, w2, k1, k2, first + i, int(not settled)))
            if out:
                yield _batch(out, WINDOW_ROW)

    return onward.select("core", "settled", "k1", "k2", "first", "windows", "c2", "skip", "flank").mapInArrow(opened, WINDOW_ROW)


def repeated_windows(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """k1, k2, first, end: runs of window starts that repeat, by the digest of the text they are in.

    A run is repeated if its windows start anywhere else too: in another row, or elsewhere in the same text.  Rows with
    equal texts repeat each other.  Nothing is gathered per group: groups are counted and joined.  The counts are stored
    first, because adaptive execution splits a hot group only where both sides of a join come straight from a shuffle.
    """
    store = Store(documents.sparkSession, "repeats")
    dealt = _first_digit(documents, depth)
    # Anchors that occur once end here; most do.
    shared = store.keep(dealt.groupBy("core").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("core"), "shared")
    runs = store.keep(dealt.join(shared, "core", "left_semi"), "runs")
    settled_runs, onward = _settle(runs, store, "runs", ("anchor",))
    onward = store.keep(onward, "runs-onward")

    texts = packed_texts(documents, depth)
    blocks = store.keep(_second_digit(onward, texts, depth), "blocks")
    settled_blocks, open_blocks = _settle(blocks, store, "blocks", ("c2", "skip", "flank"))
    windows = store.keep(_third_digit(open_blocks, depth), "windows")
    repeated = store.keep(
        windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("w1", "w2"), "repeated"
    )
    settled_windows = windows.where("open = 1").join(repeated, ["w1", "w2"], "left_semi").select(
        "k1", "k2", "first", (F.col("first") + 1).alias("end")
    )
    return settled_runs.unionByName(settled_blocks).unionByName(settled_windows)


def packed_texts(documents: DataFrame, least: int = 0) -> DataFrame:
    """k1, k2 and the compressed bytes of the distinct texts of at least ``least`` bytes within each batch."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            seen: dict[tuple[int, int], bytes] = {}
            for text in rows.column(0).to_pylist():
                data = (text or "").encode("utf-8", "replace")
                key = _halves(data)
                if len(data) >= least and key not in seen:
                    seen[key] = _pack(data)
            if seen:
                yield _batch([(*key, blob) for key, blob in seen.items()], "k1 long, k2 long, packed binary")

    return documents.select("text").mapInArrow(packed, "k1 long, k2 long, packed binary").dropDuplicates(["k1", "k2"])


def remove_repeats(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row of ``documents``.

    NULL counts as the empty text; texts shorter than ``depth`` keep everything; rows with equal texts repeat each
    other; an empty table gives no rows; other columns are ignored.  ``kept`` can begin or end within a character,
    since spans are byte spans.
    """
    spans = repeated_windows(documents, depth).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("first", "end")).alias("spans")
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in rows.column(1).to_pylist()]
            keys = [_halves(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()),
                 pa.array([_pack(t) for t in texts], pa.binary())],
                ["doc_id", "k1", "k2", "packed"],
            )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text").mapInArrow(keyed, f"doc_id {id_type}, k1 long, k2 long, packed binary")
    joined = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "packed", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, 512):
                part = rows.slice(start, 512)
                lengths, removed, counts, digests, kept_bytes = [], [], [], [], []
                for packed, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = _unpack(packed)
                    merged: list[list[int]] = []
                    for s in sorted((s["first"], s["end"] + depth - 1) for s in spans or []):
                        if merged and s[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s[1])
                        else:
                            merged.append(list(s))
                    pieces, upto = [], 0
                    for a, b in merged:
                        pieces.append(data[upto:a])
                        upto = b
                    kept = b"".join([*pieces, data[upto:]])
                    lengths.append(len(data))
                    removed.append(len(data) - len(kept))
                    counts.append(len(merged))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_bytes.append(kept)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()),
                     pa.array(digests, pa.string()), pa.array(kept_bytes, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return joined.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
