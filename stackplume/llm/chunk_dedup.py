"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the bytes of a text, and a chunk ends where it falls below a bound, so where a chunk ends depends
on the bytes just before and an insertion shifts only the chunks around it.  Chunks are compared by digest over all
documents; of equal chunks the first (smallest doc_id, then position) is kept.  Chunks are small, so that any passage of
some fifty words holds several; since short chunks may be equal by chance, only runs of neighbouring repeated chunks
of ``least_bytes`` and more are cut.
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

#: One chunk end in so many positions, beyond the least size.
CUT_ONE_IN = 24
LEAST_CHUNK = 16
MOST_CHUNK = 512
#: Bytes that the 32-bit gear hash remembers.
GEAR_BYTES = 32

GEAR = np.array([xxhash.xxh32_intdigest(bytes([byte]), 2024) for byte in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte: the sum of GEAR[byte] << age over the last 32 bytes, by doubling."""
    hashes = GEAR[data]
    span = 1
    while span < GEAR_BYTES:
        joined = hashes.copy()
        joined[span:] += hashes[:-span] << np.uint32(span)
        hashes = joined
        span *= 2
    return hashes


def chunk_ends(data: bytes) -> list[int]:
    """End positions of the chunks of a text; none for an empty one."""
    if not data:
        return []
    hashes = gear_hashes(np.frombuffer(data, np.uint8))
    ends: list[int] = []
    last = 0
    for end in [*(np.nonzero(hashes < np.uint32(2**32 // CUT_ONE_IN))[0] + 1).tolist(), len(data)]:
        while end - last > MOST_CHUNK:
            last += MOST_CHUNK
            ends.append(last)
        if end - last >= LEAST_CHUNK or (end == len(data) and end > last):
            ends.append(end)
            last = end
    return ends


CHUNK = "d1 long, d2 int, doc_id {id}, spot long, k long"


def _text_key(data: bytes) -> tuple[int, int]:
    """31 and 64 bits of one digest that tell texts with one doc_id, or without one, apart."""
    value = xxhash.xxh3_128_intdigest(data)
    return value >> 97, (value & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def chunks(documents: DataFrame) -> DataFrame:
    """d1, d2 (digest of 96 bits), doc_id, spot (31 bits of the text's key, then the position) and k (its other bits).

    These rows are the bulk of what is shuffled, so they hold nothing else; sizes follow from the text.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for rows in batches:
            for start in range(0, rows.num_rows, 128):
                part = rows.slice(start, 128)
                counts, keys, begins, digests = [], [], [], []
                for text in part.column(1).to_pylist():
                    data = (text or "").encode("utf-8", "replace")
                    stops = chunk_ends(data)
                    starts = [0, *stops[:-1]] if stops else []
                    view = memoryview(data)
                    digests += [digest(view[a:b]) for a, b in zip(starts, stops)]
                    begins += starts
                    counts.append(len(stops))
                    keys.append(_text_key(data))
                if not begins:
                    continue
                owner = np.repeat(np.arange(len(counts)), counts)
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                high, low = (np.array(x, np.int64)[owner] for x in zip(*keys))
                spots = (high << 32) | np.array(begins, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(both[:, 0]), pa.array((both[:, 1] >> 32).astype(np.int32)),
                        part.column(0).take(pa.array(owner)), pa.array(spots), pa.array(low),
                    ],
                    ["d1", "d2", "doc_id", "spot", "k"],
                )

    return documents.select("doc_id", "text").mapInArrow(cut, CHUNK.format(id=id_type))


def dedupe(documents: DataFrame, least_bytes: int = 80) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeated, n_removed, n_spans, kept_sha256, first_docs, kept of every row.

    n_repeated: chunks that are equal to a chunk anywhere else; n_removed and n_spans: bytes and maximal runs cut out;
    kept_sha256: digest of the kept bytes; first_docs: ids of the documents that keep the first copies, sorted.  NULL
    counts as the empty text, which has no chunk; rows with equal doc_id and text are one document to the method and
    judged alike; a NULL doc_id comes last; an empty table gives no rows; other columns are ignored.
    """
    found = chunks(documents)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "spot", "k")
    # Stored before the join, because adaptive execution splits a hot chunk only where both sides come from a shuffle.
    classes = Store(documents.sparkSession, "chunks").keep(
        found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("d1", "d2", "first"),
        "classes",
    )
    later = ~place.eqNullSafe(F.col("first"))
    repeated = (
        found.join(classes, ["d1", "d2"])
        .select("doc_id", F.shiftright("spot", 32).alias("j"), "k", F.col("spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"), later.alias("later"), F.col("first.doc_id").alias("first_doc"))
        .groupBy("doc_id", "j", "k")
        .agg(F.collect_set(F.struct("at", "later", "first_doc")).alias("repeats"))
        .select(F.col("doc_id").alias("_id"), F.col("j").alias("_j"), F.col("k").alias("_k"), "repeats")
    )
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for rows in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in rows.column(1).to_pylist()]
            high, low = zip(*(_text_key(t) for t in texts)) if texts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([packer.compress(t) for t in texts], pa.binary())],
                ["doc_id", "j", "k", "packed"],
            )

    texts = documents.select("doc_id", "text").mapInArrow(packed, f"doc_id {id_type}, j long, k long, packed binary")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("j") == F.col("_j")) & (F.col("k") == F.col("_k"))
    joined = texts.join(repeated, same, "left").select("doc_id", "packed", "repeats")
    first_type = joined.schema["repeats"].dataType.elementType["first_doc"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for rows in batches:
            for start in range(0, rows.num_rows, 512):
                part = rows.slice(start, 512)
                out: list[tuple] = []
                for blob, repeats in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = unpacker.decompress(blob)
                    ends = chunk_ends(data)
                    end_of = dict(zip([0, *ends[:-1]], ends))
                    sized = [{**r, "size": end_of[r["at"]] - r["at"]} for r in repeats or []]
                    out.append((len(data), len(ends), *_cut(data, sized, least_bytes)))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string()),
                        pa.array(columns[6], pa.list_(part.schema.field(0).type)), pa.array(columns[7], pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept_sha256", "first_docs", "kept"],
                )

    return joined.mapInArrow(
        cut,
        f"doc_id {id_type}, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long, kept_sha256 string, "
        f"first_docs array<{first_type}>, kept binary",
    )


def _cut(data: bytes, repeats: list[dict], least_bytes: int) -> tuple[int, int, int, str, list, bytes]:
    """What is left of a text: repeated chunks, bytes and spans removed, digest, ids of first copies, bytes kept."""
    repeats = sorted(repeats, key=lambda r: r["at"])
    spans: list[list[int]] = []
    sources = set()
    i = 0
    while i < len(repeats):
        j = i
        while j + 1 < len(repeats) and repeats[j + 1]["at"] == repeats[j]["at"] + repeats[j]["size"]:
            j += 1
        run = repeats[i : j + 1]
        if run[-1]["at"] + run[-1]["size"] - run[0]["at"] >= least_bytes:
            for r in run:
                if r["later"]:
                    sources.add(r["first_doc"])
                    if spans and spans[-1][1] == r["at"]:
                        spans[-1][1] += r["size"]
                    else:
                        spans.append([r["at"], r["at"] + r["size"]])
        i = j + 1
    pieces, upto = [], 0
    for a, b in spans:
        pieces.append(data[upto:a])
        upto = b
    kept = b"".join([*pieces, data[upto:]])
    listed = sorted(s for s in sources if s is not None)
    return len(repeats), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), listed, kept
