"""Texts that share an id, or have none, are told apart by more than the 31 bits beside a position."""

import random

import xxhash
from pyspark.sql import functions as F

from stackplume.llm import chunk_dedup


def test_texts_without_an_id_whose_short_keys_collide(spark):
    draw = random.Random(7)
    letters = [chr(97 + i) for i in range(26)]
    shared = "".join(draw.choice(letters) for _ in range(300))
    seen, pair = {}, None
    while pair is None:
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) + shared
        key = xxhash.xxh3_128_intdigest(text.encode()) >> 97
        if seen.get(key, text) != text:
            pair = (seen[key], text)
        seen[key] = text
    frame = spark.createDataFrame([(None, t) for t in pair], "doc_id long, text string")
    found = chunk_dedup.dedupe(frame).select("n_bytes", F.col("kept").cast("string").alias("kept")).collect()
    assert sorted(r["n_bytes"] for r in found) == sorted(map(len, pair))
    whole = {len(t): t for t in pair}
    if len(whole) == 2:
        assert all(whole[r["n_bytes"]].startswith(r["kept"][:1]) for r in found)
        assert sum(len(r["kept"]) for r in found) < sum(map(len, pair))
