import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from stackplume.llm import prefix_trie
from stackplume.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"


def originals(rows):
    """Turns of every conversation in order: NULL turns first, then by role and the digest of role and text."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            found[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    return {conv: [(t[2], t[4]) for t in sorted(turns)] for conv, turns in found.items()}


def spliced(convs):
    out = {}
    for conv, turns in convs.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = convs.get(conv - int(math.fmod(conv, 5)), [])[:h] + turns[h:]
    return out


def nodes_of(convs):
    members = defaultdict(list)
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for key, convs_here in members.items():
        own = (len(convs_here) - 1) * len(key[-1][1].encode()) if key else 0
        for depth in range(len(key) + 1):
            leaves[key[:depth]] += children[key] == 0
            saved[key[:depth]] += own
    out = []
    for key, convs_here in members.items():
        ends = sorted(c for c in convs_here if len(convs[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(convs_here), len(key), parent, len(convs_here), children[key], leaves[key], saved[key], digest))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def odd_rows():
    """NULLs in every column, negative ids, tied and repeated turns, absent heads, and paths many bands deep."""
    draw = random.Random(3)
    rows = [
        (conv, draw.choice([None, i, i]), draw.choice(["u", None, ""]), draw.choice(["a", "bé", None]))
        for conv in range(-20, 40) if conv % 10 or conv < 20
        for i in range(draw.choice([1, 2, 5, 8, 12, 30]))
    ]
    rows += [(101, i, "u", "x") for i in range(100)] + [(102, i, "u", "x") for i in range(95)]
    return rows + [(None, 1, "u", "x")] + rows[:20]


def test_spliced_trie_with_low_bands(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BAND", 3)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 2)
    assert got(prefix_trie.spliced_trie(spark.createDataFrame(odd_rows, SCHEMA))) == nodes_of(spliced(originals(odd_rows)))


def test_plain_trie_ignores_clashing_columns(spark, odd_rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in odd_rows], f"{SCHEMA}, depth long, k1 long")
    assert got(prefix_trie.conversation_trie(frame)) == nodes_of(originals(odd_rows))


def test_whole_table(spark):
    conversations = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in conversations.collect()]
    assert got(prefix_trie.spliced_trie(conversations)) == nodes_of(spliced(originals(rows)))


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")]])
def test_no_conversations(spark, rows):
    assert got(prefix_trie.spliced_trie(spark.createDataFrame(rows, SCHEMA))) == []


def test_turnless_conversation_is_a_member_of_the_root(spark):
    # crc32 of "1" modulo 9 is at least one, and conversation 0 is absent: the only turn of conversation 1 is dropped.
    assert zlib.crc32(b"1") % 9 >= 1
    assert got(prefix_trie.spliced_trie(spark.createDataFrame([(1, 0, "u", "x")], SCHEMA))) == [
        (1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())
    ]
