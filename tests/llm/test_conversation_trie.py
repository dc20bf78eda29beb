"""The z-fast trie against a plain trie, over generated conversations."""

import hashlib
import math
import random
import zlib

import pytest

from rollcall.llm import conversation_trie as trie


def plain(conversations, family=100, most=6):
    """Nodes by brute force: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, digest)."""
    held = {}
    for conv_id, turn, role, text in conversations:
        if conv_id is None:
            continue
        role, text = role or "", text or ""
        mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        held.setdefault(conv_id, []).append((turn is not None, turn or 0, mark, (role, text)))
    ordered = {c: [item for *_, item in sorted(rows)] for c, rows in held.items()}
    members = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % most
        path = tuple(ordered.get(c - int(math.fmod(c, family)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path)))
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        leaves = 0 if path in children else 1
        for child in children.get(path, []):
            more = below(child)
            saved, leaves = saved + more[0], leaves + more[1]
        return saved, leaves

    found = []
    for path, here in members.items():
        saved, leaves = below(path)
        ends = ",".join(str(c) for c, n in sorted(here) if n == len(path))
        parent = min(c for c, _ in members[path[:-1]]) if path else None
        found.append((min(c for c, _ in here), len(path), parent, len(here), len(children.get(path, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def rows(seed, conversations, turns, letters):
    draw = random.Random(seed)
    made = []
    for c in range(conversations):
        shared = draw.choice([0, draw.randrange(turns), turns])
        for t in range(draw.choice([0, 1, shared, turns])):
            text = f"same {t}" if t < shared else "".join(draw.choice(letters) for _ in range(draw.choice([1, 1, 3])))
            made.append((c * draw.choice([1, 1, 50]), t if draw.random() < 0.95 else None, draw.choice(["user", "user", None]), text))
    return made


def built(spark, made, settings=trie.Batches()):
    frame = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").repartition(3)
    return sorted(map(tuple, trie.conversation_trie(frame, settings).collect()), key=str)


@pytest.mark.parametrize(("seed", "turns", "block"), [(1, 13, None), (2, 40, 5)])
def test_trie_equals_a_plain_one(spark, monkeypatch, seed, turns, block):
    if block:  # conversations longer than a block are hashed in parts
        monkeypatch.setattr(trie, "BLOCK_ROWS", block)
    made = rows(seed, 120, turns, "ab")
    assert built(spark, made, trie.Batches(first=3)) == plain(made)


def test_trie_edges(spark):
    long = "é" * 100_000
    made = [
        (-7, 0, "user", "hi"), (-7, 0, "user", "hi"), (5, None, None, None), (5, 3, "user", long), (None, 0, "user", "hi"),
        (200, 0, "user", "a"), (201, 0, "user", "a"), (201, 1, "user", ""), (200, 1, "user", ""), (200, 2, "a", "b"),
    ]
    assert built(spark, made) == plain(made)
    assert built(spark, [(None, 0, "user", "hi")]) == []
    clash = spark.createDataFrame([(1, 0, "user", "x", 9, 9, "z")], "conv_id long, turn long, role string, text string, depth long, p long, digest string")
    nodes = trie.conversation_trie(clash)
    assert nodes.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert nodes.count() == len(plain([(1, 0, "user", "x")]))


def test_many_equal_conversations_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_CHUNK", 7)
    made = [(c, t, "user", f"turn {t}") for c in range(-20, 150, 1) for t in range(3)]
    assert built(spark, made) == plain(made)
