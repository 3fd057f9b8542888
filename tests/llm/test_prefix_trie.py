"""The prefix trie against all prefixes in plain Python, and its radix tree against a sorted list."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallywatch.llm import prefix_trie
from tallywatch.llm.prefix_trie import RadixTree, prefix_nodes, shared

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = set()
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in ids if full[c] == node))
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("base", F.lit(0)).withColumn("key", F.lit("k"))
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_nodes(docs).select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_prefixes(spark, seed, monkeypatch):
    # Small trees, pieces and buffers, so that every border is crossed.
    monkeypatch.setattr(prefix_trie, "TREE", [7, 1, 1 << 15][seed])
    monkeypatch.setattr(prefix_trie, "WAITING", [5, 1, 1 << 16][seed])
    monkeypatch.setattr(prefix_trie, "PIECE", [60, 20, 1 << 20][seed])
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-250, 500), 220):
        rows += [(conv, turn, rng.choice(["user", "assistant"]), "ab"[: rng.randint(0, 2)]) for turn in range(rng.choice([1, 1, 2, 3, 4, 9]))]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(1, None, None, None), (1, 0, "user", "é🙂"), (1, 0, "user", "é🙂"), (1, 0, "user", "b"), (2, 5, "", ""), (None, 1, "user", "lost"), (100, 1, "user", "x" * 100_000), (0, 0, "user", "a")])
    check(spark, [(207, 0, "user", "only"), (205, 0, "user", "only")])
    assert prefix_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_a_third_is_one_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 3000, 3) for t in range(2)]
    rows += [(c, t, "user", f"same 0" if t == 0 else f"other {c % 7} {t}") for c in range(1, 300, 3) for t in range(4)]
    check(spark, rows)


def test_radix_tree_keeps_order_and_shared_bytes():
    rng = random.Random(5)
    for width in (1, 2, 3):
        keys = {bytes(rng.randrange(0, 256 if width > 1 else 3) for _ in range(width)) * rng.randint(0, 2) + bytes(rng.choice([0, 1, 255]) for _ in range(rng.randint(0, 3))) for _ in range(3000)}
        tree = RadixTree()
        for key in sorted(keys, key=lambda _: rng.random()):
            tree.insert(key, len(key))
        got = list(tree.leaves())
        assert [k for k, _, _ in got] == sorted(keys) and all(v == len(k) for k, v, _ in got)
        for (a, _, _), (b, _, common) in zip(got, got[1:]):
            assert common == shared(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rooms = set()

    def walk(node):
        if hasattr(node, "room"):
            rooms.add(node.room)
            for _, kid in node.items():
                walk(kid)

    for size in (4, 16, 48, 256):
        tree = RadixTree()
        for i in range(size):
            tree.insert(bytes([i, 1]), i)
        walk(tree.root)
    assert rooms == {4, 16, 48, 256}
