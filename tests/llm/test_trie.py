"""Prefix tries against a brute-force version over lists of turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for node, convs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(y[: len(x)] == x and len(y) > len(x) for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in under if x)
        ends = ",".join(str(c) for c in sorted(c for c in convs if paths[c] == node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, convs=120):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.choice([1, 2, 3, 4, 6, 9])):
            if c % 3:  # a third take turns from a handful, so that subtries are shared and deep
                rows.append((c, t, rng.choice(["user", "bot"]), f"word {rng.randrange(2)} " * (t % 3)))
            else:
                rows.append((c, t, "user", "the same" if t < 4 else f"turn {rng.randrange(3)}"))
    rng.shuffle(rows)
    return rows


def got(spark, rows, limit=trie.LIMIT):
    made = trie.conversation_trie(spark.createDataFrame(rows, TURNS), limit)
    return sorted((tuple(r[c] for c in COLUMNS) for r in made.collect()), key=str)


@pytest.mark.parametrize("limit", [1, 12, 60, trie.LIMIT])
def test_nodes_equal_brute_force_at_any_limit(spark, limit):
    """Small limits deal subtries again and again, down to chains of one class."""
    rows = talk(limit)
    assert got(spark, rows, limit) == brute(rows)


def test_odd_rows(spark):
    rows = [(20, None, None, None), (20, 1, "user", ""), (20, 1, "user", ""), (21, 2, "a", "x y"), (21, 2, "a", "b"), (None, 1, "user", "nobody's"), (-7, 0, "user", "ünï cödé " * 3000), (5, 1, "u", "only"), (7, None, "u", "z")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, 1) == brute(rows)
    assert got(spark, []) == []


def test_columns_of_other_names_are_left_out(spark):
    rows = talk(5, 20)
    odd = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("pos", "key", "cls", "gid", "n", "up", "words", "_own")})
    assert sorted((tuple(r[c] for c in COLUMNS) for r in trie.conversation_trie(odd).collect()), key=str) == brute(rows)


def test_one_conversation_many_times_is_one_class(spark):
    """A third of all rows in copies of one long conversation: one of them goes into the trie, and none is lost from the counts."""
    rows = [(c, t, "user", f"line {t}") for c in range(0, 4000, 20) for t in range(30)] + [(c, 0, "user", f"other {c}") for c in range(1, 2001, 2)]
    made = trie.conversation_trie(spark.createDataFrame(rows, TURNS), 40)
    nodes = {(r["conv_id"], r["depth"]): r for r in made.collect()}
    assert nodes[(0, 30)]["n_convs"] == 200 and nodes[(0, 1)]["n_convs"] >= 200
    assert nodes[(0, 30)]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(0, 4000, 20))).encode()).hexdigest()
    assert sum(r["n_children"] for r in nodes.values()) == len(nodes) - 1
