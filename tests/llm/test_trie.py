"""The prefix trie against nested dictionaries of whole sequences."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from lodestream.llm import trie

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [x[3] for x in sorted(t, key=lambda x: x[:3])] for c, t in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    told = {}
    for p in sorted(members, key=len, reverse=True):
        m, words = members[p], len(WORD.findall(p[-1][1].encode())) if p else 0
        leaves = sum(told[c][5] for c in children[p]) or 1
        saved = (len(m) - 1) * words + sum(told[c][6] for c in children[p])
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        told[p] = (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(told.values(), key=str)


def ours(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, parent_conv_id string, depth int")
    return sorted(map(tuple, trie.prefix_trie(df.repartition(parts)).select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_python_with_nulls_ties_and_repeated_rows(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([*range(-25, 60), None]), rng.choice([0, 1, 2, 3, 4, None]), rng.choice(["u", "a", None]), rng.choice(["x", "y z", None, "", "x"])) for _ in range(400)]
    assert ours(spark, rows) == brute(rows)


def test_hot_groups_and_a_very_long_conversation(spark, monkeypatch):
    """A third of the conversations are copies, another shares its first turn, and one conversation holds most rows: the rounds follow the shared turns alone."""
    monkeypatch.setattr(trie, "BLOCK", 100)
    copies = [(c, k, "u", f"t{k}") for c in range(2000, 2300) for k in range(3)]
    rows = copies + [(7, k // 2, "u", "w w") for k in range(5000)] + [(c, 0, "u", "q") for c in range(40)]
    assert ours(spark, rows) == brute(rows)


def test_turnless_and_empty(spark):
    assert ours(spark, []) == [] == ours(spark, [(None, 1, "a", "b")])
    for c in (1, 5, 41):  # some lose all their turns to an absent donor
        assert ours(spark, [(c, 1, None, None)]) == brute([(c, 1, None, None)])
