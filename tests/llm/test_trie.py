import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postlens.llm import trie as T
from postlens.llm.queries import QUERIES
from postlens.operators.joins import join_hot
from postlens.session import scratch_path

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def truncated(c):
    return int(c / 100) * 100


def brute_force(rows):
    """The contract read plainly, with whole sequences as nodes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(own)] for c, own in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        path = turns.get(truncated(c), [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, own in members.items()
    )


def result(spark, rows, extra=()):
    folder = scratch_path(spark, "conversations")
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    df.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return sorted(tuple(r[f] for f in FIELDS) for r in QUERIES["op12_conversation_trie"](spark, folder).collect())


def random_rows(seed, conversations=60, longest=40, texts=3):
    """Few different turns, so that conversations share long openings."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-250, 500), conversations):
        base = ["x" * (k % texts) for k in range(longest)]
        for turn in range(rng.choice([1, 2, 3, 6, longest])):
            text = base[turn] if rng.random() < 0.9 else rng.choice(["", None, "é漢", "y"])
            rows.append((c, rng.choice([turn, turn, None]) if rng.random() < 0.1 else turn, rng.choice(["user", "user", "user", None]), text))
    return rows + [(None, 1, "user", "lost"), (None, None, None, None)]


@pytest.mark.parametrize("band,block,listed", [(16, 4096, 512), (2, 3, 2)])
def test_equal_to_brute_force(spark, monkeypatch, band, block, listed):
    for name, value in (("BAND", band), ("BLOCK_TURNS", block), ("LISTED", listed)):
        monkeypatch.setattr(T, name, value)
    rows = random_rows(band)
    assert result(spark, rows, ("pos", "a", "node", "band", "part")) == brute_force(rows)


def test_copies_of_one_conversation_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "LISTED", 64)
    rows = [(c, t, "user", f"t{t}") for c in range(700, 1_100) for t in range(3)] + [(5, 1, "a", "b")] * 4 + [(6, None, None, None)]
    assert result(spark, rows) == brute_force(rows)


def test_one_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_TURNS", 50)
    rows = [(7, t, "user", str(t % 5)) for t in range(1_500)] + [(c, t, "user", str(t % 5)) for c in range(8, 20) for t in range(c)]
    assert result(spark, rows) == brute_force(rows)


def test_conversation_without_turns_is_a_member_of_the_root(spark):
    # the opening of 103 comes from conversation 100, which is absent, and 103 has fewer turns than the opening
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "hello")]
    assert result(spark, rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == brute_force(rows)


def test_empty_table_has_no_nodes(spark):
    assert result(spark, []) == []


def test_join_with_hot_keys(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(500)] + [(f"k{k}", k) for k in range(1_500)] + [(None, 0), ("absent", 1)], "k string, v int")
    lookup = rows.filter("k is not null and k <> 'absent'").groupBy("k").agg(F.count("*").alias("w"), F.max("v").alias("m"))
    got = join_hot(rows, lookup, "k", "w")
    want = rows.join(lookup.drop("w"), "k", "left")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
