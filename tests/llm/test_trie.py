"""The prefix trie against nested dictionaries, with containers that burst early and late."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scriptloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, cid int, n_convs int, top string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(int(c / 20) * 20, [])[:h] + turns[h:]  # % as in SQL
    return out


def brute(rows):
    members = {}
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        parent = min(members[path[:-1]]) if path else None
        kids = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        out.add((min(own), len(path), parent, len(own), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        walk = [rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 5, 9]))] if c % 3 else list("aabba")
        rows += [(c, i, "user" if i % 2 else None, f"say {x}  {x} now") for i, x in enumerate(walk)]
    return rows + [(7, None, "user", None), (7, None, "user", "first \t of all"), (9, 0, "user", "tied"), (9, 0, "user", "tied"), (None, 1, "user", "nobody"), (1000, 0, "user", "alone"), (-3, 0, None, None)]


@pytest.mark.parametrize(("sequences", "turns"), [(2, 4), (6, 30), (2048, 65_536)])
def test_trie_equals_nested_dictionaries(spark, sequences, turns):
    rows = made(5)
    found = trie.conversation_trie(table(spark, rows), sequences=sequences, turns=turns).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    expected = brute(rows)
    assert len(found) == len(expected) and {tuple(r[x] for x in names) for r in found} == expected


def test_turnless_conversations_and_empty_tables(spark):
    rows = [(c, 0, "user", "one") for c in range(21, 40)]  # none has a conversation 20, most lose their turn
    found = trie.conversation_trie(table(spark, rows)).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {tuple(r[x] for x in names) for r in found} == brute(rows)
    assert trie.conversation_trie(table(spark, rows).limit(0)).count() == 0


def test_long_lists_of_ends_are_digested_in_pieces(spark, monkeypatch):
    ids = spark.range(10_000).select(F.when(F.col("id") < 9_000, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("conv_id"))
    found = {r.key: r.ends_sha256 for r in trie.list_digests(ids.orderBy(F.desc("id"))).collect()}
    assert found["hot"] == hashlib.sha256(",".join(map(str, range(9_000))).encode()).hexdigest()
    assert found["9500"] == hashlib.sha256(b"9500").hexdigest() and len(found) == 1_001
