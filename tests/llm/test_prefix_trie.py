"""op11 against a plain loop over odd conversations, and for any number of partitions."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from corvane.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string, conv string"


def plain(rows):
    """The contract, prefix by prefix."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, own.get(c - int(math.fmod(c, 20)), [])  # the remainder has the sign of c, as in SQL
        built[c] = t if c % 20 == 0 else base[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += not kids[k]
    ends = {k: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def got(frame):
    return sorted(tuple(r) for r in prefix_trie.conversation_trie(frame).collect())


def odd_rows():
    rows = [(None, 1, "user", "of no conversation"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 5, "user", "a\u0000b  c"), (2, 5, "user", "a"), (45, 1, "x", "base of forty is absent"), (7, 1, None, "one turn"), (999_999_999_999, 3, "user", "x" * 50_000)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"hello  {t} there\t{'x ' * (t % 3)}" if t < 40 + c % 3 or c % 2 else f"own {c} {t}") for c in range(20, 40) for t in range(3 + 17 * (c % 4))]
    rows += [(c, t, "user", f"{c} {t}") for c in (60, 61, 62, 63, 64) for t in range(c % 4)]
    rows += [(c, t, "u", "same") for c in range(100, 160) for t in range(2)]
    return rows + [(-3, 0, "user", "below zero"), (-20, 0, "user", "base below zero")]


def test_equals_plain_loop(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 5, "y", "z") for r in rows], SCHEMA)
    want = plain([(c, t, r, x) for c, t, r, x in rows])
    assert got(frame) == want
    assert any(r[1] > 40 for r in want) and any(r[2] is None for r in want)
    assert got(frame.repartition(7)) == want


def test_turnless_conversations_end_at_the_root(spark):
    # 61 takes a turn from an absent base: all its own turns are within the first h
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "gone"), (lone, 1, "user", "gone too")]
    assert got(spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA)) == plain(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_many_members_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BYTES", 100)
    frame = spark.range(3000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hi all").alias("text"))
    want = plain([(c, 0, "user", "hi all") for c in range(3000)])
    assert got(frame) == want


def test_one_conversation_of_many_turns(spark):
    rows = [(0, t, "user", f"t {t // 3}") for t in range(700)] + [(20, t, "user", f"t {t // 3}") for t in range(650)]
    assert got(spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA)) == plain(rows)
