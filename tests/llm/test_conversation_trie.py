"""The prefix trie against plain prefixes, with rows of a few turns and shards of a few rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rowtide.llm import conversation_trie
from rowtide.operators.ordered import SAFE_GROUP_ROWS_SETTING

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, n STRING, shard STRING"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)} {role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, tie, (role, text)))
    turns = {c: [t[-1] for t in sorted(x)] for c, x in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children, leaves, saved = (defaultdict(int) for _ in range(3))
    for p, m in members.items():
        leaf = all(len(rebuilt[c]) == len(p) for c in m)
        children[p[:-1]] += bool(p)
        for d in range(len(p) + 1):
            leaves[p[:d]] += leaf
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def hard_rows(seed, conversations=140, longest=14):
    """Common first turns, copies, prefixes, nulls, repeated turns, negative ids, one very long one."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, conversations), 200, 205, 1000, 1001, 1007]:
        kind = c % 4
        for t in range(rng.randint(1, longest if kind else 9)):
            text = f"t{t}" if kind == 0 or t < 3 and kind == 1 else rng.choice(["a", "b", "", "long " * 3, None])
            turn = None if rng.random() < 0.03 else t if rng.random() < 0.9 else t // 2
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if kind == 3 else "user", text))
    rows += [(77, t, "user", f"deep {t % 5}") for t in range(100, 160)] + [(78, t, "user", f"deep {t % 5}") for t in range(100, 150)]
    rows += [(None, 1, "user", "no id"), (None, None, None, None)]
    return rows


def trie(df, **settings):
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    out = conversation_trie.conversation_trie(df, F.col("conv_id") - F.col("conv_id") % 100, shared, 5, **settings)
    return sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("settings", [{}, {"width": 4, "shard_rows": 20}, {"width": 1, "shard_rows": 7}, {"width": 7, "shard_rows": 3}])
def test_matches_plain_prefixes(spark, settings):
    rows = hard_rows(len(settings) + settings.get("width", 0))
    df = spark.createDataFrame([(*r, "taken", "taken") for r in rows], SCHEMA).repartition(5)
    assert trie(df, **settings) == sorted(plain(rows), key=lambda r: (r[0], r[1]))


def test_one_conversation_with_most_rows(spark):
    rows = [(5, t, "user", f"x{t % 3}") for t in range(900)] + [(c, t, "user", f"x{t % 3}") for c in range(6, 40) for t in range(c)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    spark.conf.set(SAFE_GROUP_ROWS_SETTING, "50")
    try:
        assert trie(df, width=8, shard_rows=16) == sorted(plain(rows), key=lambda r: (r[0], r[1]))
    finally:
        spark.conf.unset(SAFE_GROUP_ROWS_SETTING)


def test_copies_over_many_shards(spark):
    rows = [(c * 100 + 1, t, "user", f"same {t}") for c in range(60) for t in range(6)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert trie(df, width=3, shard_rows=4) == sorted(plain(rows), key=lambda r: (r[0], r[1]))


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie(empty) == []
    assert trie(spark.createDataFrame([(None, 0, "user", "x", "", "")], SCHEMA)) == []
    # Conversation 1 shares five turns with an absent one and has no more of its own.
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    nothing = hashlib.sha256(str(turnless).encode()).hexdigest()
    assert trie(spark.createDataFrame([(turnless, 0, "user", "x", "", "")], SCHEMA)) == [(turnless, 0, None, 1, 0, 1, 0, nothing)]


def test_very_long_texts(spark):
    rows = [(c, t, "user", "z" * (200_000 + t)) for c in (201, 302, 303) for t in range(8)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert trie(df) == sorted(plain(rows), key=lambda r: (r[0], r[1]))
