"""Maximal conversations against plain prefixes: copies, nulls, ties, long texts and one large conversation."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rowtide.llm import chat
from rowtide.operators.ordered import SAFE_GROUP_ROWS_SETTING

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, i INT, last STRING"


def plain(rows):
    turns, lone = defaultdict(list), set()
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        piece = f"<|{role}|>\n{text}<|end|>\n"
        if c is None:
            lone.add(piece)
        else:
            turns[c].append((turn is None, turn or 0, hashlib.md5(f"{len(role)} {role}{text}".encode()).hexdigest(), piece))
    whole = {c: tuple(t[-1] for t in sorted(x)) for c, x in turns.items()}
    prefixes = {w[:k] for w in whole.values() for k in range(1, len(w))}
    least = {}
    for c, w in whole.items():
        least[w] = min(c, least.get(w, c))
    kept = [(c, len(w), "".join(w)) for w, c in least.items() if w not in prefixes]
    starts = {w[0] for w in whole.values()}
    return Counter(kept + [(None, 1, p) for p in lone if p not in starts])


def logs(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            turn = None if rng.random() < 0.04 else t if rng.random() < 0.9 else t // 2
            rows.append((c, turn, "user" if t % 2 == 0 else None, f"t{t}" if c % 3 else rng.choice(["a", "b", "", None, "x" * 30_000])))
    rows += [(None, t, "user", rng.choice(["t0", "own", None])) for t in range(20)] + rows[:5]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_plain_prefixes(spark, seed):
    rows = logs(seed)
    df = spark.createDataFrame([(*r, 1, "taken") for r in rows], SCHEMA).repartition(5)
    assert Counter(map(tuple, chat.format_chats(df).collect())) == plain(rows)
    assert chat.format_chats(df.filter("false")).count() == 0
    assert Counter(map(tuple, chat.format_chats(df.filter("conv_id IS NULL")).collect())) == plain([r for r in rows if r[0] is None])


def test_one_conversation_with_most_rows(spark):
    rows = [(1, t, "user", f"x{t % 7}") for t in range(800)] + [(c, t, "user", f"x{t % 7}") for c in (2, 3, 4) for t in range(c * 50)]
    rows += [(5, t, "user", f"x{t % 7}") for t in range(799)] + [(6, t, "user", f"x{t % 7}" if t < 700 else "end") for t in range(720)]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)
    spark.conf.set(SAFE_GROUP_ROWS_SETTING, "50")
    try:
        assert Counter(map(tuple, chat.format_chats(df).collect())) == plain(rows)
    finally:
        spark.conf.unset(SAFE_GROUP_ROWS_SETTING)


def test_many_turns_do_not_overflow(spark):
    """Sums of 2**31 hashes below 2**32 are below 2**63; here all hashes are the largest there are."""
    rows = spark.range(200_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("at"), F.col("id").alias("tie"), F.lit("f" * 32).alias("digest"))
    rolled = chat.rolling_turns(rows)
    assert rolled.count() == 200_000 and rolled.filter("last").count() == 1
    assert rolled.agg(*[F.max(n) for n in chat.HASHES]).first() <= tuple([chat.LANE - 1] * chat.LANES)


def test_main_path_is_built_in(spark):
    df = spark.createDataFrame([(*r, 1, "") for r in logs(3, 20)], SCHEMA)
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
