"""Repairs against all edits by plain dynamic programming over whole audits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rowtide.llm import conversation_repair
from rowtide.operators.ordered import SAFE_GROUP_ROWS_SETTING

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, block STRING, pos INT"
MARK = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """Cost, audit and repaired lines, from every sequence of edits (the best of each prefix of
    roles' last initial and whether anything is kept)."""
    best = {"": (0, "", ())}

    def insertions(found):
        for _ in range(3):
            for last, (cost, audit, lines) in list(found.items()):
                for role in ("user", "assistant"):
                    if last + role[0] in ("u", "su", "ua", "au"):
                        new = (cost + 2, audit + "I", lines + (f"{role}:",))
                        if role[0] not in found or new[:2] < found[role[0]][:2]:
                            found[role[0]] = new
        return found

    for role, text, fault in rows:
        after = {}
        for last, (cost, audit, lines) in insertions(best).items():
            options = [(last, cost + 3, "D", lines)]
            if fault not in ("blank", "duplicate"):
                add = fault == "truncated"
                if last + role[:1] in ("s", "u", "su", "ua", "au") and role:
                    options.append((role[0], cost + add, "K", lines + (f"{role}:{text}",)))
                options += [(r[0], cost + 2 + add, "R", lines + (f"{r}:{text}",)) for r in ("user", "assistant") if last + r[0] in ("u", "su", "ua", "au")]
            for state, price, letter, kept in options:
                new = (price, audit + letter, kept)
                if state not in after or new[:2] < after[state][:2]:
                    after[state] = new
        best = after
    return min(v for k, v in insertions(best).items() if k in ("", "a"))


def plain(rows):
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        place = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        tie = int(hashlib.md5(f"{len(role)} {role}{text}".encode()).hexdigest()[:15], 16)
        d = zlib.crc32(place.encode()) % 20
        text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
        conversations[c] += [(turn is not None, turn or 0, tie, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = {}
    for c, found in conversations.items():
        found.sort()
        seen, faulty = set(), []
        for _, _, _, role, text in found:
            marks = MARK.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [f[1] for f in found if f[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f[2] == kind for f in faulty) for kind in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = plain_repair(faulty)
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def hard_rows(seed, conversations=150, longest=12):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "users", "é"]
    texts = ["Fine.", "Why? ", "cut off", "cut, off", "  \t", "", None, "Ends!\n\n", "dots... and", "...", "ünï."]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            tidy = c % 3 == 0
            role = ("user", "assistant")[t % 2] if tidy else rng.choice(roles)
            text = f"Sentence {t}." if tidy and rng.random() < 0.8 else rng.choice(texts)
            turn = None if rng.random() < 0.05 else t * 2 if rng.random() < 0.9 else t // 2
            rows.append((c, turn, role, text))
    rows += [(None, t, "user", f"x {t}.") for t in range(30)] + [(None, None, None, None)]
    rows += [(7000, t, rng.choice(roles[:6]), rng.choice(texts) if t % 3 else f"n {t}.") for t in range(260)]
    return rows


def repaired(df, block):
    rows = conversation_repair.repaired_after_damage(df, block).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 4), (3, 3)])
def test_matches_plain_programming(spark, seed, block):
    rows = hard_rows(seed)
    df = spark.createDataFrame([(*r, "taken", 1) for r in rows], SCHEMA).repartition(5)
    assert repaired(df, block) == plain(rows)


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", "no end", f"New {t}."])) for t in range(700)] + hard_rows(4, 20)
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    spark.conf.set(SAFE_GROUP_ROWS_SETTING, "50")
    try:
        assert repaired(df, 16) == plain(rows)
    finally:
        spark.conf.unset(SAFE_GROUP_ROWS_SETTING)


def test_nothing_left_and_empty_table(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Gone.", "", 0)], SCHEMA)
    assert repaired(df, 8) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repaired(df.filter("false"), 8) == {}


def test_very_long_texts(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "word " * 60_000 + "." * (t % 3) + str(t)) for c in (3, 4) for t in range(6)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    assert repaired(df, 4) == plain(rows)


def test_steps_of_rows_are_the_cheapest():
    cost, order, audits = conversation_repair.row_steps()
    assert audits[3][0][conversation_repair.USER] == "K" and cost[3, 0, conversation_repair.USER] == 0
    assert audits[8][0][0] == "D" and audits[2][1][2] == "ID" and cost[2, 1, 2] == 5
    assert (cost < conversation_repair.FAR).sum(-1).min() >= 2
