"""Chat texts of logged conversations, without the snapshots that longer ones contain.

Logs often hold a conversation again and again as it grows: each snapshot is a prefix of a
later one. A rolling hash over the turns identifies every prefix: four sums, modulo 2**32, of the
hash of each turn and its number, taken in turn order, so the prefixes of a conversation cost one
pass. A conversation whose own hash is a prefix of a longer one goes, by an anti-join that
compares the number of turns and the digest of the last turn as well, 256 bits in all; of equal
ones the least id stays. What is left is rendered.

Everything is built-in functions. Texts are hashed where they are read, so that only digests are
sorted; conversations too large for one task are cut (``order_groups``). Hashes are aggregated
before they are shuffled, so that a first turn which a third of all conversations share is sent
once per task. A conversation is rendered into one row, so its turns come together in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.operators.ordered import Order, order_groups
from rowtide.session import written

LANES, LANE = 4, 2**32  # sums stay below 2**63 for 2**31 turns
HASHES = [f"h{k}" for k in range(LANES)]
LATEST = 2**63 - 1  # a turn without a number comes last


def turns_of(df: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` and ``tie`` (their order), the rendered ``piece`` and its ``digest``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role), F.lit(" "), role, text))
    return df.select(
        "conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(LATEST)).alias("at"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("tie"),
        digest.alias("digest"), F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n")).alias("piece"),
    )


def rolling_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, the number ``i`` of each turn from 1, its ``digest``, the hashes of the
    conversation up to it, and whether it is the ``last``."""
    groups = order_groups(turns.select("conv_id", "at", "tie", "digest"), ["conv_id"], Order("at", tiebreak="tie")).ranks()
    mixed = F.md5(F.concat("digest", F.lit(":"), F.col("row_number").cast("string")))
    for k, name in enumerate(HASHES):
        lane = F.conv(F.substring(mixed, 8 * k + 1, 8), 16, 10).cast("bigint")
        groups = groups.with_column("lane", lane).running_sum("lane", name)
    groups = groups.following("digest", "next")
    return groups.result().select("conv_id", F.col("row_number").alias("i"), "digest", *[(F.col(n) % LANE).alias(n) for n in HASHES], F.col("next").isNull().alias("last"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` of conversations that are no prefix of a longer one and no later copy."""
    by = ["i", "digest", *HASHES]
    whole = turns.filter("last").groupBy(*by).agg(F.min("conv_id").alias("conv_id"))
    prefixes = turns.filter("NOT last").select(*by).distinct()
    return whole.join(prefixes, by, "left_anti").select("conv_id")


def format_chats(df: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``text`` of every maximal conversation.

    Turns are ordered by turn (nulls last), equal ones by the digest of role and text; missing
    roles and texts count as empty. A row without a conv_id is a conversation of this one turn,
    and gives way to an equal one and to one that starts with it. Repeated rows are turns of
    their own. Other columns are not used; an empty table gives no rows.
    """
    turns = turns_of(df)
    named = turns.filter("conv_id IS NOT NULL")
    rolled = written(rolling_turns(named), "turn-hashes")
    kept = written(maximal_conversations(rolled), "maximal")
    chosen = named.join(kept, "conv_id", "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("at", "tie", "piece")))
    chats = chosen.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text"))
    lone = turns.filter("conv_id IS NULL").groupBy("digest").agg(F.min("piece").alias("text"))
    lone = lone.join(rolled.filter("i = 1").select("digest").distinct(), "digest", "left_anti")
    return chats.unionByName(lone.select(F.lit(None).cast(df.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).cast("bigint").alias("n_turns"), "text"))


OP6_SQL = """
WITH pieces AS (
  SELECT conv_id, turn, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS piece,
    md5(length(coalesce(role, '')) || ' ' || coalesce(role, '') || coalesce(text, '')) AS tie
  FROM conversations),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, tie) AS i FROM pieces WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, count(*) AS n, list(piece ORDER BY i) AS pieces FROM turns GROUP BY conv_id),
firsts AS (SELECT n, pieces, min(conv_id) AS conv_id FROM whole GROUP BY n, pieces),
prefixes AS (
  SELECT DISTINCT pieces[:k] AS pieces FROM (SELECT pieces, unnest(range(1, n)) AS k FROM firsts))
SELECT conv_id, n AS n_turns, array_to_string(pieces, '') AS text
FROM firsts WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE prefixes.pieces = firsts.pieces)
UNION ALL SELECT DISTINCT NULL, 1, piece FROM pieces
WHERE conv_id IS NULL AND piece NOT IN (SELECT piece FROM turns WHERE i = 1)
"""


@query(OP6_SQL)
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
