"""Exact stratified samples: so many rows of each stratum, whatever the partitions of the rows.

A row's digest decides: of each stratum the rows with the smallest digests are taken. The largest
digest to take is found by narrowing histograms, counts of the digests' leading bits that
are added up before the shuffle. Rows stay where they are; only those of the last bin, in which
the sample of their stratum ends, are put in order.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.operators.ordered import FIRST, Order, order_groups
from rowtide.session import written

DIGEST_BITS = 60
# Leading bits that one histogram adds to those known, so a stratum is 4096 counts at most.
BITS_A_ROUND = 12
# Narrowing goes on while the last bins of all strata hold more rows than this.
LAST_BIN_ROWS = 1_000_000


def digest(columns: list[str], seed: int = 0) -> Column:
    """60 bits of the MD5 of ``seed`` and the columns' texts, nulls as empty ones."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    text = F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *texts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGEST_BITS // 4), 16, 10).cast("bigint")


def equal_quotas(df: DataFrame, strata: list[str], rows: int) -> DataFrame:
    """The same number of rows for each stratum."""
    return df.groupBy(*strata).agg(F.lit(rows).cast("bigint").alias("quota"))


def proportional_quotas(df: DataFrame, strata: list[str], rows: int, seed: int = 0) -> DataFrame:
    """Shares of ``rows`` in proportion to the strata, whole by the largest remainders.

    They add up to ``rows``, or to the rows there are. Of equal remainders the one with the
    smaller digest of its stratum counts as larger. Any number of strata will do.
    """
    counts = written(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")), "strata")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    wanted = min(rows, total)
    if not wanted:
        return counts.select(*strata, F.lit(0).cast("bigint").alias("quota"))
    # The product of two counts needs more than 64 bits.
    product = F.col("_n").cast("decimal(19,0)") * F.lit(wanted).cast("decimal(19,0)")
    shares = counts.withColumns({
        "_rest": (product % F.lit(total)).cast("bigint"),
        "_digest": digest(strata, seed),
        "_one": F.lit(1).cast("bigint"),
    }).withColumn("quota", ((product - F.col("_rest")) / F.lit(total)).cast("bigint"))
    left = wanted - shares.agg(F.sum("quota")).first()[0]
    ordered = order_groups(shares, [], Order("_rest", descending=True, tiebreak="_digest")).running_sum("_one", "_place")
    quota = F.col("quota") + F.when(F.col("_place") <= left, 1).otherwise(0)
    return ordered.result().select(*strata, quota.cast("bigint").alias("quota"))


def mixed_quotas(df: DataFrame, stratum: str, weights: Mapping[object, int], rows: int) -> DataFrame:
    """Shares of ``rows`` by the weights of the values of ``stratum``; other values get none.

    A value with fewer rows than its share gives all it has, and what it lacks is dealt to the
    others by their weights. Shares are whole by the largest remainders, of equal ones
    that of the value named first. There is one count per weight on the driver.
    """
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be above zero")
    named = F.col(stratum).isin([v for v in weights if v is not None])
    named = named | F.col(stratum).isNull() if None in weights else named
    counted = df.where(named).groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {v: 0 for v in weights} | {r[stratum]: r["n"] for r in counted}
    quotas, open_values, left = {}, list(weights), rows
    while open_values:
        level = Fraction(left, sum(weights[v] for v in open_values))
        short = [v for v in open_values if sizes[v] <= level * weights[v]]
        if not short:
            break
        quotas |= {v: sizes[v] for v in short}
        left -= sum(sizes[v] for v in short)
        open_values = [v for v in open_values if v not in short]
    if open_values:
        shares = {v: level * weights[v] for v in open_values}
        quotas |= {v: int(share) for v, share in shares.items()}
        spare = left - sum(int(share) for share in shares.values())
        quotas |= {v: quotas[v] + 1 for v in sorted(open_values, key=lambda v: int(shares[v]) - shares[v])[:spare]}
    schema = T.StructType([T.StructField(stratum, df.schema[stratum].dataType), T.StructField("quota", T.LongType())])
    return df.sparkSession.createDataFrame(list(quotas.items()), schema)


def stratified_sample(df: DataFrame, strata: list[str], quotas: DataFrame, identity: list[str], seed: int = 0) -> DataFrame:
    """The ``quota`` rows of each stratum with the smallest digests of ``identity``, or all there are.

    ``quotas`` has one row per stratum with the ``strata`` and ``quota``; strata that it lacks
    give no rows. Null is a stratum like others. Rows of equal ``identity`` are told
    apart by the hash of their other columns (but maps), and it does not matter which of equal rows is
    taken, so equal ``seed`` and rows give an equal sample. Reads the identity once for each 12 bits that are
    needed, and the rows twice.
    """
    if not strata:
        raise ValueError("name the columns of the strata")
    rows = df.withColumn("_digest", digest(identity, seed))
    quotas = written(quotas.select(*strata, F.col("quota").cast("bigint").alias("_left")).where("_left > 0"), "quotas")
    ends, known = quotas, 0
    while known < DIGEST_BITS:
        ends = written(_narrowed(rows.select(*strata, "_digest"), strata, ends, known), "ends")
        known += BITS_A_ROUND
        if (ends.agg(F.sum("_held")).first()[0] or 0) <= LAST_BIN_ROWS:
            break
    # A stratum without an end has no more rows than its quota.
    cuts = _matched(quotas.select(*strata), ends.select(*strata, "_end", "_left"), strata, "left")
    rows = _matched(rows, written(cuts, "cuts"), strata, "inner")
    bin_ = F.shiftright("_digest", DIGEST_BITS - known)
    whole = rows.where(F.col("_end").isNull() | (bin_ < F.col("_end")))
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    last = rows.where(bin_ == F.col("_end")).withColumns({"_row": F.xxhash64(*hashed), "_one": F.lit(1).cast("bigint")})
    placed = order_groups(last, strata, Order("_digest", tiebreak="_row")).running_sum("_one", "_place").result()
    return whole.select(*df.columns).unionByName(placed.where("_place <= _left").select(*df.columns))


def _matched(left: DataFrame, right: DataFrame, strata: list[str], how: str) -> DataFrame:
    """A join on strata in which null equals null; ``right`` gives its other columns."""
    right = right.withColumnsRenamed({s: f"_of_{s}" for s in strata})
    match = [F.col(s).eqNullSafe(F.col(f"_of_{s}")) for s in strata]
    return left.join(right, match, how).drop(*[f"_of_{s}" for s in strata])


def _narrowed(rows: DataFrame, strata: list[str], ends: DataFrame, known: int) -> DataFrame:
    """The bin in which each stratum's sample ends, by 12 bits more than are ``known``, the rows
    the bin holds and how many of them to take."""
    shift = DIGEST_BITS - known
    if known:
        rows = _matched(rows, ends.select(*strata, "_end"), strata, "inner")
        rows = rows.where(F.shiftright("_digest", shift) == F.col("_end"))
    bins = rows.groupBy(*strata, F.shiftright("_digest", shift - BITS_A_ROUND).alias("_bin")).agg(F.count(F.lit(1)).alias("_held"))
    upto = F.sum("_held").over(Window.partitionBy(*strata).orderBy("_bin").rowsBetween(FIRST, 0))
    bins = _matched(bins.withColumn("_upto", upto), ends.select(*strata, "_left"), strata, "inner")
    before = F.col("_upto") - F.col("_held")
    bins = bins.where((before < F.col("_left")) & (F.col("_upto") >= F.col("_left")))
    return bins.select(*strata, F.col("_bin").alias("_end"), (F.col("_left") - before).alias("_left"), "_held")
