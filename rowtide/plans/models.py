"""Models fitted per group, and series as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.operators.regression import least_squares
from rowtide.operators.segments import line_segments
from rowtide.plans.catalog import query
from rowtide.sources.tables import read_table


@query("""
    WITH moments AS (
        SELECT l_suppkey, COUNT(*) AS n, AVG(l_quantity) AS mx, AVG(l_discount) AS mz, AVG(l_extendedprice) AS my,
               VAR_POP(l_quantity) AS xx, VAR_POP(l_discount) AS zz, COVAR_POP(l_quantity, l_discount) AS xz,
               COVAR_POP(l_extendedprice, l_quantity) AS xy, COVAR_POP(l_extendedprice, l_discount) AS zy
        FROM lineitem GROUP BY l_suppkey),
    slopes AS (
        SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b
        FROM moments)
    SELECT l_suppkey, n, CAST(my - a * mx - b * mz AS DECIMAL(18,3)) AS intercept,
           CAST(a AS DECIMAL(18,3)) AS per_piece, CAST(b AS DECIMAL(18,3)) AS per_discount
    FROM slopes
""")
def price_model_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the price of a supplier's lines goes with their quantity and discount."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    fitted = least_squares(lines, ["l_suppkey"], "l_extendedprice", ["l_quantity", "l_discount"])
    names = {"intercept": F.col("intercept"), "per_piece": F.col("slopes")[0], "per_discount": F.col("slopes")[1]}
    return fitted.select("l_suppkey", "n", *[v.cast("decimal(18,3)").alias(k) for k, v in names.items()])


@query("""
    WITH RECURSIVE points AS (
        SELECT user_id, EPOCH_US(ts) AS t, value AS v, EPOCH_US(ts) // 604800000000 AS block, ROW_NUMBER() OVER (
            PARTITION BY user_id, EPOCH_US(ts) // 604800000000 ORDER BY ts, event_id) AS place
        FROM events WHERE ts IS NOT NULL AND ISFINITE(value)),
    walk AS (
        SELECT user_id, block, place, t, t AS t0, v AS v0, CAST('-inf' AS DOUBLE) AS low, CAST('inf' AS DOUBLE) AS high
        FROM points WHERE place = 1
        UNION ALL
        SELECT user_id, block, place, t, CASE WHEN fits THEN t0 ELSE t END, CASE WHEN fits THEN v0 ELSE v END,
               CASE WHEN fits THEN new_low ELSE '-inf' END, CASE WHEN fits THEN new_high ELSE 'inf' END
        FROM (
            SELECT *, CASE WHEN t = t0 THEN ABS(v - v0) <= 25 ELSE new_low <= new_high END AS fits
            FROM (
                SELECT p.user_id, p.block, p.place, p.t, p.v, w.t0, w.v0,
                       CASE WHEN p.t = w.t0 THEN low ELSE GREATEST(low, (p.v - 25 - w.v0) / (p.t - w.t0)) END AS new_low,
                       CASE WHEN p.t = w.t0 THEN high ELSE LEAST(high, (p.v + 25 - w.v0) / (p.t - w.t0)) END AS new_high
                FROM walk w JOIN points p ON p.user_id IS NOT DISTINCT FROM w.user_id AND p.block = w.block AND p.place = w.place + 1))),
    numbered AS (
        SELECT *, SUM(begins) OVER (PARTITION BY user_id, block ORDER BY place) AS segment
        FROM (SELECT *, CASE WHEN low = '-inf' AND t = t0 AND (LAG(t0) OVER w IS DISTINCT FROM t0 OR LAG(v0) OVER w <> v0)
                             THEN 1 ELSE 0 END AS begins
              FROM walk WINDOW w AS (PARTITION BY user_id, block ORDER BY place)))
    SELECT user_id, MAKE_TIMESTAMP(MIN(t0)) AS started, MAKE_TIMESTAMP(MAX(t)) AS ended, COUNT(*) AS n,
           CAST(MIN(v0) AS DECIMAL(18,6)) AS start_value,
           CAST(MIN(v0) + CASE WHEN MAX(t) > MIN(t0) THEN (ARG_MAX(low, place) + ARG_MAX(high, place)) / 2 * (MAX(t) - MIN(t0)) ELSE 0 END
                AS DECIMAL(18,6)) AS end_value
    FROM numbered GROUP BY user_id, block, segment
""")
def value_segments_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each user's events as lines that are off by 25 at most, week by week."""
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    found = line_segments(events, ["user_id"], "ts", "value", "event_id", 25.0, 7 * 86_400_000_000)
    return found.withColumns({c: F.col(c).cast("decimal(18,6)") for c in ("start_value", "end_value")})
