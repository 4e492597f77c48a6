"""Exact samples of orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowtide.operators.samples import equal_quotas, mixed_quotas, proportional_quotas, stratified_sample
from rowtide.plans.catalog import query
from rowtide.sources.tables import read_table


@query("""
    WITH counts AS (
        SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY ALL),
    shares AS (
        SELECT *, n * wanted // total AS low, n * wanted % total AS rest
        FROM counts, (SELECT SUM(n) AS total, SUM(n) // 10 AS wanted FROM counts)),
    quotas AS (
        SELECT *, low + CASE WHEN ROW_NUMBER() OVER (
                ORDER BY rest DESC, SUBSTR(MD5('0:' || o_orderpriority || '|' || o_orderstatus), 1, 15))
            <= wanted - SUM(low) OVER () THEN 1 ELSE 0 END AS quota
        FROM shares),
    placed AS (
        SELECT o_orderkey, o_orderpriority, o_orderstatus, ROW_NUMBER() OVER (
            PARTITION BY o_orderpriority, o_orderstatus
            ORDER BY SUBSTR(MD5('0:' || CAST(o_orderkey AS VARCHAR)), 1, 15), o_orderkey) AS place
        FROM orders)
    SELECT o_orderkey, o_orderpriority, o_orderstatus
    FROM placed JOIN quotas USING (o_orderpriority, o_orderstatus) WHERE place <= quota
""")
def stratified_tenth_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all orders, of each priority and status its share."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    strata = ["o_orderpriority", "o_orderstatus"]
    quotas = proportional_quotas(orders, strata, orders.count() // 10)
    return stratified_sample(orders, strata, quotas, ["o_orderkey"])


WEIGHTS = {"purchase": 5, "view": 3, "click": 1, "error": 1}


@query("""
    WITH weights(event_type, weight, named) AS (VALUES ('purchase', 5, 1), ('view', 3, 2), ('click', 1, 3), ('error', 1, 4)),
    sizes AS (
        SELECT event_type, weight, named, COUNT(*) AS n, (SELECT COUNT(*) // 2 FROM events) AS wanted
        FROM events JOIN weights USING (event_type) GROUP BY ALL),
    filled AS (
        SELECT *, (wanted - COALESCE(SUM(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
               >= n * SUM(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS short
        FROM sizes WINDOW w AS (ORDER BY n / weight)),
    shares AS (
        SELECT *, wanted - COALESCE(SUM(n) FILTER (short) OVER (), 0) AS rest, SUM(weight) FILTER (NOT short) OVER () AS all_weight
        FROM filled),
    quotas AS (
        SELECT event_type, n AS quota FROM shares WHERE short UNION ALL
        SELECT event_type, rest * weight // all_weight + CASE WHEN ROW_NUMBER() OVER (
                ORDER BY rest * weight % all_weight DESC, named)
            <= rest - SUM(rest * weight // all_weight) OVER () THEN 1 ELSE 0 END
        FROM shares WHERE NOT short),
    placed AS (
        SELECT event_id, event_type, ROW_NUMBER() OVER (PARTITION BY event_type
            ORDER BY SUBSTR(MD5('7:' || CAST(event_id AS VARCHAR)), 1, 15), event_id) AS place
        FROM events)
    SELECT event_id, event_type FROM placed JOIN quotas USING (event_type) WHERE place <= quota
""")
def mixed_half_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as many events as there are, mixed by weights; types without enough give all."""
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    quotas = mixed_quotas(events, "event_type", WEIGHTS, events.count() // 2)
    return stratified_sample(events, ["event_type"], quotas, ["event_id"], seed=7)


@query("""
    SELECT event_id, user_id, event_type, ts FROM events
    QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id
        ORDER BY SUBSTR(MD5('0:' || CAST(event_id AS VARCHAR)), 1, 15), event_id) <= 5
""")
def sample_of_each_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events of each user, drawn by digest."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return stratified_sample(events, ["user_id"], equal_quotas(events, ["user_id"], 5), ["event_id"])
