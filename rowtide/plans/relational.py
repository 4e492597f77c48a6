"""Scans, joins, aggregations, limits and set operations on the star schema.

No join carries a broadcast hint: Spark broadcasts a side whose measured size is under
its threshold and otherwise shuffles both, splitting skewed partitions at run time.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.functions.columns import cents, exact_sum, money, revenue
from rowtide.operators.aggregates import exact_percentiles, totals_by
from rowtide.plans.catalog import query
from rowtide.session import work_path
from rowtide.sources.partitioned import read_partitioned, write_partitioned
from rowtide.sources.tables import SCHEMAS, read_table


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


@query("SELECT * FROM part")
def declared_schema_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part")


@query("""
    SELECT l_linestatus, COUNT(*) AS n,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS price
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus
""")
def partitioned_write_pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "lineitem")
    write_partitioned(read_table(spark, sf_dir, "lineitem"), path, ["l_returnflag"])
    lines = read_partitioned(spark, path, SCHEMAS["lineitem"])
    return (
        lines.where(F.col("l_returnflag") == "R")
        .groupBy("l_linestatus")
        .agg(F.count("*").alias("n"), exact_sum(cents("l_extendedprice"), 2).alias("price"))
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity,
           CAST(CAST(l_extendedprice AS DECIMAL(15,2))
                * (1.00 - CAST(l_discount AS DECIMAL(5,2))) AS DECIMAL(38,4)) AS revenue
    FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
      AND CAST(l_discount AS DECIMAL(5,2)) BETWEEN 0.05 AND 0.07 AND l_quantity < 24
""")
def filter_and_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    amount = (revenue() * F.lit(Decimal("0.0001"))).cast("decimal(38,4)")
    return lines.where(
        (F.col("l_shipdate") >= _day("1997-01-01"))
        & (F.col("l_shipdate") < _day("1998-01-01"))
        & cents("l_discount").between(5, 7)
        & (F.col("l_quantity") < 24)
    ).select("l_orderkey", "l_linenumber", "l_quantity", amount.alias("revenue"))


@query("""
    SELECT l_returnflag, l_linestatus,
           CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS sum_qty,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS sum_base_price,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))
                * (1.00 - CAST(l_discount AS DECIMAL(5,2)))) AS DECIMAL(38,4)) AS sum_disc_price,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))
                * (1.00 - CAST(l_discount AS DECIMAL(5,2)))
                * (1.00 + CAST(l_tax AS DECIMAL(5,2)))) AS DECIMAL(38,6)) AS sum_charge,
           CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) / COUNT(*) AS avg_qty,
           COUNT(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02'
    GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    charge = revenue() * (100 + cents("l_tax"))
    quantity = exact_sum(cents("l_quantity"), 2)
    return (
        lines.where(F.col("l_shipdate") <= _day("2000-09-02"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            quantity.alias("sum_qty"),
            exact_sum(cents("l_extendedprice"), 2).alias("sum_base_price"),
            exact_sum(revenue(), 4).alias("sum_disc_price"),
            exact_sum(charge, 6).alias("sum_charge"),
            (quantity.cast("double") / F.count("*")).alias("avg_qty"),
            F.count("*").alias("count_order"),
        )
    )


@query("""
    SELECT n_name, COUNT(*) AS n,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))
                * (1.00 - CAST(l_discount AS DECIMAL(5,2)))) AS DECIMAL(38,4)) AS revenue
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
         JOIN customer ON c_custkey = o_custkey
         JOIN supplier ON s_suppkey = l_suppkey
         JOIN nation ON n_nationkey = c_nationkey
    WHERE s_nationkey = c_nationkey
    GROUP BY n_name
""")
def star_join_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customer, supplier, nation = (
        read_table(spark, sf_dir, t)
        for t in ("lineitem", "orders", "customer", "supplier", "nation")
    )
    located = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "c_nationkey"
    )
    # Added up per nation and supplier, so that lines are shuffled for one join only.
    pairs = (
        lines.join(located, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("c_nationkey", "l_suppkey")
        .agg(F.count("*").alias("n"), exact_sum(revenue(), 4).alias("revenue"))
    )
    at_home = (F.col("s_suppkey") == F.col("l_suppkey")) & (
        F.col("s_nationkey") == F.col("c_nationkey")
    )
    totals = pairs.join(supplier, at_home).groupBy("c_nationkey").agg(
        F.sum("n").alias("n"), F.sum("revenue").cast("decimal(38,4)").alias("revenue")
    )
    return totals.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "n_name", "n", "revenue"
    )


@query("""
    SELECT o_orderkey, COUNT(l_orderkey) AS lines,
           CAST(COALESCE(SUM(CAST(l_quantity AS DECIMAL(15,2))), 0) AS DECIMAL(38,2)) AS quantity
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY o_orderkey
""")
def left_join_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are added up per order before the join, which then finds one row per order."""
    per_order = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("lines"), exact_sum(cents("l_quantity"), 2).alias("quantity"))
    )
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(per_order, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        "o_orderkey",
        F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"),
        F.coalesce("quantity", F.lit(0).cast("decimal(38,2)")).alias("quantity"),
    )


@query("""
    SELECT o_orderpriority, COUNT(*) AS n FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    GROUP BY o_orderpriority
""")
def semi_join_returned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = (
        read_table(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select("l_orderkey")
        .distinct()
    )
    orders = read_table(spark, sf_dir, "orders")
    kept = orders.join(returned, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey, o_custkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def anti_join_orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(with_lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@query("""
    SELECT c_custkey, n_name, r_name FROM customer
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def lookup_join_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    places = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    customer = read_table(spark, sf_dir, "customer")
    return customer.join(places, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", "n_name", "r_name"
    )


@query("""
    SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers
    FROM orders GROUP BY o_orderpriority
""")
def distinct_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("""
    SELECT event_type, COUNT(DISTINCT user_id) AS users,
           TRUE AS estimate_close, TRUE AS merged_close
    FROM events GROUP BY event_type
""")
def approximate_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users from sketches of fixed size, which merge from days into event types.

    ``users`` comes from samples of hash values (theta sketches). They count exactly up to 2**16
    users and have a standard error of 0.4 percent beyond. The others are estimates from registers:
    at 2**12 of them the standard error is about 1.6 percent, and 10 percent is over five of them.
    No exact count is computed.
    """
    events = read_table(spark, sf_dir, "events")
    daily = events.groupBy("event_type", F.to_date("ts")).agg(
        F.theta_sketch_agg("user_id", F.lit(16)).alias("sample"),
        F.hll_sketch_agg("user_id", F.lit(12)).alias("sketch"),
    )
    merged = daily.groupBy("event_type").agg(
        F.theta_sketch_estimate(F.theta_union_agg("sample", F.lit(16))).alias("users"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("merged"),
    )
    estimate = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("estimate"))

    def close(column: str) -> Column:
        return (F.abs(F.col(column) - F.col("users")) <= F.col("users") * 0.1).alias(
            f"{column}_close"
        )

    same = estimate["event_type"].eqNullSafe(merged["event_type"])
    return merged.join(estimate, same).select(
        merged["event_type"], "users", close("estimate"), close("merged")
    )


def _grouped_sql(grouping: str) -> str:
    return f"""
        SELECT l_returnflag, l_linestatus,
               CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS level,
               COUNT(*) AS n,
               CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS quantity
        FROM lineitem GROUP BY {grouping}
    """


def _line_totals(spark: SparkSession, sf_dir: str, group) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    sums = {"n": F.count("*"), "quantity": exact_sum(cents("l_quantity"), 2)}
    totals = totals_by(lines, group, ["l_returnflag", "l_linestatus"], sums)
    return totals.withColumn("quantity", F.col("quantity").cast("decimal(38,2)"))


@query(_grouped_sql("ROLLUP (l_returnflag, l_linestatus)"))
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_totals(spark, sf_dir, lambda df: df.rollup("l_returnflag", "l_linestatus"))


@query(_grouped_sql("CUBE (l_returnflag, l_linestatus)"))
def cube_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_totals(spark, sf_dir, lambda df: df.cube("l_returnflag", "l_linestatus"))


@query(_grouped_sql("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return _line_totals(
        spark, sf_dir, lambda df: df.groupingSets([[flag], [status], []], flag, status)
    )


@query("""
    SELECT user_id, COUNT(*) FILTER (event_type = 'click') AS click,
           COUNT(*) FILTER (event_type = 'error') AS error,
           COUNT(*) FILTER (event_type = 'purchase') AS purchase,
           COUNT(*) FILTER (event_type = 'signup') AS signup,
           COUNT(*) FILTER (event_type = 'view') AS view
    FROM events GROUP BY user_id
""")
def pivot_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    counts = read_table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).count()
    return counts.na.fill(0, kinds)


@query("""
    SELECT p_brand, 'largest_size' AS measure, CAST(MAX(p_size) AS DECIMAL(15,2)) AS value
    FROM part GROUP BY p_brand
    UNION ALL
    SELECT p_brand, 'smallest_size', CAST(MIN(p_size) AS DECIMAL(15,2)) FROM part GROUP BY p_brand
    UNION ALL
    SELECT p_brand, 'top_price', CAST(MAX(p_retailprice) AS DECIMAL(15,2)) FROM part GROUP BY p_brand
""")
def unpivot_part_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["largest_size", "smallest_size", "top_price"]
    wide = read_table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.max("p_size").cast("decimal(15,2)").alias("largest_size"),
        F.min("p_size").cast("decimal(15,2)").alias("smallest_size"),
        F.max(money("p_retailprice")).alias("top_price"),
    )
    return wide.unpivot("p_brand", measures, "measure", "value")


def _percentile_sql(fraction: str) -> str:
    at = f"({fraction} * (COUNT(*) - 1))"
    prices = "LIST(CAST(o_totalprice AS DECIMAL(15,2)) ORDER BY o_totalprice)"
    low = f"{prices}[CAST(FLOOR({at}) AS BIGINT) + 1]"
    high = f"{prices}[CAST(CEIL({at}) AS BIGINT) + 1]"
    rest = f"CAST({at} - FLOOR({at}) AS DECIMAL(10,6))"
    return f"CAST({low} + CAST({high} - {low} AS DECIMAL(15,2)) * {rest} AS DECIMAL(27,8))"


@query(f"""
    SELECT o_orderpriority, {_percentile_sql("0.5")} AS p50, {_percentile_sql("0.9")} AS p90
    FROM orders GROUP BY o_orderpriority
""")
def exact_price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderpriority", money("o_totalprice").alias("price")
    )
    found = exact_percentiles(orders, ["o_orderpriority"], "price", {"p50": "0.5", "p90": "0.9"})
    return found.select(
        "o_orderpriority", *[F.col(p).cast("decimal(27,8)").alias(p) for p in ("p50", "p90")]
    )


@query("""
    SELECT o_custkey, ARG_MAX(o_orderkey, (o_totalprice, o_orderkey)) AS dearest_order,
           ARG_MIN(o_orderkey, (o_orderdate, o_orderkey)) AS first_order
    FROM orders GROUP BY o_custkey
""")
def value_at_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest_order"),
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"),
    )


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice, place FROM (
        SELECT o_custkey, o_orderkey, o_totalprice,
               ROW_NUMBER() OVER (PARTITION BY o_custkey
                                  ORDER BY o_totalprice DESC, o_orderkey) AS place
        FROM orders)
    WHERE place <= 3
""")
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark keeps three rows per customer in each task before the shuffle."""
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    ranked = orders.withColumn("place", F.row_number().over(best)).where("place <= 3")
    return ranked.withColumn("place", F.col("place").cast("bigint"))


@query("""
    SELECT 'customer' AS party, c_name AS name, c_nationkey AS nationkey,
           CAST(c_acctbal AS DECIMAL(15,2)) AS balance FROM customer
    UNION ALL
    SELECT 'supplier', 'Supplier ' || s_suppkey, s_nationkey, CAST(s_acctbal AS DECIMAL(15,2))
    FROM supplier
""")
def union_of_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("party"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"),
        money("c_acctbal").alias("balance"),
    )
    suppliers = read_table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("party"),
        F.concat(F.lit("Supplier "), F.col("s_suppkey")).alias("name"),
        money("s_acctbal").alias("balance"),
        F.col("s_nationkey").alias("nationkey"),
    )
    return customers.unionByName(suppliers)


def _keys(spark: SparkSession, sf_dir: str, table: str, column: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, table).select(F.col(column).alias(name))


@query("""
    SELECT o_orderkey AS orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem
""")
def intersect_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distinct on both sides first, so that the join inside never meets copies of a key.
    ordered = _keys(spark, sf_dir, "orders", "o_orderkey", "orderkey").distinct()
    return ordered.intersect(_keys(spark, sf_dir, "lineitem", "l_orderkey", "orderkey").distinct())


@query("""
    SELECT c_nationkey AS nationkey FROM customer
    INTERSECT ALL SELECT s_nationkey FROM supplier
""")
def intersect_all_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _keys(spark, sf_dir, "customer", "c_nationkey", "nationkey")
    return customers.intersectAll(_keys(spark, sf_dir, "supplier", "s_nationkey", "nationkey"))


@query("""
    SELECT o_orderkey AS orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem
""")
def except_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = _keys(spark, sf_dir, "orders", "o_orderkey", "orderkey").distinct()
    return ordered.subtract(_keys(spark, sf_dir, "lineitem", "l_orderkey", "orderkey").distinct())


@query("""
    SELECT c_nationkey AS nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier
""")
def except_all_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _keys(spark, sf_dir, "customer", "c_nationkey", "nationkey")
    return customers.exceptAll(_keys(spark, sf_dir, "supplier", "s_nationkey", "nationkey"))
