"""Scalar, array, map, JSON and calendar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions.calendar import business_days, instalments
from rowtide.functions.columns import cents, exact_sum
from rowtide.operators.aggregates import histogram
from rowtide.plans.catalog import query
from rowtide.sources.tables import read_table


@query(r"""
    SELECT p_partkey, UPPER(SUBSTR(p_name, 1, 5)) AS prefix,
           CAST(REGEXP_EXTRACT(p_brand, '#([0-9]+)', 1) AS INTEGER) AS brand_no,
           LIST_EXTRACT(STRING_SPLIT(p_name, ' '), -1) AS last_word,
           CAST(LENGTH(p_name) AS BIGINT) AS name_length,
           LOWER(p_type) || '/' || LPAD(CAST(p_size AS VARCHAR), 3, '0') AS code,
           REPLACE(p_name, ' ', '_') AS slug, REVERSE(p_type) AS backwards,
           STRPOS(p_name, 'e') AS first_e
    FROM part
""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper(F.substring("p_name", 1, 5)).alias("prefix"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("int").alias("brand_no"),
        F.element_at(F.split("p_name", " "), -1).alias("last_word"),
        F.length("p_name").cast("bigint").alias("name_length"),
        F.concat_ws("/", F.lower("p_type"), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("code"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("slug"),
        F.reverse("p_type").alias("backwards"),
        F.instr("p_name", "e").cast("bigint").alias("first_e"),
    )


@query("""
    SELECT o_orderkey, CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS month,
           CAST(YEAR(o_orderdate) AS BIGINT) AS year, CAST(QUARTER(o_orderdate) AS BIGINT) AS quarter,
           CAST(DAYOFWEEK(o_orderdate) + 1 AS BIGINT) AS weekday,
           CAST(DAYOFYEAR(o_orderdate) AS BIGINT) AS yearday,
           CAST(DATE_DIFF('day', o_orderdate, TIMESTAMP '2002-01-01') AS BIGINT) AS age_days,
           STRFTIME(LAST_DAY(o_orderdate), '%Y-%m-%d') AS month_end,
           STRFTIME(o_orderdate + INTERVAL 3 MONTHS, '%Y-%m-%d') AS due
    FROM orders
""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_trunc("month", day).cast("timestamp_ntz").alias("month"),
        F.year(day).cast("bigint").alias("year"),
        F.quarter(day).cast("bigint").alias("quarter"),
        F.dayofweek(day).cast("bigint").alias("weekday"),
        F.dayofyear(day).cast("bigint").alias("yearday"),
        F.datediff(F.lit("2002-01-01").cast("date"), day).cast("bigint").alias("age_days"),
        F.date_format(F.last_day(day), "yyyy-MM-dd").alias("month_end"),
        F.date_format(F.add_months(day, 3), "yyyy-MM-dd").alias("due"),
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
           ABS(l_quantity - 25) AS distance, SQRT(l_quantity) AS root,
           CAST(LN(l_extendedprice) AS DECIMAL(18,6)) AS log_price,
           ((l_linenumber - 5) % 3 + 3) % 3 AS slot,
           CAST(FLOOR(l_extendedprice) AS BIGINT) AS whole,
           CAST(CEIL(l_extendedprice) AS BIGINT) AS up,
           CAST(SIGN(l_quantity - 25) AS BIGINT) AS side, GREATEST(l_discount, l_tax) AS larger
    FROM lineitem
""")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.abs(F.col("l_quantity") - 25).alias("distance"),
        F.sqrt("l_quantity").alias("root"),
        F.ln("l_extendedprice").cast("decimal(18,6)").alias("log_price"),
        F.pmod(F.col("l_linenumber") - 5, F.lit(3)).alias("slot"),
        F.floor("l_extendedprice").alias("whole"),
        F.ceil("l_extendedprice").alias("up"),
        F.signum(F.col("l_quantity") - 25).cast("bigint").alias("side"),
        F.greatest("l_discount", "l_tax").alias("larger"),
    )


@query("""
    WITH parts AS (
        SELECT l_returnflag, l_extendedprice, [CAST(l_quantity AS DECIMAL(15,2)),
               CAST(l_discount AS DECIMAL(15,2)), CAST(l_tax AS DECIMAL(15,2))] AS a
        FROM lineitem)
    SELECT l_returnflag,
           CAST(SUM(LIST_SUM(LIST_TRANSFORM(a, lambda x: x * 2))) AS DECIMAL(38,2)) AS doubled,
           CAST(SUM(LEN(LIST_FILTER(a, lambda x: x >= 0.05))) AS BIGINT) AS large_values,
           CAST(SUM(LIST_MAX(a)) AS DECIMAL(38,2)) AS largest,
           COUNT(*) FILTER (LIST_CONTAINS(a, CAST(0.04 AS DECIMAL(15,2)))) AS with_four
    FROM parts GROUP BY l_returnflag
""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.array(cents("l_quantity"), cents("l_discount"), cents("l_tax")).alias("a")
    )
    doubled = F.aggregate(F.transform("a", lambda x: x * 2), F.lit(0).cast("bigint"), lambda t, x: t + x)
    return lines.groupBy("l_returnflag").agg(
        exact_sum(doubled, 2).alias("doubled"),
        F.sum(F.size(F.filter("a", lambda x: x >= 5))).alias("large_values"),
        exact_sum(F.array_max("a"), 2).alias("largest"),
        F.count(F.when(F.array_contains("a", F.lit(4).cast("bigint")), 1)).alias("with_four"),
    )


@query("""
    SELECT word, COUNT(*) AS n, SUM(place)::BIGINT AS places FROM (
        SELECT UNNEST(STRING_SPLIT(p_name, ' ')) AS word,
               UNNEST(RANGE(LEN(STRING_SPLIT(p_name, ' ')))) AS place
        FROM part)
    GROUP BY word
""")
def explode_name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part")
    words = parts.select(F.posexplode(F.split("p_name", " ")).alias("place", "word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.sum("place").alias("places"))


@query("""
    SELECT o_orderkey,
           CAST(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS INTEGER)
               AS status_code,
           o_orderstatus IN ('F', 'O', 'P') AS known
    FROM orders
""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.map_from_entries(
        F.array(*[F.struct(F.lit(s), F.lit(n)) for s, n in (("F", 3), ("O", 1), ("P", 2))])
    )
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.try_element_at(codes, "o_orderstatus").alias("status_code"),
        F.map_contains_key(codes, F.col("o_orderstatus")).alias("known"),
    )


@query("""
    SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(props ->> '$.k' AS BIGINT) AS k_variant
    FROM events
""")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        F.from_json("props", "k BIGINT")["k"].alias("k"),
        F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k_variant"),
    )


def _weekdays_before(day: str) -> str:
    # Whole weeks since a Monday, plus the weekdays of the week begun.
    days = f"DATE_DIFF('day', DATE '1990-01-01', CAST({day} AS DATE))"
    return f"(5 * ({days} // 7) + LEAST({days} % 7, 5))"


@query(f"""
    SELECT o_orderpriority, COUNT(*) AS n,
           CAST(SUM({_weekdays_before("GREATEST(o_orderdate, l_shipdate)")}
                - {_weekdays_before("LEAST(o_orderdate, l_shipdate)")}) AS BIGINT) AS business_days
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority
""")
def business_days_to_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    # Each pair of days is looked at once per priority, not once per line.
    pairs = joined.groupBy(
        "o_orderpriority",
        F.to_date("o_orderdate").alias("ordered"),
        F.to_date("l_shipdate").alias("shipped"),
    ).agg(F.count("*").alias("n"))
    days = F.abs(business_days(F.col("ordered"), F.col("shipped")))
    counted = pairs.select("o_orderpriority", "n", (days * F.col("n")).alias("days"))
    return counted.groupBy("o_orderpriority").agg(
        F.sum("n").alias("n"), F.sum("days").alias("business_days")
    )


@query("""
    SELECT l_returnflag, CAST(LEAST(GREATEST(FLOOR((l_quantity - 1) / 5), 0), 9) AS BIGINT) AS bin,
           COUNT(*) AS n
    FROM lineitem GROUP BY 1, 2
""")
def quantity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return histogram(lines, ["l_returnflag"], "l_quantity", low=1.0, width=5.0, bins=10)


@query("""
    WITH asked AS (
        SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) * 100 AS BIGINT) AS cents,
               CAST(SUBSTR(o_orderpriority, 1, 1) AS INTEGER) AS parts
        FROM orders),
    numbered AS (
        SELECT *, UNNEST(RANGE(1, parts + 1)) AS instalment FROM asked)
    SELECT o_orderkey, CAST(instalment AS INTEGER) AS instalment,
           CAST(cents // parts + CASE WHEN instalment <= cents % parts THEN 1 ELSE 0 END AS BIGINT)
               AS due_cents
    FROM numbered
""")
def order_instalments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        cents("o_totalprice").alias("cents"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("parts"),
    )
    due = instalments(orders)
    return due.withColumnRenamed("id", "o_orderkey")
