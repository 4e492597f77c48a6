"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

In a uniformly random order of all rows, cut into shards, the numbers of rows that each input
partition sends to each shard follow a multivariate hypergeometric law. That matrix is drawn
first: partitions are halved again and again, and for each half the rows that it sends to
every shard are drawn given what both halves send. Then each partition puts its own rows in
random order and deals them out by its row of the matrix, the rows are exchanged, and each
shard orders what it got at random again. Shard sizes differ by one row at most.

All built-in functions. Random numbers are hashes of a seed and of what they are for, so a
lost task draws the same numbers again.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.llm.words import free_name, without
from rowtide.session import written

ROW_BITS = 33  # of monotonically_increasing_id
# A draw looks this many standard deviations, and 20 values, to each side of its likeliest value; one
# from further out, of a probability far below that of any uniform number's last bit, gives the
# likeliest value. Sums of rows and columns are exact either way.
REACH = 12


def _log_factorial(x: str) -> str:
    """Logarithm of x!, exact for small x and by Stirling's series beyond."""
    series = f"({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1 / (12D * {x}) - 1 / (360D * {x} * {x} * {x})"
    return f"CASE WHEN {x} < 20 THEN ln(CAST(factorial(CAST({x} AS INT)) AS DOUBLE)) ELSE {series} END"


def _log_choose(n: str, k: str) -> str:
    return f"(({_log_factorial(n)}) - ({_log_factorial(k)}) - ({_log_factorial(f'({n} - {k})')}))"


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for one draw: marked rows among ``drawn`` of ``total`` rows, ``marked`` of them marked.

    Values are tried outwards from the likeliest one, each probability from its neighbour's,
    until they add up to the uniform number.
    """
    lowest, highest = f"greatest(0D, {drawn} - ({total} - {marked}))", f"least({drawn}, {marked})"
    mode = f"least({highest}, greatest({lowest}, floor((({drawn} + 1D) * ({marked} + 1D)) / ({total} + 2D))))"
    spread = f"sqrt(greatest(0D, {drawn} * ({marked} / {total}) * (1 - {marked} / {total}) * ({total} - {drawn}) / greatest(1D, {total} - 1)))"
    up = "(m.k0 + i - 1)"
    down = "(m.k0 - i + 1)"
    step_up = f"a.up * ((m.marked - {up}) * (m.drawn - {up})) / (({up} + 1) * (m.total - m.marked - m.drawn + {up} + 1))"
    step_down = f"a.dn * ({down} * (m.total - m.marked - m.drawn + {down})) / ((m.marked - {down} + 1) * (m.drawn - {down} + 1))"
    step_up = f"CASE WHEN m.k0 + i > m.hi THEN 0D ELSE {step_up} END"
    step_down = f"CASE WHEN m.k0 - i < m.lo THEN 0D ELSE {step_down} END"
    chosen = (
        "CASE WHEN a.u < 0 THEN a "
        "WHEN a.u - b.up < 0 THEN struct(-1D AS u, m.k0 + i AS k, b.up AS up, b.dn AS dn) "
        "WHEN a.u - b.up - b.dn < 0 THEN struct(-1D AS u, m.k0 - i AS k, b.up AS up, b.dn AS dn) "
        "ELSE struct(a.u - b.up - b.dn AS u, a.k AS k, b.up AS up, b.dn AS dn) END"
    )
    p0 = f"exp({_log_choose('m.marked', 'm.k0')} + {_log_choose('(m.total - m.marked)', '(m.drawn - m.k0)')} - {_log_choose('m.total', 'm.drawn')})"
    inner = f"transform(array(struct({step_up} AS up, {step_down} AS dn)), b -> {chosen})[0]"
    inner = f"CASE WHEN a.u < 0 THEN a ELSE {inner} END"
    walk = f"aggregate(sequence(1, CAST(m.steps AS INT)), struct(m.u - m.p0 AS u, m.k0 AS k, m.p0 AS up, m.p0 AS dn), (a, i) -> {inner}, a -> a.k)"
    given = (
        f"struct({total} AS total, {marked} AS marked, {drawn} AS drawn, {uniform} AS u, {lowest} AS lo, {highest} AS hi, "
        f"{mode} AS k0, ceil({REACH} * {spread}) + 20 AS steps)"
    )
    with_p0 = f"transform(array({given}), m -> struct(m.total AS total, m.marked AS marked, m.drawn AS drawn, m.u AS u, m.lo AS lo, m.hi AS hi, m.k0 AS k0, m.steps AS steps, {p0} AS p0))"
    return f"CASE WHEN {total} <= 0 OR {drawn} <= 0 OR {marked} <= 0 THEN 0D WHEN {drawn} >= {total} THEN {marked} ELSE transform({with_p0}, m -> {walk})[0] END"


def _uniform(*parts: str) -> str:
    return f"((xxhash64({', '.join(parts)}) & {(1 << 53) - 1}) + 0.5D) / {1 << 53}D"


def _left_half(seed: int, shards: int) -> str:
    """Rows of each shard that the left half of a node's partitions gets, as an array.

    Shards are drawn one after the other, each from the rows and places that are left.
    """
    draw = hypergeometric("s.total", "need[j]", "s.places", _uniform(str(seed), "low", "high", "j"))
    step = (
        f"transform(array({draw}), x -> struct(s.total - need[j] AS total, s.places - x AS places, "
        "concat(s.out, array(x)) AS out))[0]"
    )
    return f"aggregate(sequence(0, {shards - 1}), struct(rows AS total, rows_left AS places, CAST(array() AS ARRAY<DOUBLE>) AS out), (s, j) -> {step}, s -> s.out)"


def communication_matrix(sizes: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``part`` and ``sends`` (array by shard) for a table of ``part`` and ``count``.

    Row sums are the counts, column sums differ by one at most. Only counts are handled: one
    array of as many numbers as there are partitions goes down the halvings in slices.
    """
    n = sizes.count()
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("part", F.col("count").cast("double").alias("n")))).alias("parts"))
    total = "aggregate(parts, 0D, (a, x) -> a + x.n)"
    node = listed.select(
        "parts",
        F.expr(f"transform(sequence(0, {shards - 1}), j -> floor(({total} + {shards - 1} - j) / {shards}D) + 0D)").alias("need"),
        F.lit(0).alias("low"), F.size("parts").alias("high"),
    )
    for level in range(ceil(log2(max(n, 1)))):
        middle = "CAST((high - low + 1) DIV 2 AS INT)"
        halves = node.withColumn("left", F.expr(f"slice(parts, 1, {middle})")).withColumn("right", F.expr(f"slice(parts, {middle} + 1, greatest(high - low - {middle}, 0))"))
        halves = halves.withColumn("rows_left", F.expr("aggregate(left, 0D, (a, x) -> a + x.n)")).withColumn("rows", F.expr("aggregate(parts, 0D, (a, x) -> a + x.n)"))
        drawn = halves.withColumn("drawn", F.expr(f"CASE WHEN size(right) = 0 THEN need ELSE {_left_half(seed, shards)} END"))
        both = drawn.select(F.explode(F.expr(
            f"array(struct(left AS parts, drawn AS need, low AS low, low + size(left) AS high), "
            f"struct(right AS parts, zip_with(need, drawn, (a, b) -> a - b) AS need, low + size(left) AS low, high AS high))"
        )).alias("h"))
        node = both.select("h.*").filter("size(parts) > 0")
        if level % 6 == 5:
            node = node.repartition("low")
    return node.filter("size(parts) > 0").select(F.expr("parts[0].part").alias("part"), F.expr("transform(need, x -> CAST(x AS BIGINT))").alias("sends"))


def _row_key(seed: int, purpose: int, columns: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(purpose), *columns)


def shard_documents(df: DataFrame, shards: int, key: list[str], seed: int = 0) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (bigint, gapless from 0 in each shard) to every row.

    ``key`` names columns that tell rows apart; their hash orders rows at random, and rows
    that agree in all of them are interchangeable, so nulls, ties and repeated rows are dealt
    out like any others. With fewer rows than shards the last shards stay empty. Columns of
    the added names are replaced; an empty table gives no rows.
    """
    spark = df.sparkSession
    base = without(df, ["shard", "slot"])
    place, order = free_name(base, "place"), free_name(base, "order")
    mask = (1 << ROW_BITS) - 1
    # Permute locally: a row's place in its partition, in random order. Written, so that the
    # places hold when a task is run again.
    local = base.withColumn(order, _row_key(seed, 1, key)).sortWithinPartitions(order, *key).withColumn(place, F.monotonically_increasing_id())
    local = written(local.drop(order), "sharding")
    part = F.shiftright(place, ROW_BITS).alias("part")
    sizes = written(local.groupBy(part).count(), "sharding-sizes")
    matrix = written(communication_matrix(sizes, shards, seed), "sharding-matrix")
    limits = F.expr("transform(sequence(1, size(sends)), j -> aggregate(slice(sends, 1, j), CAST(0 AS BIGINT), (a, x) -> a + x))")
    matrix = matrix.select("part", limits.alias("limits"))
    row = F.col(place).bitwiseAND(mask)
    dealt = local.join(matrix, F.shiftright(place, ROW_BITS) == F.col("part"))
    dealt = dealt.withColumn("shard", F.size(F.filter("limits", lambda x: x <= row)).cast("int")).drop("part", "limits")
    # Exchange, and permute again: rows sorted by shard and a second hash, over all partitions.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(dealt.withColumn(order, _row_key(seed, 2, [*key, place])), "sharding-dealt")
    arranged = dealt.repartitionByRange(tasks, "shard", order).sortWithinPartitions("shard", order, place)
    arranged = written(arranged.drop(order, place).withColumn(place, F.monotonically_increasing_id()), "sharding-sorted")
    # Slots: places over all partitions, less where the shard begins; one row per run.
    runs = arranged.groupBy(F.shiftright(place, ROW_BITS).alias("p"), F.col("shard").alias("s")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    joined = arranged.join(runs, (F.shiftright(place, ROW_BITS) == F.col("p")) & (F.col("shard") == F.col("s")))
    return joined.withColumn("slot", F.col(place) - F.col("first") + F.col("before")).select(*base.columns, "shard", "slot")


@query()
def op4_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sharded = shard_documents(rows, shards=40, key=["doc_id", "size", "text_crc32"])
    return sharded.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
