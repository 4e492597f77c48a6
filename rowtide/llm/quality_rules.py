"""Quality rules as weak supervision: rules vote or abstain, and a model weighs the votes.

Each rule votes that a text is good or bad, or abstains. How often a rule is right about good
and about bad texts is not given: expectation-maximisation estimates it, with the share of
good texts, from the votes alone. A text's posterior probability of being good then decides,
so one vote against a text weighs as much as that rule has earned. Votes are few distinct
patterns, so the estimate runs over counts of patterns, never over texts.

Everything is built-in functions; statistics of a text are computed in its row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.llm.words import free_name, without
from rowtide.session import written

BLANK = r"[\x20\x09-\x0D]+"
POSITION_BITS = 24
# Words of a block: in longer texts the share of distinct words falls, and that of repeated windows rises.
BLOCK = 1000
# A word without letters and digits.
BARE = r"(?<![^\\x20\\x09-\\x0D])[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+(?![^\\x20\\x09-\\x0D])"


@dataclass(frozen=True)
class Rule:
    """Conditions in SQL over the statistics; where neither holds, the rule abstains."""

    name: str
    bad: str
    good: str


# Votes for a text need enough words to tell. Each kind of junk should be within sight of two
# rules at least: votes that agree are what the estimate learns from.
RULES = (
    Rule("symbols", "n_symbols > 0.10 * n_words", "n_words >= 20 AND n_symbols <= 0.02 * n_words"),
    Rule("repeated_words", "n_block_repeats > 0.35 * n_words", "n_words >= 20 AND n_block_repeats <= 0.20 * n_words"),
    Rule("few_words", "n_words >= 20 AND n_block_distinct < 0.2 * n_words", "n_words >= 20 AND n_block_distinct >= 0.4 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.5 * n_lines", "n_lines >= 3 AND n_dup_lines <= 0.2 * n_lines"),
    Rule("capitals", "n_upper > 0.5 * word_chars", "n_words >= 20 AND n_upper <= 0.15 * word_chars"),
    Rule("marks", "n_marks > 0.2 * word_chars", "n_words >= 20 AND n_marks <= 0.1 * word_chars"),
    Rule("word_length", "word_chars > 15 * n_words", "n_words >= 20 AND word_chars BETWEEN 2.5 * n_words AND 10 * n_words"),
    Rule("exclamations", "n_exclaims > 0.3 * n_words", "n_words >= 20 AND n_exclaims <= 0.1 * n_words"),
    Rule("bare_marks", "n_bare > 0.25 * n_words", "n_words >= 20 AND n_bare <= 0.05 * n_words"),
)

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks",
    "n_exclaims", "n_bare", "n_block_distinct", "n_block_repeats",
)


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns in ``STATISTICS`` (bigint) of each whole text; no shuffle.

    Words are what stands between blanks (space, tab to carriage return). ``n_repeat_words``
    counts the words that stand in a three-word window found twice or more in the text. To
    find those, windows are hashed. Where all hashes differ, nothing repeats. Else they are sorted
    as numbers with the position in the lowest bits, and windows next to one with the same hash
    are compared word by word, so that hashes never decide. ``n_block_distinct`` and
    ``n_block_repeats`` are ``n_distinct`` and ``n_repeat_words`` with words and windows compared
    within blocks of ``BLOCK`` words only, summed over the blocks; these cover the whole text.
    Null texts count as empty and have zeros; columns of the added names are replaced.
    """
    base = without(df, [*STATISTICS])
    value, words_ = free_name(base, "value"), free_name(base, "words_")
    words = F.array_remove(F.split(F.col(value), BLANK), "")
    step = base.withColumn(value, F.coalesce(F.col(text), F.lit(""))).withColumn(words_, words)
    lines = F.filter(F.split(F.col(value), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed, packed, near, lined = (free_name(base, n) for n in ("hashed", "packed", "near", "lined"))
    window = f"struct({words_}[i], {words_}[i + 1], {words_}[i + 2])"
    small = f"size({words_}) - 2 < {1 << POSITION_BITS}"
    single = f"transform({words_}, w -> xxhash64(w))"
    step = step.withColumn(lined, lines).withColumn(hashed, F.expr(single))
    joint = f"transform(sequence(0, size({hashed}) - 3), i -> xxhash64({hashed}[i], {hashed}[i + 1], {hashed}[i + 2]))"
    step = step.withColumn(hashed, F.expr(f"CASE WHEN size({hashed}) < 4 THEN CAST(array() AS ARRAY<BIGINT>) ELSE {joint} END"))
    repeats = f"size(array_distinct({hashed})) < size({hashed})"
    keys = f"sort_array(transform({hashed}, (h, i) -> shiftleft(shiftright(h, {POSITION_BITS}), {POSITION_BITS}) + i))"
    step = step.withColumn(packed, F.expr(f"CASE WHEN {repeats} AND {small} THEN {keys} ELSE CAST(array() AS ARRAY<BIGINT>) END"))
    bits, low = POSITION_BITS, (1 << POSITION_BITS) - 1

    def shared(k: str) -> str:
        return f"coalesce(shiftright(get({packed}, {k}), {bits}) = shiftright(x, {bits}), false)"

    # Positions whose window shares its hash with another one; in a text of 2**24 words or more, all.
    maybe = f"transform(filter({packed}, (x, k) -> {shared('k - 1')} OR {shared('k + 1')}), x -> CAST(x & {low} AS INT))"
    step = step.withColumn(near, F.expr(f"CASE WHEN size({words_}) < 4 OR {small} THEN {maybe} ELSE sequence(0, size({words_}) - 3) END"))
    ordered, found = free_name(base, "ordered"), free_name(base, "found")
    step = step.withColumn(ordered, F.expr(f"sort_array(transform({near}, i -> struct({window} AS w, i AS i)))"))
    same = f"coalesce(get({ordered}, k - 1).w = x.w, false) OR coalesce(get({ordered}, k + 1).w = x.w, false)"
    step = step.withColumn(found, F.expr(f"sort_array(transform(filter({ordered}, (x, k) -> {same}), x -> x.i))"))
    # Windows in order cover three words each, less what the one before covers already.
    def covered(at: str) -> str:
        return f"aggregate({at}, struct(CAST(0 AS BIGINT) AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)"

    # Equal windows are in the order of their positions, so that those of one block are neighbours.
    def beside(k: str) -> str:
        return f"coalesce(get({ordered}, {k}).w = x.w AND get({ordered}, {k}).i DIV {BLOCK} = x.i DIV {BLOCK}, false)"

    in_block = free_name(base, "in_block")
    block = f"sort_array(transform(filter({ordered}, (x, k) -> {beside('k - 1')} OR {beside('k + 1')}), x -> x.i))"
    step = step.withColumn(in_block, F.expr(f"CASE WHEN size({words_}) <= {BLOCK} THEN {found} ELSE {block} END"))
    distinct = f"aggregate(sequence(0, size({words_}) - 1, {BLOCK}), CAST(0 AS BIGINT), (a, i) -> a + size(array_distinct(slice({words_}, i + 1, {BLOCK}))))"
    every = {
        "n_words": f"CAST(size({words_}) AS BIGINT)",
        "word_chars": f"CAST(length(array_join({words_}, '')) AS BIGINT)",
        "n_symbols": f"CAST(length(regexp_replace({value}, '[^#*$%&|<>]+', '')) AS BIGINT)",
        "n_dup_lines": f"CAST(size({lined}) - size(array_distinct({lined})) AS BIGINT)",
        "n_repeat_words": covered(found),
        "n_lines": f"CAST(size({lined}) AS BIGINT)",
        "n_distinct": f"CAST(size(array_distinct({words_})) AS BIGINT)",
        "n_upper": f"CAST(length(regexp_replace({value}, '\\\\P{{Lu}}+', '')) AS BIGINT)",
        "n_marks": f"CAST(length(regexp_replace({value}, '[^!-/:-@\\\\[-`{{-~]+', '')) AS BIGINT)",
        "n_exclaims": f"CAST(length({value}) - length(replace({value}, '!', '')) AS BIGINT)",
        "n_bare": f"CAST(size(split({value}, '{BARE}')) - 1 AS BIGINT)",
        "n_block_distinct": f"CASE WHEN size({words_}) <= {BLOCK} THEN CAST(size(array_distinct({words_})) AS BIGINT) ELSE {distinct} END",
        "n_block_repeats": covered(in_block),
    }
    return step.select(*base.columns, *[F.expr(sql).alias(name) for name, sql in every.items()])


def votes(df: DataFrame, rules: Sequence[Rule], name: str = "votes") -> DataFrame:
    """Adds an array with 1 (good), 0 (bad) or null (abstains) for each rule."""
    cast = [F.expr(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 END") for r in rules]
    return df.withColumn(name, F.array(*cast))


# Where the estimate starts, and made-up votes per rule, WEIGHT of them and PRIOR for each real one.
# They are part of every update: rules that hardly vote stay near the start, and as made-up votes
# grow with the real ones, no rule counts as infallible, and estimates are alike at every size: a
# rule that errs on one good text in twenty is estimated to err on 4.7 per cent. Bad texts differ
# from each other: a rule sees few of them, and seldom errs on good ones, but so often that one bad vote against eight good ones starts as good (odds of 2).
SHARE_GOOD, RIGHT_ON_GOOD, RIGHT_ON_BAD, WEIGHT, PRIOR = 0.8, 0.98, 0.2, 20.0, 0.1


def _estimate_sql(rules: int, rounds: int) -> str:
    """Expectation-maximisation over ``p``, an array of (v: votes, n: count), as one expression.

    The state holds the share of good texts and, for each rule, how often a vote is right on
    good and on bad texts.
    """
    odds = (
        f"ln(s.share) - ln(1 - s.share) + aggregate(sequence(0, {rules - 1}), CAST(0 AS DOUBLE), (a, r) -> a + CASE x.v[r] "
        "WHEN 1 THEN ln(s.good[r]) - ln(1 - s.bad[r]) WHEN 0 THEN ln(1 - s.good[r]) - ln(s.bad[r]) ELSE 0 END)"
    )
    expected = f"transform(p, x -> struct(x.v AS v, x.n AS n, x.n / (1 + exp(-({odds}))) AS q))"

    def share(r: str, vote: int, mass: str, right: float) -> str:
        part = f"aggregate(e, CAST(0 AS DOUBLE), (a, y) -> a + CASE WHEN y.v[{r}] = {vote} THEN {mass} ELSE 0 END)"
        both = f"aggregate(e, CAST(0 AS DOUBLE), (a, y) -> a + CASE WHEN y.v[{r}] IS NOT NULL THEN {mass} ELSE 0 END)"
        return f"({part} + {right} * ({WEIGHT} + {PRIOR} * {both})) / ((1 + {PRIOR}) * {both} + {WEIGHT})"

    total = "aggregate(e, CAST(0 AS DOUBLE), (a, y) -> a + y.n)"
    good = "aggregate(e, CAST(0 AS DOUBLE), (a, y) -> a + y.q)"
    update = (
        f"struct(({good} + {SHARE_GOOD * WEIGHT}) / ({total} + {WEIGHT}) AS share, "
        f"transform(sequence(0, {rules - 1}), r -> {share('r', 1, 'y.q', RIGHT_ON_GOOD)}) AS good, "
        f"transform(sequence(0, {rules - 1}), r -> {share('r', 0, '(y.n - y.q)', RIGHT_ON_BAD)}) AS bad)"
    )
    start = f"struct(CAST({SHARE_GOOD} AS DOUBLE) AS share, array_repeat(CAST({RIGHT_ON_GOOD} AS DOUBLE), {rules}) AS good, array_repeat(CAST({RIGHT_ON_BAD} AS DOUBLE), {rules}) AS bad)"
    return f"aggregate(sequence(1, {rounds}), {start}, (s, k) -> transform(array({expected}), e -> {update})[0])"


def rule_accuracies(voted: DataFrame, rules: Sequence[Rule] = RULES, name: str = "votes", rounds: int = 30) -> DataFrame:
    """One row: ``share``, ``good`` and ``bad`` (arrays, by rule), estimated from all votes.

    There are at most 3 ** len(rules) patterns of votes, whatever the number of rows; they
    are counted before the shuffle and gathered as one array.
    """
    patterns = voted.groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("p"))
    return one.select(F.expr(_estimate_sql(len(rules), rounds)).alias("m")).select("m.*")


def quality_posterior(voted: DataFrame, rules: Sequence[Rule] = RULES, name: str = "votes") -> DataFrame:
    """Adds ``p_good``, the posterior probability that a text is good; a text on which every
    rule abstains has the share of good texts. The model is one row of a few numbers, which
    become constants of the expression."""
    base = without(voted, ["p_good"])
    model = rule_accuracies(base, rules, name).first()
    odds = F.lit(math.log(model["share"]) - math.log(1 - model["share"]))
    for r, (good, bad) in enumerate(zip(model["good"], model["bad"])):
        vote = F.col(name)[r]
        odds += F.when(vote == 1, math.log(good) - math.log(1 - bad)).when(vote == 0, math.log(1 - good) - math.log(bad)).otherwise(0.0)
    return base.withColumn("p_good", 1 / (1 + F.exp(-odds)))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def judged(statistics: DataFrame, rules: Sequence[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """Adds ``votes``, ``p_good``, ``base_failed`` and ``kept`` to a table with the statistics.

    Kept are texts that do not fail the base and whose posterior is at least ``least``. The
    table is read twice, for the estimate and for the verdict, so it should be written. All
    rows stay; null and empty texts fail the base; repeated rows are judged alike and count
    as often as they occur; an empty table gives no rows.
    """
    scored = quality_posterior(votes(without(statistics, ["votes", "p_good", "base_failed", "kept"]), rules))
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    known = written(text_statistics(docs).drop("text"), "statistics")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(known).select("doc_id", *columns, "p_good")
