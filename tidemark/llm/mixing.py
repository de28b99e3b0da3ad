"""Op 2: mix sources to target weights by temperature.

Source token shares p are raised to an exponent a and normalised: weights w = p^a / sum(p^a). a = 1 keeps
the corpus as it is, a = 0 makes sources equal. The exponent is found by bisection over [0, 1]: the largest
that meets a target entropy of w, and then the least from there on that reads no source more often than a
limit allows. The weights become token budgets; each source deals its documents out in epochs, each a
permutation of its blocks and of the documents in each block, until the budget is used up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, materialise

WAYS, ROUNDS = 32, 8  # each round of the bisection measures 32 exponents in one job: 40 binary digits in all
LEAST_BLOCKS, BLOCK_ROWS = 256, 20_000
ADDED = ("mix_tokens", "mix_epoch", "mix_weight", "mix_position")


def token_count(text: Column) -> Column:
    """Words of the text, and one for its end: a document with no words counts one."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)) + 1).cast("long")


def _measure(sizes: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent the entropy of the weights, and the most and least that weight / tokens reaches; one row an exponent comes back."""
    t = F.col("source_tokens").cast("double")
    log_p = F.log(t / total)
    v = F.exp(log_p * F.col("a"))
    each = sizes.withColumn("a", F.explode(F.array(*map(F.lit, exponents))))
    sums = each.groupBy("a").agg(F.sum(v).alias("z"), F.sum(v * log_p * F.col("a")).alias("vl"), F.max(v / t).alias("most"), F.min(v / t).alias("least"))
    return [(math.log(r["z"]) - r["vl"] / r["z"], r["most"] / r["z"], r["least"] / r["z"]) for r in sorted(sums.collect(), key=lambda r: r["a"])]


def _bisect(measure: Callable[[list[float]], list], low: float, holds: Callable[[tuple], bool]) -> tuple[float, float]:
    """The last exponent in [low, 1] where `holds`, which is true up to some exponent, and the next one tried; both 1 if it holds throughout."""
    high = 1.0
    ends = measure([low, high] if low < high else [high])
    if not holds(ends[0]):
        return low, low
    if holds(ends[-1]):
        return 1.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / WAYS for i in range(1, WAYS)]
        true = sum(map(holds, measure(grid)))
        low, high = ([low, *grid][true], [*grid, high][true])
    return low, high


def find_exponent(sizes: DataFrame, target_entropy: float | None = None, max_epochs: float = 4.0, budget_tokens: float | None = None) -> tuple[float, float]:
    """(exponent, budget in tokens) for a table with the source_tokens of each source.

    target_entropy is a share of the highest possible entropy, log(sources); None: as even as the limit allows.
    max_epochs (1 or more) bounds how often a source is read, and always holds: where both cannot be met,
    the entropy gives way, and a budget above max_epochs times all tokens is cut to that. Without budget_tokens
    the budget is all tokens for an entropy, and otherwise as many as read the least repeated source exactly once.
    """
    if max_epochs < 1:
        raise ValueError("max_epochs must be 1 or more")
    total, n = sizes.agg(F.sum("source_tokens"), F.count("*")).first()
    if not n:
        return 1.0, 0.0

    def measure(exponents: list[float]) -> list:
        return _measure(sizes, total, exponents)

    if budget_tokens is not None:
        budget_tokens = min(float(budget_tokens), max_epochs * total)
    a = 0.0
    if target_entropy is not None:
        # Entropy falls from log(n) at a = 0 as the exponent grows.
        a, _ = _bisect(measure, 0.0, lambda m: m[0] >= target_entropy * math.log(n) - 1e-12)
        budget_tokens = float(total) if budget_tokens is None else budget_tokens

    def over(m: tuple) -> bool:
        budget = budget_tokens if budget_tokens is not None else 1 / m[2]
        return budget * m[1] > max_epochs * (1 + 1e-12)

    # The largest repetition falls to budget / total at a = 1; the second end of the last interval holds the limit.
    a = _bisect(measure, a, over)[1]
    return a, budget_tokens if budget_tokens is not None else 1 / measure([a])[0][2]


def mix(docs: DataFrame, tokens: Column, source: str = "source", target_entropy: float | None = None, max_epochs: float = 4.0, budget_tokens: float | None = None, tie_by: list[str] | None = None, least_blocks: int = LEAST_BLOCKS, block_rows: int = BLOCK_ROWS, seed: int = 11) -> DataFrame:
    """The rows that training reads, one for each time it reads them.

    Adds mix_tokens, mix_epoch (from 0), mix_weight (of the source) and mix_position in [0, 1): ordering by
    it interleaves sources at their weights. A row is read if its budget isn't used up where it starts, so a
    source exceeds its budget by less than one document, and a budget of whole epochs reads all rows. See
    find_exponent for the targets.

    Each source is dealt over at least least_blocks blocks, and over as many as leave block_rows rows in one
    if all rows were of one source. Null sources are one source. Rows that repeat are read like any others;
    rows that agree in all of tie_by may swap places. An empty table gives an empty result. Columns of
    the added names are replaced; names that begin with __mix_ are reserved.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    tie_by = tie_by or [c for c in kept if c != source]
    # Null sources are told from empty ones; joins and windows below share these keys, and so one shuffle.
    group = ["__mix_name", "__mix_null"]
    counted = docs.select("*", tokens.alias("__mix_tokens"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__mix_name"), F.isnull(source).alias("__mix_null"), F.xxhash64(F.lit(seed), *tie_by).alias("__mix_key"))
    blocks = max(least_blocks, -(-docs.count() // block_rows))
    rows = counted.drop(*ADDED).withColumn("__mix_block", F.pmod("__mix_key", F.lit(blocks)).cast("int"))
    per_block = materialise(rows.groupBy(*group, "__mix_block").agg(F.sum("__mix_tokens").alias("block_tokens")), "source-blocks")
    sizes = materialise(per_block.groupBy(*group).agg(F.sum("block_tokens").alias("source_tokens")), "source-sizes")

    exponent, budget = find_exponent(sizes, target_entropy, max_epochs, budget_tokens)
    total = sizes.agg(F.sum("source_tokens")).first()[0] or 1
    raised = F.exp(F.log(F.col("source_tokens") / F.lit(float(total))) * exponent)
    norm = sizes.agg(F.sum(raised)).first()[0] or 1.0
    plan = sizes.withColumn("mix_weight", raised / norm).withColumn("budget", F.col("mix_weight") * budget)
    # A budget of whole epochs that rounding puts a hair higher is still whole epochs.
    plan = plan.withColumn("epochs", F.ceil(F.col("budget") / F.col("source_tokens") - 1e-9).cast("int")).where("epochs > 0")

    # Blocks of all epochs in the order of each, with the tokens before each: blocks x epochs small rows a source.
    dealt = per_block.join(plan, group).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    in_epoch = Window.partitionBy(*group, "mix_epoch").orderBy(F.xxhash64(F.lit(seed), "mix_epoch", "__mix_block"), "__mix_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("mix_epoch") * F.col("source_tokens") + F.coalesce(F.sum("block_tokens").over(in_epoch), F.lit(0))
    dealt = dealt.select(*group, "__mix_block", "mix_epoch", "mix_weight", F.col("budget").alias("__mix_budget"), before.alias("__mix_before")).where("__mix_before < __mix_budget")

    read = rows.join(dealt, [*group, "__mix_block"])
    in_block = Window.partitionBy(*group, "__mix_block", "mix_epoch").orderBy(F.xxhash64("__mix_key", "mix_epoch"), "__mix_key", *tie_by)
    ahead = F.sum("__mix_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, -1))
    read = read.withColumn("__mix_at", F.col("__mix_before") + F.coalesce(ahead, F.lit(0)))
    # Less than one token over is rounding, not budget.
    read = read.where(F.col("__mix_at") < F.col("__mix_budget") - 1e-6)
    return read.select(*kept, F.col("__mix_tokens").alias("mix_tokens"), "mix_epoch", "mix_weight", (F.col("__mix_at") / F.col("__mix_budget")).alias("mix_position"))
