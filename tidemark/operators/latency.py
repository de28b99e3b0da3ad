"""Latency histograms of calls: log-linear buckets, four for each power of two of microseconds, and what they sum up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST, LAST_EXP = 99, 24
OPS = ("LOOKUP", "READDIRPLUS", "GETATTR", "READ", "CREATE", "MKDIR", "WRITE", "COMMIT", "SETATTR", "RENAME")
DESTINATION_BOUND = SOURCE_BOUND = 85.0
STORE_BOUND, HEADROOM = 50.0, 60.0


def op_of(tag: Column) -> Column:
    return F.when(tag.isin("ROOT", "ROOTFH", "MOUNT"), "ROOTFH").when(tag.isin(*OPS), tag).otherwise("OTHER")


def bucket(us: Column) -> Column:
    exp = F.length(F.bin(us)) - 1  # the highest bit: exact, unlike a logarithm
    sub = F.when(exp >= 2, F.floor(us / F.pow(F.lit(2.0), exp - 2)).cast("long").bitwiseAND(3)).otherwise((us * F.pow(F.lit(2.0), 2 - exp)).cast("long").bitwiseAND(3))
    return F.when(us < 1, 0).when(exp >= LAST_EXP, LAST).otherwise(exp * 4 + sub).cast("int")


def upper(b: Column) -> Column:
    """The highest value of a bucket."""
    exp, sub = F.floor(b / 4), b % 4
    two = lambda n: F.pow(F.lit(2.0), n)
    return F.when(b >= LAST, 1 << LAST_EXP).when(exp >= 2, two(exp) + (sub + 1) * two(exp - 2) - 1).otherwise(two(exp + 1) - 1).cast("long")


def histogram(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sum and maximum of each bucket: additive, so that windows and workers can be merged."""
    return samples.groupBy(*keys, bucket(F.col("us")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("us").alias("total_us"), F.max("us").alias("max_us"))


def summary(hist: DataFrame, keys: list[str]) -> DataFrame:
    """count, mean_us, p50_us, p95_us, p99_us, max_us, total_us per key: a percentile is its bucket's highest value, at most the maximum."""
    w = Window.partitionBy(*keys)
    seen = hist.withColumn("_seen", F.sum("n").over(w.orderBy("bucket"))).withColumn("_count", F.sum("n").over(w)).withColumn("_max", F.max("max_us").over(w))
    value = F.when(F.col("bucket") == LAST, F.greatest("_max", upper(F.col("bucket")))).otherwise(F.least(upper(F.col("bucket")), F.greatest("_max", F.lit(1))))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("_seen") >= F.greatest(F.ceil(F.col("_count") * q), F.lit(1)), value))

    out = seen.groupBy(*keys).agg(F.sum("n").alias("count"), at(0.5).alias("p50_us"), at(0.95).alias("p95_us"), at(0.99).alias("p99_us"), F.max("max_us").alias("max_us"), F.sum("total_us").alias("total_us"))
    return out.withColumn("mean_us", F.floor(F.col("total_us") / F.col("count")))


def busy_share(samples: DataFrame, keys: list[str], window_us: int, pairs: int) -> DataFrame:
    """Percent of the pairs' time spent waiting on each side, and of the window in the object store."""
    per = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("us"))), F.lit(0))
    capacity = float(window_us * max(pairs, 1))
    return samples.groupBy(*keys).agg((per("src") * 100.0 / capacity).alias("src_busy_pct"), (per("dst") * 100.0 / capacity).alias("dst_busy_pct"), (per("s3") * 100.0 / float(window_us)).alias("s3_wait_pct"))


def fleet_ops(worker_ops: DataFrame) -> DataFrame:
    """Per side and op over workers: counts and totals add up, percentiles are the worst worker's."""
    out = worker_ops.groupBy("side", "op").agg(F.sum("count").alias("count"), F.sum("total_us").alias("total_us"), *[F.max(c).alias(c) for c in ("p50_us", "p95_us", "p99_us", "max_us")])
    return out.withColumn("mean_us", F.floor(F.col("total_us") / F.col("count")))


def fleet_verdict(shares: DataFrame) -> DataFrame:
    """One row: busy shares weighted by pairs (the store's is a plain mean) and what the fleet waits for. shares: with pairs."""
    pairs = F.greatest("pairs", F.lit(1))
    weighted = lambda c: F.sum(F.col(c) * pairs) / F.sum(pairs)
    one = shares.agg(F.count("*").alias("workers"), weighted("src_busy_pct").alias("src"), weighted("dst_busy_pct").alias("dst"), F.avg("s3_wait_pct").alias("s3"))
    verdict = F.when((F.col("dst") >= DESTINATION_BOUND) & (F.col("dst") >= F.col("src")), "destination-bound").when(F.col("src") >= SOURCE_BOUND, "source-bound").when(F.col("s3") >= STORE_BOUND, "store-bound").when(F.greatest("src", "dst") < HEADROOM, "client-bound").otherwise("mixed")
    return one.withColumn("verdict", verdict)


def windows(cumulative: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What each cumulative count gained since the one before it; never less than nothing."""
    w = Window.partitionBy(*keys).orderBy(order)
    return cumulative.withColumn("gained", F.greatest(F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0)), F.lit(0)))
