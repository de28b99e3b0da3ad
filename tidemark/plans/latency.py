"""Queries over operators.latency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import latency as L
from tidemark.plans.registry import query

HIST = """o AS (SELECT *, CASE WHEN tag IN ('ROOT', 'ROOTFH', 'MOUNT') THEN 'ROOTFH' WHEN tag IN ('LOOKUP', 'READ', 'WRITE') THEN tag ELSE 'OTHER' END AS op, length(bin(us)) - 1 AS e FROM samples),
  b AS (SELECT *, CAST(CASE WHEN us < 1 THEN 0 WHEN e >= 24 THEN 99 ELSE e * 4 + CASE WHEN e >= 2 THEN (us >> (e - 2)) & 3 ELSE (us << (2 - e)) & 3 END END AS INTEGER) AS bucket FROM o),
  h AS (SELECT worker_id, side, op, bucket, count(*) AS n, CAST(sum(us) AS BIGINT) AS total_us, max(us) AS max_us FROM b GROUP BY ALL),
  u AS (SELECT *, CASE WHEN bucket >= 99 THEN 16777216 WHEN bucket // 4 >= 2 THEN (1 << (bucket // 4)) + (bucket % 4 + 1) * (1 << (bucket // 4 - 2)) - 1 ELSE (1 << (bucket // 4 + 1)) - 1 END AS upper FROM h)"""


def summed(keys: str, name: str, source: str = "u") -> str:
    return f"""{name}_h AS (SELECT {keys}, bucket, max(upper) AS upper, sum(n) AS n, sum(total_us) AS total_us, max(max_us) AS max_us FROM {source} GROUP BY {keys}, bucket),
  {name}_s AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY {keys}) AS c, max(max_us) OVER (PARTITION BY {keys}) AS m FROM {name}_h),
  {name}_v AS (SELECT *, CASE WHEN bucket = 99 THEN greatest(m, upper) ELSE least(upper, greatest(m, 1)) END AS v FROM {name}_s),
  {name} AS (SELECT {keys}, CAST(sum(n) AS BIGINT) AS count, CAST(min(v) FILTER (seen >= greatest(ceil(c * 0.5), 1)) AS BIGINT) AS p50_us, CAST(min(v) FILTER (seen >= greatest(ceil(c * 0.95), 1)) AS BIGINT) AS p95_us,
    CAST(min(v) FILTER (seen >= greatest(ceil(c * 0.99), 1)) AS BIGINT) AS p99_us, max(max_us) AS max_us, CAST(sum(total_us) AS BIGINT) AS total_us, CAST(floor(sum(total_us) / sum(n)) AS BIGINT) AS mean_us FROM {name}_v GROUP BY {keys})"""


def with_op(samples):
    return samples.withColumn("op", L.op_of(F.col("tag")))


@query("latency_histogram", "samples", sql=f"{HIST} SELECT worker_id, side, op, bucket, n, total_us, max_us FROM h")
def latency_histogram(samples):
    return L.histogram(with_op(samples), ["worker_id", "side", "op"])


@query("agg_latency", "samples", sql=f"{HIST}, {summed('side, op', 's')} SELECT * FROM s")
def agg_latency(samples):
    return L.summary(L.histogram(with_op(samples), ["side", "op"]), ["side", "op"])


SHARES = "p AS (SELECT worker_id, coalesce(sum(us) FILTER (side = 'src'), 0) * 100.0 / 1999999874.0 AS src_busy_pct, coalesce(sum(us) FILTER (side = 'dst'), 0) * 100.0 / 1999999874.0 AS dst_busy_pct, coalesce(sum(us) FILTER (side = 's3'), 0) * 100.0 / 999999937.0 AS s3_wait_pct, 1 + CAST(substr(worker_id, 3) AS INTEGER) % 4 AS pairs FROM samples GROUP BY worker_id)"


@query("agg_busy_share", "samples", sql=f"{SHARES} SELECT worker_id, round(src_busy_pct, 6) AS src_busy_pct, round(dst_busy_pct, 6) AS dst_busy_pct, round(s3_wait_pct, 6) AS s3_wait_pct FROM p")
def agg_busy_share(samples):
    shares = L.busy_share(samples, ["worker_id"], 999_999_937, 2)
    return shares.select("worker_id", *[F.round(c, 6).alias(c) for c in ("src_busy_pct", "dst_busy_pct", "s3_wait_pct")])


@query("agg_fleet_latency", "samples", sql=f"{HIST}, {summed('worker_id, side, op', 'w')} SELECT side, op, CAST(sum(count) AS BIGINT) AS count, CAST(sum(total_us) AS BIGINT) AS total_us, max(p50_us) AS p50_us, max(p95_us) AS p95_us, max(p99_us) AS p99_us, max(max_us) AS max_us, CAST(floor(sum(total_us) / sum(count)) AS BIGINT) AS mean_us FROM w GROUP BY side, op")
def agg_fleet_latency(samples):
    keys = ["worker_id", "side", "op"]
    return L.fleet_ops(L.summary(L.histogram(with_op(samples), keys), keys))


@query("agg_fleet_verdict", "samples", sql=f"""{SHARES}, f AS (SELECT count(*) AS workers, sum(src_busy_pct * pairs) / sum(pairs) AS src, sum(dst_busy_pct * pairs) / sum(pairs) AS dst, avg(s3_wait_pct) AS s3 FROM p)
  SELECT workers, round(src, 6) AS src, round(dst, 6) AS dst, round(s3, 6) AS s3, CASE WHEN dst >= 85 AND dst >= src THEN 'destination-bound' WHEN src >= 85 THEN 'source-bound' WHEN s3 >= 50 THEN 'store-bound' WHEN greatest(src, dst) < 60 THEN 'client-bound' ELSE 'mixed' END AS verdict FROM f""")
def agg_fleet_verdict(samples):
    shares = L.busy_share(samples, ["worker_id"], 999_999_937, 2)
    one = L.fleet_verdict(shares.withColumn("pairs", 1 + F.substring("worker_id", 3, 9).cast("int") % 4))
    return one.select("workers", *[F.round(c, 6).alias(c) for c in ("src", "dst", "s3")], "verdict")


@query("win_lat_diff", "samples", sql="""d AS (SELECT side, tag, CAST(floor(epoch(event_at) / 86400) AS BIGINT) AS day, count(*) AS k FROM samples GROUP BY ALL),
  c AS (SELECT side, tag, day, CAST(sum(k) OVER (PARTITION BY side, tag ORDER BY day) AS BIGINT) AS n FROM d) SELECT side, tag, day, n, greatest(n - coalesce(lag(n) OVER (PARTITION BY side, tag ORDER BY day), 0), 0) AS gained FROM c""")
def win_lat_diff(samples):
    day = F.floor(F.unix_seconds(F.col("event_at").cast("timestamp")) / 86400)
    daily = samples.groupBy("side", "tag", day.alias("day")).agg(F.count("*").alias("k"))
    return L.windows(daily.select("side", "tag", "day", F.sum("k").over(Window.partitionBy("side", "tag").orderBy("day")).alias("n")), ["side", "tag"], "day")
