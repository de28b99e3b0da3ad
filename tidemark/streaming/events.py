"""The event log as a stream: ingest without repeats, running progress, windowed rates. State with timers is in streaming.live.

Order within a key comes from seq, which its single writer assigns; a micro-batch is sorted by it. Batch folds
(operators.eventlog) are the authority: replaying the log gives what the stream arrived at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.scratch import scratch_path

LATE = "10 minutes"


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there now, and read back what it wrote. In update mode rows carry the micro-batch."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, f"{name}-checkpoint"))
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        # One folder a micro-batch: a batch that runs again replaces its own rows.
        query = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out)


def ingest(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each stamped event of a worker once, if its repeats come within the lateness; unstamped ones as they are."""
    marked = events.withWatermark("event_at", late)
    stamped = marked.where("client_seq is not null").dropDuplicatesWithinWatermark(["worker_id", "client_seq"])
    return stamped.unionByName(marked.where("client_seq is null"))


def live_progress(events: DataFrame, key: str = "job_id", reset: str | None = None) -> DataFrame:
    """key, total, last_seq after each micro-batch: deltas add up, absolute values raise, an event of the kind `reset` starts
    anew, events at or before last_seq are ignored."""

    def fold(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last = state.get if state.exists else (0, 0)
        rows = pd.concat(pdfs).sort_values("seq")
        for seq, kind, delta, sync in zip(rows["seq"], rows["kind"], rows["files_delta"], rows["sync_files"]):
            if seq > last:
                last = int(seq)
                if kind == reset:
                    total = 0
                    continue
                if pd.notna(delta):
                    total += int(delta)
                if pd.notna(sync):
                    total = max(total, int(sync))
        state.update((total, last))
        yield pd.DataFrame({key: [group[0]], "total": [total], "last_seq": [last]})

    useful = events.where(F.expr("files_delta is not null or sync_files is not null") | (F.col("kind") == F.lit(reset))).select(key, "seq", "kind", "files_delta", "sync_files")
    return useful.groupBy(key).applyInPandasWithState(fold, f"{key} string, total long, last_seq long", "total long, last_seq long", "update", GroupStateTimeout.NoTimeout)


def windowed_rates(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """job_id, start, files of sliding windows, each once it is complete."""
    windows = events.where("kind = 'ProgressDelta'").withWatermark("event_at", LATE).groupBy("job_id", F.window("event_at", window, slide).alias("w")).agg(F.sum("files_delta").alias("files"))
    return windows.select("job_id", F.col("w.start").alias("start"), "files")
