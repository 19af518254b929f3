"""Structured Streaming forms of the merge, the sweep and the status machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import scratch
from ..schemas import MAX_SKEW_S, SWEEP_BUDGET


def lww(changes: DataFrame, now: Column, *, key: str = "id", stamp: str = "updated_at") -> DataFrame:
    """The newest stamp and its payload of each key; rows over an hour ahead of now are left out. State is one row for each key."""
    payload = F.struct(*[F.col(c) for c in changes.columns if c != key])
    ok = changes.where(F.col(stamp).isNotNull() & (F.unix_micros(F.col(stamp).cast("timestamp")) <= F.unix_micros(now.cast("timestamp")) + MAX_SKEW_S * 1_000_000))
    return ok.groupBy(key).agg(F.max_by(payload, F.struct(stamp, *[F.col(c) for c in changes.columns if c not in (key, stamp)])).alias("w")).select(key, "w.*")


def counted(events: DataFrame, *, ts: str = "ts", window: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Events by window and type; what is later than the watermark is left out and its state freed."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def status_machine(observations: DataFrame, *, key: str = "entry_id", order: str = "ts") -> DataFrame:
    """(key, status, penalties) from a stream of (key, order, fate): stale counts a penalty only when it follows active; superseded is final.

    A user-defined state of one small record for each key, updated in event
    order within each batch.
    """
    import pandas as pd

    def step(keys, frames, state):
        status, penalties = state.get if state.exists else ("active", 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        for fate in rows["fate"]:
            if status == "superseded":
                break
            penalties += status == "active" and fate == "stale"
            status = fate
        state.update((status, int(penalties)))
        yield pd.DataFrame({key: [keys[0]], "status": [status], "penalties": [int(penalties)]})

    kind = observations.schema[key].dataType.simpleString()
    return observations.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, penalties long", "status string, penalties long", "update", "NoTimeout")


def sweep_stream(source: DataFrame, apply) -> StreamingQuery:
    """Run apply(batch, batch_id) over a file stream that takes SWEEP_BUDGET files at a time, until what is there now is done."""
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", scratch(source.sparkSession, "sweep-checkpoint")).trigger(availableNow=True).start()


def bounded_files(spark, folder: str, schema, budget: int = SWEEP_BUDGET, glob: str = "*") -> DataFrame:
    """A folder's Parquet files as a stream, budget files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", budget).option("pathGlobFilter", glob).parquet(folder)


def run_to_table(stream: DataFrame, *, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its last result.

    Every batch's result replaces the one before in the shared folder (complete
    mode), or is added to it (append and update; update keeps the last of a key
    only in the caller's hands).
    """
    spark = stream.sparkSession
    out, schema = scratch(spark, "stream"), stream.schema

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}" if mode != "complete" else f"{out}/batch=0")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*")
