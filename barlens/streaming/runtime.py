"""The event-driven runtime on Structured Streaming: late-data rule, fills, flow control, gateway and replays.

Transformations are functions of a streaming (or batch) DataFrame; ``run_once`` drains a source with the available-now trigger
into a table, so that a stream's result can be compared with the batch answer.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A file source of Parquet tables in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def causal(events: DataFrame, exchange_ts: str, local_ts: str, max_lag_seconds: float = 10.0) -> DataFrame:
    """``events`` with ``accepted`` and ``reason``: nothing from the future, nothing later than ``max_lag_seconds``."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lag = micros(local_ts) - micros(exchange_ts)
    reason = F.when(lag < 0, "future").when(lag > int(max_lag_seconds * 1e6), "late")
    return events.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def tumbling(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """(start, keys, n, total) by fixed windows of event time."""
    w = events.withWatermark(ts, watermark).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total"))
    return w.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, keys: list[str], width: str = "7 days", step: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    w = events.withWatermark(ts, watermark).groupBy(F.window(ts, width, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    w = events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique_fills(fills: DataFrame, ts: str, order_id: str, watermark: str = WATERMARK) -> DataFrame:
    """Each order's fill once, though it may be reported again within the watermark."""
    return fills.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([order_id])


def positions(fills: DataFrame, key: str, side: Column, qty: str) -> DataFrame:
    """(key, position, n): running sums of signed quantities, for complete or update mode."""
    signed = F.when(side == "buy", F.col(qty)).otherwise(-F.col(qty))
    return fills.groupBy(key).agg(F.sum(signed.cast("decimal(18,4)")).cast("double").alias("position"), F.count(F.lit(1)).alias("n"))


def ratio_guard(orders: DataFrame, key: str, last: int = 100, most: float = 0.8) -> DataFrame:
    """(key, event_id, share, tripped): over each key's last ``last`` orders, whether the share without a fill exceeds ``most``.

    ``orders``: (key, event_id long, filled boolean), in the order of event_id within a trigger. State is at most ``last`` flags a key.
    """
    kind = orders.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flags = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("event_id", kind="stable")
        out = []
        for event_id, filled in zip(rows["event_id"], rows["filled"], strict=True):
            flags = [*flags, bool(filled)][-last:]
            share = 1 - sum(flags) / len(flags)
            out.append((group[0], int(event_id), share, len(flags) >= 10 and share > most))
        state.update((flags,))
        yield pd.DataFrame(out, columns=[key, "event_id", "share", "tripped"])

    return orders.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, share double, tripped boolean", "flags array<boolean>", "append", GroupStateTimeout.NoTimeout)


def ratio_guard_batch(orders: DataFrame, key: str, last: int = 100, most: float = 0.8) -> DataFrame:
    """The same from a rows frame over a table."""
    w = Window.partitionBy(key).orderBy("event_id").rowsBetween(-(last - 1), 0)
    share = 1 - F.avg(F.col("filled").cast("double")).over(w)
    return orders.select(key, "event_id", share.alias("share"), ((F.count(F.lit(1)).over(w) >= 10) & (share > most)).alias("tripped"))


def settled(trades: DataFrame, key: str, day: str, qty: str) -> DataFrame:
    """(key, day, bought, sellable): under T+1 only what was bought on earlier days may be sold."""
    d = trades.groupBy(key, day).agg(F.sum(qty).alias("bought"))
    before = F.sum("bought").over(Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    return d.select(key, day, "bought", F.coalesce(before, F.lit(0.0)).alias("sellable"))


def checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset in a local session, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="barlens-stream-")


def run_once(stream: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """Drain what is available into a memory table ``name`` and return it; for tests and small results."""
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", f"{checkpoint}/{table}").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """The rows of a stream in append mode, drained into shared storage and read from there; no row passes the driver."""
    path = f"{checkpoint_root(stream.sparkSession)}/barlens-{name}-{uuid.uuid4().hex}"
    run_to_parquet(stream, f"{path}/rows", f"{path}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream's rows to a Parquet table until the source is drained."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _into(check, sink: str):
    """A batch's checked rows go to the folder of its number, so that a batch that is run again replaces what it wrote."""

    def execute(batch: DataFrame, i: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{sink}/batch={i}")

    return execute


def gated(stream: DataFrame, check, sink: str, checkpoint: str) -> None:
    """Each micro-batch passes ``check`` (a function of a DataFrame) before it is kept in ``sink``: the gate-and-execute loop, until the source is drained."""
    stream.writeStream.foreachBatch(_into(check, sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def live(stream: DataFrame, check, sink: str, checkpoint: str, immediate: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """The running query of the same loop: what arrives passes at once, or, buffered, ``every`` so long. The caller stops it; a restart goes on from the checkpoint."""
    writer = stream.writeStream.foreachBatch(_into(check, sink)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime="0 seconds" if immediate else every).start()
