"""Structured Streaming counterparts (ST1-ST3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import FeatureStore


def _windowed(ticks: DataFrame, width: str, lateness: str) -> DataFrame:
    typed = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    return typed.withWatermark("ts", lateness).withColumn("_w", F.window("ts", width))


def bar_stream(
    ticks: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """ST1: ``(symbol, ts, seq, price, quantity)`` ticks to closed bars.

    Ticks later than the watermark are dropped; ``seq`` decides first and
    last.  State is one row per open (symbol, window).
    """
    bars = _windowed(ticks, width, lateness).groupBy("symbol", F.col("_w")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("quantity").alias("volume"),
    )
    return bars.select(
        "symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume"
    )


def liquidation_stream(
    orders: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """ST3: windowed liquidation totals."""
    q = F.col("quantity")
    out = _windowed(orders, width, lateness).groupBy("symbol", F.col("_w")).agg(
        F.sum(q).alias("liq_volume"),
        F.avg(q).alias("liq_avg_size"),
        F.count(q).alias("liq_count"),
        F.sum(F.when(F.col("side") == "SELL", q).otherwise(0)).alias("long_liq_volume"),
        F.sum(F.when(F.col("side") == "BUY", q).otherwise(0)).alias("short_liq_volume"),
    )
    rest = [c for c in out.columns if c not in ("symbol", "_w")]
    return out.select("symbol", F.col("_w.start").alias("ts"), *rest)


def expiry_stream(rows: DataFrame, ttl: str = "7 days", lateness: str = "10 minutes") -> DataFrame:
    """ST2: rows ``(symbol, ts, seq, ...)`` to the last row of a symbol before its time to live ran out.

    A symbol is live from a row on until no other has come for ``ttl`` of event time.
    ``expired_at`` is that time, ``live_from`` the first row of the stretch, ``rows`` how
    many there were; the other columns are those of the last row (the largest ``seq``
    of equal times).  A stretch is told once, when the watermark has passed its end,
    so rows that are late by no more than ``lateness`` still prolong it.  State is one
    row per live symbol.
    """
    typed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    rest = [c for c in rows.columns if c not in ("symbol", "ts", "seq")]
    last = F.max_by(F.struct("ts", "seq", *rest), F.struct("ts", "seq")).alias("_last")
    live = typed.groupBy("symbol", F.session_window("ts", ttl).alias("_w")).agg(
        F.min("ts").alias("live_from"), F.count(F.lit(1)).alias("rows"), last
    )
    return live.select("symbol", "_last.*", "live_from", "rows", F.col("_w.end").alias("expired_at"))


def maintain_store(
    rows: DataFrame,
    store: FeatureStore,
    checkpoint: str,
    configure: Callable | None = None,
) -> StreamingQuery:
    """ST2: keep the feature store current from ``(symbol, ts, features)`` rows.

    Each micro-batch upserts with its batch id, counted from what the store has,
    as write sequence: replaying a batch after a failure changes nothing, and a
    stream with a new checkpoint wins over rows of an earlier one.
    """
    written = store.read().agg(F.max("write_seq")).first()[0] if store.exists() else None
    first = 0 if written is None else written + 1

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.save(batch.withColumn("write_seq", F.lit(first + batch_id).cast("bigint")))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = configure(writer) if configure else writer.trigger(availableNow=True)
    return writer.start()
