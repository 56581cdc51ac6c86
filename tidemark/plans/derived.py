"""Market feeds derived from the event and order-line tables.

Each feed is an aggregate of a whole input table, so the work of every query
built on it grows with the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import bin_start, join_all
from ..operators.fill import ffill
from ..operators.prefix import DEFAULT, Series, running_sum
from ..session import prepare

HOUR = 3_600
FIVE_MINUTES = 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Feeds:
    """The five feeds; ``seconds`` is the bar width."""

    ticks: DataFrame
    seconds: int = HOUR
    series: Series = DEFAULT

    @classmethod
    def read(cls, spark: SparkSession, sf_dir: str, seconds: int = HOUR, series=DEFAULT):
        events = table(spark, sf_dir, "events")
        ts = F.col("ts").cast("timestamp")
        ticks = events.select(
            F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
            ts.alias("tick_ts"),
            "event_id",
            "event_type",
            "value",
            (F.col("value") + 1).alias("px"),
            F.get_json_object("props", "$.k").cast("bigint").alias("qty"),
        ).withColumn("ts", bin_start("tick_ts", seconds))
        return cls(ticks, seconds, series)

    def ohlcv(self) -> DataFrame:
        px, seq = F.col("px"), F.col("event_id")
        return self.ticks.groupBy("symbol", "ts").agg(
            F.min_by(px, seq).alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.max_by(px, seq).alias("close"),
            F.sum("qty").cast("double").alias("volume"),
        )

    def open_interest(self) -> DataFrame:
        signed = F.when(F.col("event_id") % 2 == 0, F.col("qty")).otherwise(-F.col("qty"))
        flow = self.ticks.groupBy("symbol", "ts").agg(F.sum(signed).alias("_flow"))
        level = running_sum(flow, {"_level": "_flow"}, self.series)
        return level.select(
            "symbol", "ts", (F.lit(100000) + F.col("_level")).cast("double").alias("open_interest")
        )

    def funding(self) -> DataFrame:
        cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
        bucket = bin_start("tick_ts", 8 * HOUR)
        rate = (cents / F.lit(100.0) / F.count(F.lit(1)) - 50) / 100
        return (
            self.ticks.groupBy("symbol", bucket.alias("_b"))
            .agg(rate.alias("funding_rate"))
            .withColumnRenamed("_b", "ts")
        )

    def liquidations(self) -> DataFrame:
        side = F.when(F.col("event_type") == "purchase", "BUY").when(
            F.col("event_type") == "error", "SELL"
        )
        return self.ticks.where(F.col("event_type").isin("purchase", "error")).select(
            "symbol",
            "ts",
            F.col("qty").cast("double").alias("quantity"),
            side.alias("side"),
            F.col("event_id").alias("order_id"),
            F.col("px").alias("price"),
        )

    def ls_ratio(self) -> DataFrame:
        def n(kind):
            return F.count_if(F.col("event_type") == kind)

        seen = self.ticks.where(F.col("event_type").isin("click", "view"))
        return seen.groupBy("symbol", "ts").agg(
            ((1 + n("click")) / (1 + n("view"))).cast("double").alias("longShortRatio")
        )

    def joined(self) -> DataFrame:
        """All feeds on the bar timeline, funding carried forward."""
        frame = join_all(
            self.ohlcv(),
            self.open_interest(),
            self.funding(),
            self.liquidations(),
            self.ls_ratio(),
            self.series,
        )
        return ffill(frame, ["funding_rate"], self.series)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order lines: symbol = return flag, price = line price."""
    lines = table(spark, sf_dir, "lineitem")
    seq = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    px = F.col("l_extendedprice")
    return (
        lines.select(
            F.col("l_returnflag").alias("symbol"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            px.alias("px"),
            F.col("l_quantity").alias("qty"),
            seq.alias("seq"),
        )
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("px", "seq").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "seq").alias("close"),
            F.sum("qty").alias("volume"),
        )
    )


DAILY = DEFAULT.with_(bucket_seconds=86_400 * 128)


def latest(df: DataFrame, series: Series = DEFAULT) -> DataFrame:
    """The last row of every series by partial aggregation."""
    rest = [c for c in df.columns if c not in series.keys]
    return (
        df.groupBy(*series.keys)
        .agg(F.max_by(F.struct(*rest), F.col(series.order)).alias("_row"))
        .select(*series.keys, "_row.*")
    )

