"""Feed sources (S1-S6): parquet folders or JDBC tables.

Filters and projections are declared on the DataFrame and reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Relation and columns of each feed, {relation: {source: output}}.
FEEDS: dict[str, tuple[str, dict[str, str]]] = {
    "ohlcv": (
        "ohlcv",
        {c: c for c in ("symbol", "timestamp", "open", "high", "low", "close", "volume")},
    ),
    "open_interest": (
        "open_interest",
        {c: c for c in ("symbol", "timestamp", "open_interest")},
    ),
    "funding": ("funding_rate", {c: c for c in ("symbol", "timestamp", "funding_rate")}),
    "liquidations": (
        "liquidations",
        {c: c for c in ("symbol", "timestamp", "quantity", "side", "order_id")},
    ),
    "ls_ratio": (
        "long_short_ratio",
        {"symbol": "symbol", "timestamp": "timestamp", "long_short_ratio": "longShortRatio"},
    ),
}


def select_feed(
    table: DataFrame,
    feed: str,
    symbol: str | list[str] | None = None,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
) -> DataFrame:
    """Project a feed, filter symbols and an inclusive time range."""
    _, columns = FEEDS[feed]
    out = table.select(*[F.col(src).alias(dst) for src, dst in columns.items()])
    if symbol is not None:
        out = out.where(F.col("symbol").isin([symbol] if isinstance(symbol, str) else symbol))
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return out.withColumnRenamed("timestamp", "ts")


@dataclass
class MarketSource:
    """Reads the five feeds from one place.

    ``parquet``: ``location`` is a folder with one table per relation.
    ``jdbc``: ``options`` are Spark's JDBC options; ``partitionColumn`` (say,
    the timestamp), its bounds and ``numPartitions`` are demanded.
    """

    spark: SparkSession
    location: str = ""
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    def table(self, feed: str) -> DataFrame:
        relation, _ = FEEDS[feed]
        if self.format == "jdbc":
            ranged = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
            if missing := sorted(ranged - self.options.keys()):
                raise ValueError(f"a JDBC feed would be read by one task; options {missing} are missing")
            return self.spark.read.format("jdbc").options(dbtable=relation, **self.options).load()
        return self.spark.read.format(self.format).options(**self.options).load(
            f"{self.location}/{relation}"
        )

    def read(self, feed: str, symbol=None, start=None, end=None) -> DataFrame:
        return select_feed(self.table(feed), feed, symbol, start, end)

    def read_all(
        self,
        symbol: str | list[str] | None = None,
        start=None,
        end=None,
        days_back: float | None = None,
        hours_back: float | None = None,
    ) -> dict[str, DataFrame]:
        """All feeds, lazily.  A relative window ends at ``end`` or at the
        newest bar, never at the wall clock."""
        hours = hours_back if hours_back is not None else (days_back or 0) * 24
        if hours and start is None:
            last = end
            if last is None:
                bars = self.read("ohlcv", symbol)
                last = bars.agg(F.max("ts")).first()[0]
            seconds = int(hours * 3600)
            since = F.lit(last).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
            tables = {f: self.read(f, symbol, None, last) for f in FEEDS}
            return {f: t.where(F.col("ts") >= since) for f, t in tables.items()}
        return {f: self.read(f, symbol, start, end) for f in FEEDS}
