"""Feature store as partitioned tables.

Rows are keyed by (symbol, ts).  The map form keeps one row per key with all
features in ``features MAP<STRING, DOUBLE>``; the wide form keeps a column per
feature.  Files are partitioned by symbol and date, so reads prune to the
partitions they need, and writes replace only the partitions they touch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

PERIODS = {"date": "yyyy-MM-dd", "month": "yyyy-MM"}


def _period(by: str) -> Column:
    return F.date_format("ts", PERIODS[by])


def save_table(
    df: DataFrame, path: str, partition_by: str | None = "date", mode: str = "overwrite"
) -> None:
    """Wide feature table by symbol and date, month, or symbol only.

    Rows are shuffled by (symbol, period): one file per partition, and a
    symbol's periods spread over tasks.
    """
    if partition_by is None:
        keys, out = ["symbol"], df
        out = out.repartition("symbol", F.to_date("ts"))
    elif partition_by in PERIODS:
        keys, out = ["symbol", partition_by], df.withColumn(partition_by, _period(partition_by))
        out = out.repartition(*keys)
    else:
        raise ValueError(f"partition_by must be one of {sorted(PERIODS)} or None")
    writer = out.write.partitionBy(*keys).mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def load_table(
    spark: SparkSession,
    path: str,
    symbol: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Inclusive bounds compared with ``ts``; a plain date as upper bound
    means midnight of that day.  Partitions outside the range are skipped."""
    df = spark.read.parquet(path)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    period = next((p for p in PERIODS if p in df.columns), None)
    for bound, low in ((start, True), (end, False)):
        if bound is None:
            continue
        edge = F.lit(bound).cast("timestamp")
        df = df.where(F.col("ts") >= edge if low else F.col("ts") <= edge)
        if period:
            part = F.date_format(edge, PERIODS[period])
            column = F.col(period).cast("string")
            df = df.where(column >= part if low else column <= part)
    return df.drop(period) if period else df


def as_map(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Wide rows to ``(symbol, ts, features)``; missing values are left out."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in features]
    )
    known = F.filter(pairs, lambda p: p["v"].isNotNull())
    return df.select("symbol", "ts", F.map_from_entries(known).alias("features"))


def newest(df: DataFrame, seq: str) -> DataFrame:
    """Per (symbol, ts) the row written last."""
    w = Window.partitionBy("symbol", "ts").orderBy(F.desc(seq))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(current: DataFrame, changes: DataFrame, seq: str = "write_seq") -> DataFrame:
    """Keyed overwrite; the higher ``write_seq`` wins.  Idempotent."""
    return newest(current.unionByName(changes), seq)


def get(df: DataFrame, symbol: str, ts: str) -> DataFrame:
    """E2."""
    return df.where((F.col("symbol") == symbol) & (F.col("ts") == F.lit(ts).cast("timestamp")))


def get_latest(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """The row with the greatest timestamp per symbol."""
    rows = df if symbol is None else df.where(F.col("symbol") == symbol)
    rest = [c for c in df.columns if c != "symbol"]
    found = rows.groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("_row"))
    return found.select("symbol", "_row.*")


def get_range(df: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """Inclusive on both sides."""
    low, high = (F.lit(x).cast("timestamp") for x in (start, end))
    return df.where((F.col("symbol") == symbol) & F.col("ts").between(low, high))


def without(df: DataFrame, symbol: str, ts: str | None = None) -> DataFrame:
    """E5: the table after deleting one row or a whole symbol."""
    hit = F.col("symbol") == symbol
    if ts is not None:
        hit = hit & (F.col("ts") == F.lit(ts).cast("timestamp"))
    return df.where(~hit)


def count_deleted(df: DataFrame, symbol: str) -> DataFrame:
    return df.where(F.col("symbol") == symbol).agg(F.count(F.lit(1)).alias("deleted"))


def expire(df: DataFrame, days: int = 7, now: str | None = None) -> DataFrame:
    """Rows not older than ``days`` before ``now`` (default: newest row).

    The newest timestamp is one value, fetched to prune the scan."""
    limit = now or df.agg(F.max("ts")).first()[0]
    return df.where(F.col("ts") >= F.lit(limit).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def storage_info(df: DataFrame) -> DataFrame:
    """Number of keys per symbol."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("keys"))


class FeatureStore:
    """The map table on shared storage, with E1-E8 as methods."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def _rows(self) -> str:
        return f"{self.path}/rows"

    def exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._rows)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return bool(fs.exists(p))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self._rows)

    def save(self, rows: DataFrame) -> None:
        """Upsert ``(symbol, ts, features, write_seq)`` rows.

        Only the (symbol, date) partitions present in ``rows`` are read,
        merged and replaced.  The merge is stored first, because a partition
        cannot be overwritten while it is being read.
        """
        new = newest(rows, "write_seq").withColumn("date", F.to_date("ts"))
        merged = new
        if self.exists():
            new = stored(new, "upsert-new")
            touched = new.select("symbol", "date").distinct()
            known = self.read().where(self._span(touched))
            kept = known.join(touched, ["symbol", "date"], "left_semi")
            merged = newest(kept.unionByName(new), "write_seq")
        self._replace(stored(merged, "upsert"))

    @staticmethod
    def _span(touched: DataFrame, most: int = 1000) -> Column:
        """A partition filter known before the scan: dates of each symbol, or of all if they are many."""
        days = touched.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
        spans = days.limit(most + 1).collect()
        if len(spans) > most:
            a, b = touched.agg(F.min("date"), F.max("date")).first()
            return F.col("date").between(F.lit(a), F.lit(b))
        out = F.lit(False)
        for r in spans:
            out = out | ((F.col("symbol") == r["symbol"]) & F.col("date").between(F.lit(r["a"]), F.lit(r["b"])))
        return out

    def _replace(self, rows: DataFrame) -> None:
        out = rows.repartition("symbol", "date").write.partitionBy("symbol", "date")
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._rows)

    def get(self, symbol: str, ts: str) -> DataFrame:
        return get(self._pruned(symbol, ts, ts), symbol, ts)

    def latest(self, symbol: str | None = None) -> DataFrame:
        """E3; of one symbol only its newest day is read, found among the folders."""
        rows = self.read()
        if symbol is not None and (dates := self._dates(symbol)):
            rows = rows.where((F.col("symbol") == symbol) & (F.col("date") == F.lit(dates[-1]).cast("date")))
        return get_latest(rows.drop("date"), symbol)

    def _dates(self, symbol: str) -> list[str]:
        """The dates a symbol has rows of, in order: names of folders."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._rows}/{self._folder('symbol', symbol)}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(n.removeprefix("date=") for n in names if n.startswith("date="))

    def range(self, symbol: str, start: str, end: str) -> DataFrame:
        return get_range(self._pruned(symbol, start, end), symbol, start, end)

    def _pruned(self, symbol: str, start: str, end: str) -> DataFrame:
        day = [F.to_date(F.lit(x).cast("timestamp")) for x in (start, end)]
        rows = self.read().where((F.col("symbol") == symbol) & F.col("date").between(*day))
        return rows.drop("date")

    def delete(self, symbol: str, ts: str | None = None) -> int:
        """E5: delete one row or a symbol; returns how many rows went."""
        before = self.read().where(F.col("symbol") == symbol)
        if ts is not None:
            before = before.where(F.col("date") == F.to_date(F.lit(ts).cast("timestamp")))
        before = stored(before, "delete")
        kept = without(before, symbol, ts)
        gone = before.count() - kept.count()
        if gone:
            emptied = before.select("symbol", "date").distinct()
            left = kept.select("symbol", "date").distinct()
            self._drop_partitions(emptied.exceptAll(left))
            self._replace(kept)
        return gone

    def _folder(self, column: str, value) -> str:
        """A partition folder as Spark names it: signs such as ``/``, ``:`` and ``%`` are escaped, a null has a name."""
        names = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return names.getPartitionPathString(column, None if value is None else str(value))

    def _drop_partitions(self, partitions: DataFrame) -> None:
        """Remove (symbol, date) folders that lost their last row; the list is
        file metadata, one entry per day of one symbol."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for r in partitions.toLocalIterator():
            p = jvm.org.apache.hadoop.fs.Path("/".join([self._rows, *(self._folder(c, r[c]) for c in ("symbol", "date"))]))
            if not p.getFileSystem(conf).delete(p, True):
                raise RuntimeError(f"the rows in {p.toString()} could not be deleted")

    def expire(self, days: int = 7, now: str | None = None) -> DataFrame:
        """The rows :meth:`purge` would leave; days before the limit are not read."""
        limit = self._limit(days, now)
        rows = self.read().where(F.col("date") >= F.lit(limit).cast("date"))
        return rows.where(F.col("ts") >= F.lit(limit)).drop("date")

    def purge(self, days: int = 7, now: str | None = None) -> None:
        """Delete rows older than ``days`` before ``now`` (default: the newest row).

        Folders of earlier days go whole; only the day of the limit is rewritten.
        """
        limit = self._limit(days, now)
        day = F.lit(limit).cast("date")
        parts = self.read().select("symbol", "date").distinct()
        edge = stored(self.read().where(F.col("date") == day), "purge")
        kept = edge.where(F.col("ts") >= F.lit(limit))
        emptied = edge.select("symbol", "date").distinct().exceptAll(kept.select("symbol", "date").distinct())
        gone = stored(parts.where(F.col("date") < day).unionByName(emptied), "purge-folders")
        self._drop_partitions(gone)
        if not kept.isEmpty():
            self._replace(kept)

    def _limit(self, days: int, now: str | None):
        newest_day = self.read().agg(F.max("date")).first()[0]
        last = self.read().where(F.col("date") == F.lit(newest_day)).agg(F.max("ts")).first()[0] if now is None else now
        value = F.lit(last).cast("timestamp") - F.make_dt_interval(F.lit(days))
        return self.spark.range(1).select(value).first()[0]

    def info(self) -> DataFrame:
        return storage_info(self.read())

    # E8 -----------------------------------------------------------------
    def save_metadata(self, name: str, features: DataFrame) -> None:
        """Feature metadata ``(feature, type, selected)`` under a name."""
        features.coalesce(1).write.mode("overwrite").json(f"{self.path}/metadata/{name}")

    def metadata(self, name: str) -> DataFrame:
        schema = "feature string, type string, selected boolean"
        return self.spark.read.schema(schema).json(f"{self.path}/metadata/{name}")
