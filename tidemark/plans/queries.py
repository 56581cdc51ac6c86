"""Every registered query: ``name -> callable(spark, sf_dir)``.

Each one runs an operator over whole derived feeds.  Timestamps are shown as
text and doubles rounded, so results can be compared with SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fdiv, tidy
from ..operators import align, balance, fill, importance, indicators, metrics, quality
from ..operators import scaling, splits, stats, targets
from ..operators.ewm import ewm
from ..operators.features import feature_names
from ..operators.prefix import Series, row_index
from ..operators.models import (
    CLASSIFIER_SPACE,
    FOREST_SPACE,
    BoostedClassifier,
    BoostedRegressor,
    ForestClassifier,
    StackedClassifier,
    StackedRegressor,
    assemble,
    fold_summary,
    search,
    search_all,
    walk_forward,
)
from ..session import shared_dir, stored
from ..sources import store as fs
from ..sources import artifacts
from ..sources.artifacts import class_counts, split_metadata
from ..sources.feeds import FEEDS, MarketSource, select_feed
from ..streaming.bars import bar_stream, expiry_stream, liquidation_stream, maintain_store
from .derived import DAILY, HOUR, Feeds, daily_bars, latest, table
from .families import FAMILIES, family, show, stamp
from .feature_table import engineer_all
from .pipeline import run_all, train

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _feeds(spark: SparkSession, sf_dir: str) -> Feeds:
    return Feeds.read(spark, sf_dir)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feeds(spark, sf_dir).ohlcv()


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feeds(spark, sf_dir).joined()


def _named(feed: DataFrame) -> DataFrame:
    return feed.withColumnRenamed("ts", "timestamp")


# ------------------------------------------------------------------- sources
def _range(feed: DataFrame, name: str) -> DataFrame:
    return select_feed(_named(feed), name, "S1", "2024-01-05 00:00:00", "2024-01-20 12:00:00")


@register
def src_ohlcv(spark, sf_dir):
    out = _range(_bars(spark, sf_dir), "ohlcv")
    return show(out, "open", "high", "low", "close", "volume")


@register
def src_open_interest(spark, sf_dir):
    return show(_range(_feeds(spark, sf_dir).open_interest(), "open_interest"), "open_interest")


@register
def src_funding(spark, sf_dir):
    return show(_range(_feeds(spark, sf_dir).funding(), "funding"), "funding_rate")


@register
def src_liquidations(spark, sf_dir):
    out = _range(_feeds(spark, sf_dir).liquidations(), "liquidations")
    return out.select("symbol", stamp(), tidy("quantity").alias("quantity"), "side", "order_id")


@register
def src_ls_ratio(spark, sf_dir):
    feed = _feeds(spark, sf_dir).ls_ratio()
    feed = feed.withColumnRenamed("longShortRatio", "long_short_ratio")
    return show(_range(feed, "ls_ratio"), "longShortRatio")


@register
def src_all_recent(spark, sf_dir):
    feeds = _feeds(spark, sf_dir)
    home = f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    tables = {
        "ohlcv": feeds.ohlcv(),
        "open_interest": feeds.open_interest(),
        "funding": feeds.funding(),
        "liquidations": feeds.liquidations(),
        "ls_ratio": feeds.ls_ratio().withColumnRenamed("longShortRatio", "long_short_ratio"),
    }
    for name, df in tables.items():
        _named(df).write.parquet(f"{home}/{FEEDS[name][0]}")
    read = MarketSource(spark, home).read_all(days_back=7)
    counted = [
        df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("feed", F.lit(name))
        for name, df in read.items()
    ]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@register
def table_save_load(spark, sf_dir):
    path = f"{shared_dir(spark)}/wide-{uuid.uuid4().hex}"
    fs.save_table(_bars(spark, sf_dir), path, "date")
    out = fs.load_table(spark, path, "S2", "2024-01-10", "2024-01-15")
    return show(out, "open", "high", "low", "close", "volume")


@register
def table_save_load_month(spark, sf_dir):
    path = f"{shared_dir(spark)}/wide-{uuid.uuid4().hex}"
    fs.save_table(_bars(spark, sf_dir), path, "month")
    out = fs.load_table(spark, path, "S3", "2024-01-10", "2024-01-15 12:00:00")
    return show(out, "close", "volume")


# ------------------------------------------------------------------- quality
@register
def validate_feeds(spark, sf_dir):
    f = _feeds(spark, sf_dir)
    report = quality.validate_feeds(
        {
            "ohlcv": f.ohlcv(),
            "open_interest": f.open_interest(),
            "funding": f.funding().drop("funding_rate"),
            "liquidations": f.liquidations(),
            "ls_ratio": None,
            "targets": f.ticks.select("symbol", "ts", F.col("value").alias("target")),
        }
    )
    return report.select(
        "feed", "valid", F.array_join("errors", ";").alias("errors"), F.size("warnings").alias("n_warnings")
    )


@register
def validation_summary(spark, sf_dir):
    f = _feeds(spark, sf_dir)
    feeds = {"ohlcv": f.ohlcv(), "targets": f.ticks.select("symbol", "ts")}
    return quality.validation_summary(quality.validate_feeds(feeds))


@register
def timezone_utc(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    out = quality.ensure_timezone(events, "Asia/Tokyo")
    return out.select("event_id", stamp())


def _ticks_by_arrival(spark, sf_dir):
    ticks = _feeds(spark, sf_dir).ticks
    return ticks.select(
        "symbol",
        F.col("tick_ts").alias("ts"),
        F.col("event_id").bitwiseXOR(F.lit(5)).alias("arrival"),
    )


@register
def out_of_order(spark, sf_dir):
    late = quality.out_of_order(_ticks_by_arrival(spark, sf_dir), "arrival")
    return late.select("symbol", stamp(), "arrival")


@register
def monotonic_check(spark, sf_dir):
    return quality.is_monotonic(_ticks_by_arrival(spark, sf_dir), "arrival")


@register
def duplicate_timestamps(spark, sf_dir):
    rows = quality.duplicate_timestamps(_feeds(spark, sf_dir).liquidations())
    return rows.select("symbol", stamp(), "order_id")


@register
def gap_report(spark, sf_dir):
    gaps = quality.time_gaps(_bars(spark, sf_dir), HOUR, 60)
    return show(gaps, "gap_seconds", "expected_seconds", "excess_seconds")


@register
def missing_report(spark, sf_dir):
    f = _feeds(spark, sf_dir)
    frame = align.join_all(f.ohlcv(), f.open_interest(), f.funding(), f.liquidations(), f.ls_ratio())
    rep = quality.missing_report(frame)
    first = F.date_format("first_missing", "yyyy-MM-dd HH:mm:ss").alias("first_missing")
    return rep.select("column", "missing_count", tidy("missing_pct").alias("missing_pct"), first)


@register
def alignment_summary(spark, sf_dir):
    f = _feeds(spark, sf_dir)
    frame = align.join_all(f.ohlcv(), f.open_interest(), f.funding(), f.liquidations(), f.ls_ratio())
    s = quality.alignment_summary(frame)
    return s.select(
        "rows",
        "columns",
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"),
        "missing_cells",
    )


@register
def feature_set_check(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    sets = events.groupBy(F.col("event_type").alias("feature_set_id")).agg(
        F.collect_set(F.concat(F.lit("f"), F.col("user_id") % 40)).alias("features")
    )
    out = quality.feature_set_check(sets, [f"f{i}" for i in range(0, 40, 2)])
    return out.select("feature_set_id", F.array_join("missing", ",").alias("missing"), "valid")


# ----------------------------------------------------------------- alignment
@register
def base_timeline(spark, sf_dir):
    ticks = _feeds(spark, sf_dir).ticks.select("symbol", "ts", "px", "qty", "event_id")
    out = align.base_timeline(ticks, seq="event_id")
    return out.select("symbol", stamp(), tidy("px").alias("px"), "qty", "event_id")


def _aligned(method: str, spark, sf_dir):
    f = _feeds(spark, sf_dir)
    feeds = {"funding": f.funding(), "ls_ratio": f.ls_ratio()}
    frame = align.align_feeds(f.ohlcv(), feeds, method)
    return show(frame, "close", "funding_rate", "longShortRatio")


for _m in fill.FILLS:
    REGISTRY[f"align_{_m}"] = partial(_aligned, _m)


@register
def align_one_feed(spark, sf_dir):
    f = _feeds(spark, sf_dir)
    feed = f.ls_ratio().withColumn("close", F.col("longShortRatio") * 2)
    frame = align.align_feed(f.ohlcv(), feed, "ls", "ffill")
    return show(frame, "close", "longShortRatio", "close_ls")


@register
def joined_feeds(spark, sf_dir):
    f = _feeds(spark, sf_dir)
    frame = align.join_all(f.ohlcv(), f.open_interest(), f.funding(), f.liquidations(), f.ls_ratio())
    return show(
        frame,
        "close",
        "open_interest",
        "funding_rate",
        "liq_volume",
        "liq_avg_size",
        "liq_count",
        "long_liq_volume",
        "short_liq_volume",
        "longShortRatio",
    )


@register
def resample_4h(spark, sf_dir):
    out = align.resample(_joined(spark, sf_dir), 4 * HOUR, series=_feeds(spark, sf_dir).series)
    return show(out, "open", "high", "low", "close", "volume", "open_interest", "longShortRatio")


@register
def resample_ticks(spark, sf_dir):
    ticks = _feeds(spark, sf_dir).ticks.select(
        "symbol", F.col("tick_ts").alias("ts"), "event_id", "px", "qty"
    )
    out = align.resample(
        ticks, 1800, {"px": "mean", "qty": "sum"}, order="event_id"
    )
    return show(out, "px", "qty")


def _completed(method: str, spark, sf_dir):
    ratio = _feeds(spark, sf_dir).ls_ratio()
    return show(align.complete_timestamps(ratio, HOUR, method), "longShortRatio")


for _m in ("ffill", "bfill", "interpolate"):
    REGISTRY[f"complete_{_m}"] = partial(_completed, _m)


def _final_fill(mode: str, spark, sf_dir):
    f = _feeds(spark, sf_dir)
    frame = align.join_all(f.ohlcv(), None, f.funding(), f.liquidations(), f.ls_ratio())
    cols = ["funding_rate", "long_liq_volume", "short_liq_volume", "longShortRatio"]
    return show(fill.fill_all(frame, cols, f.series, mode), *cols)


REGISTRY["fill_reference"] = partial(_final_fill, "reference")
REGISTRY["fill_causal"] = partial(_final_fill, "causal")


@register
def clean_infinite(spark, sf_dir):
    frame = _joined(spark, sf_dir)
    frame = frame.select("symbol", "ts", fdiv("liq_volume", F.col("liq_count") % 3).alias("x"))
    cleaned = fill.fill_all(fill.replace_inf(frame, ["x"]), ["x"])
    return show(cleaned, "x")


@register
def drop_missing_rows(spark, sf_dir):
    f = _feeds(spark, sf_dir)
    frame = align.join_all(f.ohlcv(), None, None, f.liquidations(), f.ls_ratio())
    return show(fill.drop_missing(frame), "close", "long_liq_volume", "longShortRatio")


@register
def latest_row(spark, sf_dir):
    return show(latest(_joined(spark, sf_dir)), "close", "open_interest", "funding_rate")


@register
def top_volume(spark, sf_dir):
    out = _bars(spark, sf_dir).orderBy(F.desc("volume"), "symbol", "ts").limit(20)
    return show(out, "volume")


# ---------------------------------------------------------------- indicators
def _daily(operator: Callable, columns: tuple[str, ...], spark, sf_dir):
    return show(operator(daily_bars(spark, sf_dir), series=DAILY), *columns)


_TA: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "ta_rsi": (indicators.rsi, ("rsi_14",)),
    "ta_sma": (partial(indicators.sma, column="close", length=30), ("sma",)),
    "ta_macd": (indicators.macd, ("MACD_12_26_9", "MACDs_12_26_9", "MACDh_12_26_9")),
    "ta_stoch": (indicators.stoch, ("STOCHk_14_3_3", "STOCHd_14_3_3")),
    "ta_roc": (partial(indicators.rate_of_change, column="close"), ("roc_10",)),
    "ta_willr": (indicators.williams_r, ("willr_14",)),
    "ta_atr": (indicators.atr, ("atr_14",)),
    "ta_bbands": (indicators.bbands, tuple(f"BB{k}_20_2" for k in "LMUBP")),
    "ta_adx": (indicators.adx, ("ADX_14", "DMP_14", "DMN_14")),
    "ta_obv": (indicators.obv, ("obv",)),
    "ta_cmf": (indicators.cmf, ("cmf",)),
    "ta_mfi": (indicators.mfi, ("mfi",)),
}
for _n, (_op, _cols) in _TA.items():
    REGISTRY[_n] = partial(_daily, _op, _cols)


@register
def ta_ema(spark, sf_dir):
    """Gap-aware average of a series with holes (bars without liquidations)."""
    f = _feeds(spark, sf_dir)
    frame = align.join_all(f.ohlcv(), None, None, f.liquidations(), None)
    out = ewm(frame, {"ema_9": ("long_liq_volume", 9), "ema_26": ("long_liq_volume", 26)})
    return show(out, "ema_9", "ema_26")


# -------------------------------------------------------------- feature table
def _engineered(spark, sf_dir) -> DataFrame:
    f = _feeds(spark, sf_dir)
    funding = fill.ffill(
        align.join_feed(f.ohlcv().select("symbol", "ts"), f.funding(), "")[0], ["funding_rate"]
    )
    return engineer_all(
        f.ohlcv(), f.open_interest(), funding, f.liquidations(), f.ls_ratio(), f.series
    )


@register
def feature_table(spark, sf_dir):
    out = _engineered(spark, sf_dir)
    names = sorted(feature_names(out))
    return show(out, *names)


# ------------------------------------------------------------------- targets
@register
def target_class3(spark, sf_dir):
    out = targets.classification_target(_bars(spark, sf_dir), 12, 0.1)
    return show(targets.with_return_target(out), "target", "future_return", "target_return")


@register
def target_class2(spark, sf_dir):
    out = targets.classification_target(_bars(spark, sf_dir), 12, 0.1, n_classes=2)
    return show(out, "target", "future_return")


@register
def target_returns(spark, sf_dir):
    out = targets.regression_target(_bars(spark, sf_dir))
    return show(out, "target_return_1h", "target_return_4h", "target_return_24h")


@register
def target_oi(spark, sf_dir):
    return show(targets.oi_target(_joined(spark, sf_dir), 48), "target_oi_change")


@register
def target_volatility(spark, sf_dir):
    return show(targets.volatility_target(_bars(spark, sf_dir)), "target_volatility")


@register
def target_volatility_long(spark, sf_dir):
    """A lookback that reaches behind the row itself."""
    out = targets.volatility_target(_bars(spark, sf_dir), horizon=10, lookback=20)
    return show(out, "target_volatility")


@register
def target_multi(spark, sf_dir):
    out = targets.multi_horizon_targets(_bars(spark, sf_dir))
    names = [f"target_{k}_{h}h" for k in ("return", "class") for h in (1, 4, 8, 24)]
    return show(out, *names)


@register
def target_direction(spark, sf_dir):
    return show(targets.direction_labels(_bars(spark, sf_dir)), "direction")


def _labelled(spark, sf_dir) -> DataFrame:
    return targets.classification_target(_bars(spark, sf_dir), 4, 0.5)


@register
def target_distribution(spark, sf_dir):
    out = targets.target_distribution(_labelled(spark, sf_dir))
    return out.select("target", "count", tidy("percentage").alias("percentage"))


def _balanced(method: str, spark, sf_dir):
    out = balance.balance_classes(stored(_labelled(spark, sf_dir), "labelled"), "target", method)
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("count"))


def _balanced_rows(method: str, spark, sf_dir):
    """Which rows a class has after balancing: how many different ones, strange ones, and how often each."""
    rows = stored(_labelled(spark, sf_dir), "labelled")
    out = balance.balance_classes(rows, "target", method).groupBy("target", "symbol", "ts").agg(F.count(F.lit(1)).alias("n"))
    known = rows.select("target", "symbol", "ts", F.lit(1).alias("known"))
    return out.join(known, ["target", "symbol", "ts"], "left").groupBy("target").agg(
        F.count(F.lit(1)).alias("different"),
        F.count_if(F.col("known").isNull()).alias("strange"),
        F.min("n").alias("fewest"),
        F.max("n").alias("most"),
    )


REGISTRY["balance_undersample_rows"] = partial(_balanced_rows, "undersample")
REGISTRY["balance_oversample_rows"] = partial(_balanced_rows, "oversample")
REGISTRY["balance_undersample"] = partial(_balanced, "undersample")
REGISTRY["balance_oversample"] = partial(_balanced, "oversample")


@register
def sequence_windows(spark, sf_dir):
    seq = targets.sequences(_bars(spark, sf_dir), ["close", "volume"], "close", 24)
    s = F.col("sequence")
    total = F.aggregate(s, F.lit(0.0), lambda a, v: a + v[0] + 1000 * v[1])
    return seq.select(
        "symbol",
        stamp(),
        F.size(s).alias("length"),
        tidy(s[0][0]).alias("oldest"),
        tidy(s[23][0]).alias("newest"),
        tidy(total, 3).alias("total"),
        tidy("close").alias("close"),
    )


# -------------------------------------------------------------------- splits
@register
def split_ratio(spark, sf_dir):
    return splits.ratio_split(_bars(spark, sf_dir)).select("symbol", stamp(), "rn", "n", "split")


@register
def split_dates(spark, sf_dir):
    out = splits.date_split(_bars(spark, sf_dir), "2024-01-18", "2024-01-24 06:00:00")
    return out.select("symbol", stamp(), "split")


@register
def split_cv(spark, sf_dir):
    return splits.cv_split(_bars(spark, sf_dir)).select("symbol", stamp(), "fold", "role")


@register
def split_walk_forward(spark, sf_dir):
    out = splits.walk_forward_split(_bars(spark, sf_dir), 200, 50, 60)
    return out.select("symbol", stamp(), "fold", "role")


@register
def split_series_folds(spark, sf_dir):
    return splits.series_folds(_bars(spark, sf_dir)).select("symbol", stamp(), "fold", "role")


@register
def split_purged(spark, sf_dir):
    out = splits.purge_and_embargo(splits.ratio_split(_bars(spark, sf_dir)), 24, 12)
    return out.select("symbol", stamp(), "rn", "split")


@register
def split_statistics(spark, sf_dir):
    out = splits.split_statistics(splits.ratio_split(_labelled(spark, sf_dir)), "future_return")
    return out.select("split", "n_samples", *[tidy(c).alias(c) for c in ("mean", "std", "min", "max")])


@register
def split_class_counts(spark, sf_dir):
    out = splits.split_class_counts(splits.ratio_split(_labelled(spark, sf_dir)), "target")
    return out.select("split", "target", "count", tidy("pct").alias("pct"))


@register
def dataset_metadata(spark, sf_dir):
    df = splits.ratio_split(_labelled(spark, sf_dir))
    m = split_metadata(df, ["close", "volume"])
    return m.select(
        "split",
        "n_samples",
        "n_features",
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"),
        *[tidy(c).alias(c) for c in ("target_min", "target_max", "target_mean", "target_std")],
    )


def _sample(rows: DataFrame, n: int) -> DataFrame:
    return balance.cap_rows(rows, n, ["symbol", "ts"])


@register
def sample_capped(spark, sf_dir):
    """A seeded sample has its size, no row twice, and a larger one holds it."""
    rows = stored(_bars(spark, sf_dir).select("symbol", "ts"), "sampled")
    few, more = (stored(_sample(rows, n), "sample").distinct() for n in (500, 1000))
    sizes = [few.count(), more.count(), few.join(more, ["symbol", "ts"]).count(), _sample(rows, 10**9).count()]
    return spark.createDataFrame([tuple(sizes)], "few long, more long, both long, every long")


def _ticks(spark, sf_dir) -> DataFrame:
    """All events as one series of ticks; every third value is missing."""
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return events.select(F.lit("all").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", value.alias("x"))


#: Ticks crowd in time, so buckets are cut by rows.
TICKS = Series(dense=1000, ties=("event_id",))


@register
def dense_fill(spark, sf_dir):
    ticks = _ticks(spark, sf_dir)
    back = fill.bfill(ticks, ["x"], TICKS).select("event_id", F.col("x").alias("after"))
    return fill.ffill(ticks, ["x"], TICKS).select("event_id", F.col("x").alias("before")).join(back, "event_id")


@register
def dense_row_index(spark, sf_dir):
    placed = row_index(_ticks(spark, sf_dir), TICKS, "rn", "n")
    return placed.select("event_id", "rn", "n")


@register
def dataset_class_counts(spark, sf_dir):
    return class_counts(splits.ratio_split(_labelled(spark, sf_dir)))


# ---------------------------------------------------------------- statistics
# inputs of the statistics, all known on every bar or missing on purpose
STAT_COLUMNS = [
    "open",
    "high",
    "low",
    "close",
    "volume",
    "open_interest",
    "liq_volume",
    "liq_count",
    "long_liq_volume",
]
DENSE = STAT_COLUMNS[:-1]


def _numbers(spark, sf_dir) -> DataFrame:
    f = _feeds(spark, sf_dir)
    return align.join_all(f.ohlcv(), f.open_interest(), None, f.liquidations(), None)


@register
def variance_filter(spark, sf_dir):
    v = stats.variances(_numbers(spark, sf_dir), STAT_COLUMNS)
    return v.where("variance < 5000").select("feature", tidy("variance", 4).alias("variance"))


@register
def corr_pairs(spark, sf_dir):
    p = stats.correlation_pairs(_numbers(spark, sf_dir), STAT_COLUMNS)
    return p.select("feature_1", "feature_2", tidy("correlation").alias("correlation"))


@register
def corr_report(spark, sf_dir):
    p = stats.correlation_report(_numbers(spark, sf_dir), STAT_COLUMNS, 0.5)
    return p.select("feature_1", "feature_2", tidy("correlation").alias("correlation"))


@register
def corr_filter(spark, sf_dir):
    dropped = stats.highly_correlated(_numbers(spark, sf_dir), STAT_COLUMNS, 0.7)
    return spark.createDataFrame([(c,) for c in dropped], "feature string")


@register
def corr_spearman(spark, sf_dir):
    p = stats.correlation_pairs(_numbers(spark, sf_dir), STAT_COLUMNS, "spearman")
    return p.select("feature_1", "feature_2", tidy("correlation").alias("correlation"))


@register
def corr_kendall(spark, sf_dir):
    p = stats.correlation_pairs(_numbers(spark, sf_dir), STAT_COLUMNS, "kendall")
    return p.select("feature_1", "feature_2", tidy("correlation").alias("correlation"))


@register
def target_correlation(spark, sf_dir):
    df = targets.classification_target(_numbers(spark, sf_dir), 4, 0.5)
    out = stats.target_correlation(df, STAT_COLUMNS, "future_return")
    return out.select("feature", tidy("correlation").alias("correlation"))


@register
def distribution_stats(spark, sf_dir):
    d = stats.distributions(_numbers(spark, sf_dir), STAT_COLUMNS)
    names = [c for c in d.columns if c != "feature"]
    return d.select("feature", *[tidy(c, 5).alias(c) for c in names])


@register
def distribution_issues(spark, sf_dir):
    return stats.distribution_issues(stats.distributions(_numbers(spark, sf_dir), STAT_COLUMNS))


@register
def outliers_iqr(spark, sf_dir):
    o = stats.outliers(_numbers(spark, sf_dir), STAT_COLUMNS, "iqr")
    return o.select("feature", "outliers", tidy("outlier_pct").alias("outlier_pct"))


@register
def outliers_zscore(spark, sf_dir):
    o = stats.outliers(_numbers(spark, sf_dir), STAT_COLUMNS, "zscore", 2.5)
    return o.select("feature", "outliers", tidy("outlier_pct").alias("outlier_pct"))


def _sets(spark, sf_dir) -> DataFrame:
    """Feature lists seen per event type (bounded names)."""
    events = table(spark, sf_dir, "events")
    name = F.concat(F.lit("f"), F.col("user_id") % 40)
    return events.groupBy("event_type").agg(F.collect_set(name).alias("features"))


@register
def feature_set_hash(spark, sf_dir):
    config = F.to_json(F.struct(F.col("event_type").alias("kind")))
    return _sets(spark, sf_dir).select(
        "event_type",
        stats.feature_set_hash(F.col("features")).alias("plain"),
        stats.feature_set_hash(F.col("features"), config).alias("configured"),
    )


@register
def feature_set_compare(spark, sf_dir):
    s = _sets(spark, sf_dir)
    a = s.where("event_type = 'view'").select("features")
    b = F.array(*[F.lit(f"f{i}") for i in range(10, 60)])
    both = {**stats.compare_sets(F.col("features"), b), **stats.reduction(F.col("features"), b)}
    text = {"common_features", "only_in_1", "only_in_2", "removed_features"}
    return a.select(
        *[
            (F.array_join(c, ",") if k in text else tidy(c) if k == "reduction_pct" else c).alias(k)
            for k, c in both.items()
        ]
    )


def _scores(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.concat(F.lit("f"), F.col("user_id") % 25).alias("feature")).agg(
        (F.count(F.lit(1)) % 40).cast("double").alias("importance")
    )


@register
def importance_rank(spark, sf_dir):
    return stats.average_rank(_scores(spark, sf_dir), "importance", "rank")


@register
def importance_cumulative(spark, sf_dir):
    c = stats.cumulative_importance(_scores(spark, sf_dir))
    return c.select("feature", "importance", tidy("cumulative").alias("cumulative"))


@register
def importance_for_share(spark, sf_dir):
    return stats.features_for_share(stats.cumulative_importance(_scores(spark, sf_dir)))


# ------------------------------------------------------------------- scaling
def _scaled(method: str, per_symbol: bool, spark, sf_dir):
    df = splits.ratio_split(_numbers(spark, sf_dir))
    out, _ = scaling.scale_splits(df, DENSE, method, per_symbol)
    return show(out, *DENSE)


for _m in scaling.METHODS:
    REGISTRY[f"scale_{_m}"] = partial(_scaled, _m, False)
REGISTRY["scale_per_symbol"] = partial(_scaled, "standard", True)


@register
def scale_unseen_symbol(spark, sf_dir):
    df = _numbers(spark, sf_dir)
    scaler = scaling.fit_scaler(df.where("symbol <> 'S3'"), ["close"], "standard", True)
    return show(scaling.apply_scaler(df, scaler, ["close"]), "close")


@register
def scaler_statistics(spark, sf_dir):
    df = splits.ratio_split(_numbers(spark, sf_dir)).where("split = 'train'")
    s = scaling.fit_scaler(df, DENSE, "robust", True)
    return s.select("symbol", "feature", tidy("center").alias("center"), tidy("scale").alias("scale"))


# ------------------------------------------------------------------- metrics
def _predicted(spark, sf_dir) -> DataFrame:
    """Labels with deterministic predictions and tied probabilities."""
    df = _labelled(spark, sf_dir)
    v = F.col("volume").cast("bigint")
    parts = [1 + v % 7, 1 + v % 5, 1 + v % 3]
    total = parts[0] + parts[1] + parts[2]
    probs = F.array(*[(p / total).cast("double") for p in parts])
    return df.select(
        "symbol",
        "ts",
        F.col("target").alias("label"),
        (v % 3).cast("int").alias("prediction"),
        probs.alias("probabilities"),
        F.col("future_return").alias("actual"),
        F.when(v % 11 > 0, (v % 21 - 10) / 10.0).alias("forecast"),
    )


@register
def metric_decision(spark, sf_dir):
    d = metrics.decisions(_predicted(spark, sf_dir), "probabilities", "forecast")
    return show(d, "signal", "confidence", "predicted_return")


@register
def metric_accuracy(spark, sf_dir):
    a = metrics.accuracy(_predicted(spark, sf_dir))
    return a.select("n", *[tidy(c).alias(c) for c in ("accuracy", "directional_accuracy")])


@register
def metric_class_report(spark, sf_dir):
    r = metrics.class_report(_predicted(spark, sf_dir))
    return r.select("class", "support", *[tidy(c).alias(c) for c in ("precision", "recall", "f1")])


@register
def metric_confusion(spark, sf_dir):
    c = metrics.confusion(_predicted(spark, sf_dir))
    return c.select("actual", "predicted", "count", tidy("share").alias("share"))


@register
def metric_roc_points(spark, sf_dir):
    r = metrics.roc_points(_predicted(spark, sf_dir))
    return r.select("class", *[tidy(c).alias(c) for c in ("threshold", "fpr", "tpr")])


@register
def metric_roc_auc(spark, sf_dir):
    r = metrics.roc_auc(_predicted(spark, sf_dir))
    return r.select("class", tidy("auc").alias("auc"), "support")


@register
def metric_weighted_auc(spark, sf_dir):
    r = metrics.weighted_auc(metrics.roc_auc(_predicted(spark, sf_dir)))
    return r.select(tidy("roc_auc").alias("roc_auc"))


_REG = ("mse", "rmse", "mae", "r2", "directional_accuracy", "correlation")


@register
def metric_regression(spark, sf_dir):
    r = metrics.regression_metrics(_predicted(spark, sf_dir), "actual", "forecast")
    return r.select("n", *[tidy(c).alias(c) for c in _REG])


@register
def metric_forecast(spark, sf_dir):
    r = metrics.forecast_metrics(_predicted(spark, sf_dir), "actual", "forecast")
    return r.select("n", *[tidy(c).alias(c) for c in ("mse", "rmse", "mae", "directional_accuracy")])


@register
def metric_residuals(spark, sf_dir):
    df = _predicted(spark, sf_dir).fillna(0.0, subset=["forecast"])
    h = metrics.residual_histogram(df, "actual", "forecast")
    return h.select("bin", "count", tidy("low").alias("low"), tidy("high").alias("high"))


@register
def metric_compare_models(spark, sf_dir):
    df = _predicted(spark, sf_dir)
    rows = None
    for name, p in (("volume", F.col("prediction")), ("neutral", F.lit(1)), ("long", F.lit(2))):
        m = metrics.accuracy(df.withColumn("prediction", p)).withColumn("model", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    out = metrics.compare_models(rows)
    return out.select("model", tidy("accuracy").alias("accuracy"))


# ----------------------------------------------------------------- artifacts
def _home(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _in_order(df: DataFrame, *columns: str) -> DataFrame:
    """A short catalogue with the place of each row."""
    rows = [(n, *r) for n, r in enumerate(df.select(*columns).collect(), 1)]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.sparkSession.createDataFrame(rows, f"place int, {kinds}")


@register
def dataset_round_trip(spark, sf_dir):
    """Exported splits come back."""
    home = _home(spark, "datasets")
    artifacts.export_datasets(splits.ratio_split(_labelled(spark, sf_dir)), home, "a", ["close", "volume"])
    out = artifacts.load_datasets(spark, home, "a")
    return out.select("symbol", stamp(), tidy("close").alias("close"), tidy("volume").alias("volume"), "target", "split")


@register
def dataset_catalogue(spark, sf_dir):
    """Newest first."""
    home, df = _home(spark, "datasets"), splits.ratio_split(_labelled(spark, sf_dir))
    artifacts.export_datasets(df, home, "old", ["close", "volume"], created_at="2024-01-01")
    artifacts.export_datasets(df.where("split = 'test'"), home, "new", ["close"], created_at="2024-02-01")
    return _in_order(artifacts.list_datasets(spark, home), "feature_set_id", "created_at", "n_samples", "n_features")


@register
def feature_set_catalogue(spark, sf_dir):
    """Sets saved one by one, listed newest first."""
    home = _home(spark, "sets")
    for n, r in enumerate(_sets(spark, sf_dir).orderBy("event_type").collect(), 1):
        config = '{"kind":"' + r["event_type"] + '"}'
        artifacts.save_feature_set(artifacts.feature_set_record(spark, r["features"], config, f"2024-01-0{n}"), home)
    found = artifacts.list_feature_sets(spark, home).withColumn("features", F.array_join("features", ","))
    return _in_order(found, "feature_set_id", "features", "n_features", "config", "created_at")


@register
def comparison_csv(spark, sf_dir):
    """The comparison of models as a CSV file, best first."""
    home = _home(spark, "comparison")
    artifacts.save_comparison(REGISTRY["metric_compare_models"](spark, sf_dir), home)
    return _in_order(spark.read.schema("model string, accuracy double").option("header", True).csv(home), "model", "accuracy")


@register
def scaler_round_trip(spark, sf_dir):
    """A scaler that was saved and loaded scales as before."""
    df, home = splits.ratio_split(_numbers(spark, sf_dir)), _home(spark, "scaler")
    scaling.save_scaler(scaling.fit_scaler(df.where("split = 'train'"), DENSE), home)
    return show(scaling.apply_scaler(df, scaling.load_scaler(spark, home), DENSE), *DENSE)


@register
def report_round_trip(spark, sf_dir):
    """Tables of a report come back."""
    home = _home(spark, "report")
    artifacts.save_report({"variance": REGISTRY["variance_filter"](spark, sf_dir), "balance": REGISTRY["target_distribution"](spark, sf_dir)}, home)
    return spark.read.parquet(f"{home}/variance").selectExpr("feature AS name", "variance AS value").unionByName(
        spark.read.parquet(f"{home}/balance").selectExpr("CAST(target AS STRING) AS name", "percentage AS value")
    )


@register
def store_metadata(spark, sf_dir):
    """Names, types and selection of features."""
    df = _numbers(spark, sf_dir)
    chosen = stats.variances(df, STAT_COLUMNS).selectExpr("feature", "variance >= 5000 AS selected")
    kinds = spark.createDataFrame([(c, df.schema[c].dataType.simpleString()) for c in STAT_COLUMNS], "feature string, type string")
    store = fs.FeatureStore(spark, _home(spark, "store"))
    store.save_metadata("v1", kinds.join(chosen, "feature"))
    return store.metadata("v1").select("feature", F.col("type").isin("double", "bigint").alias("numeric"), "selected")


# --------------------------------------------------------------------- store
def _map_rows(spark, sf_dir) -> DataFrame:
    bars = fs.as_map(_bars(spark, sf_dir), ["close", "volume"])
    return bars.withColumn("write_seq", F.lit(0).cast("bigint"))


def _changes(rows: DataFrame) -> DataFrame:
    """A second write: every bar of even hours again with other values."""
    again = rows.where(F.hour("ts") % 2 == 0)
    doubled = F.transform_values("features", lambda k, v: v * 2)
    return again.withColumns({"features": doubled, "write_seq": F.lit(1).cast("bigint")})


def _flat(df: DataFrame) -> DataFrame:
    f = F.col("features")
    return df.select(
        "symbol", stamp(), tidy(f["close"]).alias("close"), tidy(f["volume"]).alias("volume")
    )


def _store(spark, sf_dir) -> fs.FeatureStore:
    store = fs.FeatureStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = _map_rows(spark, sf_dir)
    store.save(rows)
    store.save(_changes(rows))
    return store


@register
def store_upsert(spark, sf_dir):
    return _flat(_store(spark, sf_dir).read())


@register
def store_upsert_plan(spark, sf_dir):
    rows = _map_rows(spark, sf_dir)
    return _flat(fs.upsert(rows, _changes(rows)))


@register
def store_get(spark, sf_dir):
    return _flat(fs.get(_map_rows(spark, sf_dir), "S1", "2024-01-10 05:00:00"))


@register
def store_latest(spark, sf_dir):
    return _flat(fs.get_latest(_map_rows(spark, sf_dir)))


@register
def store_range(spark, sf_dir):
    rows = _map_rows(spark, sf_dir)
    return _flat(fs.get_range(rows, "S2", "2024-01-10 05:00:00", "2024-01-12 05:00:00"))


@register
def store_delete(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.delete("S0")
    store.delete("S1", "2024-01-10 05:00:00")
    return _flat(store.read())


@register
def store_delete_count(spark, sf_dir):
    return fs.count_deleted(_map_rows(spark, sf_dir), "S0")


@register
def store_ttl(spark, sf_dir):
    return _flat(fs.expire(_map_rows(spark, sf_dir), 7))


@register
def store_purge(spark, sf_dir):
    store = fs.FeatureStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.save(_map_rows(spark, sf_dir))
    store.purge(7)
    return _flat(store.read())


#: Symbols whose folders are named otherwise.
ODD_SYMBOLS = {"S0": "S/0", "S1": "S:1", "S2": "S%2", "S3": "S 3=#"}


def _odd_store(spark, sf_dir) -> fs.FeatureStore:
    store = fs.FeatureStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    names = F.create_map(*[F.lit(x) for pair in ODD_SYMBOLS.items() for x in pair])
    store.save(_map_rows(spark, sf_dir).withColumn("symbol", names[F.col("symbol")]))
    return store


@register
def store_delete_odd_symbols(spark, sf_dir):
    store = _odd_store(spark, sf_dir)
    store.delete("S/0")
    store.delete("S:1", "2024-01-10 05:00:00")
    store.delete("S 3=#")
    return _flat(store.read())


@register
def store_purge_odd_symbols(spark, sf_dir):
    store = _odd_store(spark, sf_dir)
    store.purge(7)
    return _flat(store.read())


@register
def store_latest_of_odd_symbol(spark, sf_dir):
    return _flat(_odd_store(spark, sf_dir).latest("S%2"))


@register
def store_latest_of_symbol(spark, sf_dir):
    return _flat(_store(spark, sf_dir).latest("S1"))


@register
def store_info(spark, sf_dir):
    return fs.storage_info(_map_rows(spark, sf_dir))


# ----------------------------------------------------------------- streaming
def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    events = reader.parquet(sf_dir)
    return events.select(
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("value") + 1).alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("quantity"),
        F.col("event_type"),
    )


def _run_to_table(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", f"{home}/log").trigger(availableNow=True)
    query = writer.start(f"{home}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


@register
def stream_bars(spark, sf_dir):
    bars = bar_stream(_event_stream(spark, sf_dir), "1 hour", "10 minutes")
    return show(_run_to_table(bars, "bars"), "open", "high", "low", "close", "volume")


@register
def stream_liquidations(spark, sf_dir):
    side = F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL")
    orders = _event_stream(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    out = liquidation_stream(orders.withColumn("side", side), "1 hour", "10 minutes")
    return show(
        _run_to_table(out, "liquidations"),
        "liq_volume",
        "liq_avg_size",
        "liq_count",
        "long_liq_volume",
        "short_liq_volume",
    )


@register
def stream_store(spark, sf_dir):
    home = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    bars = bar_stream(_event_stream(spark, sf_dir), "1 hour", "10 minutes")
    # the store needs closed bars: a first query writes them, a second upserts
    closed = _run_to_table(bars, "closed")
    path = f"{home}/closed"
    closed.write.parquet(path)
    live = spark.readStream.schema(closed.schema).parquet(path)
    store = fs.FeatureStore(spark, f"{home}/store")
    query = maintain_store(fs.as_map(live, ["close", "volume"]), store, f"{home}/log")
    query.awaitTermination()
    return _flat(store.read())


@register
def stream_expiry(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select("symbol", "ts", "seq", "price")
    out = _run_to_table(expiry_stream(rows, "1 hour", "10 minutes"), "expiry")
    times = [stamp(c).alias(c) for c in ("live_from", "expired_at")]
    return out.select("symbol", stamp(), "seq", tidy("price").alias("price"), "rows", *times)


@register
def stream_store_again(spark, sf_dir):
    """A second stream with a checkpoint of its own writes the same bars with other values."""
    home = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    bars = fs.as_map(_bars(spark, sf_dir), ["close", "volume"])
    store = fs.FeatureStore(spark, f"{home}/store")
    for n, rows in enumerate((bars, _changes(bars.withColumn("write_seq", F.lit(0))).drop("write_seq"))):
        rows.write.parquet(f"{home}/in{n}")
        live = spark.readStream.schema(rows.schema).parquet(f"{home}/in{n}")
        maintain_store(live, store, f"{home}/log{n}").awaitTermination()
    return _flat(store.read())


def _family(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return family(spark, sf_dir, name)


# -------------------------------------------------------------------- models
# Small ensembles: these runs check behaviour over the whole tables.
def _model_rows(spark, sf_dir) -> DataFrame:
    df = targets.classification_target(_numbers(spark, sf_dir), 4, 0.5)
    df = df.withColumn("label", F.col("target").cast("double")).fillna(0.0)
    return stored(splits.ratio_split(df), "model-rows")


def _vectors(df: DataFrame) -> DataFrame:
    keep = ["symbol", "ts", "split", "label", "future_return"]
    return stored(assemble(df, DENSE, keep), "vectors")


def _fit_score(make: Callable, spark, sf_dir) -> DataFrame:
    rows = _vectors(_model_rows(spark, sf_dir))
    rows = rows.withColumn("is_val", F.col("split") == "val")
    model = make().fit(rows.where("split <> 'test'"), "label")
    return metrics.accuracy(model.predict(rows.where("split = 'test'")))


def _quick_boost(**kw):
    return BoostedClassifier(max_iter=5, max_depth=3, **kw)


def _quick_forest(**kw):
    return ForestClassifier(trees=10, max_depth=4, **kw)


def _quick_regressor(**kw):
    return BoostedRegressor(max_iter=5, max_depth=3, **kw)


REGISTRY["model_boosted"] = partial(_fit_score, _quick_boost)
REGISTRY["model_boosted_early"] = partial(_fit_score, partial(_quick_boost, validation="is_val"))
REGISTRY["model_forest"] = partial(_fit_score, _quick_forest)
REGISTRY["model_stacked"] = partial(
    _fit_score, lambda: StackedClassifier([_quick_forest, partial(_quick_forest, seed=7)], folds=3)
)


@register
def model_regressor(spark, sf_dir):
    rows = _vectors(_model_rows(spark, sf_dir))
    model = _quick_regressor().fit(rows.where("split = 'train'"), "future_return")
    scored = model.predict(rows.where("split = 'test'"))
    return metrics.regression_metrics(scored, "future_return", "prediction")


@register
def model_stacked_regressor(spark, sf_dir):
    rows = _vectors(_model_rows(spark, sf_dir))
    stack = StackedRegressor([_quick_regressor, partial(_quick_regressor, seed=7)], folds=2)
    model = stack.fit(rows.where("split = 'train'"), "future_return")
    scored = model.predict(rows.where("split = 'test'"))
    return metrics.regression_metrics(scored, "future_return", "prediction")


@register
def model_importance(spark, sf_dir):
    rows = _vectors(_model_rows(spark, sf_dir))
    model = _quick_boost().fit(rows.where("split = 'train'"), "label")
    return importance.importance_table(spark, DENSE, model.importance())


@register
def model_walk_forward(spark, sf_dir):
    folds = splits.series_folds(_model_rows(spark, sf_dir).drop("rn", "n"), 3)
    rows = stored(assemble(folds, DENSE, ["fold", "role", "label"]), "folds")
    return fold_summary(walk_forward(_quick_forest, rows))


@register
def model_search(spark, sf_dir):
    rows = _vectors(_model_rows(spark, sf_dir))
    space = {"trees": (5, 20), "max_depth": (2, 5)}
    fit_on, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    found = search(ForestClassifier, space, fit_on, val, trials=4)
    p = F.col("params")
    return found.select("trial", "score", p["trees"].alias("trees"), p["max_depth"].alias("depth"))


# Search ranges of the queries: the library's, with fewer and flatter trees.
_SMALL = {"max_iter": (3, 8), "max_depth": (2, 4)}
_SMALL_SPACES = {
    "boosted_classifier": CLASSIFIER_SPACE | _SMALL,
    "forest_classifier": FOREST_SPACE | {"trees": (5, 20), "max_depth": (2, 5)},
    "boosted_regressor": CLASSIFIER_SPACE | _SMALL,
}


def _split_vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _vectors(_model_rows(spark, sf_dir))
    return rows.where("split = 'train'"), rows.where("split = 'val'")


@register
def model_search_regressor(spark, sf_dir):
    """Every trial, best first."""
    fit_on, val = _split_vectors(spark, sf_dir)
    space = _SMALL_SPACES["boosted_regressor"]
    found = search(BoostedRegressor, space, fit_on, val, "future_return", "regression", trials=4)
    p = F.col("params")
    return found.select("trial", "score", *[p[name].alias(name) for name in space])


@register
def model_search_all(spark, sf_dir):
    """The best trial of each family and whether its parameters lie in their ranges."""
    fit_on, val = _split_vectors(spark, sf_dir)
    found = search_all(fit_on, val, "label", "future_return", trials=2, spaces=_SMALL_SPACES)
    params = F.col("params")
    inside = reduce(
        lambda whole, part: whole.when(F.col("model") == part[0], reduce(
            lambda a, b: a & b, [params[k].between(*r[:2]) for k, r in part[1].items()]
        )),
        _SMALL_SPACES.items(),
        F.when(F.lit(False), False),
    )
    return found.select("model", inside.alias("in_range"), F.col("score").isNotNull().alias("scored"))


@register
def prediction_facts(spark, sf_dir):
    """K1, K3, K6, K8: test rows, those whose probabilities sum to 1, those that take the likeliest class."""
    rows = _vectors(_model_rows(spark, sf_dir))
    fit_on, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    makes = {
        "boosted": _quick_boost,
        "forest": _quick_forest,
        "stacked": lambda: StackedClassifier([_quick_forest, partial(_quick_forest, seed=7)], folds=3),
    }
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    likeliest = F.element_at(p, F.col("prediction").cast("int") + 1) == F.array_max(p)
    parts = [
        make().fit(fit_on, "label").predict(test).agg(
            F.lit(name).alias("model"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.abs(total - 1) < 1e-9).alias("sum_to_one"),
            F.count_if(likeliest).alias("likeliest"),
        )
        for name, make in makes.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@register
def shapley_sums(spark, sf_dir):
    """Rows whose effects sum to the change of the output, and whose output is the model's."""
    rows = _vectors(_model_rows(spark, sf_dir))
    fit_on = rows.where("split = 'train'")
    makes = {"boosted": _quick_boost, "forest": _quick_forest, "regressor": _quick_regressor}
    parts = []
    for name, make in makes.items():
        regression = name == "regressor"
        model = make().fit(fit_on, "future_return" if regression else "label")
        own = F.array("prediction") if regression else F.col("probabilities")
        scored = model.predict(rows).withColumn("own", own)
        found = importance.shapley_values(model, scored, DENSE, permutations=2, keep=["own"])
        near = lambda a, b: F.forall(
            F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-9 * (1 + F.abs(y))), lambda ok: ok
        )
        summed = F.aggregate(
            "phi", F.col("base"), lambda a, v: F.zip_with(a, v, lambda x, y: x + y)
        )
        parts.append(
            found.agg(
                F.lit(name).alias("model"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(near(summed, F.col("value"))).alias("sums_hold"),
                F.count_if(near(F.col("value"), F.col("own"))).alias("outputs_hold"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@register
def importance_forest(spark, sf_dir):
    return importance.forest_importance(
        _model_rows(spark, sf_dir), DENSE, "label", trees=10, depth=4
    )


@register
def importance_summary(spark, sf_dir):
    return importance.importance_summary(
        _model_rows(spark, sf_dir), DENSE, "label", repeats=3, trees=10, depth=4
    )


@register
def importance_shapley(spark, sf_dir):
    rows = _vectors(_model_rows(spark, sf_dir))
    model = _quick_forest().fit(rows.where("split = 'train'"), "label")
    return importance.shapley_importance(model, rows, DENSE, permutations=2)


@register
def select_combined(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    return importance.select_combined(rows, DENSE, "label", 5, trees=10, depth=4)[1]


@register
def feature_report(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    report = importance.feature_report(rows, DENSE, "label", trees=10, depth=4)
    parts = [t.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(n)) for n, t in report.items()]
    return reduce(DataFrame.unionByName, parts)


@register
def train_pipeline(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).withColumn("target_return", F.col("future_return"))
    result = train(
        rows,
        DENSE,
        "label",
        classifiers={"forest": _quick_forest, "boosted": _quick_boost},
        regressor=_quick_regressor,
        stack_folds=2,
        explain=False,
    )
    return result.scores


@register
def train_explanation(spark, sf_dir):
    """Mean absolute effect of each feature on the test predictions."""
    rows = _model_rows(spark, sf_dir).withColumn("target_return", F.col("future_return"))
    result = train(
        rows, DENSE, "label", classifiers={"forest": _quick_forest}, regressor=None, stack=False, permutations=2
    )
    return result.explanation


@register
def end_to_end(spark, sf_dir):
    """Feeds to trained models; rows of the artifacts that the job left."""
    f, home = _feeds(spark, sf_dir), _home(spark, "job")
    feeds = {"ohlcv": f.ohlcv(), "open_interest": f.open_interest(), "ls_ratio": f.ls_ratio()}
    result = run_all(
        feeds,
        home,
        horizon=4,
        threshold=0.5,
        n_features=8,
        trees=5,
        classifiers={"forest": _quick_forest},
        regressor=None,
        stack_folds=2,
        permutations=2,
    )
    set_id = artifacts.list_datasets(spark, home).first()["feature_set_id"]
    parts = artifacts.load_datasets(spark, home, set_id)
    tables = {
        "selection": spark.read.parquet(f"{home}/selection_report"),
        "feature_sets": artifacts.list_feature_sets(spark, home),
        "comparison": spark.read.option("header", True).csv(f"{home}/comparison"),
        "explanation": spark.read.parquet(f"{home}/explanation"),
        "predictions": result.predictions["stacked"],
    }
    rows = F.count(F.lit(1)).alias("rows")
    counts = [t.agg(rows).select(F.lit(n).alias("artifact"), "rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counts, parts.groupBy(F.col("split").alias("artifact")).agg(rows))


@register
def train_regressors(spark, sf_dir):
    """Test metrics of the regressor and of its stack."""
    rows = _model_rows(spark, sf_dir).withColumn("target_return", F.col("future_return"))
    result = train(
        rows, DENSE, "label", classifiers={"forest": _quick_forest}, regressor=_quick_regressor, stack_folds=2,
        explain=False,
    )
    return result.regression.select("model", "n", *[tidy(c).alias(c) for c in _REG])


def all_queries() -> dict[str, Query]:
    out = {name: partial(_family, name) for name in FAMILIES}
    out.update(REGISTRY)
    return out
