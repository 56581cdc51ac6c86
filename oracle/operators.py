"""Comparison SQL of all operators outside the feature families."""

from __future__ import annotations

from . import features as f
from .build import (
    DAILY,
    FEEDS,
    Query,
    fdiv,
    feeds,
    lag,
    lead,
    mean,
    only,
    stamp,
    tidy,
    with_ewm,
)

SQL: dict[str, str] = {}
BARS = only("tick", "bars")
RAW = (
    "SELECT b.*, o.open_interest, f.funding_rate, coalesce(l.liq_volume, 0) AS liq_volume, "
    "coalesce(l.liq_avg_size, 0) AS liq_avg_size, coalesce(l.liq_count, 0) AS liq_count, "
    'l.long_liq_volume, l.short_liq_volume, r."longShortRatio" '
    "FROM bars b LEFT JOIN oi o ON b.symbol = o.symbol AND b.ts = o.ts "
    "LEFT JOIN fund f ON b.symbol = f.symbol AND b.ts = f.ts "
    "LEFT JOIN liqbars l ON b.symbol = l.symbol AND b.ts = l.ts "
    "LEFT JOIN lsr r ON b.symbol = r.symbol AND b.ts = r.ts"
)
raw = Query(FEEDS[:-1], "liqbars").cte("raw", RAW)


def t(*names: str, digits: int = 6) -> str:
    return ", ".join(f'{tidy(n, digits)} AS "{n.strip(chr(34))}"' for n in names)


# ------------------------------------------------------------------- sources
RANGE = "symbol = 'S1' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"
SQL["src_ohlcv"] = BARS.rows("open", "high", "low", "close", "volume", where=RANGE)
SQL["src_open_interest"] = only("tick", "oi").rows("open_interest", where=RANGE)
SQL["src_funding"] = only("tick", "fund").rows("funding_rate", where=RANGE)
SQL["src_liquidations"] = only("tick", "liq").sql(
    f"SELECT symbol, {stamp()} AS ts, {t('quantity')}, side, order_id FROM liq WHERE {RANGE}"
)
SQL["src_ls_ratio"] = only("tick", "lsr").rows("longShortRatio", where=RANGE)
SQL["src_all_recent"] = Query(FEEDS[:6], "lsr").sql(
    " UNION ALL ".join(
        f"SELECT symbol, count(*) AS n, '{n}' AS feed FROM {v} WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 7 DAY GROUP BY symbol"
        for n, v in (
            ("ohlcv", "bars"),
            ("open_interest", "oi"),
            ("funding", "fund"),
            ("liquidations", "liq"),
            ("ls_ratio", "lsr"),
        )
    )
)
SQL["table_save_load"] = BARS.rows(
    "open", "high", "low", "close", "volume",
    where="symbol = 'S2' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-15'",
)
SQL["table_save_load_month"] = BARS.rows(
    "close", "volume",
    where="symbol = 'S3' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-15 12:00:00'",
)

# ------------------------------------------------------------------- quality
SQL["validate_feeds"] = only("tick").sql(
    "SELECT 'ohlcv' AS feed, true AS valid, '' AS errors, 0 AS n_warnings "
    "UNION ALL SELECT 'open_interest', true, '', 0 "
    "UNION ALL SELECT 'funding', false, 'missing column funding_rate', 0 "
    "UNION ALL SELECT 'liquidations', true, '', 0 "
    "UNION ALL SELECT 'ls_ratio', NULL, '', 1 "
    "UNION ALL SELECT 'targets', d = 0, CASE WHEN d > 0 THEN d || ' duplicate timestamps' ELSE '' END, 1 "
    "FROM (SELECT count(*) - count(DISTINCT (symbol, ts)) AS d FROM tick)"
)
SQL["validation_summary"] = only("tick").sql(
    "SELECT 1 + CASE WHEN count(*) > count(DISTINCT (symbol, ts)) THEN 1 ELSE 0 END AS total_errors, "
    "0 AS total_warnings, false AS passed FROM tick"
)
SQL["timezone_utc"] = f"SELECT event_id, {stamp('ts - INTERVAL 9 HOUR')} AS ts FROM events"
ARRIVAL = only("tick").cte(
    "a", "SELECT symbol, tick_ts AS ts, xor(event_id, 5) AS arrival FROM tick"
).cte("p", "SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY arrival) AS prev FROM a")
SQL["out_of_order"] = ARRIVAL.sql(f"SELECT symbol, {stamp()} AS ts, arrival FROM p WHERE ts < prev")
SQL["monotonic_check"] = ARRIVAL.sql("SELECT count(*) = 0 AS monotonic FROM p WHERE ts < prev")
SQL["duplicate_timestamps"] = only("tick", "liq").sql(
    f"SELECT symbol, {stamp()} AS ts, order_id FROM liq QUALIFY count(*) OVER (PARTITION BY symbol, ts) > 1"
)
SQL["gap_report"] = BARS.add(gap_seconds=f"epoch(ts) - {lag('epoch(ts)')}").add(
    expected_seconds="3600.0", excess_seconds="gap_seconds - 3600"
).rows("gap_seconds", "expected_seconds", "excess_seconds", where="gap_seconds > 3660")
RAW_COLUMNS = [
    "symbol", "open", "high", "low", "close", "volume", "open_interest", "funding_rate",
    "liq_volume", "liq_avg_size", "liq_count", "long_liq_volume", "short_liq_volume", '"longShortRatio"',
]
SQL["missing_report"] = raw.sql(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c.strip(chr(34))}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_count, "
        f"{tidy(f'count(*) FILTER ({c} IS NULL) * 100.0 / count(*)')} AS missing_pct, "
        f"{stamp(f'min(ts) FILTER ({c} IS NULL)')} AS first_missing FROM raw"
        for c in RAW_COLUMNS
    )
    + ") WHERE missing_count > 0"
)
SQL["alignment_summary"] = raw.sql(
    f"SELECT count(*) AS rows, 15 AS columns, {stamp('min(ts)')} AS start, {stamp('max(ts)')} AS \"end\", "
    + "CAST("
    + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in RAW_COLUMNS)
    + " AS BIGINT) AS missing_cells FROM raw"
)
SQL["feature_set_check"] = (
    "SELECT event_type AS feature_set_id, "
    "coalesce(string_agg(n, ',' ORDER BY n) FILTER (i % 2 = 1), '') AS missing, "
    "count(*) FILTER (i % 2 = 1) = 0 AS valid "
    "FROM (SELECT DISTINCT event_type, user_id % 40 AS i, 'f' || CAST(user_id % 40 AS VARCHAR) AS n FROM events) GROUP BY event_type"
)

# ----------------------------------------------------------------- alignment
SQL["base_timeline"] = only("tick").sql(
    f"SELECT symbol, {stamp()} AS ts, {t('px')}, qty, event_id FROM tick "
    "QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) = 1"
)
BACK = "OVER (PARTITION BY symbol ORDER BY ts)"
AHEAD = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
ALL = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
LS = '"longShortRatio"'


def ff(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) {BACK}"


def bf(c: str) -> str:
    return f"first_value({c} IGNORE NULLS) {AHEAD}"


def line(q: Query, c: str, out: str) -> Query:
    """Linear interpolation in time; trailing rows keep the last value."""
    q = q.add(
        pt=f"last_value(CASE WHEN {c} IS NOT NULL THEN epoch(ts) END IGNORE NULLS) {BACK}",
        px_=ff(c),
        nt=f"first_value(CASE WHEN {c} IS NOT NULL THEN epoch(ts) END IGNORE NULLS) {AHEAD}",
        nx_=bf(c),
    )
    q = q.add(
        **{
            out: f"coalesce({c}, CASE WHEN nt > pt THEN px_ + (nx_ - px_) * ((epoch(ts) - pt) / (nt - pt)) END, px_)"
        }
    )
    return q.cte(f"d{len(q.ctes)}", f"SELECT * EXCLUDE (pt, px_, nt, nx_) FROM {q.last}")


def align_sql(a: str, b: str, where: str = "") -> str:
    return raw.sql(
        f'SELECT symbol, ts, close, funding_rate, "longShortRatio" FROM (SELECT symbol, {stamp()} AS ts, {t("close")}, '
        f'{tidy(a)} AS funding_rate, {tidy(b)} AS "longShortRatio" FROM raw {where})'
    )


SQL["align_ffill"] = align_sql(ff("funding_rate"), ff(LS))
SQL["align_bfill"] = align_sql(bf("funding_rate"), bf(LS))
SQL["align_zero"] = align_sql("coalesce(funding_rate, 0)", f"coalesce({LS}, 0)")
SQL["align_drop"] = align_sql("funding_rate", LS, f"WHERE funding_rate IS NOT NULL AND {LS} IS NOT NULL")
_interp = line(line(raw, "funding_rate", "fr"), LS, "lr")
SQL["align_interpolate"] = _interp.sql(
    f'SELECT symbol, {stamp()} AS ts, {t("close")}, {tidy("fr")} AS funding_rate, {tidy("lr")} AS "longShortRatio" FROM {_interp.last}'
)
SQL["align_one_feed"] = raw.sql(
    f'SELECT symbol, {stamp()} AS ts, {t("close")}, {tidy(ff(LS))} AS "longShortRatio", {tidy(f"2 * ({ff(LS)})")} AS close_ls FROM raw'
)
SQL["joined_feeds"] = raw.rows(
    "close", "open_interest", "funding_rate", "liq_volume", "liq_avg_size", "liq_count",
    "long_liq_volume", "short_liq_volume", "longShortRatio",
)


def spine(src: str, step: str) -> str:
    return (
        f"SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts FROM {src} GROUP BY symbol"
    )


_res = (
    feeds()
    .cte(
        "r",
        "SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2024-01-01') AS ts, arg_min(open, ts) AS open, "
        "max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, "
        "arg_max(open_interest, ts) AS open_interest, arg_max(ratio_raw, ts) AS lsr_ FROM j GROUP BY 1, 2",
    )
    .cte("sp", spine("r", "4 HOUR"))
    .cte(
        "o",
        'SELECT sp.symbol, sp.ts, open, high, low, close, coalesce(volume, 0) AS volume, open_interest, lsr_ AS "longShortRatio" '
        "FROM sp LEFT JOIN r ON sp.symbol = r.symbol AND sp.ts = r.ts",
    )
)
SQL["resample_4h"] = _res.rows("open", "high", "low", "close", "volume", "open_interest", "longShortRatio")
SQL["resample_ticks"] = (
    only("tick")
    .cte(
        "r",
        "SELECT symbol, time_bucket(INTERVAL 30 MINUTE, tick_ts, TIMESTAMP '2024-01-01') AS ts, avg(px) AS px, sum(qty) AS qty FROM tick GROUP BY 1, 2",
    )
    .cte("sp", spine("r", "30 MINUTE"))
    .cte(
        "o",
        "SELECT sp.symbol, sp.ts, px, coalesce(qty, 0) AS qty FROM sp LEFT JOIN r ON sp.symbol = r.symbol AND sp.ts = r.ts",
    )
    .rows("px", "qty")
)
_full = (
    only("tick", "lsr")
    .cte("sp", spine("lsr", "1 HOUR"))
    .cte("c", f"SELECT sp.symbol, sp.ts, {LS} FROM sp LEFT JOIN lsr ON sp.symbol = lsr.symbol AND sp.ts = lsr.ts")
)
for _name, _expr in (("ffill", ff(LS)), ("bfill", bf(LS))):
    SQL[f"complete_{_name}"] = _full.sql(
        f'SELECT symbol, {stamp()} AS ts, {tidy(_expr)} AS "longShortRatio" FROM c'
    )
_li = line(_full, LS, "lr")
SQL["complete_interpolate"] = _li.sql(
    f'SELECT symbol, {stamp()} AS ts, {tidy("lr")} AS "longShortRatio" FROM {_li.last}'
)
_FILLED = ("funding_rate", "long_liq_volume", "short_liq_volume", "longShortRatio")
for _mode in ("reference", "causal"):
    _cols = ", ".join(
        f'{tidy("coalesce(" + ff(chr(34) + c + chr(34)) + (", first_value(" + chr(34) + c + chr(34) + " IGNORE NULLS) " + ALL if _mode == "reference" else "") + ", 0)")} AS "{c}"'
        for c in _FILLED
    )
    SQL[f"fill_{_mode}"] = raw.sql(f"SELECT symbol, {stamp()} AS ts, {_cols} FROM raw")
_inf = feeds().add(x=fdiv("liq_volume", "(liq_count % 3)")).add(
    y="CASE WHEN abs(x) < CAST('inf' AS DOUBLE) THEN x END"
)
SQL["clean_infinite"] = _inf.sql(
    f"SELECT symbol, {stamp()} AS ts, {tidy(f'coalesce({ff(chr(121))}, first_value(y IGNORE NULLS) {ALL}, 0)')} AS x FROM {_inf.last}"
)
SQL["drop_missing_rows"] = raw.rows(
    "close", "long_liq_volume", "longShortRatio",
    where=f"long_liq_volume IS NOT NULL AND {LS} IS NOT NULL",
)
SQL["latest_row"] = feeds().sql(
    f"SELECT symbol, {stamp()} AS ts, {t('close', 'open_interest', 'funding_rate')} FROM j "
    "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"
)
SQL["top_volume"] = BARS.sql(
    f"SELECT symbol, {stamp()} AS ts, {t('volume')} FROM (SELECT * FROM bars ORDER BY volume DESC, symbol, ts LIMIT 20)"
)

# ---------------------------------------------------------------- indicators
_daily = Query([("d", DAILY)], "d").cte(
    "j",
    "SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS rn FROM d",
)
_dp = f.price(_daily)
_dv = f.volume(_daily)
SQL["ta_rsi"] = _dp.rows("rsi_14")
SQL["ta_sma"] = _daily.add(sma=mean("close", 30)).rows("sma")
SQL["ta_macd"] = (
    with_ewm(_daily, {"ema_12": ("close", 12), "ema_26": ("close", 26)}, {"macds": ("ema_12", "ema_26")})
    .add(macd_12_26_9="ema_12 - ema_26", macds_12_26_9="macds", macdh_12_26_9="ema_12 - ema_26 - macds")
    .rows("MACD_12_26_9", "MACDs_12_26_9", "MACDh_12_26_9")
)
SQL["ta_stoch"] = _dp.rows("STOCHk_14_3_3", "STOCHd_14_3_3")
SQL["ta_roc"] = _dp.rows("roc_10")
SQL["ta_willr"] = _dp.rows("willr_14")
SQL["ta_atr"] = _dp.rows("atr_14")
SQL["ta_bbands"] = _dp.rows(*(f"BB{k}_20_2" for k in "LMUBP"))
SQL["ta_adx"] = _dp.rows("ADX_14", "DMP_14", "DMN_14")
SQL["ta_obv"] = _dv.rows("obv")
SQL["ta_cmf"] = _dv.rows("cmf")
SQL["ta_mfi"] = _dv.rows("mfi")


def _gap_step(o: str, span: int) -> str:
    a, al = f"(1.0 - 2.0 / {span + 1}.0)", f"(2.0 / {span + 1}.0)"
    return (
        f"CASE WHEN b.x IS NULL THEN e.{o} WHEN e.{o} IS NULL THEN b.x "
        f"ELSE (power({a}, e.g + 1) * e.{o} + {al} * b.x) / (power({a}, e.g + 1) + {al}) END AS {o}"
    )


_gap = feeds().cte(
    "gi", "SELECT symbol, ts, CAST(rn AS BIGINT) AS k, CAST(long_liq_volume AS DOUBLE) AS x FROM j"
).cte(
    "ge",
    "SELECT symbol, k, ts, x AS ema_9, x AS ema_26, 0 AS g FROM gi WHERE k = 1 UNION ALL "
    f"SELECT b.symbol, b.k, b.ts, {_gap_step('ema_9', 9)}, {_gap_step('ema_26', 26)}, "
    "CASE WHEN b.x IS NULL THEN e.g + 1 ELSE 0 END FROM ge e JOIN gi b ON b.symbol = e.symbol AND b.k = e.k + 1",
    recursive=True,
)
SQL["ta_ema"] = _gap.rows("ema_9", "ema_26")


# -------------------------------------------------------------- feature table
def feature_table_sql(names: list[str]) -> str:
    q = f.everything()
    cols = ", ".join(
        f'{tidy(f"coalesce({ff(c)}, first_value({c} IGNORE NULLS) {ALL}, 0)")} AS "{c}"'
        for c in names
    )
    return q.sql(f"SELECT symbol, {stamp()} AS ts, {cols} FROM {q.last}")


# ------------------------------------------------------------------- targets
def change(x: str, h: int) -> str:
    return fdiv(f"{lead(x, h)} - {x}", x)


def label(x: str, thr: float) -> str:
    return f"CASE WHEN {x} > {thr} THEN 2 WHEN {x} < -{thr} THEN 0 ELSE 1 END"


_b = BARS.add(
    rn="row_number() OVER (PARTITION BY symbol ORDER BY ts)",
    n="count(*) OVER (PARTITION BY symbol)",
)
_c = _b.add(future_return=change("close", 12))
SQL["target_class3"] = _c.add(target=label("future_return", 0.1), target_return="future_return").rows(
    "target", "future_return", "target_return", where="rn <= n - 12"
)
SQL["target_class2"] = _c.add(target="CASE WHEN future_return > 0.1 THEN 1 ELSE 0 END").rows(
    "target", "future_return", where="rn <= n - 12"
)
SQL["target_returns"] = _b.add(
    target_return_1h=change("close", 12),
    target_return_4h=change("close", 48),
    target_return_24h=change("close", 288),
).rows("target_return_1h", "target_return_4h", "target_return_24h", where="rn <= n - 288")
_j = feeds().add(n="count(*) OVER (PARTITION BY symbol)")
SQL["target_oi"] = _j.add(target_oi_change=change("open_interest", 48)).rows(
    "target_oi_change", where="rn <= n - 48"
)
_lr = _b.add(lr=f"ln({fdiv('close', lag('close'))})")
_VF = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 FOLLOWING AND 48 FOLLOWING)"
SQL["target_volatility"] = _lr.add(
    target_volatility=f"CASE WHEN rn >= 20 AND count(lr) OVER {_VF} = 20 THEN stddev_samp(lr) OVER {_VF} * sqrt(288) END"
).rows("target_volatility", where="rn <= n - 68")
_VL = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING)"
SQL["target_volatility_long"] = _lr.add(
    target_volatility=f"CASE WHEN rn >= 20 AND count(lr) OVER {_VL} = 20 THEN stddev_samp(lr) OVER {_VL} * sqrt(288) END"
).rows("target_volatility", where="rn <= n - 30")
_m = _b.add(**{f"target_return_{k}h": change("close", h) for k, h in ((1, 12), (4, 48), (8, 96), (24, 288))})
_m = _m.add(**{f"target_class_{k}h": label(f"target_return_{k}h", 0.005) for k in (1, 4, 8, 24)})
SQL["target_multi"] = _m.rows(
    *(f"target_{k}_{h}h" for k in ("return", "class") for h in (1, 4, 8, 24)), where="rn <= n - 288"
)
SQL["target_direction"] = _b.add(direction=f"sign({lead('close', 48)} - close)").rows(
    "direction", where="rn <= n - 48"
)
_lab = (
    _b.add(future_return=change("close", 4))
    .add(target=label("future_return", 0.5))
    .cte("lab", "SELECT * EXCLUDE (rn, n) FROM s3 WHERE rn <= n - 4")
)
_lab.ctes[-1] = ("lab", f"SELECT * EXCLUDE (rn, n) FROM {_lab.ctes[-2][0]} WHERE rn <= n - 4")
SQL["target_distribution"] = _lab.sql(
    f"SELECT target, count(*) AS count, {tidy('count(*) * 100.0 / sum(count(*)) OVER ()')} AS percentage FROM lab GROUP BY target"
)
for _name, _fn in (("undersample", "min"), ("oversample", "max")):
    SQL[f"balance_{_name}"] = _lab.sql(
        f"SELECT target, CAST({_fn}(count(*)) OVER () AS BIGINT) AS count FROM lab GROUP BY target"
    )
_PREV = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
SQL["sequence_windows"] = _b.add(
    length=f"count(*) OVER {_PREV}",
    oldest=lag("close", 24),
    newest=lag("close", 1),
    total=f"sum(close + 1000 * volume) OVER {_PREV}",
).sql("SELECT 1").rsplit("\n", 1)[0] + (
    f"\nSELECT symbol, {stamp()} AS ts, length, {t('oldest', 'newest')}, {t('total', digits=3)}, {t('close')} FROM s3 WHERE rn > 24"
)

# -------------------------------------------------------------------- splits
_i = BARS.add(
    rn="row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1",
    n="count(*) OVER (PARTITION BY symbol)",
)
_last = _i.last


def ratio_case(rn: str = "rn", n: str = "n") -> str:
    return (
        f"CASE WHEN {rn} < floor({n} * CAST(0.6 AS DOUBLE)) THEN 'train' "
        f"WHEN {rn} < floor({n} * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END"
    )


SQL["split_ratio"] = _i.sql(
    f"SELECT symbol, {stamp()} AS ts, rn, n, {ratio_case()} AS split FROM {_last}"
)
SQL["split_dates"] = BARS.sql(
    f"SELECT symbol, {stamp()} AS ts, CASE WHEN ts <= TIMESTAMP '2024-01-18' THEN 'train' "
    "WHEN ts <= TIMESTAMP '2024-01-24 06:00:00' THEN 'val' ELSE 'test' END AS split FROM bars"
)
_cv = _i.add(cv="CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)").add(v="cv // 6")
SQL["split_cv"] = _cv.sql(
    f"SELECT symbol, {stamp()} AS ts, CAST(i AS INTEGER) AS fold, CASE WHEN rn < v * i THEN 'train' ELSE 'val' END AS role "
    f"FROM {_cv.last} CROSS JOIN generate_series(1, 5) g(i) WHERE rn < v * (i + 1) AND rn < cv"
)
SQL["split_walk_forward"] = _i.sql(
    f"SELECT symbol, {stamp()} AS ts, CAST(w + 1 AS INTEGER) AS fold, CASE WHEN rn < w * 60 + 200 THEN 'train' ELSE 'val' END AS role "
    f"FROM {_last} CROSS JOIN generate_series(0, 100) g(w) WHERE w * 60 + 250 <= n AND rn >= w * 60 AND rn < w * 60 + 250"
)
SQL["split_series_folds"] = _i.add(z="n // 6").sql("SELECT 1").rsplit("\n", 1)[0] + (
    f"\nSELECT symbol, {stamp()} AS ts, CAST(i AS INTEGER) AS fold, CASE WHEN rn >= n - z * (6 - i) THEN 'test' "
    "WHEN rn < floor((n - z * (6 - i)) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS role "
    "FROM s3 CROSS JOIN generate_series(1, 5) g(i) WHERE rn < n - z * (5 - i)"
)
SQL["split_purged"] = _i.add(split=ratio_case()).sql("SELECT 1").rsplit("\n", 1)[0] + (
    f"\nSELECT symbol, {stamp()} AS ts, rn, split FROM s3 WHERE split = 'test' "
    "OR (split = 'train' AND rn < floor(n * CAST(0.6 AS DOUBLE)) - 24) "
    "OR (split = 'val' AND rn >= floor(n * CAST(0.6 AS DOUBLE)) + 12)"
)
_ls = _lab.add(
    rn="row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1",
    n="count(*) OVER (PARTITION BY symbol)",
).add(split=ratio_case())
_lsn = _ls.last
SQL["split_statistics"] = _ls.sql(
    f"SELECT split, count(*) AS n_samples, {tidy('avg(future_return)')} AS mean, {tidy('stddev_samp(future_return)')} AS std, "
    f"{tidy('min(future_return)')} AS min, {tidy('max(future_return)')} AS max FROM {_lsn} GROUP BY split"
)
SQL["split_class_counts"] = _ls.sql(
    f"SELECT split, target, count(*) AS count, {tidy('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split)')} AS pct FROM {_lsn} GROUP BY split, target"
)
SQL["dataset_metadata"] = _ls.sql(
    f"SELECT split, count(*) AS n_samples, 2 AS n_features, {stamp('min(ts)')} AS start, {stamp('max(ts)')} AS \"end\", "
    f"{tidy('min(target)')} AS target_min, {tidy('max(target)')} AS target_max, {tidy('avg(target)')} AS target_mean, "
    f"{tidy('stddev_samp(target)')} AS target_std FROM {_lsn} GROUP BY split"
)
SQL["dataset_class_counts"] = _ls.sql(
    f"SELECT split, target, count(*) AS count FROM {_lsn} GROUP BY split, target"
)

# ---------------------------------------------------------------- statistics
STAT = ["open", "high", "low", "close", "volume", "open_interest", "liq_volume", "liq_count", "long_liq_volume"]
DENSE = STAT[:-1]


def each(select: str, columns: list[str], src: str = "raw") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {select.replace('$x', f'CAST({c} AS DOUBLE)')} FROM {src}" for c in columns
    )


SQL["variance_filter"] = raw.sql(
    f"SELECT feature, {tidy('v', 4)} AS variance FROM ({each('var_samp($x) AS v', STAT)}) WHERE v < 5000"
)
_pairs = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS c FROM raw"
    for i, a in enumerate(STAT)
    for b in STAT[i + 1 :]
)
SQL["corr_pairs"] = raw.sql(
    f"SELECT feature_1, feature_2, {tidy('c')} AS correlation FROM ({_pairs})"
)
SQL["corr_report"] = raw.sql(
    f"SELECT feature_1, feature_2, {tidy('abs(c)')} AS correlation FROM ({_pairs}) WHERE abs(c) >= 0.5"
)
SQL["corr_filter"] = raw.sql(
    f"SELECT DISTINCT feature_2 AS feature FROM ({_pairs}) WHERE abs(c) > 0.7"
)
_spearman = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr(x, y) AS c FROM (SELECT "
    f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, "
    f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y "
    f"FROM raw WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    for i, a in enumerate(STAT)
    for b in STAT[i + 1 :]
)
SQL["corr_spearman"] = raw.sql(
    f"SELECT feature_1, feature_2, {tidy('c')} AS correlation FROM ({_spearman})"
)
SQL["corr_kendall"] = raw.sql(
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
        + tidy(
            f"sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) / "
            f"sqrt(CAST(sum(abs(sign(p.{a} - q.{a}))) AS DOUBLE) * sum(abs(sign(p.{b} - q.{b}))))"
        )
        + f" AS correlation FROM (SELECT {a}, {b} FROM raw WHERE {a} IS NOT NULL AND {b} IS NOT NULL) p,"
        + f" (SELECT {a}, {b} FROM raw WHERE {a} IS NOT NULL AND {b} IS NOT NULL) q"
        for i, a in enumerate(STAT)
        for b in STAT[i + 1 :]
    )
)
_tc = (
    raw.add(
        rn="row_number() OVER (PARTITION BY symbol ORDER BY ts)",
        n="count(*) OVER (PARTITION BY symbol)",
        future_return=change("close", 4),
    )
)
SQL["target_correlation"] = _tc.cte(
    "tc", f"SELECT * FROM {_tc.last} WHERE rn <= n - 4"
).sql(
    f"SELECT feature, {tidy('c')} AS correlation FROM ({each('corr($x, future_return) AS c', STAT, 'tc')})"
)
_DIST = (
    "avg($x) AS mean, stddev_samp($x) AS std, min($x) AS min, max($x) AS max, quantile_cont($x, 0.5) AS median, "
    "skewness($x) AS skew, kurtosis($x) AS kurtosis, count(*) FILTER ($x = 0) * 100.0 / count(*) AS zeros_pct, "
    "count(*) FILTER ($x IS NULL) * 100.0 / count(*) AS missing_pct"
)
SQL["distribution_stats"] = raw.sql(
    f"SELECT feature, {t('mean', 'std', 'min', 'max', 'median', 'skew', 'kurtosis', 'zeros_pct', 'missing_pct', digits=5)} FROM ({each(_DIST, STAT)})"
)
SQL["distribution_issues"] = raw.sql(
    "SELECT feature, abs(skew) > 2 AS high_skew, missing_pct > 10 AS high_missing "
    f"FROM ({each(_DIST, STAT)}) WHERE abs(skew) > 2 OR missing_pct > 10"
)


def outlier(a: str, b: str, cond: str, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return (
        f"SELECT '{c}' AS feature, count(*) FILTER ({cond.replace('$x', x)}) AS outliers, "
        f"{tidy(f'count(*) FILTER ({cond.replace(chr(36) + chr(120), x)}) * 100.0 / count(*)')} AS outlier_pct "
        f"FROM raw, (SELECT {a.replace('$x', x)} AS a, {b.replace('$x', x)} AS b FROM raw)"
    )


SQL["outliers_iqr"] = raw.sql(
    " UNION ALL ".join(
        outlier("quantile_cont($x, 0.25)", "quantile_cont($x, 0.75)", "$x < a - 1.5 * (b - a) OR $x > b + 1.5 * (b - a)", c)
        for c in STAT
    )
)
SQL["outliers_zscore"] = raw.sql(
    " UNION ALL ".join(outlier("avg($x)", "stddev_samp($x)", "abs(($x - a) / b) > 2.5", c) for c in STAT)
)
_sets = "SELECT DISTINCT event_type, 'f' || CAST(user_id % 40 AS VARCHAR) AS n FROM events"
SQL["feature_set_hash"] = (
    "SELECT event_type, substr(sha256(s), 1, 12) AS plain, "
    "substr(sha256(s || '|{\"kind\":\"' || event_type || '\"}'), 1, 12) AS configured "
    f"FROM (SELECT event_type, string_agg(n, ',' ORDER BY n) AS s FROM ({_sets}) GROUP BY event_type)"
)
SQL["feature_set_compare"] = f"""
WITH a AS (SELECT n FROM ({_sets}) WHERE event_type = 'view'),
b AS (SELECT 'f' || CAST(i AS VARCHAR) AS n FROM generate_series(10, 59) g(i)),
m AS (SELECT coalesce(a.n, b.n) AS n, a.n IS NOT NULL AS l, b.n IS NOT NULL AS r FROM a FULL JOIN b ON a.n = b.n)
SELECT coalesce(string_agg(n, ',' ORDER BY n) FILTER (l AND r), '') AS common_features,
coalesce(string_agg(n, ',' ORDER BY n) FILTER (l AND NOT r), '') AS only_in_1,
coalesce(string_agg(n, ',' ORDER BY n) FILTER (r AND NOT l), '') AS only_in_2,
count(*) FILTER (l) AS n_features_1, count(*) FILTER (r) AS n_features_2, count(*) FILTER (l AND r) AS n_common,
count(*) FILTER (l AND NOT r) AS n_only_1, count(*) FILTER (r AND NOT l) AS n_only_2,
count(*) FILTER (l) AS original_count, count(*) FILTER (r) AS selected_count,
count(*) FILTER (l AND NOT r) AS removed_count,
{tidy("count(*) FILTER (l AND NOT r) * 100.0 / count(*) FILTER (l)")} AS reduction_pct,
coalesce(string_agg(n, ',' ORDER BY n) FILTER (l AND NOT r), '') AS removed_features FROM m"""
_SC = (
    "SELECT 'f' || CAST(user_id % 25 AS VARCHAR) AS feature, CAST(count(*) % 40 AS DOUBLE) AS importance FROM events GROUP BY 1"
)
_CUM = (
    "SELECT feature, importance, sum(importance) OVER (ORDER BY importance DESC, feature) / sum(importance) OVER () AS cumulative "
    f"FROM ({_SC})"
)
SQL["importance_rank"] = (
    "SELECT feature, importance, rank() OVER (ORDER BY importance DESC) + (count(*) OVER (PARTITION BY importance) - 1) / 2.0 AS rank "
    f"FROM ({_SC})"
)
SQL["importance_cumulative"] = (
    f"SELECT feature, importance, {tidy('cumulative')} AS cumulative FROM ({_CUM})"
)
SQL["importance_for_share"] = (
    "SELECT "
    + ", ".join(f"count(*) FILTER (cumulative <= CAST({s} AS DOUBLE)) + 1 AS n_{k}" for s, k in ((0.8, 80), (0.9, 90), (0.95, 95)))
    + f" FROM ({_CUM})"
)

# ------------------------------------------------------------------- scaling
_sp = raw.add(
    rn="row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1",
    n="count(*) OVER (PARTITION BY symbol)",
).add(split=ratio_case())
_KINDS = {
    "standard": ("avg($x)", "stddev_pop($x)"),
    "minmax": ("min($x)", "max($x) - min($x)"),
    "robust": ("quantile_cont($x, 0.5)", "quantile_cont($x, 0.75) - quantile_cont($x, 0.25)"),
}


def scaled(kind: str, by_symbol: bool) -> str:
    a, b = _KINDS[kind]
    group = "symbol" if by_symbol else "1"
    st = ", ".join(
        f"{a.replace('$x', f'CAST({c} AS DOUBLE)')} AS a_{c}, {b.replace('$x', f'CAST({c} AS DOUBLE)')} AS b_{c}" for c in DENSE
    )
    key = "symbol" if by_symbol else "1 AS one"
    q = _sp.cte("st", f"SELECT {key}, {st} FROM {_sp.last} WHERE split = 'train' GROUP BY {group}")
    on = "s.symbol = st.symbol" if by_symbol else "true"
    cols = ", ".join(
        f"{tidy(f'(s.{c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END')} AS {c}" for c in DENSE
    )
    return q.sql(f"SELECT s.symbol, {stamp('s.ts')} AS ts, {cols} FROM {_sp.last} s JOIN st ON {on}")


for _k in _KINDS:
    SQL[f"scale_{_k}"] = scaled(_k, False)
SQL["scale_per_symbol"] = scaled("standard", True)
SQL["scale_unseen_symbol"] = BARS.cte(
    "st", "SELECT symbol, avg(close) AS a, stddev_pop(close) AS b FROM bars GROUP BY symbol"
).sql(
    f"SELECT b.symbol, {stamp('b.ts')} AS ts, {tidy('(close - a) / st.b')} AS close FROM bars b "
    "JOIN st ON st.symbol = CASE WHEN b.symbol = 'S3' THEN 'S0' ELSE b.symbol END"
)
SQL["scaler_statistics"] = _sp.sql(
    " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS feature, {tidy(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS center, "
        f"{tidy(f'quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS scale "
        f"FROM {_sp.last} WHERE split = 'train' GROUP BY symbol"
        for c in DENSE
    )
)

# ------------------------------------------------------------------- metrics
_p = _lab.cte(
    "pr",
    "SELECT symbol, ts, target AS label, CAST(volume AS BIGINT) % 3 AS prediction, future_return AS actual, "
    "CASE WHEN CAST(volume AS BIGINT) % 11 > 0 THEN (CAST(volume AS BIGINT) % 21 - 10) / 10.0 END AS forecast, "
    "1 + CAST(volume AS BIGINT) % 7 AS w0, 1 + CAST(volume AS BIGINT) % 5 AS w1, 1 + CAST(volume AS BIGINT) % 3 AS w2 FROM lab",
).cte(
    "pp",
    "SELECT *, w0 / CAST(w0 + w1 + w2 AS DOUBLE) AS p0, w1 / CAST(w0 + w1 + w2 AS DOUBLE) AS p1, w2 / CAST(w0 + w1 + w2 AS DOUBLE) AS p2 FROM pr",
)
SQL["metric_decision"] = _p.sql(
    f"SELECT symbol, {stamp()} AS ts, {tidy('CASE WHEN w0 >= w1 AND w0 >= w2 THEN 0 WHEN w1 >= w2 THEN 1 ELSE 2 END')} AS signal, "
    f"{tidy('greatest(p0, p1, p2)')} AS confidence, {tidy('forecast')} AS predicted_return FROM pp"
)
SQL["metric_accuracy"] = _p.sql(
    f"SELECT count(*) AS n, {tidy('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END)')} AS accuracy, "
    f"{tidy('coalesce(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END) FILTER (label <> 1 AND prediction <> 1), 0)')} AS directional_accuracy FROM pp"
)
_cr = _p.cte(
    "cr",
    "SELECT CAST(c AS VARCHAR) AS class, count(*) FILTER (label = c) AS support, "
    "coalesce(count(*) FILTER (label = c AND prediction = c) / CAST(nullif(count(*) FILTER (prediction = c), 0) AS DOUBLE), 0) AS precision, "
    "coalesce(count(*) FILTER (label = c AND prediction = c) / CAST(nullif(count(*) FILTER (label = c), 0) AS DOUBLE), 0) AS recall, "
    "coalesce(2 * count(*) FILTER (label = c AND prediction = c) / CAST(nullif(count(*) FILTER (label = c) + count(*) FILTER (prediction = c), 0) AS DOUBLE), 0) AS f1 "
    "FROM pp, generate_series(0, 2) g(c) GROUP BY c",
).cte(
    "al",
    "SELECT class, support, precision, recall, f1 FROM cr UNION ALL SELECT 'macro', sum(support), avg(precision), avg(recall), avg(f1) FROM cr "
    "UNION ALL SELECT 'weighted', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM cr",
)
SQL["metric_class_report"] = _cr.sql(
    f"SELECT class, CAST(support AS BIGINT) AS support, {t('precision', 'recall', 'f1')} FROM al"
)
SQL["metric_confusion"] = _p.sql(
    f"SELECT label AS actual, prediction AS predicted, count(*) AS count, {tidy('count(*) / sum(count(*)) OVER (PARTITION BY label)')} AS share FROM pp GROUP BY 1, 2"
)
_roc = _p.cte(
    "lg",
    " UNION ALL ".join(
        f"SELECT {k} AS class, p{k} AS s, CASE WHEN label = {k} THEN 1 ELSE 0 END AS y FROM pp" for k in range(3)
    ),
).cte(
    "sc", "SELECT class, s, sum(y) AS pos, sum(1 - y) AS neg FROM lg GROUP BY 1, 2"
).cte(
    "cu",
    "SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS np, sum(neg) OVER (PARTITION BY class) AS nn "
    "FROM sc WINDOW w AS (PARTITION BY class ORDER BY s DESC)",
)
SQL["metric_roc_points"] = _roc.sql(
    f"SELECT class, {tidy('s')} AS threshold, {tidy('fp / nn')} AS fpr, {tidy('tp / np')} AS tpr FROM cu"
)
_AUC = "SELECT class, sum(neg * (tp - pos / 2.0)) / (max(np) * CAST(max(nn) AS DOUBLE)) AS auc, max(np) AS support FROM cu GROUP BY class"
SQL["metric_roc_auc"] = _roc.sql(
    f"SELECT class, {tidy('auc')} AS auc, CAST(support AS BIGINT) AS support FROM ({_AUC})"
)
SQL["metric_weighted_auc"] = _roc.sql(
    f"SELECT {tidy('sum(auc * support) / sum(support)')} AS roc_auc FROM ({_AUC})"
)


def _reg(fc: str) -> str:
    return (
        f"{tidy(f'avg(power(actual - {fc}, 2))')} AS mse, {tidy(f'sqrt(avg(power(actual - {fc}, 2)))')} AS rmse, "
        f"{tidy(f'avg(abs(actual - {fc}))')} AS mae, "
        f"{tidy(f'avg(CASE WHEN sign(actual) = sign({fc}) THEN 1.0 ELSE 0 END)')} AS directional_accuracy"
    )


SQL["metric_regression"] = _p.cte("rg", "SELECT actual, forecast AS fc FROM pp WHERE actual IS NOT NULL AND forecast IS NOT NULL").sql(
    f"SELECT count(*) AS n, {_reg('fc')}, {tidy('1 - sum(power(actual - fc, 2)) / (var_pop(actual) * count(*))')} AS r2, "
    f"{tidy('corr(actual, fc)')} AS correlation FROM rg"
)
SQL["metric_forecast"] = _p.sql(
    f"SELECT count(*) AS n, {_reg('forecast')} FROM pp WHERE forecast IS NOT NULL"
)
SQL["metric_residuals"] = _p.cte(
    "rs", "SELECT actual - coalesce(forecast, 0) AS r FROM pp"
).cte("lh", "SELECT min(r) AS lo, (max(r) - min(r)) / 50 AS w FROM rs").sql(
    f"SELECT CAST(i AS INTEGER) AS bin, {tidy('lo + i * w')} AS low, {tidy('lo + (i + 1) * w')} AS high, "
    "(SELECT count(*) FROM rs WHERE least(floor((r - lo) / w), 49) = i) AS count FROM lh, generate_series(0, 49) g(i)"
)
SQL["metric_compare_models"] = _p.sql(
    " UNION ALL ".join(
        f"SELECT '{m}' AS model, {tidy(f'avg(CASE WHEN label = {e} THEN 1.0 ELSE 0 END)')} AS accuracy FROM pp"
        for m, e in (("volume", "prediction"), ("neutral", "1"), ("long", "2"))
    )
)

# --------------------------------------------------------------------- store
_CV = ("close", "volume")
_up = BARS.cte(
    "up",
    "SELECT symbol, ts, CASE WHEN hour(ts) % 2 = 0 THEN 2 * close ELSE close END AS close, "
    "CASE WHEN hour(ts) % 2 = 0 THEN 2 * volume ELSE volume END AS volume FROM bars",
)
SQL["store_upsert"] = SQL["store_upsert_plan"] = _up.rows(*_CV)
SQL["store_get"] = BARS.rows(*_CV, where="symbol = 'S1' AND ts = TIMESTAMP '2024-01-10 05:00:00'")
SQL["store_latest"] = BARS.sql(
    f"SELECT symbol, {stamp()} AS ts, {t(*_CV)} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"
)
SQL["store_range"] = BARS.rows(
    *_CV,
    where="symbol = 'S2' AND ts BETWEEN TIMESTAMP '2024-01-10 05:00:00' AND TIMESTAMP '2024-01-12 05:00:00'",
)
SQL["store_delete"] = _up.rows(
    *_CV, where="symbol <> 'S0' AND NOT (symbol = 'S1' AND ts = TIMESTAMP '2024-01-10 05:00:00')"
)
SQL["store_delete_count"] = BARS.sql("SELECT count(*) AS deleted FROM bars WHERE symbol = 'S0'")
SQL["store_ttl"] = BARS.rows(*_CV, where="ts >= (SELECT max(ts) FROM bars) - INTERVAL 7 DAY")
SQL["store_purge"] = SQL["store_ttl"]
SQL["store_latest_of_symbol"] = (
    f"SELECT * FROM ({SQL['store_upsert']}) WHERE symbol = 'S1' QUALIFY row_number() OVER (ORDER BY ts DESC) = 1"
)
_odd = "CASE symbol WHEN 'S0' THEN 'S/0' WHEN 'S1' THEN 'S:1' WHEN 'S2' THEN 'S%2' ELSE 'S 3=#' END AS symbol"
_renamed = f"SELECT {_odd}, * EXCLUDE (symbol) FROM"
SQL["store_delete_odd_symbols"] = (
    f"{_renamed} ({BARS.rows(*_CV)}) WHERE symbol NOT IN ('S0', 'S3') AND NOT (symbol = 'S1' AND ts = TIMESTAMP '2024-01-10 05:00:00')"
)
SQL["store_purge_odd_symbols"] = f"{_renamed} ({SQL['store_ttl']})"
SQL["store_latest_of_odd_symbol"] = (
    f"{_renamed} ({BARS.rows(*_CV)}) WHERE symbol = 'S2' QUALIFY row_number() OVER (ORDER BY ts DESC) = 1"
)
SQL["store_info"] = BARS.sql("SELECT symbol, count(*) AS keys FROM bars GROUP BY symbol")

# ---------------------------------------------------------------- dense series
_ticks = "SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS x FROM events"
SQL["dense_fill"] = (
    "SELECT event_id, last_value(x IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS before, "
    f"first_value(x IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM ({_ticks})"
)
SQL["dense_row_index"] = "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM events"
SQL["sample_capped"] = BARS.sql(
    'SELECT least(count(*), 500) AS few, least(count(*), 1000) AS more, least(count(*), 500) AS "both", count(*) AS "every" FROM bars'
)

# ----------------------------------------------------------------- streaming
_mark = "(SELECT max(tick_ts) FROM tick) - INTERVAL 10 MINUTE"
CLOSED = f"ts + INTERVAL 1 HOUR <= {_mark}"
SQL["stream_bars"] = BARS.rows("open", "high", "low", "close", "volume", where=CLOSED)
SQL["stream_liquidations"] = only("tick", "liq", "liqbars").rows(
    "liq_volume", "liq_avg_size", "liq_count", "long_liq_volume", "short_liq_volume",
    where=CLOSED.replace("FROM tick)", "FROM tick WHERE event_type IN ('purchase', 'error'))"),
)
SQL["stream_store"] = BARS.rows(*_CV, where=CLOSED)
SQL["stream_store_again"] = SQL["store_upsert"]
_day = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
SQL["stream_expiry"] = f"""
WITH t AS (SELECT 'S' || (user_id % 4) AS symbol, ts, event_id AS seq, value + 1 AS price FROM events),
gaps AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) + INTERVAL 1 HOUR AS apart FROM t),
runs AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY symbol ORDER BY ts, seq) AS run FROM gaps),
live AS (
  SELECT symbol, max(ts) AS ts, max_by(seq, (ts, seq)) AS seq, max_by(price, (ts, seq)) AS p, min(ts) AS live_from,
    max(ts) + INTERVAL 1 HOUR AS expired_at, count(*) AS "rows" FROM runs GROUP BY symbol, run)
SELECT symbol, seq, {tidy('p')} AS price, "rows", {_day('ts')}, {_day('live_from')}, {_day('expired_at')}
FROM live WHERE expired_at <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
"""

# ----------------------------------------------------------------- round trips
_n = "SELECT target, count(*) AS c, min(count(*)) OVER () AS lo, max(count(*)) OVER () AS hi FROM lab GROUP BY target"
SQL["balance_undersample_rows"] = _lab.sql(f"SELECT target, lo AS different, 0 AS strange, 1 AS fewest, 1 AS most FROM ({_n})")
SQL["balance_oversample_rows"] = _lab.sql(
    f"SELECT target, c AS different, 0 AS strange, hi // c AS fewest, hi // c + CASE WHEN hi % c > 0 THEN 1 ELSE 0 END AS most FROM ({_n})"
)
SQL["dataset_round_trip"] = _ls.sql(
    f"SELECT symbol, {stamp()} AS ts, {tidy('close')} AS close, {tidy('volume')} AS volume, target, split FROM {_lsn}"
)
SQL["dataset_catalogue"] = _ls.sql(
    f"SELECT 1 AS place, 'new' AS feature_set_id, '2024-02-01' AS created_at, count(*) AS n_samples, 1 AS n_features FROM {_lsn} WHERE split = 'test' "
    f"UNION ALL SELECT 2, 'old', '2024-01-01', count(*), 2 FROM {_lsn}"
)
SQL["feature_set_catalogue"] = f"""
WITH s AS (SELECT event_type, count(*) AS n, string_agg(n, ',' ORDER BY n) AS f FROM ({_sets}) GROUP BY event_type),
o AS (SELECT *, row_number() OVER (ORDER BY event_type) AS i, count(*) OVER () AS k, '{{"kind":"' || event_type || '"}}' AS config FROM s)
SELECT k - i + 1 AS place, substr(sha256(f || '|' || config), 1, 12) AS feature_set_id, f AS features, n AS n_features, config,
  '2024-01-0' || i AS created_at FROM o
"""
SQL["comparison_csv"] = f"SELECT row_number() OVER (ORDER BY accuracy DESC) AS place, model, accuracy FROM ({SQL['metric_compare_models']})"
SQL["scaler_round_trip"] = SQL["scale_standard"]
SQL["report_round_trip"] = (
    f"SELECT feature AS name, variance AS value FROM ({SQL['variance_filter']}) "
    f"UNION ALL SELECT CAST(target AS VARCHAR), percentage FROM ({SQL['target_distribution']})"
)
SQL["store_metadata"] = raw.sql(
    f"SELECT feature, true AS numeric, v >= 5000 AS selected FROM ({each('var_samp($x) AS v', STAT)})"
)

# ----------------------------------------------------------------- facts of models
SQL["prediction_facts"] = _ls.sql(
    'SELECT model, count(*) AS "rows", count(*) AS sum_to_one, count(*) AS likeliest '
    f"FROM {_lsn}, (VALUES ('boosted'), ('forest'), ('stacked')) m(model) WHERE split = 'test' GROUP BY model"
)
SQL["shapley_sums"] = _ls.sql(
    'SELECT model, count(*) AS "rows", count(*) AS sums_hold, count(*) AS outputs_hold '
    f"FROM {_lsn}, (VALUES ('boosted'), ('forest'), ('regressor')) m(model) GROUP BY model"
)
SQL["model_search_all"] = (
    "SELECT model, true AS in_range, true AS scored "
    "FROM (VALUES ('boosted_classifier'), ('forest_classifier'), ('boosted_regressor')) m(model)"
)
SQL["end_to_end"] = _ls.sql(
    f'SELECT split AS artifact, count(*) AS "rows" FROM {_lsn} GROUP BY split '
    f"UNION ALL SELECT 'predictions', count(*) FROM {_lsn} WHERE split = 'test' "
    "UNION ALL SELECT * FROM (VALUES ('selection', 4), ('feature_sets', 1), ('comparison', 2), ('explanation', 8))"
)
