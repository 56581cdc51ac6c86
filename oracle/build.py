"""Small helpers that assemble the comparison SQL (DuckDB dialect).

The SQL states the same null and division policy as the engine: every ratio is
a CASE, rolling values are guarded by a count, doubles are rounded.
"""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY ts"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def fdiv(a: str, b: str) -> str:
    return (
        f"(CASE WHEN ({b}) = 0 THEN CASE WHEN ({a}) > 0 THEN CAST('inf' AS DOUBLE) "
        f"WHEN ({a}) < 0 THEN CAST('-inf' AS DOUBLE) END ELSE ({a}) / ({b}) END)"
    )


def ratio(a: str, b: str) -> str:
    return fdiv(a, f"({b}) + 1e-10")


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER ({W})"


def diff(x: str, k: int = 1) -> str:
    return f"({x} - {lag(x, k)})"


def pct(x: str, k: int = 1) -> str:
    return f"({fdiv(x, lag(x, k))} - 1)"


def log_return(x: str, k: int = 1) -> str:
    return f"ln({fdiv(x, lag(x, k))})"


def full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {value} END"


def agg(fn: str, x: str, n: int) -> str:
    return full(x, n, f"{fn}({x}) OVER {frame(n)}")


def mean(x, n):
    return agg("avg", x, n)


def total(x, n):
    return agg("sum", x, n)


def std(x, n):
    return agg("stddev_samp", x, n)


def low(x, n):
    return agg("min", x, n)


def high(x, n):
    return agg("max", x, n)


def slope(x: str, n: int) -> str:
    return full(x, n, f"regr_slope({x}, rn) OVER {frame(n)}")


def percentile(x: str, n: int) -> str:
    a = f"list({x}) OVER {frame(n)}"
    return full(
        x,
        n,
        f"(len(list_filter({a}, lambda v: v < {x})) + (len(list_filter({a}, lambda v: v = {x})) + 1) / 2.0) / {float(n)}",
    )


def sgn(x: str) -> str:
    return f"CAST(sign({x}) AS DOUBLE)"


def flag(c: str) -> str:
    return f"CAST(coalesce({c}, false) AS INTEGER)"


def tidy(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


def stamp(ts: str = "ts") -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


class Query:
    """A chain of CTEs; ``add`` appends computed columns."""

    def __init__(self, ctes: list[tuple[str, str]], last: str, recursive: bool = False):
        self.ctes, self.last, self.recursive = list(ctes), last, recursive

    def _copy(self) -> "Query":
        return Query(self.ctes, self.last, self.recursive)

    def cte(self, name: str, sql: str, recursive: bool = False) -> "Query":
        q = self._copy()
        q.ctes.append((name, sql))
        q.last = name
        q.recursive = q.recursive or recursive
        return q

    def add(self, **columns: str) -> "Query":
        name = f"s{len(self.ctes)}"
        body = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        return self.cte(name, f"SELECT *, {body} FROM {self.last}")

    def sql(self, select: str) -> str:
        head = "WITH RECURSIVE " if self.recursive else "WITH "
        body = ",\n".join(f"{n} AS ({s})" for n, s in self.ctes)
        return f"{head}{body}\n{select}"

    def rows(self, *columns: str, digits: int = 6, where: str = "") -> str:
        cols = ", ".join(f'{tidy(c, digits)} AS "{c}"' for c in columns)
        cond = f" WHERE {where}" if where else ""
        return self.sql(f"SELECT symbol, {stamp()} AS ts, {cols} FROM {self.last}{cond}")


TICK = (
    "SELECT event_id, event_type, value, value + 1 AS px, ts AS tick_ts, "
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS qty, "
    "'S' || CAST(user_id % 4 AS VARCHAR) AS symbol, date_trunc('hour', ts) AS ts FROM events"
)
OHLCV = (
    "SELECT symbol, ts, arg_min(px, event_id) AS open, max(px) AS high, min(px) AS low, "
    "arg_max(px, event_id) AS close, CAST(sum(qty) AS DOUBLE) AS volume FROM tick GROUP BY symbol, ts"
)
OI = (
    "SELECT symbol, ts, CAST(100000 + sum(f) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS open_interest "
    "FROM (SELECT symbol, ts, sum(CASE WHEN event_id % 2 = 0 THEN qty ELSE -qty END) AS f FROM tick GROUP BY symbol, ts)"
)
FUND = (
    "SELECT symbol, time_bucket(INTERVAL 8 HOUR, tick_ts, TIMESTAMP '2024-01-01') AS ts, "
    "(sum(CAST(round(value * 100) AS BIGINT)) / 100.0 / count(*) - 50) / 100 AS funding_rate FROM tick GROUP BY 1, 2"
)
LIQ = (
    "SELECT symbol, ts, CAST(qty AS DOUBLE) AS quantity, CASE WHEN event_type = 'purchase' THEN 'BUY' ELSE 'SELL' END AS side, "
    "event_id AS order_id, px AS price FROM tick WHERE event_type IN ('purchase', 'error')"
)
LSR = (
    "SELECT symbol, ts, (1 + count(*) FILTER (WHERE event_type = 'click')) / CAST(1 + count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) "
    "AS \"longShortRatio\" FROM tick WHERE event_type IN ('click', 'view') GROUP BY symbol, ts"
)
LIQ_BARS = (
    "SELECT symbol, ts, sum(quantity) AS liq_volume, avg(quantity) AS liq_avg_size, count(quantity) AS liq_count, "
    "sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0 END) AS long_liq_volume, "
    "sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS short_liq_volume FROM liq GROUP BY symbol, ts"
)
JOINED = (
    "SELECT b.*, o.open_interest, "
    "last_value(f.funding_rate IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS funding_rate, "
    "coalesce(l.liq_volume, 0) AS liq_volume, coalesce(l.liq_avg_size, 0) AS liq_avg_size, "
    "coalesce(l.liq_count, 0) AS liq_count, l.long_liq_volume, l.short_liq_volume, "
    "r.\"longShortRatio\" AS ratio_raw, "
    "last_value(r.\"longShortRatio\" IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS ratio, "
    "CAST(row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts) AS DOUBLE) AS rn "
    "FROM bars b LEFT JOIN oi o ON b.symbol = o.symbol AND b.ts = o.ts "
    "LEFT JOIN fund f ON b.symbol = f.symbol AND b.ts = f.ts "
    "LEFT JOIN liqbars l ON b.symbol = l.symbol AND b.ts = l.ts "
    "LEFT JOIN lsr r ON b.symbol = r.symbol AND b.ts = r.ts"
)
FEEDS = [
    ("tick", TICK),
    ("bars", OHLCV),
    ("oi", OI),
    ("fund", FUND),
    ("liq", LIQ),
    ("lsr", LSR),
    ("liqbars", LIQ_BARS),
    ("j", JOINED),
]
DAILY = (
    "SELECT l_returnflag AS symbol, l_shipdate AS ts, "
    "arg_min(l_extendedprice, k) AS open, max(l_extendedprice) AS high, "
    "min(l_extendedprice) AS low, arg_max(l_extendedprice, k) AS close, "
    "sum(l_quantity) AS volume FROM (SELECT *, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k FROM lineitem) GROUP BY 1, 2"
)


def feeds() -> Query:
    return Query(FEEDS, "j")


def only(*names: str) -> Query:
    picked = [(n, s) for n, s in FEEDS if n in names]
    return Query(picked, names[-1])


def ewm_step(x: str, span: int, prev: str) -> str:
    a = f"(1.0 - 2.0 / {span + 1}.0)"
    return (
        f"CASE WHEN {x} IS NULL THEN {prev} WHEN {prev} IS NULL THEN {x} "
        f"ELSE {a} * {prev} + (1.0 - {a}) * {x} END"
    )


def with_ewm(q: Query, columns: dict[str, tuple[str, int]], signals: dict[str, tuple[str, str]] = {}) -> Query:
    """Recursive evaluation of ewm columns; ``signals`` are ewm-9 of a-b."""
    src = q.last
    q = q.cte("ew_in", f"SELECT *, CAST(rn AS BIGINT) AS k FROM {src}")
    first = [f"CAST({x} AS DOUBLE) AS {o}" for o, (x, _) in columns.items()]
    first += [f"CAST({columns[a][0]} - {columns[b][0]} AS DOUBLE) AS {o}" for o, (a, b) in signals.items()]
    step = [f"{ewm_step(f'b.{x}', s, f'e.{o}')} AS {o}" for o, (x, s) in columns.items()]
    for o, (a, b) in signals.items():
        na, nb = (ewm_step(f"b.{columns[c][0]}", columns[c][1], f"e.{c}") for c in (a, b))
        step.append(f"{ewm_step(f'(({na}) - ({nb}))', 9, f'e.{o}')} AS {o}")
    q = q.cte(
        "ew",
        f"SELECT symbol, k, {', '.join(first)} FROM ew_in WHERE k = 1 UNION ALL "
        f"SELECT b.symbol, b.k, {', '.join(step)} FROM ew e JOIN ew_in b ON b.symbol = e.symbol AND b.k = e.k + 1",
        recursive=True,
    )
    names = ", ".join(f"ew.{o}" for o in [*columns, *signals])
    return q.cte("ewd", f"SELECT i.*, {names} FROM ew_in i JOIN ew ON i.symbol = ew.symbol AND i.k = ew.k")
