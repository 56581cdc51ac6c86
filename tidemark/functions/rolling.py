"""Rolling expressions over a segment.

Every function returns a Column.  A rolling result is defined only when the
window holds ``n`` non-null values, hence the count guard.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.segments import RN, Segmented
from .scalar import col, fdiv, sign

class Rolling:
    """Expression factory bound to one segmented frame specification.

    Columns named in ``tracked`` get their count guard from a running column
    (see :meth:`runs`) instead of a count in every sliding frame, and sums over
    long frames from running totals: a sliding frame costs its length per row,
    a running one does not.
    """

    def __init__(self, seg: Segmented, tracked: Iterable[str] = ()):
        self.seg = seg
        self.tracked = set(tracked)
        self.used_runs: set[str] = set()
        self.used_totals: set[str] = set()

    def runs(self) -> dict[str, Column]:
        """``_run_<x>``: consecutive known values ending at this row."""
        return {
            f"_run_{x}": F.row_number().over(self.seg.window)
            - F.coalesce(
                F.last(F.when(col(x).isNull(), F.col("_at")), ignorenulls=True).over(
                    self.seg.running
                ),
                F.lit(0),
            )
            for x in sorted(self.used_runs)
        }

    def totals(self) -> dict[str, Column]:
        """``_tot_<x>``: running total inside the segment."""
        return {
            f"_tot_{x}": F.coalesce(F.sum(col(x).cast("double")).over(self.seg.running), F.lit(0.0))
            for x in sorted(self.used_totals)
        }

    # -- offsets ---------------------------------------------------------
    def lag(self, x: Column | str, k: int = 1) -> Column:
        return F.lag(col(x), k).over(self.seg.window)

    def diff(self, x: Column | str, k: int = 1) -> Column:
        return col(x) - self.lag(x, k)

    def pct(self, filled: Column | str, k: int = 1) -> Column:
        """Relative change; the argument must already be forward filled."""
        return fdiv(filled, self.lag(filled, k)) - 1

    def log_return(self, x: Column | str, k: int = 1) -> Column:
        return F.ln(fdiv(x, self.lag(x, k)))

    def ffill(self, x: str) -> Column:
        """Last known value, reaching behind the segment through its carry."""
        last = F.last(col(x), ignorenulls=True).over(self.seg.running)
        return F.coalesce(last, F.col(f"{x}__carry"))

    # -- trailing aggregates ---------------------------------------------
    def _full(self, x: Column | str, n: int, value: Column) -> Column:
        if isinstance(x, str) and x in self.tracked:
            self.used_runs.add(x)
            return F.when(F.col(f"_run_{x}") >= n, value)
        return F.when(F.count(col(x)).over(self.seg.trailing(n)) == n, value)

    def long_sum(self, x: str, n: int) -> Column:
        """Sum over a long frame as a difference of running totals.

        For columns whose rounding in the last bits is harmless; a frame of
        zeros still gives exactly 0."""
        self.used_totals.add(x)
        total = F.col(f"_tot_{x}")
        return self._full(x, n, total - F.coalesce(self.lag(total, n), F.lit(0.0)))

    def long_mean(self, x: str, n: int) -> Column:
        return self.long_sum(x, n) / F.lit(float(n))

    def mean(self, x: Column | str, n: int) -> Column:
        return self._full(x, n, F.avg(col(x)).over(self.seg.trailing(n)))

    def sum(self, x: Column | str, n: int) -> Column:
        return self._full(x, n, F.sum(col(x)).over(self.seg.trailing(n)))

    def std(self, x: Column | str, n: int) -> Column:
        return self._full(x, n, F.stddev_samp(col(x)).over(self.seg.trailing(n)))

    def min(self, x: Column | str, n: int) -> Column:
        return self._full(x, n, F.min(col(x)).over(self.seg.trailing(n)))

    def max(self, x: Column | str, n: int) -> Column:
        return self._full(x, n, F.max(col(x)).over(self.seg.trailing(n)))

    def slope(self, x: Column | str, n: int) -> Column:
        """Least-squares slope against the row position."""
        fit = F.regr_slope(col(x).cast("double"), F.col(RN).cast("double"))
        return self._full(x, n, fit.over(self.seg.trailing(n)))

    def r_squared(self, x: Column | str, n: int) -> Column:
        frame = self.seg.trailing(n)
        x = col(x).cast("double")
        flat = F.min(x).over(frame) == F.max(x).over(frame)
        fit = F.regr_r2(x, F.col(RN).cast("double")).over(frame)
        return self._full(x, n, F.when(flat, F.lit(0.0)).otherwise(fit))

    def corr(self, x: str, y: str, n: int) -> Column:
        """Rolling Pearson correlation; NULL when either side is constant."""
        frame = self.seg.trailing(n)
        x_name, y_name = x, y
        x, y = col(x).cast("double"), col(y).cast("double")
        both = x.isNotNull() & y.isNotNull()
        px, py = F.when(both, x), F.when(both, y)
        value = fdiv(
            F.covar_pop(px, py).over(frame),
            F.stddev_pop(px).over(frame) * F.stddev_pop(py).over(frame),
        )
        flat = (F.min(px).over(frame) == F.max(px).over(frame)) | (
            F.min(py).over(frame) == F.max(py).over(frame)
        )
        whole = F.count(px).over(frame) == n
        if {x_name, y_name} <= self.tracked:
            self.used_runs |= {x_name, y_name}
            whole = (F.col(f"_run_{x_name}") >= n) & (F.col(f"_run_{y_name}") >= n)
        return F.when(whole, F.when(~flat, value))

    def percentile_rank(self, x: Column | str, n: int) -> Column:
        """Average-tie percentile rank of the current value in its window.

        The list is bounded by ``n``.
        """
        x = col(x).cast("double")
        values = F.collect_list(x).over(self.seg.trailing(n))
        return _rank_in(values, x, n)

    # -- cumulative within a segment -------------------------------------
    def running_sum(self, x: Column) -> Column:
        return F.sum(x).over(self.seg.running)


def _rank_in(values: Column, x: Column, n: int) -> Column:
    # twice the number below plus the number equal, in one pass over the list
    score = F.aggregate(
        values, F.lit(0), lambda acc, v: acc + F.when(v < x, 2).when(v == x, 1).otherwise(0)
    )
    return F.when(F.size(values) == n, (score + 1) / F.lit(2.0 * n))


def divergence(d1: Column, d2: Column) -> Column:
    """-1 where the second moves up and the first does not move with it, +1 in
    the mirrored case, else 0.  A missing first direction counts as different.
    """
    s1, s2 = sign(d1), sign(d2)
    differ = ~s1.eqNullSafe(s2)
    return (
        F.when(differ & (s2 > 0), F.lit(-1)).when(differ & (s2 < 0), F.lit(1)).otherwise(F.lit(0))
    )
