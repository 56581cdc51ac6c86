"""Exponential moving averages (recursive form, ``alpha = 2 / (span + 1)``).

``y_t = (1-alpha) y_{t-1} + alpha x_t`` is evaluated as a blocked scan with two
window passes.  Inside a block the recurrence has a closed form (a running sum
of decay-weighted values); across blocks only the end of the previous block
matters, because blocks are long enough for anything older to weigh less than
double precision.  The same property makes a finite halo exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .fill import ffill
from .prefix import DEFAULT, Series, row_index
from .segments import BLOCK, RN, SEG, Segmented, segment

# exp(-45) ~ 3e-20 is far below the resolution of a double
_MEMORY_NATS = 45.0


def decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def memory(span: int) -> int:
    """Rows after which an exponential average has forgotten its past."""
    return 1 if span <= 1 else math.ceil(_MEMORY_NATS / -math.log(decay(span)))


def _check(seg: Segmented, spans) -> None:
    need = max(memory(s) for s in spans)
    if seg.block_rows < need:
        raise ValueError(f"block_rows {seg.block_rows} < {need} needed by span {max(spans)}")


def add_ewm(seg: Segmented, outputs: dict[str, tuple[str, int]]) -> Segmented:
    """Add ``{name: (column, span)}`` for columns without gaps.

    A column may start late (leading NULLs) but must be known from then on;
    use :func:`ewm` for a column with interior gaps.
    """
    spans = [s for _, s in outputs.values()]
    _check(seg, spans)
    sources = sorted({x for x, _ in outputs.values()})
    seg = seg.add({f"_seen_{x}": F.count(x).over(seg.running) for x in sources})
    j = (F.col(RN) - F.col(BLOCK) * F.lit(seg.block_rows)).cast("double")

    def local(x: str, span: int) -> Column:
        a = decay(span)
        value = F.col(x).cast("double")
        weight = F.when(F.col(f"_seen_{x}") == 1, value).otherwise(F.lit(1.0 - a) * value)
        total = F.sum(weight * F.pow(F.lit(a), -j)).over(seg.block_running)
        return F.pow(F.lit(a), j) * total

    seg = seg.add({f"_loc_{o}": local(x, s) for o, (x, s) in outputs.items()})
    at_end = j == F.lit(float(seg.block_rows - 1))
    seg = seg.add(
        {
            f"_end_{o}": F.last(F.when(at_end, F.col(f"_loc_{o}")), ignorenulls=True).over(
                seg.running_before
            )
            for o in outputs
        }
    )

    def combined(o: str, x: str, span: int) -> Column:
        carried = F.pow(F.lit(decay(span)), j + 1) * F.coalesce(f"_end_{o}", F.lit(0.0))
        return F.when(
            F.col(f"_seen_{x}") > 0, F.coalesce(f"_loc_{o}", F.lit(0.0)) + carried
        )

    seg = seg.add({o: combined(o, x, s) for o, (x, s) in outputs.items()})
    helpers = [f"_loc_{o}" for o in outputs] + [f"_end_{o}" for o in outputs]
    return seg.select(
        *[
            c
            for c in seg.df.columns
            if c not in helpers and c not in {f"_seen_{x}" for x in sources}
        ]
    )


def ewm(
    df: DataFrame, outputs: dict[str, tuple[str, int]], series: Series = DEFAULT
) -> DataFrame:
    """Gap-aware exponential averages of any table (TA3).

    A missing value decays the weight of the past by its row distance and the
    last average is carried over it.  Each source column is compacted to its
    known rows, scanned there, and joined back.  The numbered rows and the
    joined result are each read more than once and therefore stored.
    """
    indexed = stored(row_index(df, series, "_pos"), "ewm-rows")
    keys = [*series.keys, series.order]
    out = indexed
    for x in sorted({x for x, _ in outputs.values()}):
        mine = {o: s for o, (src, s) in outputs.items() if src == x}
        known = indexed.where(F.col(x).isNotNull()).select(*keys, "_pos", x)
        out = out.join(_scan_known(known, x, mine, series), keys, "left")
    out = out.drop("_pos")
    return ffill(stored(out, "ewm-known"), list(outputs), series)


def _scan_known(
    known: DataFrame, x: str, spans: dict[str, int], series: Series
) -> DataFrame:
    """Scan over known rows only; a row's factors depend on the gap before it.

    Blocks are cut where the accumulated decay passes ``_MEMORY_NATS``, so the
    weights inside a block stay in range and two blocks back is forgotten.
    """
    seg = segment(known, halo=max(memory(s) for s in spans.values()), series=series)
    seg = seg.add({"_gap": (F.col("_pos") - F.lag("_pos").over(seg.window)).cast("double")})
    gap, value = F.col("_gap"), F.col(x).cast("double")
    results = {}
    for o, span in spans.items():
        if span <= 1:
            results[o] = value
            continue
        a, alpha = decay(span), 1.0 - decay(span)
        old = F.pow(F.lit(a), gap)
        keep = F.coalesce(old / (old + alpha), F.lit(0.0))
        take = F.coalesce(alpha * value / (old + alpha), value)
        forgotten = F.when(gap.isNull(), 0.0).when(keep > 1e-300, -F.ln(keep)).otherwise(700.0)
        seg = seg.add({f"_c_{o}": keep, f"_d_{o}": take, f"_k_{o}": forgotten})
        seg = seg.add({f"_cum_{o}": F.sum(f"_k_{o}").over(seg.running)})
        seg = seg.add({f"_blk_{o}": F.floor(F.col(f"_cum_{o}") / F.lit(_MEMORY_NATS))})
        block = Window.partitionBy(*series.keys, SEG, f"_blk_{o}").orderBy(series.order)
        block = block.rowsBetween(Window.unboundedPreceding, 0)
        seg = seg.add(
            {
                f"_rel_{o}": F.col(f"_cum_{o}") - F.first(f"_cum_{o}").over(block),
                f"_c0_{o}": F.first(f"_c_{o}").over(block),
            }
        )
        scaled = F.col(f"_d_{o}") * F.exp(f"_rel_{o}")
        seg = seg.add({f"_s_{o}": F.sum(scaled).over(block)})
        seg = seg.add({f"_l_{o}": F.exp(-F.col(f"_rel_{o}")) * F.col(f"_s_{o}")})
        seg = seg.add({f"_p_{o}": F.lag(f"_l_{o}").over(seg.window)})
        seg = seg.add({f"_e_{o}": F.coalesce(F.first(f"_p_{o}").over(block), F.lit(0.0))})
        results[o] = F.col(f"_l_{o}") + F.exp(-F.col(f"_rel_{o}")) * F.col(
            f"_c0_{o}"
        ) * F.col(f"_e_{o}")
    return seg.finish(*series.keys, series.order, *[e.alias(o) for o, e in results.items()])
