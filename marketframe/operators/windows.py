"""Rolling, lagged and recursive columns over a window from :mod:`series`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketframe.operators import series

# Columns by depth: each layer reads the rows and the layers before it.
Layers = list[dict[str, Column]]

# weight below which an older value cannot change a double
_NEGLIGIBLE = 1e-18
# powers of ten that scaled sums may reach
_LARGEST_POWER = 250


def with_layers(df: DataFrame, *parts: Layers) -> DataFrame:
    """Add the columns of all parts, layer by layer, and drop those named with a leading underscore.

    Equal layers of different parts go into one projection, so that they share one Window
    operator.  Spark evaluates a window expression again wherever it is repeated, hence a value
    that is used twice is a column of its own.
    """
    for depth in range(max(map(len, parts))):
        df = df.withColumns({n: c for p in parts if len(p) > depth for n, c in p[depth].items()})
    inner = {n for p in parts for layer in p for n in layer if n.startswith("_")}
    return df.drop(*inner)


def frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def full(x: Column, n: int, w: WindowSpec, value: Column) -> Column:
    """``value`` once the last n rows all hold a non-null x, else NULL."""
    return F.when(F.count(x).over(frame(w, n)) == n, value)


def rolling(how: str, x: Column, n: int, w: WindowSpec) -> Column:
    """Mean, std (sample), min, max or sum of the last n rows; NULL until n values are there."""
    agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}[how]
    return full(x, n, w, agg(x).over(frame(w, n)))


def running_sums(keys: list[str], values: dict[str, Column]) -> dict[str, Column]:
    """Sum and count of each value from the start of its block on, as ``_run_<name>`` and ``_cnt_<name>``."""
    w = Window.partitionBy(*keys, series.CHUNK, series.BLOCK).orderBy(series.POS) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    for name, v in values.items():
        out[f"_run_{name}"] = F.sum(F.coalesce(v, F.lit(0.0))).over(w)
        out[f"_cnt_{name}"] = F.count(v).over(w)
    return out


def of_last(run: str, n: int, keys: list[str], block: int, w: WindowSpec) -> Column:
    """What a running sum of a block gained over the last n rows, n <= block.

    Two rows of the sum and the total of the block before replace a frame of n rows.
    """
    k = F.col(series.POS) - F.col(series.BLOCK) * block
    before = Window.partitionBy(*keys, series.CHUNK).orderBy(series.BLOCK).rangeBetween(-1, -1)
    total = F.max(F.when(k == block - 1, F.col(run))).over(before)
    zero = F.lit(0)
    return F.col(run) - F.coalesce(F.lag(run, n).over(w), zero) + F.when(k < n, F.coalesce(total, zero)).otherwise(zero)


def long_mean(name: str, n: int, keys: list[str], block: int, w: WindowSpec) -> Column:
    """Mean of the last n rows from running sums; NULL until n values are there."""
    count = of_last(f"_cnt_{name}", n, keys, block, w)
    return F.when(count == n, of_last(f"_run_{name}", n, keys, block, w) / n)


def _varies(spread: Column, squares: Column, n: int) -> Column:
    """Whether a spread is more than what rounding alone leaves of a constant."""
    return spread > 1e-12 * n * squares


def long_std(x: str, n: int, keys: list[str], block: int, w: WindowSpec) -> Layers:
    """Sample deviation of the last n rows as ``_std_<x>``, from running sums.  For values around 0."""
    sums = running_sums(keys, {x: F.col(x), f"{x}_{x}": F.col(x) * F.col(x)})
    parts = {f"_s{n}_{x}": of_last(f"_run_{x}", n, keys, block, w), f"_c{n}_{x}": of_last(f"_cnt_{x}", n, keys, block, w),
             f"_s{n}_{x}_{x}": of_last(f"_run_{x}_{x}", n, keys, block, w)}
    s, ss = F.col(f"_s{n}_{x}"), F.col(f"_s{n}_{x}_{x}")
    spread = n * ss - s * s
    std = F.when(_varies(spread, ss, n), F.sqrt(spread / (n * (n - 1)))).otherwise(0.0)
    return [sums, parts, {f"_std_{x}": F.when(F.col(f"_c{n}_{x}") == n, std)}]


def rolling_corr(keys: list[str], w: WindowSpec, n: int, specs: dict[str, tuple[str, str]], block: int) -> Layers:
    """Correlation of the last n pairs per output name; NULL when a side is constant or a value is missing.

    Values are taken relative to the first of their chunk, so that the spread of a series far from zero is not lost."""
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inputs = dict.fromkeys(c for pair in specs.values() for c in pair)
    anchored = {f"_from_{c}": F.col(c) - F.first(c, True).over(so_far) for c in inputs}
    specs = {name: (f"_from_{x}", f"_from_{y}") for name, (x, y) in specs.items()}
    values: dict[str, Column] = {}
    for x, y in specs.values():
        for c in (x, y):
            values[c], values[f"{c}_{c}"] = F.col(c), F.col(c) * F.col(c)
        values[f"{x}_{y}"] = F.col(x) * F.col(y)
    parts = {f"_s{n}_{v}": of_last(f"_run_{v}", n, keys, block, w) for v in values}
    out = {}
    for name, (x, y) in specs.items():
        parts[f"_c{n}_{x}_{y}"] = of_last(f"_cnt_{x}_{y}", n, keys, block, w)
        sx, sy, sxx, syy, sxy = (F.col(f"_s{n}_{v}") for v in (x, y, f"{x}_{x}", f"{y}_{y}", f"{x}_{y}"))
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        out[name] = F.when((F.col(f"_c{n}_{x}_{y}") == n) & _varies(vx, sxx, n) & _varies(vy, syy, n),
                           (n * sxy - sx * sy) / F.sqrt(vx * vy))
    return [anchored, running_sums(keys, values), parts, out]


def abs_dev(values: Column, mean: Column) -> Column:
    """Sum of the distances of an array's values from ``mean``."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.abs(v - mean))


def rolling_abs_dev(x: Column, n: int, w: WindowSpec) -> Column:
    """Mean distance of the last n values from their own mean."""
    f = frame(w, n)
    return full(x, n, w, abs_dev(F.collect_list(x).over(f), F.avg(x).over(f)) / n)


def change(x: Column, n: int, w: WindowSpec) -> Column:
    """Relative change against the value n rows earlier."""
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a/b), NULL where it is not a finite number."""
    q = F.try_divide(a, b)
    return F.when(q > 0, F.ln(q))


def ema_reach(span: int, negligible: float = _NEGLIGIBLE) -> int:
    """Rows after which a value's weight in the average is too small to matter."""
    return math.ceil(math.log(negligible) / math.log(1 - 2 / (span + 1)))


def block_rows(spans: list[int]) -> int:
    """Rows per block: long enough that a few earlier blocks hold all the weight."""
    return max(series.BLOCK_ROWS, math.ceil(max(ema_reach(s) for s in spans) / 4))


def _ema_block(span: int, block: int) -> int:
    """Rows over which a span's weights stay within the range of doubles, at most ``block``."""
    return min(block, int(_LARGEST_POWER / -math.log10(1 - 2 / (span + 1))))


def ema(keys: list[str], specs: dict[str, tuple[Column, int]], block: int, negligible: float = _NEGLIGIBLE) -> Layers:
    """Exponential averages e[t] = (1-a) e[t-1] + a x[t], e[first] = x[first], a = 2/(span+1).

    ``specs`` maps an output name to (non-null value, span >= 2).  The rows come from
    :func:`series.chunked` with that ``block`` and ``before`` >= the longest reach.
    Inside a block the recursion is a scaled running sum; the tails of the few
    earlier blocks that still carry weight, at least ``negligible``, are added on top.  A span too short for the
    common block has a shorter one of its own.
    """
    pos = F.col(series.POS)
    local, total = {}, {}
    common = block
    for out, (x, span) in specs.items():
        if span < 2:
            raise ValueError("span must be at least 2")
        block = _ema_block(span, common)
        number = F.col(series.BLOCK) if block == common else F.floor(pos / F.lit(block))
        k = (pos - number * block).cast("double")
        in_block = Window.partitionBy(*keys, series.CHUNK, number).orderBy(series.POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        by_block = Window.partitionBy(*keys, series.CHUNK).orderBy(number)
        a = 2 / (span + 1)
        q = 1 - a
        c = F.when(pos == 0, x).otherwise(F.lit(a) * x)
        local[f"_loc_{out}"] = F.sum(c * F.pow(F.lit(q), -k)).over(in_block) * F.pow(F.lit(q), k)
        e = F.col(f"_loc_{out}")
        for j in range(1, math.ceil(ema_reach(span, negligible) / block) + 1):
            tail = F.max(F.when(k == block - 1, F.col(f"_loc_{out}"))).over(by_block.rangeBetween(-j, -j))
            e = e + F.coalesce(tail, F.lit(0.0)) * F.pow(F.lit(q), k + 1 + block * (j - 1))
        total[out] = e
    return [local, total]
