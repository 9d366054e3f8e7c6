"""Exponential averages as associative scans: exact at any span, and over any window.

One step of e[t] = q e[t-1] + c[t] is the map e -> q e + c; maps compose to maps.  A block of rows makes one map, from a
partial aggregate; the table of block maps, one row per block, is composed in groups of ``GROUP``, whose totals are
composed in turn, so that no task holds a whole series even there.  A row then adds what its block brings to the state
before the block.  No weight is cut off, and no row is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators import series
from marketframe.operators.asof import asof_join
from marketframe.operators.indicators import EMA_SPAN, MACD_FAST, MACD_SIGNAL, MACD_SLOW
from marketframe.operators.windows import _ema_block

GROUP = 64


def keep(span: int) -> float:
    """What a step keeps of the average before it."""
    if span < 2:
        raise ValueError("span must be at least 2")
    return 1 - 2 / (span + 1)


def composed(maps: DataFrame, keys: list[str], number: str, names: list[str], longest: int, group: int = GROUP) -> DataFrame:
    """``maps`` (keys, number = 0, 1, ..., and m_<name>, c_<name> of e -> m e + c) with each map after all earlier ones of its key.

    ``longest`` is the largest count of maps of one key.  In a group of ``group`` numbers a map takes in the one 1, 2, 4, ...
    places ahead; whole groups are then maps of their own.
    """
    out = maps.withColumn("_group", F.floor(F.col(number) / F.lit(group)))
    w = Window.partitionBy(*keys, "_group").orderBy(number)
    step = 1
    while step < min(group, longest):
        out = out.withColumns({k: v for n in names for k, v in {
            f"c_{n}": F.col(f"c_{n}") + F.col(f"m_{n}") * F.coalesce(F.lag(f"c_{n}", step).over(w), F.lit(0.0)),
            f"m_{n}": F.col(f"m_{n}") * F.coalesce(F.lag(f"m_{n}", step).over(w), F.lit(1.0))}.items()})
        step *= 2
    if longest <= group:
        return out.drop("_group")
    ends = out.where(F.col(number) % group == group - 1).select(
        *keys, F.col("_group").alias(number), *[f"{p}_{n}" for n in names for p in "mc"])
    ahead = composed(ends, keys, number, names, -(-longest // group), group)
    ahead = ahead.select(*[F.col(k).alias(f"_of_{k}") for k in keys], (F.col(number) + 1).alias("_of_group"),
                         *[F.col(f"{p}_{n}").alias(f"_{p}_{n}") for n in names for p in "mc"])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_group") == F.col("_of_group")]
    joined = out.join(ahead, same, "left")
    return joined.select(*keys, number, *[x for n in names for x in (
        (F.col(f"m_{n}") * F.coalesce(f"_m_{n}", F.lit(1.0))).alias(f"m_{n}"),
        (F.col(f"c_{n}") + F.col(f"m_{n}") * F.coalesce(f"_c_{n}", F.lit(0.0))).alias(f"c_{n}"))])


def ema(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, int]], block: int = series.BLOCK_ROWS,
        group: int = GROUP) -> DataFrame:
    """``df`` with e[t] = q e[t-1] + (1 - q) x[t], e[first] = x[first], q = 1 - 2/(span+1), per output name of ``specs``
    (column x without NULLs, span), and the position ``series.POS`` of each row.

    Rows without a key are a series of their own; (key, order) is unique.  An empty table gives an empty one.
    """
    p = df if series.POS in df.columns else series.with_position(df, keys, order)
    block = min(_ema_block(span, block) for _, span in specs.values())
    rows = p.withColumn("_n", F.floor(F.col(series.POS) / F.lit(block)))
    k = F.col(series.POS) - F.col("_n") * block

    def brought(x: str, span: int) -> Column:
        return F.when(F.col(series.POS) == 0, F.col(x)).otherwise(F.lit(1 - keep(span)) * F.col(x)) * F.pow(F.lit(keep(span)), -k)

    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    maps = rows.groupBy(*keys, "_n").agg(F.max(k).alias("_last"), *[F.sum(brought(x, s)).alias(f"c_{o}") for o, (x, s) in specs.items()])
    maps = maps.select(*keys, "_n", *[col for o, (_, s) in specs.items() for col in (
        F.pow(F.lit(keep(s)), F.col("_last") + 1).alias(f"m_{o}"), (F.col(f"c_{o}") * F.pow(F.lit(keep(s)), F.col("_last"))).alias(f"c_{o}"))])
    done = composed(maps, keys, "_n", list(specs), -(-longest // block), group)
    before = done.select(*[F.col(key).alias(f"_of_{key}") for key in keys], (F.col("_n") + 1).alias("_of_n"),
                         *[F.col(f"c_{o}").alias(f"_before_{o}") for o in specs])
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys] + [F.col("_n") == F.col("_of_n")]
    so_far = Window.partitionBy(*keys, "_n").orderBy(series.POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(before, same, "left").withColumns({
        o: (F.sum(brought(x, s)).over(so_far) + F.coalesce(f"_before_{o}", F.lit(0.0)) * keep(s)) * F.pow(F.lit(keep(s)), k)
        for o, (x, s) in specs.items()})
    return out.select(*p.columns, *specs)


def close_averages(bars: DataFrame, keys: list[str], order: str, **how) -> DataFrame:
    """``bars`` (with a close) and the averages ema_50, _fast, _slow, macd and macd_signal of each whole series."""
    one = ema(bars, keys, order, {"ema_50": ("close", EMA_SPAN), "_fast": ("close", MACD_FAST), "_slow": ("close", MACD_SLOW)}, **how)
    return ema(one.withColumn("macd", F.col("_fast") - F.col("_slow")), keys, order, {"macd_signal": ("macd", MACD_SIGNAL)}, **how)


def window_averages(bars: DataFrame, windows: DataFrame, **how) -> DataFrame:
    """``windows`` (symbol, start, end and more) with ema_50, macd, macd_signal and macd_hist at the last bar up to ``end`` as
    if the series began with the first bar from ``start`` on; NULL where no bar lies between.

    The averages of the whole series are found once.  Starting at s instead changes an average by its difference from
    the value at s, which fades by q each step; the signal line takes in two such geometric series.  So windows
    that overlap are not run again, and a window costs two rows however long it is.  Both dates are DATE columns;
    a reversed window, or one without a symbol, has NULLs.
    """
    cols = ["close", "ema_50", "_fast", "_slow", "macd_signal", series.POS]
    # neither side's other columns can clash with these names
    table = close_averages(bars.select("symbol", "date", "close"), ["symbol"], "date", **how).select(
        "symbol", "date", *[F.col(c).alias(f"_w{c}") for c in cols])
    names = [f"_w{c}" for c in cols]
    asked = windows.select("symbol", "start", "end").distinct()
    first = asof_join(asked, table, ["symbol"], "start", "date", names, direction="forward")
    first = first.withColumnsRenamed({n: f"_s{n}" for n in names})
    found = asof_join(first, table, ["symbol"], "end", "date", names)
    n = F.col(f"_w{series.POS}") - F.col(f"_s_w{series.POS}")
    x, q, now = F.col("_s_wclose"), keep, lambda c: F.col(f"_w{c}")

    def faded(c: str, span: int) -> Column:
        return now(c) + F.pow(F.lit(q(span)), n) * (x - F.col(f"_s_w{c}"))

    def drift(c: str, span: int) -> Column:
        """What the difference of an average adds to the signal line."""
        p, s = q(span), q(MACD_SIGNAL)
        return (1 - s) * (x - F.col(f"_s_w{c}")) * p * (F.pow(F.lit(p), n) - F.pow(F.lit(s), n)) / (p - s)

    signal = now("macd_signal") - F.pow(F.lit(q(MACD_SIGNAL)), n) * F.col("_s_wmacd_signal") + drift("_fast", MACD_FAST) - drift("_slow", MACD_SLOW)
    found = found.select("symbol", "start", "end", *[F.when(n >= 0, v).alias(a) for a, v in {
        "ema_50": faded("ema_50", EMA_SPAN), "macd": faded("_fast", MACD_FAST) - faded("_slow", MACD_SLOW), "macd_signal": signal}.items()])
    found = found.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ("symbol", "start", "end")]
    kept = windows.drop("ema_50", "macd", "macd_signal", "macd_hist")
    return kept.join(found.withColumnsRenamed({c: f"_of_{c}" for c in ("symbol", "start", "end")}), same, "left") \
        .drop("_of_symbol", "_of_start", "_of_end")
