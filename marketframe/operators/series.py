"""Ordered work on keyed series without one task per key.

A series is all rows of one key in the order of one column, at most one row per
(key, order value).  Nothing here needs a whole series in one task: rows are
first counted per time bucket, the small bucket table gives every row its
position in the series, and windows then run over fixed-size chunks of positions
that carry copies of the neighbouring rows their frames reach into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"
SIZE = "_size"
CHUNK = "_chunk"
BLOCK = "_block"
OWN = "_own"
HELPERS = (POS, SIZE, CHUNK, BLOCK, OWN)

BUCKET_DAYS = 512
CHUNK_ROWS = 8192
BLOCK_ROWS = 256


def time_bucket(df: DataFrame, order: str, width: int = BUCKET_DAYS) -> Column:
    """Bucket number that never falls as ``order`` rises: days, or seconds for timestamps."""
    kind = df.schema[order].dataType
    c = F.col(order)
    if isinstance(kind, T.DateType):
        n = F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        n = F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000)
    else:
        n = c
    return F.floor(n / F.lit(width)).cast("long")


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Each row with the columns of its group; NULL is a group like any other."""
    other = groups.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return rows.join(other, same, "inner").drop(*[f"_of_{c}" for c in on])


def running(df: DataFrame, keys: list[str], levels: list[str], order: list, sums: dict[str, Column],
            inclusive: bool = True) -> DataFrame:
    """Running totals of ``sums`` in (levels, order) order within ``keys``.

    ``levels`` are columns of ``df``, coarse to fine, that never fall along the
    order.  Totals per level are partial aggregates; only one finest-level group is
    ever sorted in one task.  Callers pick levels fine enough for that group to be small.
    """
    names = list(sums)
    df = df.withColumns({f"_in_{n}": c for n, c in sums.items()})
    finest = df.groupBy(*keys, *levels).agg(*[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in names])
    offsets = finest.select(*keys, *levels)
    for i, level in enumerate(levels):
        parent, group = [*keys, *levels[:i]], [*keys, *levels[:i + 1]]
        totals = finest.groupBy(*group).agg(*[F.sum(f"_tot_{n}").alias(f"_tot_{n}") for n in names])
        earlier = Window.partitionBy(*parent).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*group, *[
            F.coalesce(F.sum(f"_tot_{n}").over(earlier), F.lit(0)).alias(f"_before{i}_{n}") for n in names])
        offsets = _with_groups(offsets, before, group)
    offsets = offsets.select(*keys, *levels, *[
        sum(F.col(f"_before{i}_{n}") for i in range(len(levels))).alias(f"_off_{n}") for n in names])
    end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    out = _with_groups(df, offsets, [*keys, *levels]).withColumns({
        n: F.col(f"_off_{n}") + F.coalesce(F.sum(f"_in_{n}").over(inner), F.lit(0)) for n in names})
    return out.drop(*[f"_in_{n}" for n in names], *[f"_off_{n}" for n in names])


def with_position(df: DataFrame, keys: list[str], order: str, width: int = BUCKET_DAYS,
                  pos: str = POS, size: str = SIZE, fill: list[str] | None = None) -> DataFrame:
    """Add the 0-based position of each row in its series and the length of the series.

    ``fill`` names columns whose NULLs take the last value before them, found in the same pass.  Rows without a
    key form a series of their own; rows without an order value come first in theirs.
    """
    fill = fill or []
    b = df.withColumn("_bucket", time_bucket(df, order, width))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = b.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in fill])
    offsets = per_bucket.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(size),
        *[F.last(f"_end_{c}", True).over(w).alias(f"_carry_{c}") for c in fill])
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    so_far = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _with_groups(b, offsets, [*keys, "_bucket"])
        .withColumns({pos: F.col("_before") + F.row_number().over(inner) - 1,
                      **{c: F.coalesce(F.last(c, True).over(so_far), F.col(f"_carry_{c}")) for c in fill}})
        .drop("_bucket", "_before", *[f"_carry_{c}" for c in fill])
    )


def chunked(df: DataFrame, keys: list[str], order: str, before: int, after: int = 0,
            rows: int = CHUNK_ROWS, block: int = BLOCK_ROWS, width: int = BUCKET_DAYS) -> DataFrame:
    """Cut each series into chunks of ``rows`` positions, each with its halo of copied rows.

    Every own row sees the ``before`` rows ahead of it and the ``after`` rows behind
    it inside its chunk, so any frame within that reach gives the whole-series answer.
    Run windows from :func:`chunk_window`, then :func:`own_rows`.
    """
    p = df if POS in df.columns else with_position(df, keys, order, width)
    pos, last = F.col(POS), F.floor((F.col(SIZE) - 1) / F.lit(rows))
    lo = F.greatest(F.lit(0), F.floor((pos - after) / F.lit(rows)))
    hi = F.least(last, F.floor((pos + before) / F.lit(rows)))
    # windows cost far more than their bytes suggest, so the partitions are not left to size-based merging
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        p.withColumn(CHUNK, F.explode(F.sequence(lo, hi)))
        .repartition(tasks, *keys, CHUNK)
        .withColumn(OWN, F.col(CHUNK) == F.floor(pos / F.lit(rows)))
        .withColumn(BLOCK, F.floor(pos / F.lit(block)))
    )


def chunk_window(keys: list[str]):
    """The one (partition, order) that all chunked windows share: one exchange, one sort."""
    return Window.partitionBy(*keys, CHUNK).orderBy(BLOCK, POS)


def own_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop the copied rows and the helper columns."""
    return df.filter(F.col(OWN)).drop(*[c for c in HELPERS if c not in keep])


def forward_fill(df: DataFrame, keys: list[str], order: str, cols: list[str], width: int = BUCKET_DAYS) -> DataFrame:
    """Replace NULLs by the last value before them in the series, however far back it lies."""
    return with_position(df, keys, order, width, fill=cols).select(*df.columns)
