"""As-of joins by date or time.

Probes are reduced to their distinct (key, date) pairs first, so however many rows ask
for one key, a task sorts at most one row per key and calendar day from each side.  Timestamps are cut into
buckets: a task sorts one bucket of a key, and the nearest row of another bucket comes from a table
with one row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from marketframe.operators import series

HOUR = 3600

def require_date(df: DataFrame, column: str) -> None:
    """A DATE column bounds the rows of a key that a window sorts in one task by the calendar."""
    if not isinstance(df.schema[column].dataType, DateType):
        raise TypeError(f"{column} must be a DATE, not {df.schema[column].dataType.simpleString()}")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str,
              values: list[str], direction: str = "backward", strict: bool = False,
              tolerance_days: float | None = None, matched: str | None = None, bucket: int | None = None) -> DataFrame:
    """Give each left row the ``values`` of the nearest right row at/before (or at/after) its date.

    ``strict`` excludes the same date.  A match further away than ``tolerance_days`` is no match.
    A matched NULL stays NULL.  ``matched`` names an output column for the matched date.
    Right rows with equal key and date are reduced to the largest by ``values``.
    Both are DATE columns, which bounds what a task sorts per key by the calendar.  With a ``bucket`` they may be timestamps of one
    kind too: a task then sorts the distinct times of one key and ``bucket`` seconds (days for dates).  With no keys the result depends on the date alone.
    Rows without a key or a date, and all rows of an empty right side, find nothing.
    """
    timed = bucket is not None and isinstance(left.schema[left_date].dataType, (TimestampType, TimestampNTZType))
    if timed and left.schema[left_date].dataType != right.schema[right_date].dataType:
        raise TypeError(f"{left_date} and {right_date} are of different types")
    for df, date in () if timed else ((left, left_date), (right, right_date)):
        require_date(df, date)
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction {direction!r}")
    probes = left.select(*keys, F.col(left_date).alias("_d")).filter(F.col("_d").isNotNull()).distinct().select(
        *keys, "_d", F.lit(1).alias("_probe"), F.lit(None).alias("_hit"))
    hits = right.filter(F.col(right_date).isNotNull()).groupBy(*keys, F.col(right_date).alias("_d")).agg(
        F.max(F.struct(*values)).alias("_v"))
    hits = hits.select(*keys, "_d", F.lit(0).alias("_probe"), F.struct(F.col("_d").alias("d"), "_v").alias("_hit"))
    probes = probes.withColumn("_hit", F.lit(None).cast(hits.schema["_hit"].dataType))
    day = F.col("_d") if direction == "backward" else F.col("_d").desc()
    rank = F.col("_probe").desc() if strict else F.col("_probe")
    both = hits.unionByName(probes)
    if bucket:
        both = both.withColumn("_bucket", series.time_bucket(both, "_d", bucket))
    cut = [*keys, "_bucket"] if bucket else keys
    w = Window.partitionBy(*cut).orderBy(day, rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_hit", F.last("_hit", True).over(w)).filter("_probe = 1")
    if bucket:
        found = _with_carried(found, both, keys, direction)
    if tolerance_days is not None:
        apart = F.abs(F.date_diff(F.col("_d"), F.col("_hit.d")))
        if timed:
            apart = F.abs(F.unix_micros(F.col("_d").cast("timestamp")) - F.unix_micros(F.col("_hit.d").cast("timestamp"))) / (86_400 * 1_000_000)
        found = found.withColumn("_hit", F.when(apart <= tolerance_days, F.col("_hit")))
    found = found.select(
        *keys, F.col("_d").alias(left_date), *[F.col(f"_hit._v.{v}").alias(v) for v in values],
        *([F.col("_hit.d").alias(matched)] if matched else []))
    return left.join(found, [*keys, left_date], "left")


def _with_carried(found: DataFrame, both: DataFrame, keys: list[str], direction: str) -> DataFrame:
    """Where a probe's bucket holds nothing for it: the nearest row of the nearest earlier (or later) bucket that has one."""
    backward = direction == "backward"
    nearest = (F.max_by if backward else F.min_by)("_hit", F.when(F.col("_hit").isNotNull(), F.col("_d")))
    ends = both.groupBy(*keys, "_bucket").agg(nearest.alias("_end"))
    number = F.col("_bucket") if backward else F.col("_bucket").desc()
    w = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_bucket", F.last("_end", True).over(w).alias("_carried"))
    return series._with_groups(found, carried, [*keys, "_bucket"]).withColumn("_hit", F.coalesce("_hit", "_carried"))
