"""Finding landed files by age and name; only paths are listed, no content is read."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _listing(spark: SparkSession, path: str, **options: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").options(**options).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime", "length")


def changed_since(spark: SparkSession, path: str, minutes: int, now: datetime) -> DataFrame:
    """Files modified in the last ``minutes`` before ``now`` (session time zone)."""
    return _listing(spark, path, modifiedAfter=(now - timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S"))


def first_named(spark: SparkSession, path: str, contains: str, suffix: str) -> DataFrame:
    """The first file, by name, that contains a text and ends with a suffix; no row without one."""
    hits = _listing(spark, path).filter(F.contains("name", F.lit(contains)) & F.endswith("name", F.lit(suffix)))
    return hits.orderBy("name").limit(1)


def named_any(spark: SparkSession, path: str, any_of: list[str], and_text: str) -> DataFrame:
    """Files whose name holds one of some texts and also another one."""
    one = F.lit(False)
    for t in any_of:
        one = one | F.contains("name", F.lit(t))
    return _listing(spark, path).filter(one & F.contains("name", F.lit(and_text)))
