"""Reading and writing the market tables: scans, casts, upserts and the write modes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators.select import latest_per_key
from marketframe.schemas import spark_type


def scan(table: DataFrame, symbols: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of some symbols between two dates; both filters reach the files."""
    out = table.filter(F.col("symbol").isin(symbols))
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out


def run_sql(spark: SparkSession, statement: str, **args) -> DataFrame:
    """A statement with named parameters (``:name``); values never become part of its text."""
    return spark.sql(statement, args=args)


def _cast(df: DataFrame, types: dict[str, str]) -> dict[str, Column]:
    known = {c: spark_type(t) for c, t in types.items() if c in df.columns}
    return {c: F.col(c).try_cast(t) for c, t in known.items() if t}


def conform(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns to their declared database types; what does not fit becomes NULL, and a column of a type
    that is not known stays as it is."""
    return df.withColumns(_cast(df, types))


def cast_failures(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """How many non-empty values of each column the cast would lose."""
    return df.agg(*[F.count(F.when(F.col(c).isNotNull() & x.isNull(), 1)).alias(c) for c, x in _cast(df, types).items()])


def _in_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join in which NULL keys are equal."""
    other = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys])
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], how)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None, one_row: bool = True) -> DataFrame:
    """``target`` with the rows of ``batch`` put in: whole rows, new ones added, same keys replaced.

    Of several batch rows with one key the last by ``order`` counts, or the largest by all columns; with
    ``one_row=False`` they are all put in.  NULL keys are equal, so a batch put in twice changes nothing.  Target
    rows only meet the batch's keys (an anti join), so a small batch leaves the target unshuffled.
    """
    rows = latest_per_key(batch, keys, order or [c for c in batch.columns if c not in keys] or keys) if one_row else batch
    rows = rows.select(*target.columns)
    return _in_keys(target, rows, keys, "left_anti").select(*target.columns).unionByName(rows)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _replace_partitions(staged: DataFrame, path: str, partition: str, keys: list[str]) -> None:
    # ranges of the key keep a large partition value in many tasks and the files sorted for pruning
    (staged.repartitionByRange(partition, *keys).sortWithinPartitions(partition, *keys).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], partition: str,
                 order: list[str] | None = None, one_row: bool = True) -> None:
    """Upsert into a Parquet table, rewriting only the partitions that the batch touches.

    ``partition`` is a column that follows from the keys.  The new partitions are first written whole beside the
    table (``<path>_staged``) and only then put in their place, so nothing is read and overwritten at once.  If a
    run ends in between, the next one finds the staged partitions and puts them in place before its own.
    """
    staged = f"{path}_staged"

    def place() -> None:
        whole = spark.read.parquet(staged)
        _replace_partitions(whole, path, partition, keys)
        whole.limit(0).write.mode("overwrite").parquet(staged)

    if table_exists(spark, staged) and not spark.read.parquet(staged).isEmpty():
        place()
    if not table_exists(spark, path):
        rows = upsert(batch.limit(0), batch, keys, order, one_row)
        rows.drop(*(order or [])).write.mode("overwrite").parquet(staged)
    else:
        table = spark.read.parquet(path)
        old = _in_keys(table, batch.select(partition).distinct(), [partition], "left_semi").select(*table.columns)
        upsert(old, batch, keys, order, one_row).write.mode("overwrite").parquet(staged)
    place()


def overwrite(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def truncate_and_load(df: DataFrame, table: str) -> None:
    df.write.insertInto(table, overwrite=True)


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def bulk_load(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Batched inserts over as many connections as ``df`` has partitions."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize="10000", **options).mode("append").save()


def column_types(spark: SparkSession, table: str) -> dict[str, str]:
    return {c.name: c.dataType for c in spark.catalog.listColumns(table)}


def json_records(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns), {"dateFormat": "yyyy-MM-dd"}).alias("record"))
