"""Cut the lineage of a result that several passes read."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_landed: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.  A session that names none gets a folder
    in its warehouse, which executors share as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_landed"


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; its files go when the program ends."""
    path = f"{shared_folder(spark)}/land-{uuid.uuid4().hex}"
    _landed.append((spark, path))
    return path


def land(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back from there, so that later passes
    prune columns and push filters, and a lost executor costs a read and no recomputation.  The write's shuffle files go
    with it, since nothing else reads them."""
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession)
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._landed_at = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Remove the files of landed frames.  Call it once everything that reads them has been landed itself."""
    for df in frames:
        path = getattr(df, "_landed_at", None)
        held = next((x for x in _landed if x[1] == path), None)
        if held:
            _landed.remove(held)
            _remove(*held)


def _remove(spark: SparkSession, path: str) -> None:
    """A local path is removed; in another store an empty table replaces the files, if the session still runs."""
    local = path.removeprefix("file://") if path.startswith("file:") else path
    if "://" not in local:
        shutil.rmtree(local.removeprefix("file:"), ignore_errors=True)
    elif spark.getActiveSession() is not None:
        spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)


@atexit.register
def _release() -> None:
    for spark, path in _landed:
        _remove(spark, path)
