"""Tables that end a lineage: written as Parquet to the shared folder of spark.checkpoint.dir and read back."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN = uuid.uuid4().hex
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a local session names none (tests) a temporary one; a cluster has to."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pelagraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step", *by: str) -> DataFrame:
    """df as a written table, in folders by some columns. Plans stay short, and a lost executor costs only its running tasks."""
    spark = df.sparkSession
    if not _WRITTEN:
        atexit.register(_clean, spark)
    path = f"{shared_dir(spark)}/pelagraph-{_OWN}/{name}-{uuid.uuid4().hex[:8]}"
    _WRITTEN.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = vars(df).get("_written_to") if df is not None else None
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is written within at its end, but for the tables given to the function that it yields."""
    before, kept = set(_WRITTEN), set()

    def hold(df: DataFrame) -> DataFrame:
        kept.add(vars(df).get("_written_to"))
        return df

    try:
        yield hold
    finally:
        for path in [p for p in _WRITTEN if p not in before and p not in kept]:
            _WRITTEN.remove(path)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession) -> None:
    """At the end of the driver's process; a session that has already stopped leaves its files."""
    if spark.sparkContext._jsc is None:
        return
    for path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package where the driver has it (a cluster ships it)."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
