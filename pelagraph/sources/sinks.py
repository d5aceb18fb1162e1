"""Query results as files. Files are written in parallel, one a partition; ``single`` asks for one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write(df: DataFrame, path: str, single: bool = False) -> None:
    """By the path's ending: csv, parquet/pq or json."""
    kind = path.rsplit(".", 1)[-1].lower()
    df = df.coalesce(1) if single else df
    if kind == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        flat = df.select(*((F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema))
        flat.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")
    elif kind in ("parquet", "pq"):
        df.write.mode("overwrite").parquet(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no writer for {path}")
