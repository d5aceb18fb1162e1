"""Files and databases as DataFrames: CSV, JSON, Parquet, and SQL databases by JDBC.

Paths may have any scheme that the cluster's Hadoop file systems know (file, hdfs, http, https, s3a, gs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagraph.functions.casts import spark_type

_DATABASES = {"sqlite": "jdbc:sqlite:{}", "db": "jdbc:sqlite:{}", "duckdb": "jdbc:duckdb:{}", "ddb": "jdbc:duckdb:{}"}


def kind_of(path: str) -> str:
    return path.split("|")[0].rsplit(".", 1)[-1].lower()


def read(spark: SparkSession, path: str, headers: list[tuple[str, str]] | None = None) -> DataFrame:
    """By the path's ending. headers: names and types of a CSV file's columns; else its header names them, as texts."""
    kind = kind_of(path)
    if kind == "csv":
        return read_csv(spark, path, headers)
    if kind in ("json", "jsonl", "ndjson"):
        return read_json(spark, path)
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind in _DATABASES:
        file, table = path.split("|", 1)
        return read_jdbc(spark, _DATABASES[kind].format(file), table)
    raise ValueError(f"no reader for {path}")


def read_csv(spark: SparkSession, path: str, headers: list[tuple[str, str]] | None = None) -> DataFrame:
    """Empty cells are null. With headers, the file's columns are cast by place; what fails is null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', emptyValue="")
    raw = raw.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns))
    if headers is None:
        return raw
    if len(headers) != len(raw.columns):
        raise ValueError(f"{path} has {len(raw.columns)} columns, the headers name {len(headers)}")
    return raw.select(*(F.col(f"`{c}`").try_cast(spark_type(t)).alias(n) for c, (n, t) in zip(raw.columns, headers, strict=True)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, one object a line, or one object over several lines; the first text that is not blank tells."""
    start = spark.read.text(path).where(F.trim("value") != "").select(F.ltrim("value").alias("v")).first()
    if start is not None and start["v"].startswith("["):
        return spark.read.json(path, multiLine=True)
    lines = spark.read.json(path)
    return spark.read.json(path, multiLine=True) if lines.columns == ["_corrupt_record"] else lines


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """table: a name or a query. key: a numeric column by whose range the scan is split over partitions."""
    source = table if " " not in table.strip() else f"({table}) q"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**options)
    if key:
        low, high = reader.load().agg(F.min(key), F.max(key)).first()
        if low is not None:
            reader = reader.option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", partitions)
    return reader.load()


def scan_postgres(spark: SparkSession, connection: str, table: str) -> DataFrame:
    """connection: 'host=… port=… dbname=… user=… password=…' or a JDBC address."""
    if connection.startswith("jdbc:"):
        return read_jdbc(spark, connection, table)
    parts = dict(x.split("=", 1) for x in connection.split())
    url = f"jdbc:postgresql://{parts.get('host', 'localhost')}:{parts.get('port', '5432')}/{parts.get('dbname', '')}"
    return read_jdbc(spark, url, table, **{k: parts[k] for k in ("user", "password") if k in parts})
