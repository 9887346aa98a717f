"""File sources and sinks with the engine's conventions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_sorted(spark: SparkSession, path: str, key: Sequence[str], partitions: int | None = None) -> DataFrame:
    """A dataset partitioned and sorted by key: established, not assumed."""
    df = spark.read.parquet(path)
    return (df.repartition(partitions, *key) if partitions else df.repartition(*key)).sortWithinPartitions(*key)


def read_records(spark: SparkSession, path: str, schema: str, form: str = "json", skip_bad: bool = False, max_bytes: int | None = None) -> DataFrame:
    """JSON or CSV records of a given schema, one a line; bad records fail, or are skipped, and so are those larger than ``max_bytes``."""
    mode = "DROPMALFORMED" if skip_bad else "FAILFAST"
    if max_bytes is None:
        return spark.read.schema(schema).option("mode", mode).format(form).load(path)
    large = F.octet_length("value") > max_bytes
    lines = spark.read.text(path)
    lines = lines.where(~large) if skip_bad else lines.select(F.when(large, F.raise_error(F.lit(f"a record of more than {max_bytes} bytes"))).otherwise(F.col("value")).alias("value"))
    named = f"{schema}, __bad string"
    options = {"columnNameOfCorruptRecord": "__bad"}
    read = (F.from_json if form == "json" else F.from_csv)("value", named, options | {"mode": "PERMISSIVE"})
    rows = lines.where("value <> ''").select(read.alias("r"))
    if skip_bad:
        rows = rows.where("r.__bad IS NULL")
    else:
        rows = rows.select(F.when(F.col("r.__bad").isNotNull(), F.raise_error(F.lit("a record that can't be read"))).otherwise(F.col("r")).alias("r"))
    return rows.select("r.*").drop("__bad")


def read_bytes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as (path, modificationTime, length, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def write_parquet(df: DataFrame, path: str, codec: str = "lz4_raw", max_records: int | None = None, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.option("compression", codec)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def skip(df: DataFrame) -> None:
    """Runs ``df`` and throws its rows away."""
    df.write.format("noop").mode("overwrite").save()


def name_parts(df: DataFrame, pattern: str = r"log=([^/]+)/hour=([^/]+)/([^/]+)$") -> DataFrame:
    """``df`` with the log, hour and file that each row came from."""
    name = F.input_file_name()
    return df.withColumns({c: F.regexp_extract(name, pattern, i) for i, c in enumerate(("from_log", "from_hour", "from_file"), 1)})
