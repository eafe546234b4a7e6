"""Readers and writers. Schemas are declared, so no source is scanned to infer one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Tables whose texts take long to work on, and the key to spread them by.
TEXT_TABLES = {"documents": "doc_id"}


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{base}/{name}.parquet")
    return spread(rows, TEXT_TABLES[name]) if name in TEXT_TABLES else rows


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan of a few large row groups spread over all cores; one of many files stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)


def json_records(
    raw: DataFrame, schema: str, column: str = "payload"
) -> tuple[DataFrame, DataFrame]:
    """Parse model output held as JSON text into typed rows, and set aside what does not parse.

    Code fences around the JSON are removed first. Broken JSON is not repaired: such rows go to
    the second frame unchanged, with the text that failed.
    """
    parsed = raw.withColumn("_parsed", parse_json(F.col(column), schema))
    broken = F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull()
    good = parsed.where(~broken).withColumn("record", F.col("_parsed").dropFields("_corrupt"))
    bad = parsed.where(broken).select(*raw.columns)
    return good.drop("_parsed"), bad


def parse_json(text: Column, schema: str) -> Column:
    unfenced = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(
        unfenced,
        f"{schema}, _corrupt string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, modificationTime, length, content), for hashing uploads."""
    return spark.read.format("binaryFile").load(path)
