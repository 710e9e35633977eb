"""Change-record sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import CHANGE_RECORD_SCHEMA


def read_records(
    spark: SparkSession, path: str, schema: StructType = CHANGE_RECORD_SCHEMA
) -> DataFrame:
    """Finished batch of change records (Parquet)."""
    return spark.read.schema(schema).parquet(path)


def stream_records(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    max_files_per_trigger: int = 64,
    schema: StructType = CHANGE_RECORD_SCHEMA,
) -> DataFrame:
    """Stream of change-record files as they arrive.

    A corrupt file fails its source, which ``await_sources`` reports; nothing is left out silently.
    ``schema`` is ``FLEET_RECORD_SCHEMA`` for records that name their host.
    """
    return (
        spark.readStream.schema(schema)
        .format(fmt)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("ignoreCorruptFiles", "false")
        .load(path)
    )


def stream_kafka_records(
    spark: SparkSession,
    servers: str,
    topic: str,
    max_offsets_per_trigger: int = 5_000_000,
    schema: StructType = CHANGE_RECORD_SCHEMA,
) -> DataFrame:
    """Stream of JSON change records from Kafka, from the end of the topic on.

    A message that is no JSON record fails the source instead of vanishing.

    Key the topic by volume: records of one volume must arrive in order. Needs the public
    ``spark-sql-kafka`` package on the class path.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        .load()
    )
    parsed = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST"})
    return raw.select(parsed.alias("r")).select("r.*")


def union_volumes(streams: list[DataFrame]) -> DataFrame:
    """One stream out of one per volume."""
    merged = streams[0]
    for other in streams[1:]:
        merged = merged.unionByName(other)
    return merged
