"""Run a watch: sinks, triggers, several sources, graceful stop."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.query import StreamingQueryException

from ..operators.events import enrich_events, event_digests, host_key
from ..operators.manifest import collect_content, event_manifest, pick_sources


def event_rows(events: DataFrame) -> DataFrame:
    """Events in the shape of the line-per-event output; hash and size null unless enriched."""
    present = set(events.columns)
    null = F.lit(None)
    return events.select(
        F.unix_seconds("ts").alias("timestamp"),
        "volume",
        "kind",
        "path",
        "renamed_from",
        *host_key(events),
        (F.col("sha256_hex") if "sha256_hex" in present else null).cast("string").alias("sha256_hex"),
        (F.col("size") if "size" in present else null).cast("long").alias("size"),
    )


def write_events(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """JSON lines, one event per line, without triage."""
    writer = (
        event_rows(events)
        .writeStream.format("json")
        .option("path", path)
        .option("ignoreNullFields", "false")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return _start(writer, available_now)


def write_events_with_triage(
    events: DataFrame,
    content: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = False,
    collect: bool = True,
) -> StreamingQuery:
    """Events, manifest rows and collected bytes out of every micro-batch.

    ``content`` gets distinct ``volume, path`` (and ``host``, where records have one) and returns the files as
    they are then; what else it returns is dropped before any digest is computed. It is called for the
    batch's files, and, to collect bytes, once more for those alone whose name no earlier batch has
    collected: a name is copied once over the whole watch.

    Each batch owns a folder named by its number. A batch that is run again after a failure replaces its own
    folder and looks at those of smaller numbers only, so it neither loses nor doubles a name.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        place = ["path", "volume", *host_key(batch)]
        wanted = batch.filter(F.col("kind") != "Deleted").select(*place).distinct()

        def read(files: DataFrame) -> DataFrame:
            source = content(files)
            return source.join(files, [c for c in place if c in source.columns], "left_semi")

        enriched = enrich_events(batch, event_digests(read(wanted))).persist()
        try:
            _write_json(event_rows(enriched), f"{path}/events/batch_id={batch_id}")
            rows = event_manifest(enriched)
            _write_json(rows, f"{path}/manifest/batch_id={batch_id}")
            if collect:
                named = rows.withColumnRenamed("dumped_to", "target_name")
                taken = collected_names(batch.sparkSession, f"{path}/files", batch_id)
                picked = pick_sources(named, taken).persist()
                source = read(picked.select(*place).distinct())
                collect_content(picked, source).write.mode("overwrite").parquet(f"{path}/files/batch_id={batch_id}")
                picked.unpersist()
        finally:
            enriched.unpersist()

    writer = (
        events.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return _start(writer, available_now)


def collected_names(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Names that batches before ``batch_id`` have collected; no bytes are read."""
    schema = "target_name string, content binary, batch_id long"
    try:
        files = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], schema)
    return files.filter(F.col("batch_id") < batch_id).select("target_name")


def _write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _start(writer, available_now: bool) -> StreamingQuery:
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stop_after_drain(query: StreamingQuery) -> None:
    """Process what has arrived, then stop; a later start resumes from the checkpoint."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def await_sources(queries: Iterable[StreamingQuery]) -> list[str]:
    """Wait for one query per source; tolerate failed ones unless all of them failed."""
    errors, total = [], 0
    for query in queries:
        total += 1
        try:
            query.awaitTermination()
        except StreamingQueryException as error:
            errors.append(f"[{query.name or query.id}] source failed: {error}")
    if total and len(errors) == total:
        raise RuntimeError("all watch sources failed: " + "; ".join(errors))
    return errors
