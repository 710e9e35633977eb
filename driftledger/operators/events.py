"""Change records to events: classification, rename pairing and the emit filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, values
from ..model import SIZE_LIMIT, WatchOptions
from .enrich import one_per_path
from .rules import PathFilter
from .selection import filter_volumes

# Rename pairing looks back without bound, so a file's records are cut into pieces of this many
# sequence numbers: no task ever holds more of one file than a piece.
USN_PIECE = 1 << 22

EVENT_COLUMNS = ("ts", "usn", "volume", "frn", "kind", "path")


def host_key(df: DataFrame) -> tuple[str, ...]:
    """The host column of a fleet's records; a single host's records have none."""
    return ("host",) if "host" in df.columns else ()


def event_columns(df: DataFrame) -> tuple[str, ...]:
    return (*EVENT_COLUMNS, *host_key(df))


def event_kind(reason: Column) -> Column:
    """Deleted, Created, Renamed or Modified, in that precedence; null unless closed."""
    return F.when(
        values.has_bits(reason, "CLOSE"),
        F.when(values.has_bits(reason, "FILE_DELETE"), F.lit("Deleted"))
        .when(values.has_bits(reason, "FILE_CREATE"), F.lit("Created"))
        .when(values.has_bits(reason, "RENAME_NEW_NAME"), F.lit("Renamed"))
        .when(
            values.has_bits(reason, "DATA_EXTEND", "DATA_OVERWRITE", "DATA_TRUNCATION"),
            F.lit("Modified"),
        ),
    )


def is_event(kind: Column, reason: Column) -> Column:
    """Classified, and not the old half of a rename."""
    old_half = (kind != "Renamed") & values.has_bits(reason, "RENAME_OLD_NAME")
    return kind.isNotNull() & ~old_half


def prepare_records(
    records: DataFrame, options: WatchOptions, mount: Column | None = None
) -> DataFrame:
    """Selected volumes from the start time on, with plain paths and an event kind.

    Records may name their ``host``; then files, repeats and old names are told apart by it, and a
    missing host is one of its own, written as the empty string.
    """
    selected = filter_volumes(records, options.volumes)
    if options.start_ts is not None:
        selected = selected.filter(F.col("ts") >= F.lit(options.start_ts).cast("timestamp"))
    mount = F.col("volume") if mount is None else mount
    return selected.select(
        "ts",
        "usn",
        "volume",
        "frn",
        "reason",
        event_kind(F.col("reason")).alias("kind"),
        paths.record_path(F.col("path"), mount).alias("path"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in host_key(records)),
    )


def classify_events(prepared: DataFrame) -> DataFrame:
    return prepared.filter(is_event(F.col("kind"), F.col("reason"))).select(*event_columns(prepared))


def emitted(events: DataFrame, keep: PathFilter) -> DataFrame:
    """The emit filter looks at the new path only."""
    kept = keep.keep(F.col("path"))
    return events if kept is None else events.filter(kept)


def pair_renames(prepared: DataFrame, piece: int = USN_PIECE) -> DataFrame:
    """Classified events; Renamed ones carry the latest earlier old name of the same file.

    Only renames and old names are shuffled; other events pass through. Inside one piece of
    sequence numbers an ordered window finds the name. What a piece leaves behind for later
    ones is a single row, so the carry over all pieces of a file is small even if that file
    made a third of all records.
    """
    file = ["frn", "volume", *host_key(prepared)]
    key = [*file, "_piece"]
    is_rename = F.coalesce(F.col("kind") == "Renamed", F.lit(False))
    old_half = values.has_bits(F.col("reason"), "RENAME_OLD_NAME")
    halves = prepared.filter(is_rename | old_half).withColumn(
        "_piece", values.floor_div(F.col("usn"), piece)
    )
    # a record that is both old and new name must not answer itself: strictly smaller usn
    earlier = (
        Window.partitionBy(*key).orderBy("usn").rangeBetween(Window.unboundedPreceding, -1)
    )
    old_name = F.when(old_half, F.col("path"))
    in_piece = halves.withColumn(
        "_found", F.last(old_name, ignorenulls=True).over(earlier)
    ).filter(F.col("kind") == "Renamed")

    earlier_pieces = (
        Window.partitionBy(*file).orderBy("_piece")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        halves.groupBy(*key)
        .agg(F.max_by(old_name, F.when(old_half, F.col("usn"))).alias("_left"))
        .withColumn("_carried", F.last("_left", ignorenulls=True).over(earlier_pieces))
        .filter(F.col("_carried").isNotNull())
        .drop("_left")
    )
    paired = in_piece.join(carried, key, "left").select(
        *event_columns(prepared), F.coalesce("_found", "_carried").alias("renamed_from")
    )
    others = classify_events(prepared).filter(F.col("kind") != "Renamed")
    return others.withColumn("renamed_from", F.lit(None).cast("string")).unionByName(paired)


def enrichable(kind: Column, path: Column, size: Column, is_mz: Column) -> Column:
    """Events that get a hash: not deletions, executable-like, non-empty, up to 200 MiB."""
    pe = paths.has_pe_name_extension(path) | F.coalesce(is_mz, F.lit(False))
    return kind.isin("Created", "Modified", "Renamed") & pe & size.between(1, SIZE_LIMIT)


def event_digests(content: DataFrame) -> DataFrame:
    """Digest table for events: one row per readable file that can qualify."""
    is_mz = values.starts_with_mz(F.col("content"))
    size = F.length("content").cast("long")
    pe = paths.has_pe_name_extension(F.col("path")) | is_mz
    fits = F.col("content").isNotNull() & size.between(1, SIZE_LIMIT)
    return content.filter(fits & pe).select(
        "volume",
        "path",
        *host_key(content),
        size.alias("_size"),
        values.sha256_hex(F.col("content")).alias("_sha256"),
        is_mz.alias("_is_mz"),
    )


def enrich_events(events: DataFrame, digests: DataFrame) -> DataFrame:
    """Add ``sha256_hex`` and ``size`` where the file qualifies and can still be read.

    Digests of a fleet have a ``host`` as its events do. A file that is listed twice counts once.
    """
    d = digests.withColumnRenamed("volume", "_volume").withColumnRenamed("path", "_path")
    same = (events["path"] == F.col("_path")) & (events["volume"] == F.col("_volume"))
    if host_key(events) and host_key(digests):
        d = d.withColumn("_host", F.coalesce("host", F.lit(""))).drop("host")
        same &= events["host"] == F.col("_host")
    d = one_per_path(d, tuple(c for c in ("_path", "_volume", "_host") if c in d.columns))
    joined = events.join(d, same, "left")
    take = F.col("_path").isNotNull() & enrichable(
        F.col("kind"), F.col("path"), F.col("_size"), F.col("_is_mz")
    )
    return joined.select(
        *[events[c] for c in events.columns],
        F.when(take, F.col("_sha256")).alias("sha256_hex"),
        F.when(take, F.col("_size")).alias("size"),
    )
