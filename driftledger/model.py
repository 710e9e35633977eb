"""Schemas, fixed values and option records shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Extensions treated as Windows executables ("PE"), without the dot.
PE_EXTENSIONS = (
    "exe", "dll", "sys", "scr", "cpl", "ocx", "drv", "efi", "pyd", "com",
)

# Fixed value: files above this many bytes are never hashed (200 MiB).
SIZE_LIMIT = 209_715_200

# Fixed value: repeats of one (path, kind) inside this window are dropped.
THROTTLE_MS = 800

# Change-record reason bits.
REASON_BITS = {
    "DATA_OVERWRITE": 0x1,
    "DATA_EXTEND": 0x2,
    "DATA_TRUNCATION": 0x4,
    "FILE_CREATE": 0x100,
    "FILE_DELETE": 0x200,
    "RENAME_OLD_NAME": 0x1000,
    "RENAME_NEW_NAME": 0x2000,
    "BASIC_INFO_CHANGE": 0x8000,
    "CLOSE": 0x80000000,
}

# The console tag of every event kind.
EVENT_TAGS = {"Created": "[+]", "Deleted": "[-]", "Modified": "[M]", "Renamed": "[R]"}

# Diff categories in report order.
CATEGORIES = ("added", "removed", "modified", "replaced")

# Fixed value: file name used when a path has no last component.
UNNAMED = "unnamed.bin"

# Fixed value: stands in for the short hash of a file without a digest.
NO_HASH = "nohash"


def _fields(*spec: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, null) for name, dtype, null in spec])


_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()

SNAPSHOT_SCHEMA = _fields(
    ("id", _L, False),
    ("name", _S, False),
    ("taken_at", _L, False),
    ("host", _S, True),
    ("note", _S, True),
)

FILE_SCHEMA = _fields(
    ("snapshot_id", _L, False),
    ("volume", _S, False),
    ("frn", _L, False),
    ("parent_frn", _L, False),
    ("path", _S, False),
    ("name", _S, False),
    ("size", _L, False),
    ("mtime", _L, False),
    ("ctime", _L, False),
    ("is_dir", _B, False),
    ("sha256", _S, True),
    ("digest2", _S, True),
)

SCAN_RECORD_SCHEMA = _fields(
    ("volume", _S, False),
    ("frn", _L, False),
    ("parent_frn", _L, False),
    ("path", _S, False),
    ("name", _S, False),
    ("size", _L, False),
    ("mtime", _L, False),
    ("ctime", _L, False),
    ("is_dir", _B, False),
    ("seq", _L, False),
)

CHANGE_RECORD_SCHEMA = _fields(
    ("usn", _L, False),
    ("ts", T.TimestampType(), False),
    ("volume", _S, False),
    ("frn", _L, False),
    ("reason", _L, False),
    ("path", _S, False),
)

#: Change records of many hosts.
FLEET_RECORD_SCHEMA = T.StructType([*CHANGE_RECORD_SCHEMA.fields, T.StructField("host", _S, True)])

RULE_SCHEMA = _fields(("pos", T.IntegerType(), False), ("kind", _S, False), ("pattern", _S, False))

CONTENT_SCHEMA = _fields(
    ("volume", _S, False),
    ("path", _S, False),
    ("length", _L, False),
    ("content", T.BinaryType(), True),
)


@dataclass(frozen=True)
class Rule:
    """One exclusion rule as its author typed it. ``kind`` is prefix, glob or regex."""

    kind: str
    pattern: str


@dataclass(frozen=True)
class DiffOptions:
    """What a comparison reports.

    ``limit`` caps every category after filtering; 0 means no cap.
    ``extensions`` and ``rules`` are taken as typed and normalised on use.
    ``hidden_paths`` are output locations of this engine (tables, dump folders) that
    scans pick up again; they act as extra prefix rules unless ``include_self``.
    """

    include_dirs: bool = False
    limit: int = 0
    extensions: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    variables: dict[str, str] = field(default_factory=dict)
    hidden_paths: tuple[str, ...] = ()
    include_self: bool = False


@dataclass(frozen=True)
class ScanOptions:
    """What an ingest keeps, and whether it hashes."""

    volumes: tuple[str, ...] = ()
    exclude_volumes: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    variables: dict[str, str] = field(default_factory=dict)
    hidden_paths: tuple[str, ...] = ()
    hash_content: bool = True
    second_digest: str | None = None


@dataclass(frozen=True)
class WatchOptions:
    """Which change records become events. ``mount`` completes unqualified record paths."""

    volumes: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    variables: dict[str, str] = field(default_factory=dict)
    hidden_paths: tuple[str, ...] = ()
    include_self: bool = False
    window_ms: int = THROTTLE_MS
    start_ts: str | None = None
