"""Files of the machines themselves: a folder tree as rows, and digests read chunk by chunk.

Neither a file nor its bytes ever become a row: the inventory row goes to the task, and the task reads the
file in chunks of 64 KiB and hands on digests. A file may be far larger than the task's memory, rows that are no candidates
are never opened, and a candidate that is not executable-like costs its first two bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import paths
from ..functions.paths import BACKSLASH
from ..operators.enrich import hash_candidate

CHUNK = 64 * 1024
#: Bytes of candidates that a task reads, about.
TASK_BYTES = 1 << 30
_DIGESTS = (None, "sha512", "xxhash64")


class _Second:
    """The optional second digest, fed chunk by chunk."""

    def __init__(self, name: str | None):
        if name == "xxhash64":
            import xxhash

            self.state = xxhash.xxh64(seed=42)
        else:
            self.state = hashlib.sha512() if name else None

    def update(self, chunk: bytes) -> None:
        if self.state:
            self.state.update(chunk)

    def hex(self) -> str | None:
        return self.state.hexdigest() if self.state else None


def _open(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


def _location(path: str, volume: str, roots: Mapping[str, str]) -> str | None:
    """Where the file lies; null for paths of unknown volumes or that climb out of their root."""
    top = volume + BACKSLASH
    if volume not in roots or not path.startswith(top):
        return None
    parts = path[len(top) :].replace(BACKSLASH, "/").split("/")
    return None if ".." in parts else f"{roots[volume].rstrip('/')}/{'/'.join(parts)}"


def digest_file(location: str | None, by_name: bool, second: str | None) -> tuple[str, str | None, str | None, int]:
    """Outcome, digests and bytes read of one candidate."""
    read = 0
    try:
        if location is None:
            raise OSError("no such volume")
        system, path = _open(location)
        with system.open_input_stream(path, buffer_size=0) as stream:
            chunk = stream.read(2)
            read = len(chunk)
            if not by_name and chunk != b"MZ":
                return "skipped", None, None, read
            first, other = hashlib.sha256(), _Second(second)
            while chunk:
                first.update(chunk)
                other.update(chunk)
                chunk = stream.read(CHUNK)
                read += len(chunk)
        return "hashed", first.hexdigest(), other.hex(), read
    except (OSError, pa.ArrowInvalid):
        return "failed", None, None, read


def hash_files(
    files: DataFrame, roots: Mapping[str, str], second_digest: str | None = None, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """``files`` with fresh ``sha256`` and ``digest2`` where they can be hashed, ``outcome`` and ``bytes_read``.

    ``roots`` tells per volume where its top folder is mounted: a folder all executors see, or a URI that
    Arrow can open. Outcomes are those of :func:`driftledger.operators.enrich.with_outcome`; rows without one
    keep their digests and read nothing. Candidates are dealt by their bytes, so a task reads about
    ``task_bytes`` or one file. Columns with the names made here are replaced.
    """
    if second_digest not in _DIGESTS:
        raise ValueError(f"no second digest is called '{second_digest}'; there are sha512 and xxhash64")
    names = [c for c in files.columns if c not in ("outcome", "bytes_read")]
    asked = F.coalesce(hash_candidate(), F.lit(False))
    rest = files.where(~asked).select(
        *names, F.lit(None).cast("string").alias("outcome"), F.lit(0).cast("long").alias("bytes_read")
    )
    candidates = files.where(asked).select(*names)
    total = candidates.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-total // task_bytes), files.sparkSession.sparkContext.defaultParallelism)
    dealt = candidates.withColumn("_by_name", paths.has_pe_path_extension(F.col("path"))).repartition(int(tasks))
    kept = [f for f in candidates.schema]
    schema = StructType([*kept, StructField("outcome", StringType()), StructField("bytes_read", LongType())])
    where = dict(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                digest_file(_location(p, v, where), n, second_digest)
                for p, v, n in zip(*(batch.column(c).to_pylist() for c in ("path", "volume", "_by_name")))
            ]
            columns = list(zip(*found)) or [[]] * 4
            new = {"outcome": pa.array(columns[0], pa.string()), "bytes_read": pa.array(columns[3], pa.int64())}
            hashed = pa.array([o == "hashed" for o in columns[0]], pa.bool_())
            for name, values in (("sha256", columns[1]), ("digest2", columns[2])):
                new[name] = pa.compute.if_else(hashed, pa.array(values, pa.string()), batch.column(name).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([new.get(f.name, _column(batch, f.name)) for f in schema], schema.names)

    return rest.unionByName(dealt.mapInArrow(run, schema))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array | None:
    return batch.column(name) if name in batch.schema.names else None


def copy_file(location: str | None, target: str) -> tuple[str, int]:
    """What became of one copy, and its bytes. A copy that is there already is left alone.

    The bytes go to a name of their own first and are renamed when complete, so a copy that was killed half
    way is none, and one that is made twice at a time is still the same file.
    """
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        if location is None:
            raise OSError("no such volume")
        out, to = _open(target)
        if out.get_file_info(to).type == fs.FileType.File:
            return "kept", 0
        system, path = _open(location)
        copied = 0
        with system.open_input_stream(path, buffer_size=0) as source, out.open_output_stream(_open(part)[1]) as sink:
            while chunk := source.read(CHUNK):
                sink.write(chunk)
                copied += len(chunk)
        out.move(_open(part)[1], to)
        return "copied", copied
    except (OSError, pa.ArrowInvalid) as error:
        return f"<error: {error}>", 0


def copy_files(picked: DataFrame, roots: Mapping[str, str], target: str) -> DataFrame:
    """``target_name``, ``result`` (copied, kept, or an error text) and ``bytes``: every name once below ``target``.

    ``picked`` has ``target_name, volume, path``, one row per name (``pick_sources``). No bytes become rows.
    """
    where, folder = dict(roots), target.rstrip("/")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, volumes, files = (batch.column(c).to_pylist() for c in ("target_name", "volume", "path"))
            done = [copy_file(_location(f, v, where), f"{folder}/{n}") for n, v, f in zip(names, volumes, files)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([r for r, _ in done], pa.string()), pa.array([b for _, b in done], pa.int64())],
                ["target_name", "result", "bytes"],
            )

    tasks = picked.sparkSession.sparkContext.defaultParallelism
    chosen = picked.select("target_name", "volume", "path").repartition(max(1, tasks))
    return chosen.mapInArrow(run, "target_name string, result string, bytes long")


class TreeSource(DataSource):
    """``spark.read.format("file_tree").option("root", …).option("volume", …).load()``: files and folders below a root.

    Rows: ``volume, path, name, size, mtime, is_dir``. Nothing is opened, and nothing is left out: empty
    files and names that begin with ``_`` or ``.`` are rows as well. A partition is a share of the
    root's entries and walks what lies below them.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "volume string, path string, name string, size long, mtime long, is_dir boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(self.options)


class _Share(InputPartition):
    """Entries to list: a path, and whether what lies below it belongs to the share too."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries


class _TreeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.root = options["root"].rstrip("/")
        self.volume = options.get("volume", "C:")
        self.shares = int(options.get("shares", "64"))

    def partitions(self) -> list[InputPartition]:
        """The root's entries, and one level down those of its folders, so that a large folder is shared out."""
        system, top = _open(self.root)
        entries = []
        for info in system.get_file_info(fs.FileSelector(top)):
            entries.append((info.path, False))
            if info.type == fs.FileType.Directory:
                entries += [(x.path, True) for x in system.get_file_info(fs.FileSelector(info.path))]
        entries.sort()
        return [_Share(entries[k :: self.shares]) for k in range(min(self.shares, len(entries)))]

    def read(self, partition: _Share) -> Iterator[tuple]:
        system, top = _open(self.root)
        for path, deep in partition.entries:
            info = system.get_file_info(path)
            yield self._row(info, top)
            if deep and info.type == fs.FileType.Directory:
                for below in system.get_file_info(fs.FileSelector(path, recursive=True)):
                    yield self._row(below, top)

    def _row(self, info: fs.FileInfo, top: str) -> tuple:
        path = self.volume + BACKSLASH + info.path[len(top) :].strip("/").replace("/", BACKSLASH)
        seconds = int(info.mtime.timestamp()) if info.mtime else 0
        return self.volume, path, info.base_name, info.size or 0, seconds, info.type == fs.FileType.Directory


def read_tree(spark: SparkSession, root: str, volume: str, shares: int = 64) -> DataFrame:
    """Everything below ``root`` as inventory rows; digests come from :func:`hash_files`."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("file_tree").option("root", root).option("volume", volume).option("shares", shares).load()
