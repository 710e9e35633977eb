"""File bytes by path, for hashing, magic tests and triage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import BACKSLASH
from ..model import SIZE_LIMIT


def read_content(
    spark: SparkSession,
    root: str,
    volume: str,
    max_length: int = SIZE_LIMIT,
    glob: str | None = None,
) -> DataFrame:
    """Bytes below ``root`` as ``volume, path, length, content``.

    ``root`` stands for the top of ``volume``; the part of each file's path below it becomes
    the inventory path. The length filter reaches the file listing, so oversized files are
    never opened.

    The reader skips empty files and names that begin with ``_`` or ``.``; inventory rows must
    therefore come from a metadata feed. A candidate without content counts as failed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).filter(F.col("length").between(1, max_length))
    return files.select(
        F.lit(volume).alias("volume"),
        _inventory_path(F.col("path"), root, volume).alias("path"),
        "length",
        "content",
    )


def _inventory_path(path: Column, root: str, volume: str) -> Column:
    plain = F.regexp_replace(path, "^[a-z0-9]+:/*(?=/)", "")
    top = "/" + root.split("://")[-1].strip("/") + "/"
    below = F.substring(plain, F.instr(plain, top) + F.lit(len(top)), F.length(plain))
    return F.concat(F.lit(volume + BACKSLASH), F.translate(below, "/", BACKSLASH))
