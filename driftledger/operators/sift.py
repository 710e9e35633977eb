"""Which rows of two inventories can be part of a change, told before whole rows move.

Most files of two inventories are the same, so hashes are shuffled first: 32 bytes a row tell which ids
are settled (one row on each side, equal in every column), 16 bytes which paths only one file ever held.
What is left is marked in a bitmap of hashed cells, and rows of other cells never leave their task. A cell that
is marked by chance, or by a hash that two ids or paths share, only keeps rows that the joins then sort out. The
one place where a hash stands for a value is that the two rows of an id count as equal: 96 bits of a SHA-256.

Every step ends in a small table, and its shuffle files go before the next one begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workdir import stored

# Cells of a bitmap: so many for each marked hash, and 16 MB of bits at most, which are broadcast.
CELLS_PER_HASH, CELLS = 16, 1 << 27

_MAP = 1 << 15  # bits that bitmap_construct_agg puts into one map
_WORD = 32


def id_hash() -> Column:
    return F.xxhash64("frn", "volume")


def path_hash() -> Column:
    return F.xxhash64("volume", "path")


def open_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """Hashes (``hash``) of the ids that are not settled; rows without an id have none."""
    known = F.col("frn").isNotNull() & F.col("volume").isNotNull()
    sides = [
        df.filter(known).select(id_hash().alias("hash"), _content().alias("_text"), F.lit(side).cast("long").alias("_after"))
        .select("hash", F.sha2("_text", 256).alias("_sha"), "_after")
        .select("hash", F.xxhash64("_sha").alias("_h1"), F.hash("_sha").alias("_h2"), "_after")
        for side, df in enumerate((before, after))
    ]
    seen = sides[0].unionByName(sides[1]).groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_after").alias("n_after"),
        F.bit_xor("_h1").alias("h1"), F.bit_xor("_h2").alias("h2"),
    )
    settled = (F.col("n") == 2) & (F.col("n_after") == 1) & (F.col("h1") == 0) & (F.col("h2") == 0)
    return seen.filter(~settled).select("hash")


def _content() -> Column:
    """All other columns as one text that tells any two rows apart, what is missing included."""
    missing = F.lit("~")
    plain = [F.coalesce(F.col(c).cast("string"), missing) for c in ("size", "mtime", "is_dir")]
    digest = [F.coalesce(F.length("sha256").cast("string"), missing), F.coalesce("sha256", F.lit(""))]
    return F.concat_ws("\0", *plain, *digest, F.coalesce(F.concat(F.lit("="), "path"), missing))


def shared_paths(files: DataFrame) -> DataFrame:
    """Hashes (``hash``) of the paths that more than one id holds, of rows ``volume, path, frn`` of both sides."""
    held = files.groupBy(path_hash().alias("hash")).agg(F.min("frn").alias("least"), F.max("frn").alias("most"))
    return held.filter(F.col("least") != F.col("most")).select("hash")


class Marks:
    """A bitmap of hashed cells; ``rows`` keeps what lies in a marked one."""

    def __init__(self, hashes: DataFrame) -> None:
        """``hashes`` (``hash``) is computed once, here."""
        hashes = stored(hashes, "marked")
        self.cells = min(CELLS, max(_MAP, CELLS_PER_HASH * hashes.count()))
        cell = self._cell(F.col("hash"))
        maps = (
            hashes.select(F.bitmap_bucket_number(cell).alias("_map"), F.bitmap_bit_position(cell).alias("_place"))
            .repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_place").alias("_bits"))
        )
        word = lambda i: F.conv(F.hex(F.substring("_bits", i * (_WORD // 8) + 1, F.lit(_WORD // 8))), 16, 10).cast("long")
        words = F.transform(F.sequence(F.lit(0), F.lit(_MAP // _WORD - 1)), word)
        self.maps = stored(maps.select("_map", words.alias("_words")), "marks")

    def _cell(self, hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(self.cells)) + 1

    def rows(self, df: DataFrame, hashed: Column, also: Column | None = None) -> DataFrame:
        """Rows of ``df`` whose hash lies in a marked cell, and those that ``also`` says, as they are."""
        cell = self._cell(hashed)
        own = df.withColumns({"_map": F.bitmap_bucket_number(cell), "_place": F.bitmap_bit_position(cell)})
        place = F.col("_place")
        # the bytes of a word stand in the order of the bitmap, the first one on the left
        shift = (F.lit(_WORD - 8) - F.floor(place % _WORD / 8) * 8 + place % 8).cast("int")
        marked = F.getbit(F.get("_words", F.floor(place / _WORD).cast("int")), shift) == 1
        kept = F.coalesce(marked, F.lit(False))
        near = own.join(F.broadcast(self.maps), "_map", "left")
        return near.filter(kept if also is None else kept | also).select(*df.columns)
