"""Comparison of two inventories.

Two shuffles per side at most: one full outer join on ``(frn, volume)`` finds everything that
is added, removed, modified or renamed, and one inner join on ``(volume, path)`` finds paths
whose file was replaced by another one. On tables bucketed by ``(volume, frn)`` the first join
needs no shuffle.

The categories overlap on purpose: a replaced path normally shows up as added and removed too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CATEGORIES, DiffOptions
from .rules import PathFilter, path_filter
from .sift import Marks, id_hash, open_ids, path_hash, shared_paths

SIDE_COLUMNS = ("volume", "frn", "path", "size", "mtime", "sha256", "is_dir")
REPORT_SIDE = ("frn", "path", "size", "mtime", "sha256")
REPORT_COLUMNS = (
    "category", "kind", "volume",
    *(f"before_{c}" for c in REPORT_SIDE),
    *(f"after_{c}" for c in REPORT_SIDE),
)

BEFORE, AFTER = "before_", "after_"


def content_changed(before: str = BEFORE, after: str = AFTER) -> Column:
    """With both hashes, only they count; otherwise size or mtime must differ."""
    b, a = (lambda c: F.col(before + c)), (lambda c: F.col(after + c))
    hashed = b("sha256").isNotNull() & a("sha256").isNotNull()
    return F.when(hashed, b("sha256") != a("sha256")).otherwise(
        (b("size") != a("size")) | (b("mtime") != a("mtime"))
    )


def change_kind(path_changed: Column, content: Column) -> Column:
    """Kind of a file present on both sides; null when nothing changed."""
    return (
        F.when(path_changed & content, F.lit("RenamedModified"))
        .when(path_changed, F.lit("Renamed"))
        .when(content, F.lit("Modified"))
    )


def frn_changes(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """Added, removed, modified and renamed files from one full outer join.

    Directory tests come after the join: dropping directories first would turn a file whose
    other side is a directory into an added or removed one. The path filter also comes after
    it, so patterns are evaluated for changed rows only.
    """
    kind = (
        F.when(_only_after(), F.lit("Added"))
        .when(_only_before(), F.lit("Removed"))
        .otherwise(change_kind(_path_changed(), content_changed()))
    )
    joined = _matched(before, after).filter(_reported(options))
    return _report(joined, _id_category(), kind, F.coalesce("before_volume", "after_volume"))


def _matched(before: DataFrame, after: DataFrame) -> DataFrame:
    return _side(before, BEFORE).join(_side(after, AFTER), _same_file(), "full_outer")


def _only_after() -> Column:
    return F.col("before_volume").isNull()


def _only_before() -> Column:
    return F.col("after_volume").isNull()


def _path_changed() -> Column:
    return F.col("before_path") != F.col("after_path")


def _id_category() -> Column:
    return (
        F.when(_only_after(), F.lit("added"))
        .when(_only_before(), F.lit("removed"))
        .otherwise(F.lit("modified"))
    )


def _reported(options: DiffOptions) -> Column:
    """Rows of the full outer join that are changes to report."""
    keep = path_filter(options)
    changed = _path_changed() | content_changed()
    return (
        F.when(_only_after(), _one_side(AFTER, keep, options))
        .when(_only_before(), _one_side(BEFORE, keep, options))
        .otherwise(_files_only(options) & changed & _either_side(keep))
    )


def modified(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """Files on both sides whose path or content changed."""
    joined = _side(_files(before, options), BEFORE).join(
        _side(_files(after, options), AFTER), _same_file()
    )
    changed = joined.filter(_path_changed() | content_changed()).filter(
        _either_side(path_filter(options))
    )
    kind = change_kind(_path_changed(), content_changed())
    return _report(changed, F.lit("modified"), kind, F.col("before_volume"))


def added(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """Files of ``after`` whose id is unknown to ``before`` (directories included there)."""
    return _one_sided(after, before, AFTER, "added", "Added", options)


def removed(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """Files of ``before`` whose id is unknown to ``after`` (directories included there)."""
    return _one_sided(before, after, BEFORE, "removed", "Removed", options)


def replaced(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """Same path, another file. A path held by several files keeps join multiplicity.

    The hash leads the join key: a sort on paths, which nearly all share their first
    bytes, compares whole strings, while a sort on a number stays in its 8-byte prefix.
    """
    keep = path_filter(options)
    sides = []
    for df, tag in ((before, BEFORE), (after, AFTER)):
        kept = keep.keep(F.col("path"))
        df = _files(df, options)
        df = df if kept is None else df.filter(kept)
        sides.append(
            _side(df, tag).withColumn(
                tag + "slot", F.xxhash64(F.col(tag + "volume"), F.col(tag + "path"))
            )
        )
    same_path = (
        (F.col("before_slot") == F.col("after_slot"))
        & (F.col("before_path") == F.col("after_path"))
        & (F.col("before_volume") == F.col("after_volume"))
        & (F.col("before_frn") != F.col("after_frn"))
    )
    joined = sides[0].join(sides[1], same_path)
    return _report(joined, F.lit("replaced"), F.lit("Replaced"), F.col("before_volume"))


def sifted(
    before: DataFrame, after: DataFrame, options: DiffOptions
) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Both sides with the rows that changes by id can need, and with those that replaced pairs can need.

    Rows of a cell stay or go on both sides together, so the joins find what they would find in all rows. A
    row of ``after`` whose id is settled equals one of ``before``, so paths are counted without it.
    """
    before, after = (df.select(*SIDE_COLUMNS) for df in (before, after))
    no_id = F.col("frn").isNull() | F.col("volume").isNull()
    ids = Marks(open_ids(before, after))
    by_id = tuple(ids.rows(df, id_hash(), no_id) for df in (before, after))
    kept = path_filter(options).keep(F.col("path"))
    held = (_files(df, options) for df in (before, by_id[1]))
    held = [(df if kept is None else df.filter(kept)).select("volume", "path", "frn") for df in held]
    paths = Marks(shared_paths(held[0].unionByName(held[1])))
    by_path = tuple(paths.rows(df, path_hash()) for df in (before, after))
    return by_id, by_path


def counts(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """Changes per category without building them.

    Replaced pairs are all pairs of files under one path minus those of a file with itself.
    The first number follows from counts per path (combined before the shuffle, so a path that
    holds a third of all files is one row per task), the second from the join on file ids. Paths are
    counted by 128 bits of hash: no text is shuffled for them.
    """
    keep = path_filter(options)
    kept_path = keep.keep(F.col("before_path"))
    itself = F.coalesce(
        _files_only(options) & ~_path_changed() & (F.lit(True) if kept_path is None else kept_path),
        F.lit(False),
    )
    reported, category = _reported(options), _id_category()
    by_id = _matched(before, after).agg(
        *[F.count_if(reported & (category == c)).alias(c) for c in CATEGORIES if c != "replaced"],
        (-F.count_if(itself)).alias("replaced"),
    )
    sides = []
    for df, tag in ((before, "_b"), (after, "_a")):
        kept = keep.keep(F.col("path"))
        df = _files(df, options)
        df = df if kept is None else df.filter(kept)
        slot = [F.xxhash64(*(F.col(c) for c in own)).alias(n) for n, own in (("_h1", ("path", "volume")), ("_h2", ("volume", "path")))]
        sides.append(df.select(*slot, F.lit(1).cast("long").alias(tag)))
    by_path = (
        sides[0].unionByName(sides[1], allowMissingColumns=True)
        .groupBy("_h1", "_h2")
        .agg(F.count("_b").alias("_b"), F.count("_a").alias("_a"))
        .agg(F.coalesce(F.sum(F.col("_b") * F.col("_a")), F.lit(0).cast("long")).alias("n"))
        .select(F.lit("replaced").alias("category"), "n")
    )
    parts = _category_rows(by_id).unionByName(by_path)
    return parts.groupBy("category").agg(F.sum("n").alias("n"))


# Order inside a category, used by every limit so that it is repeatable.
CATEGORY_ORDER = {
    "added": ("volume", "after_frn"),
    "removed": ("volume", "before_frn"),
    "modified": ("volume", "before_frn"),
    "replaced": ("volume", "before_path", "before_frn", "after_frn"),
}


def limited(changes: DataFrame, category: str, limit: int) -> DataFrame:
    """First ``limit`` rows of a category, after filtering (a distributed top-k)."""
    return changes.orderBy(*CATEGORY_ORDER[category]).limit(limit)


def summary(changes: DataFrame) -> DataFrame:
    """Number of changes per category, zeros included, from one partial aggregation."""
    return _category_rows(
        changes.agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    )


def _category_rows(totals: DataFrame) -> DataFrame:
    """One row with a column per category, turned into one row per category."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in CATEGORIES]
    )
    return totals.select(F.explode(pairs).alias("p")).select("p.category", "p.n")


def category_rank(category: Column) -> Column:
    """Position of a category in the report, from 0."""
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category).cast("int") - 1


def _side(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[F.col(c).alias(tag + c) for c in SIDE_COLUMNS])


def _files(df: DataFrame, options: DiffOptions) -> DataFrame:
    return df if options.include_dirs else df.filter(~F.col("is_dir"))


def _same_file() -> Column:
    # the id leads: sorting on a label that nearly all rows share compares whole rows
    return (F.col("before_frn") == F.col("after_frn")) & (
        F.col("before_volume") == F.col("after_volume")
    )


def _files_only(options: DiffOptions) -> Column:
    if options.include_dirs:
        return F.lit(True)
    return ~F.col("before_is_dir") & ~F.col("after_is_dir")


def _one_side(tag: str, keep: PathFilter, options: DiffOptions) -> Column:
    kept = keep.keep(F.col(tag + "path"))
    test = F.lit(True) if options.include_dirs else ~F.col(tag + "is_dir")
    return test if kept is None else test & kept


def _either_side(keep: PathFilter) -> Column:
    kept_after = keep.keep(F.col("after_path"))
    if kept_after is None:
        return F.lit(True)
    return kept_after | keep.keep(F.col("before_path"))


def _one_sided(
    df: DataFrame, other: DataFrame, tag: str, category: str, kind: str, options: DiffOptions
) -> DataFrame:
    side = _side(df, tag).filter(_one_side(tag, path_filter(options), options))
    known = other.select(F.col("frn").alias("_frn"), F.col("volume").alias("_volume"))
    unknown = side.join(
        known,
        (F.col(tag + "frn") == F.col("_frn")) & (F.col(tag + "volume") == F.col("_volume")),
        "left_anti",
    )
    return _report(unknown, F.lit(category), F.lit(kind), F.col(tag + "volume"))


def _report(df: DataFrame, category: Column, kind: Column, volume: Column) -> DataFrame:
    present = set(df.columns)
    kinds = {"frn": "long", "size": "long", "mtime": "long"}
    columns = [category.alias("category"), kind.alias("kind"), volume.alias("volume")]
    for tag in (BEFORE, AFTER):
        for c in REPORT_SIDE:
            name = tag + c
            value = F.col(name) if name in present else F.lit(None)
            columns.append(value.cast(kinds.get(c, "string")).alias(name))
    return df.select(*columns)
