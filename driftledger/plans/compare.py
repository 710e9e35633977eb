"""The diff entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DiffOptions
from ..operators import diff as ops
from ..operators.rules import check_rules, compile_rules
from ..sources.store import SnapshotStore


def diff(
    before: DataFrame, after: DataFrame, options: DiffOptions | None = None, sift: bool = False
) -> DataFrame:
    """All changes between two inventories as one flat report.

    Without a limit the three id-based categories come from one full outer join. With a limit
    every category is its own query ending in a top-k, so that no category is built in full
    just to be cut.

    With ``sift`` hashes tell first which rows can be part of a change, and only those are joined: for
    inventories that are stored, not bucketed by id, and large against the disks. Their files are
    read three times then, and a fraction of them is shuffled; the report is the same.
    """
    options = options or DiffOptions()
    check_rules(before.sparkSession, compile_rules(options.rules, options.variables))
    by_id = by_path = (before, after)
    if sift:
        by_id, by_path = ops.sifted(before, after, options)
    if not options.limit:
        return ops.frn_changes(*by_id, options).unionByName(ops.replaced(*by_path, options))
    parts = [
        ops.limited(build(*sides, options), category, options.limit)
        for category, build, sides in (
            ("added", ops.added, by_id),
            ("removed", ops.removed, by_id),
            ("modified", ops.modified, by_id),
            ("replaced", ops.replaced, by_path),
        )
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def diff_snapshots(
    store: SnapshotStore, before: str, after: str, options: DiffOptions | None = None, sift: bool = False
) -> DataFrame:
    """Diff two stored snapshots by name; both names must exist."""
    return diff(store.files(before), store.files(after), options, sift)


def diff_summary(
    before: DataFrame, after: DataFrame, options: DiffOptions | None = None
) -> DataFrame:
    """Changes per category, without building the replaced pairs.

    A path held by n files before and m files after makes up to n * m pairs; their number
    follows from counts per path, so not even a path that holds a third of all files is ever
    expanded.
    """
    options = options or DiffOptions()
    check_rules(before.sparkSession, compile_rules(options.rules, options.variables))
    counts = ops.counts(before, after, options)
    if options.limit:
        return counts.select("category", F.least("n", F.lit(options.limit).cast("long")).alias("n"))
    return counts
