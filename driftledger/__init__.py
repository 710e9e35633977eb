"""File-inventory snapshots, diffs and change streams on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .model import DiffOptions, Rule, ScanOptions, WatchOptions
from .plans.compare import diff, diff_snapshots
from .plans.monitor import replay, watch
from .plans.scan import ingest_snapshot
from .sources.store import SnapshotStore

__all__ = [
    "DiffOptions", "Rule", "ScanOptions", "SnapshotStore", "WatchOptions",
    "diff", "diff_snapshots", "ingest_snapshot", "replay", "watch",
]

# Tasks receive this package's functions by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
