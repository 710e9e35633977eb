"""The watch entry point, as a batch replay and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..model import WatchOptions
from ..operators import events as ops
from ..operators.rules import PathFilter, check_rules, path_filter
from ..operators.throttle import throttle
from ..streaming.stateful import pair_renames_stream, throttle_stream


def replay(
    records: DataFrame, options: WatchOptions | None = None, mount: Column | None = None
) -> DataFrame:
    """Events of a finished batch of change records: classify, pair, filter, throttle."""
    options = options or WatchOptions()
    prepared = ops.prepare_records(records, options, mount)
    kept = ops.emitted(ops.pair_renames(prepared), _checked_filter(records, options))
    return throttle(kept, options.window_ms, key=(*ops.host_key(kept), "path", "kind"))


def watch(
    records: DataFrame,
    options: WatchOptions | None = None,
    mount: Column | None = None,
    state_ttl: str = "1 day",
    lateness: str | None = None,
) -> DataFrame:
    """The same events from a stream of change records.

    With ``lateness`` (``"10 minutes"``), records that arrive out of order by up to that much are put in
    order first, at the price of so much delay; then the stream equals the replay. Without it events
    come out at once, and a late record is compared with what its micro-batch brings.

    Old names must reach the pairing state although they are never emitted, so pairing comes
    before the filter here. Events other than renames skip that state altogether.
    """
    options = options or WatchOptions()
    prepared = ops.prepare_records(records, options, mount)
    paired = pair_renames_stream(prepared, state_ttl, lateness)
    kept = ops.emitted(paired, _checked_filter(records, options))
    return throttle_stream(kept, options.window_ms, state_ttl)


def _checked_filter(records: DataFrame, options: WatchOptions) -> PathFilter:
    found = path_filter(options)
    check_rules(records.sparkSession, found.rules)
    return found
