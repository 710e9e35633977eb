"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts are the items. Small groups are bundled by hash, so the number of items stays
below a fixed bound however many documents there are; groups above a bundle's share are items of
their own and are cut into pieces when they are larger still. Items are placed in order of size, each
into the shard where the dot product of its demand with the residual capacity is highest. Pieces of a
group go together as long as the shards' bytes stay near equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Items per shard, about: hash bundles, and as many large groups or pieces at most.
BUNDLES = 256
_DIMS = ("size", "tokens", "rows")
#: Bytes are the law, so their balance weighs most.
_WEIGHTS = (512.0, 1.0, 1.0)
#: Groups up to this share of a shard's capacity are placed whole, larger ones piece by piece.
WHOLE = 1 / 4


def place(demand: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``demand`` has a row per item and a column per resource.

    Resources are measured in shares of a shard's capacity. What exceeds a capacity counts as
    negative residual, so an overfull shard is chosen last.
    """
    capacity = np.maximum(demand.sum(axis=0) / shards, 1e-9)
    share = demand / capacity
    residual = np.ones((shards, demand.shape[1]))
    weights = np.array(_WEIGHTS)
    chosen = np.zeros(len(demand), np.int64)
    for i in np.lexsort((np.arange(len(demand)), -(share @ weights))):
        best = int(np.argmax(residual @ (weights * share[i])))
        chosen[i] = best
        residual[best] -= share[i]
    return chosen


def place_groups(demand: np.ndarray, groups: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; items of one group number share one, unless the group is above ``WHOLE``."""
    if not len(demand):
        return np.zeros(0, np.int64)
    number, own = np.unique(groups, return_inverse=True)
    whole = np.zeros((len(number), demand.shape[1]))
    np.add.at(whole, own, demand)
    capacity = np.maximum(demand.sum(axis=0) / shards, 1e-9)
    largest = (whole / capacity).max(axis=1)[own]
    # units: whole groups, and single items of the groups above the share
    unit = np.unique(np.where(largest <= WHOLE, own, len(number) + np.arange(len(demand))), return_inverse=True)[1]
    units = np.zeros((unit.max() + 1, demand.shape[1]))
    np.add.at(units, unit, demand)
    return place(units, shards)[unit]


def shard(docs: DataFrame, shards: int, doc_id: str = "doc_id", bundles: int = BUNDLES) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    ``docs`` has ``size`` (bytes), ``tokens`` and two group keys ``g1``, ``g2`` that are equal for equal
    texts. A group larger than a bundle's share of all bytes or rows (``1 / (shards * bundles)``) is cut
    into pieces of about that share by a hash of the id, so that no task holds a large group; rows of an
    id (null is one) that alone are above the share are told apart by a stored row number. The pieces share
    a shard, unless the group is above ``WHOLE`` of a shard. Slots follow the items' order, inside an item
    the group keys, ids and row numbers. An empty table stays empty. Existing columns ``shard`` and
    ``slot`` are replaced; any other column goes through as it is.

    The driver holds at most about three items per bundle: large groups, and ids above a share, cannot be
    more than twice as many as there are shares.
    """
    spark = docs.sparkSession
    count = shards * bundles
    # callers' columns travel in one struct, so their names cannot meet the ones made here
    docs = stored(
        docs.drop("shard", "slot").select(
            F.struct("*").alias("doc"), "g1", "g2", F.col(doc_id).alias("id"), "size", "tokens",
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    sums = [F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")]
    groups = stored(docs.groupBy("g1", "g2").agg(*sums), "shard-groups")
    total = groups.agg(F.sum("size"), F.sum("rows")).first()
    byte_share, row_share = (max(1.0, (x or 0) / count) for x in total)
    above = (F.col("size") > byte_share) | (F.col("rows") > row_share)
    # fewer than 2 * count groups can be above one of the two shares: bounded on the driver and as a broadcast
    large = groups.where(above).select(
        "g1",
        "g2",
        F.least(
            F.col("rows"), F.ceil(F.greatest(F.col("size") / byte_share, F.col("rows") / row_share))
        ).cast("long").alias("pieces"),
    )
    keyed = docs.join(F.broadcast(large), ["g1", "g2"], "left")
    # the same bound holds for ids
    repeated = (
        keyed.where("pieces is not null").groupBy("g1", "g2", "id").agg(*sums).where(above & (F.col("rows") > 1))
        .select("g1", "g2", "id", F.lit(True).alias("repeated"))
    ).alias("r")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("g1", "g2", "id")]
    keyed = keyed.alias("k").join(F.broadcast(repeated), same, "left").select("k.*", "r.repeated")
    piece = F.pmod(F.xxhash64(F.lit("piece"), "id", F.when(F.col("repeated"), F.col("row"))), F.col("pieces"))
    none = F.lit(0).cast("long")
    keyed = keyed.withColumn(
        "item",
        F.when(F.col("pieces").isNull(), F.struct(none.alias("a"), none.alias("b"), F.pmod("g1", F.lit(count)).alias("c")))
        .otherwise(F.struct(F.col("g1").alias("a"), F.col("g2").alias("b"), (piece + count).alias("c"))),
    ).drop("pieces", "repeated")
    sums = keyed.groupBy("item").agg(*sums, F.sum("tokens").alias("tokens")).toPandas()
    items = sums["item"].map(lambda x: (x["a"], x["b"], x["c"]))
    sums = sums.assign(key=items).sort_values("key", ignore_index=True)
    demand = sums[list(_DIMS)].fillna(0).to_numpy(dtype=np.float64).reshape(-1, len(_DIMS))
    # bundles stand alone; the pieces of a large group have its keys
    group = {k: n for n, k in enumerate(dict.fromkeys(x[:2] if x[2] >= count else x for x in sums["key"]))}
    groups_of = np.array([group[x[:2] if x[2] >= count else x] for x in sums["key"]], np.int64)
    sums["shard"] = place_groups(demand, groups_of, shards)
    sums["start"] = sums.groupby("shard")["rows"].cumsum() - sums["rows"]
    # an Arrow table becomes a local relation; a list of rows would be unpickled by Python workers of its own
    columns = [*(list(zip(*sums["key"])) or [[]] * 3), sums["shard"], sums["start"]]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64()]
    placed = spark.createDataFrame(
        pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "b", "c", "shard", "start"])
    ).select(F.struct("a", "b", "c").alias("item"), "shard", "start")
    inside = Window.partitionBy("item").orderBy("g1", "g2", "id", "row")
    return (
        keyed.withColumn("n", F.row_number().over(inside))
        .join(F.broadcast(placed), "item")
        .select("doc.*", "shard", (F.col("start") + F.col("n") - 1).alias("slot"))
    )
