"""Mixing sources to target weights by a time-varying curriculum.

Every source has a token budget (its target) and a schedule of how its rate changes while training
goes on. The schedule is integrated to cumulative token demand, the demand is inverted at each
document's place in its source's sequence, and that gives the document's positions in training,
by which the stream is range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows per prefix-sum bucket that a task handles together.
BUCKET_ROWS = 50_000


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", repeat: int = 3) -> DataFrame:
    """One row per source: ``source_size``, ``weight``, ``target``.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at ``repeat`` times
    the source's size and the excess goes to the others by weight. Filling that up ends at one level
    of tokens per weight: sources in order of capacity per weight are full as long as the level that
    is left for the rest would overfill them. The number of sources is configuration-sized.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    cap = F.col("source_size") * repeat
    fill = Window.orderBy(cap / F.col("weight"), "weight", F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double")
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"),
    )
    level = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct(cap / F.col("weight"), "level"))).over(whole)
    target = F.least(cap.cast("double"), F.col("weight") * level["level"])
    return per.select("source", "source_size", "weight", target.alias("target"))


def arrival(progress: Column, slope: Column) -> Column:
    """Time in [0, 1] at which the demand has reached ``progress`` of the source's budget.

    The rate is ``1 + slope * (2 t - 1)``, its integral ``t + slope * (t * t - t)``.
    """
    b = F.lit(1.0) - slope
    root = F.sqrt(F.greatest(b * b + 4 * slope * progress, F.lit(0.0)))
    # the stable form of the quadratic's root; it also holds at slope zero
    return F.when(progress <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2 * progress / (b + root)))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", repeat: int = 3
) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``taken`` and ``positions``.

    ``size`` names a column of words per row (null: 0). In a source documents follow each other by a
    hash of their id; the source's stream goes through that sequence again and again until its target
    (rounded down) is reached, so ``taken`` sums up to the target and no document gives more than
    ``repeat`` times its size. ``positions`` holds the training time of each pass that takes words of
    it (empty: not taken). Rows of one id are ordered by size; equal rows share alike. Sources of no
    words have target 0, and an empty table stays empty. Columns with the names made here are replaced.

    A source may hold any share of the rows: sums run inside hash buckets, whose number follows the
    rows, and only the buckets' totals are summed up per source.
    """
    rows = docs.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    names = [c for c in docs.columns if c not in ("source_size", "target", "taken", "positions")]
    keyed = docs.select(
        *names,
        F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("_size"),
        F.col(source).alias("_source"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("_key"),
    ).withColumn("_bucket", F.expr(f"cast(floor(conv(substr(_key, 1, 8), 16, 10) * {buckets}D / 4294967296D) as long)"))
    totals = stored(keyed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")), "mix-buckets")
    targets = source_targets(totals, "_source", "_sum", repeat)
    slope = (F.conv(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % 9 - 4) / 5.0
    plan = (
        totals.withColumn(
            "_before",
            F.coalesce(
                F.sum("_sum").over(
                    Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .join(targets.withColumn("_slope", slope), F.col("_source").eqNullSafe(F.col("source")))
        .select(
            F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_before", "_slope", "source_size", "target"
        )
    )
    running = Window.partitionBy("_source", "_bucket").orderBy("_key", "_size", *([doc_id] if doc_id in names else []))
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        keyed.withColumn("_end", F.sum("_size").over(running))
        .join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_at", F.col("_before") + F.col("_end") - F.col("_size"))
    )
    goal = F.floor("target")

    def part(k: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_size"), goal - k * F.col("source_size") - F.col("_at")))

    def when(k: int) -> Column:
        at = (k * F.col("source_size") + F.col("_at")).cast("double") / F.greatest(goal, F.lit(1))
        return F.when(part(k) > 0, arrival(at, F.col("_slope")))

    taken = sum((part(k) for k in range(1, repeat)), part(0)).cast("long")
    return placed.select(
        *names, "source_size", "target", taken.alias("taken"),
        F.array_compact(F.array(*(when(k) for k in range(repeat)))).alias("positions"),
    )


def training_stream(mixed: DataFrame) -> DataFrame:
    """One row per pass that takes the document, range-sorted by ``position``."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position")
