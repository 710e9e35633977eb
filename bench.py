"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the number of local cores. Every query is run to the
end with its full result consumed. One unmeasured pass over a few queries warms the JVM.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from driftledger.model import DiffOptions
from driftledger.operators import diff as ops
from driftledger.plans.compare import diff, diff_summary
from driftledger.session import build_session
from driftledger.sources.workdir import fresh_path
from testbed import derive
from testbed.catalog import QUERIES

HEADLINE = (
    "diff_inventory", "diff_inventory_summary", "diff_all", "diff_summary", "diff_modified",
    "diff_added", "diff_removed", "diff_replaced", "diff_excluded", "ingest_upsert",
    "ingest_inventory", "hash_enrich", "same_hash_across", "same_hash_files", "rule_any",
    "event_rename", "event_throttle", "event_throttle_hot", "event_enrich", "event_stream",
    "triage_manifest",
)
STORED_FILES = 1_000_000
WARM_UP = ("diff_inventory", "event_throttle", "ingest_inventory")


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stored_diff(spark, sf_dir: str) -> dict[str, float]:
    """Phases of a diff over two stored inventories of about a million files each.

    The derived inventory is repeated under new ids and paths until it has that size; writing
    it is not timed.
    """
    root = fresh_path(spark, "bench")
    before, after = derive.lineitem_pair(spark, sf_dir)
    copies = max(1, round(STORED_FILES / before.count()))
    sides = []
    for tag, df in (("before", before), ("after", after)):
        repeated = (
            df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
            .withColumn("frn", F.col("frn") + F.col("copy") * F.lit(1 << 40))
            .withColumn("path", F.concat("path", F.lit("~"), F.col("copy").cast("string")))
            .drop("copy")
        )
        # several files per snapshot, as any real inventory has
        repeated.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{root}/{tag}")
        sides.append(spark.read.schema(repeated.schema).parquet(f"{root}/{tag}"))
    plain = DiffOptions()
    phases = {
        "stored_diff_total": diff(*sides),
        "stored_diff_modified": ops.modified(*sides, plain),
        "stored_diff_added": ops.added(*sides, plain),
        "stored_diff_removed": ops.removed(*sides, plain),
        "stored_diff_replaced": ops.replaced(*sides, plain),
        "stored_diff_summary": diff_summary(*sides),
    }
    consume(phases["stored_diff_total"])
    seconds = {name: timed(lambda df=df: consume(df)) for name, df in phases.items()}
    rows = sum(side.count() for side in sides)
    seconds["stored_diff_input_rows"] = rows
    return seconds


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    for name in WARM_UP:
        consume(QUERIES[name](spark, sf_dir))
    seconds = {name: timed(lambda n=name: consume(QUERIES[n](spark, sf_dir))) for name in names}
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    if not chosen:
        stored = stored_diff(spark, sf_dir)
        rows = stored.pop("stored_diff_input_rows")
        seconds.update(stored)
        result["stored_diff_input_rows"] = rows
        result["stored_diff_rows_per_sec"] = round(rows / stored["stored_diff_total"])
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
