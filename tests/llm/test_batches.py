"""What an executor and its Python workers hold at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from driftledger.llm import common, packing, queries

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def batches(spark):
    """Bytes of the batch that each of 16,000 texts of 2,000 bytes came in, and the texts' sizes."""
    texts = spark.range(0, 16_000, 1, 1).select("id", F.repeat(F.lit("ab cd "), 333).alias("text"))

    def compute(column):
        return [pa.array([column.nbytes] * len(column), pa.int64()), pa.array([len(x.as_py()) for x in column], pa.int64())]

    return common.add_columns(
        texts, ["text"], [StructField("held", LongType()), StructField("size", LongType())], compute, ["id"]
    ).collect()


@pytest.mark.parametrize("named", [None, 8 << 20])
def test_batches_are_cut_by_bytes(spark, named):
    before = spark.conf.getAll.get(KEY)
    try:
        spark.conf.unset(KEY)
        if named:
            spark.conf.set(KEY, str(named))
        out = batches(spark)
    finally:
        spark.conf.set(KEY, before) if before else spark.conf.unset(KEY)
    bound = named or common.BATCH_BYTES
    assert bound / 2 < max(r.held for r in out) < 1.1 * bound
    # no row is lost between batches
    assert sorted(r.id for r in out) == list(range(16_000)) and {r.size for r in out} == {1998}


def test_powers_fit_a_chunk(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", {})
    up, down = common.powers(5)
    assert (up * down == 1).all()
    assert len(common._POWERS["up"]) == common.CHUNK + 1
    assert len(common.powers(3 * common.CHUNK)[1]) == 3 * common.CHUNK
    assert (common.powers(5)[0] == up).all()


def test_places_of_items_need_no_python_worker(spark):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(100)], "doc_id long, text string")
    path = common.stored(docs, "batch-docs")
    plan = packing.shard(queries.shard_input(path), 4)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
