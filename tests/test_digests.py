"""Digest texts against other implementations."""

import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from driftledger.functions import values

BODIES = [b"", b"a", b"MZ\x00\xff" * 9, b"z" * 100_000]


@pytest.mark.parametrize(
    ("algorithm", "known"),
    [
        ("sha512", lambda b: hashlib.sha512(b).hexdigest()),
        ("xxhash64", lambda b: xxhash.xxh64(b, seed=42).hexdigest()),
    ],
)
def test_second_digest(spark, algorithm, known):
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(BODIES)] + [(99, None)], "i int, c binary")
    out = dict(df.select("i", values.second_digest(F.col("c"), algorithm)).collect())
    assert [out[i] for i in range(len(BODIES))] == [known(b) for b in BODIES]
    with pytest.raises(ValueError):
        values.second_digest(F.col("c"), "md5")
