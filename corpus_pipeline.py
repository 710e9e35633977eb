"""A corpus pipeline of five stages; each works on all that its predecessor kept.

toxicity, SimHash near-duplicates, benchmark decontamination, mixing sources, sharding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftledger.llm import curriculum, decontam, simhash, toxicity
from driftledger.llm.common import stored, table
from driftledger.llm.queries import shard_documents, word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that nearest labelled examples call toxic go. All labels are learnt from."""
    index = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, index, keep=docs.columns)
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id stays, once.

    Documents without an id cannot be told apart by it and all stay.
    """
    found = simhash.near_duplicates(docs.where("doc_id is not null"))
    stay = found.select(F.col("component_id").alias("doc_id")).distinct()
    named = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth of the words or more go."""
    judged = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.where("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of training.

    A pass that is cut short by the source's target still takes its last document whole.
    """
    sized = docs.withColumn("_words", word_count())
    stream = curriculum.training_stream(curriculum.mix(sized, size="_words"))
    return stream.select(*docs.columns)


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every row in 40 shards that are balanced by bytes, tokens and rows."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("sharding", shard_corpus),
]

#: Fingerprints, examples and bin packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
