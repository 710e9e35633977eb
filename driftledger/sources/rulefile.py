"""The rules file: ``{"exclude_paths": [{"kind": ..., "pattern": ...}, ...]}``."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Rule
from ..operators.rules import default_rules, rule_kind

_SCHEMA = "exclude_paths array<struct<kind: string, pattern: string>>"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file as ``pos, kind, pattern``; the shipped defaults if there is no file."""
    try:
        doc = spark.read.schema(_SCHEMA).option("mode", "FAILFAST").json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return default_rules(spark)
        raise
    return doc.select(F.posexplode("exclude_paths").alias("pos", "rule")).select(
        (F.col("pos") + 1).alias("pos"), "rule.kind", "rule.pattern"
    )


def rules_document(rules: Iterable[Rule]) -> str:
    """The file's text, readable and in rule order."""
    entries = [{"kind": rule_kind(r.kind), "pattern": r.pattern} for r in rules]
    return json.dumps({"exclude_paths": entries}, indent=2, ensure_ascii=False)


def write_rules(spark: SparkSession, rules: Iterable[Rule], path: str) -> None:
    """Write the rules document below ``path`` (one small text part)."""
    entries = [(rule_kind(r.kind), r.pattern) for r in rules]
    row = spark.createDataFrame([(entries,)], _SCHEMA)
    row.coalesce(1).write.mode("overwrite").json(path)
