"""Triage: which sides of which changes are collected, and under what name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, values
from .diff import category_rank
from .enrich import one_per_path, pe_like
from .events import host_key
from .ranking import rank_in_groups

#: Report order: a change after the other, its sides next to each other.
ORDER = ("category_rank", "volume", "change_path", "change_frn", "change_other_frn", "side_rank")

MANIFEST_COLUMNS = (
    "category_rank", "change_path", "change_frn", "change_other_frn", "side_rank", "kind", "side", "original_path", "volume", "frn", "size",
    "mtime", "sha256_hex", "target_name",
)

# Two components of a target name before the file name: short hash and side.
_GROUP = ["_hash", "side"]
_NUMBERED = r"^([1-9][0-9]*)_((?s).+)$"
_ROOT = r"^(?:[1-9][0-9]*_)+"


def changed_sides(changes: DataFrame) -> DataFrame:
    """One row per present side of every change, with its place in the report."""
    by_path = F.col("category") == "replaced"
    base = changes.withColumns(
        {
            "category_rank": category_rank(F.col("category")),
            "change_path": F.when(by_path, F.col("before_path")).otherwise(F.lit("")),
            "change_frn": F.coalesce("before_frn", "after_frn"),
            "change_other_frn": F.coalesce("after_frn", F.lit(0)),
        }
    )

    def side(rank: int, tag: str) -> Column:
        return F.struct(
            F.lit(rank).alias("side_rank"),
            F.lit(tag).alias("side"),
            F.col(f"{tag}_frn").alias("frn"),
            F.col(f"{tag}_path").alias("original_path"),
            F.col(f"{tag}_size").alias("size"),
            F.col(f"{tag}_mtime").alias("mtime"),
            F.col(f"{tag}_sha256").alias("sha256_hex"),
        )

    return (
        base.withColumn("_side", F.explode(F.array(side(0, "before"), side(1, "after"))))
        .filter(F.col("_side.frn").isNotNull())
        .select(
            "category_rank", "volume", "kind", "change_path", "change_frn", "change_other_frn",
            "_side.*",
        )
    )


def triage_sides(changes: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """The executable-like sides. ``digests`` supplies the magic test for other extensions."""
    sides = changed_sides(changes)
    if digests is None:
        return sides.filter(paths.has_pe_path_extension(F.col("original_path")))
    magic = one_per_path(
        digests.select(F.col("volume").alias("_volume"), F.col("path").alias("_path"), "is_mz"), ("_path", "_volume")
    )
    joined = sides.join(
        magic,
        (F.col("original_path") == F.col("_path")) & (F.col("volume") == F.col("_volume")),
        "left",
    )
    return joined.filter(pe_like(F.col("original_path"), F.col("is_mz"))).drop(
        "_volume", "_path", "is_mz"
    )


def manifest(changes: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """One row per collected side with a target name no other row has.

    In report order, a side gets ``{hash16}_{side}_{file}`` if that is free, else
    ``{hash16}_{side}_{n}_{file}`` with the smallest free n. Names only clash within one
    (hash, side), either between equal file names (a row number decides) or because one file
    is really called like a numbered form of another (``1_f.dll``); see :func:`_clashes`.
    """
    sides = triage_sides(changes, digests).withColumns(
        {
            "_hash": values.short_hash(F.col("sha256_hex")),
            "_file": paths.basename(F.col("original_path")),
            "_asks": F.lit(None).cast("string"),
        }
    )
    ranked = rank_in_groups(
        sides.unionByName(_numbered_markers(sides)),
        [*_GROUP, "_file"],
        [*ORDER],
        "_rank",
        counted=F.col("_asks").isNull(),
    )
    clashes = _clashes(_reachable_markers(ranked))
    rows = ranked.filter(F.col("_asks").isNull()).join(clashes, [*_GROUP, "_file"], "left")
    suffix = F.col("_rank") - 1 + F.coalesce("_demoted", F.lit(0))
    taken = F.coalesce("_taken", F.array().cast("array<long>"))
    passed = F.filter(
        F.transform(taken, lambda n, i: n - i), lambda slot: slot <= F.col("_suffix")
    )
    number = F.col("_suffix") + F.size(passed)
    prefix = F.concat_ws("_", "_hash", "side")
    return (
        rows.withColumn("_suffix", suffix)
        .withColumn(
            "target_name",
            F.when(F.col("_suffix") == 0, F.concat_ws("_", prefix, "_file")).otherwise(
                F.concat_ws("_", prefix, number.cast("string"), "_file")
            ),
        )
        .select(*MANIFEST_COLUMNS)
    )


def in_report_order(rows: DataFrame) -> DataFrame:
    """The before side of a change right ahead of its after side, whatever their paths are."""
    return rows.orderBy(*ORDER)


def _numbered_markers(sides: DataFrame) -> DataFrame:
    """For the first row called ``n_x``: a marker among the rows called ``x``, same place.

    Ranking the markers together with the rows tells how many rows called ``x`` come first.
    """
    numbered = sides.filter(F.col("_file").rlike(_NUMBERED))
    first = numbered.groupBy(*_GROUP, "_file").agg(F.min(F.struct(*ORDER)).alias("_at"))
    marker = {
        "_asks": F.col("_file"),
        "_file": F.regexp_extract("_file", _NUMBERED, 2),
        **{c: F.col("_at")[c] for c in ORDER},
    }
    return first.select(
        *[
            (marker[c] if c in marker else F.col(c) if c in _GROUP else F.lit(None))
            .cast(sides.schema[c].dataType)
            .alias(c)
            for c in sides.columns
        ]
    )


def _reachable_markers(ranked: DataFrame) -> DataFrame:
    """Markers that can matter: ``x`` exists and has rows enough to ever reach their number."""
    named = [*_GROUP, "_file"]
    sizes = (
        ranked.groupBy(*named)
        .agg(
            F.count_if(F.col("_asks").isNull()).alias("_rows"),
            F.count("_asks").alias("_markers"),
        )
        .filter((F.col("_rows") > 0) & (F.col("_markers") > 0))
    )
    number = F.regexp_extract("_asks", _NUMBERED, 1).try_cast("long")
    return (
        ranked.filter(F.col("_asks").isNotNull())
        .withColumn("_n", number)
        .join(sizes, named)
        .filter(F.col("_n") <= F.col("_rows") + F.col("_markers"))
    )


def _clashes(markers: DataFrame) -> DataFrame:
    """Per clashing name: whether its first row lost the plain name, and which numbers are gone.

    Works on one row per distinct numbered name, never on the files themselves; names that
    share a hash, a side and an unnumbered root are settled together.
    """
    families = markers.select(
        *_GROUP,
        "_file",
        F.col("_asks").alias("_numbered"),
        "_n",
        F.col("_rank").alias("_ahead"),
        F.regexp_replace("_asks", _ROOT, "").alias("_root"),
    )
    return families.groupBy(*_GROUP, "_root").applyInPandas(
        _settle, "_hash string, side string, _file string, _demoted int, _taken array<long>"
    )


def _settle(family: pd.DataFrame) -> pd.DataFrame:
    """Settle one family of names from the shortest on.

    Row number k of ``x`` (k > 1, or k > 0 if ``x`` lost its plain name) takes the smallest
    free n. It takes the name of ``n_x`` if it gets there before the first row called ``n_x``.
    """
    demoted: dict[str, int] = {}
    taken: dict[str, list[int]] = {}
    for name, group in sorted(family.groupby("_file"), key=lambda item: (len(item[0]), item[0])):
        gone: list[int] = []
        for n, numbered, ahead in sorted(zip(group["_n"], group["_numbered"], group["_ahead"])):
            suffix = int(n) - len(gone)
            if ahead >= suffix + 1 - demoted.get(name, 0):
                demoted[numbered] = 1
            else:
                gone.append(int(n))
        taken[name] = gone
    names = sorted(set(demoted) | {name for name, gone in taken.items() if gone})
    head = family.iloc[0]
    return pd.DataFrame(
        {
            "_hash": [head["_hash"]] * len(names),
            "side": [head["side"]] * len(names),
            "_file": names,
            "_demoted": [demoted.get(name, 0) for name in names],
            "_taken": [taken.get(name, []) for name in names],
        }
    )


def pick_sources(selected: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``target_name`` and the one file its bytes come from: ``volume``, ``path``, and ``host`` where there is one.

    ``selected`` has ``target_name, volume`` and ``original_path`` (or ``path``). Names in ``taken`` are left out.
    """
    path = "original_path" if "original_path" in selected.columns else "path"
    place = [F.col("volume"), F.col(path).alias("path"), *(F.col(c) for c in host_key(selected))]
    once = selected.groupBy("target_name").agg(F.min(F.struct(*place)).alias("_source")).select("target_name", "_source.*")
    return once if taken is None else once.join(taken.select("target_name"), "target_name", "left_anti")


def collect_content(selected: DataFrame, content: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``target_name, content`` of the selected rows, once per name.

    The name is made unique on keys alone, and only the files picked by then are read further: bytes take
    part in one join and no aggregation. A file that ``content`` lists twice counts once. Where the bytes lie
    in a folder, :func:`driftledger.sources.filehash.copy_files` copies them without any row of bytes.
    """
    once = pick_sources(selected, taken)
    key = ["path", "volume", *(c for c in host_key(once) if c in content.columns)]
    found = once.join(content.filter(F.col("content").isNotNull()).select(*key, "content"), key)
    return found.select("target_name", "content").dropDuplicates(["target_name"])


def event_manifest(enriched: DataFrame) -> DataFrame:
    """Manifest rows of a watch: events that got a hash, named by hash and file name."""
    hashed = enriched.filter(F.col("sha256_hex").isNotNull())
    return hashed.select(
        F.unix_seconds("ts").alias("timestamp"),
        "kind",
        "volume",
        *host_key(enriched),
        F.col("path").alias("original_path"),
        "renamed_from",
        "size",
        "sha256_hex",
        F.concat_ws(
            "_", values.short_hash(F.col("sha256_hex")), paths.basename(F.col("path"))
        ).alias("dumped_to"),
    )
