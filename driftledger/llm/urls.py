"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything is column expressions and aggregations. Trees are grown level by level: one grouped
aggregation gives the gradient histogram of every node, feature and bin, and only that histogram
reaches the driver. A trained ensemble is a sum of CASE expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ALLOW, BLOCK = "allow", "block"
#: Suffixes share this many hashed statistics.
SUFFIX_CELLS = 1024
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "labels", "suffix_rate", "suffix_share")
TREES, DEPTH, BINS, RATE = 12, 3, 16, 0.3
_RIDGE = 1.0


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for a host with all its subdomains and every path that starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> dict[str, Column]:
    """``host`` (A-Z lower-cased), ``path`` and ``query``; empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return {
        "host": lower_ascii(host),
        "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1),
    }


def matched_rule(rules: list[UrlRule]) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits columns ``host`` and ``path``; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits &= F.col("path").startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def lexical(url: Column, path: Column, query: Column, host: Column) -> dict[str, Column]:
    """The url's own features; those of its suffix come from ``suffix_statistics``."""
    whole = F.coalesce(url, F.lit(""))
    n = F.length(whole)
    chars = F.array_distinct(F.split(whole, ""))

    def plus(total: Column, c: Column) -> Column:
        # the share of one character; the empty string, if split gives one, has none
        k = (n - F.length(F.replace(whole, c, F.lit("")))).cast("double")
        return total - F.when((c == "") | (k <= 0), 0.0).otherwise(k / n * F.log2(k / n))

    filled = F.filter(F.split(path, "/"), lambda s: s != "")
    return {
        "length": n.cast("double"),
        "depth": F.size(filled).cast("double"),
        "digit_ratio": (n - F.length(F.regexp_replace(whole, "[0-9]", ""))) / F.greatest(n, F.lit(1)),
        "entropy": F.aggregate(chars, F.lit(0.0), plus),
        "parameters": F.when(query == "", 0.0).otherwise(
            (F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).cast("double")
        ),
        "labels": (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).cast("double"),
    }


def suffix_cell(host: Column) -> Column:
    """Hashed number of the last label of a host."""
    return F.pmod(F.crc32(F.element_at(F.split(host, r"\."), -1)), F.lit(SUFFIX_CELLS)).cast("int")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Per suffix cell its smoothed rate of blocked urls and its share of urls; at most SUFFIX_CELLS rows."""
    sums = labelled.groupBy("cell").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    whole = labelled.agg(F.sum("y").alias("all_y"), F.count(F.lit(1)).alias("all_n"))
    return sums.join(F.broadcast(whole)).select(
        "cell",
        ((F.col("y") + 10 * F.col("all_y") / F.col("all_n")) / (F.col("n") + 10)).alias("suffix_rate"),
        (F.col("n") / F.col("all_n")).alias("suffix_share"),
    )


@dataclass
class Node:
    """A leaf with a value, or a split: bins up to ``bin`` of ``feature`` go left."""

    value: float = 0.0
    feature: int = -1
    bin: int = 0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Ensemble:
    edges: list[list[float]]
    start: float
    trees: list[Node] = field(default_factory=list)

    def binned(self, name: str, number: int) -> Column:
        steps = [(F.col(name) > e).cast("int") for e in self.edges[number]]
        return sum(steps[1:], steps[0]) if steps else F.lit(0)

    def margin(self, columns: list[Column]) -> Column:
        """Log odds of a block, from columns that hold the features' bins."""
        return sum((_value(t, columns) for t in self.trees), F.lit(self.start))


def _value(node: Node, columns: list[Column]) -> Column:
    if node.left is None:
        return F.lit(node.value)
    return F.when(columns[node.feature] <= node.bin, _value(node.left, columns)).otherwise(
        _value(node.right, columns)
    )


def _place(node: Node, columns: list[Column], leaves: list[Node]) -> Column:
    """Number of the leaf a row is in; ``leaves`` collects them in that order."""
    if node.left is None:
        leaves.append(node)
        return F.lit(len(leaves) - 1)
    left = _place(node.left, columns, leaves)
    return F.when(columns[node.feature] <= node.bin, left).otherwise(_place(node.right, columns, leaves))


def _split(node: Node, cells: dict[tuple[int, int], tuple[float, float]], depth: int) -> None:
    """Give a leaf its best split by second-order gain; both sides get their values."""
    g = sum(x for (f, _), (x, _) in cells.items() if f == 0)
    h = sum(x for (f, _), (_, x) in cells.items() if f == 0)
    node.value = RATE * g / (h + _RIDGE)
    best = (1e-6, None)
    for f in range(len(FEATURES)):
        left_g = left_h = 0.0
        for b in sorted(b for k, b in cells if k == f):
            left_g, left_h = left_g + cells[f, b][0], left_h + cells[f, b][1]
            right_g, right_h = g - left_g, h - left_h
            if left_h < _RIDGE or right_h < _RIDGE:
                continue
            gain = left_g**2 / (left_h + _RIDGE) + right_g**2 / (right_h + _RIDGE) - g * g / (h + _RIDGE)
            if gain > best[0] * (1 + 1e-9):
                best = (gain, (f, b, left_g / (left_h + _RIDGE), right_g / (right_h + _RIDGE)))
    if best[1]:
        node.feature, node.bin, left, right = best[1]
        node.left, node.right = Node(RATE * left), Node(RATE * right)


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Ensemble | None:
    """Boosted trees on all labelled rows: the features, and ``y`` (1: block). None without rows.

    Rows are grouped by their bins first, so later passes read one row per distinct combination.
    """
    cuts = [i / bins for i in range(1, bins)]
    found = labelled.agg(
        F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"),
        *(F.percentile_approx(f, cuts, 1000).alias(f) for f in FEATURES),
    ).first()
    if not found.n:
        return None
    rate = min(max(found.y / found.n, 1e-3), 1 - 1e-3)
    model = Ensemble([sorted(set(found[f])) for f in FEATURES], math.log(rate / (1 - rate)))
    own = [f"b{i}" for i in range(len(FEATURES))]
    grouped = labelled.groupBy(*(model.binned(f, i).alias(own[i]) for i, f in enumerate(FEATURES)))
    cells = stored(grouped.agg(F.sum("y").cast("double").alias("y"), F.count(F.lit(1)).cast("double").alias("n")), "url-cells")
    columns = [F.col(c) for c in own]
    wide = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), c.alias("b")) for i, c in enumerate(columns))))
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin(columns)))
        tree = Node()
        for _ in range(depth):
            leaves: list[Node] = []
            place = _place(tree, columns, leaves)
            hist = (
                cells.select(place.alias("leaf"), (F.col("y") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), wide.alias("at"))
                .groupBy("leaf", "at.f", "at.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            )
            for k, leaf in enumerate(leaves):
                _split(leaf, {(r.f, r.b): (r.g, r.h) for r in hist if r.leaf == k}, depth)
        model.trees.append(tree)
    return model


def judge(pages: DataFrame, rules: list[UrlRule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (0 to 1).

    The longest rule that fits decides; urls without one are judged by trees trained on the urls that
    have one, all of them. Null urls and urls without ``://`` have empty host and path and are judged
    by the trees like any other. Without any labelled url everything is allowed, with a score of 0.
    Rows are judged one by one, repeated ones alike; columns with the names made here are replaced.
    """
    made = ("host", "path", "rule", "verdict", "block_score")
    kept = [c for c in pages.columns if c not in made]
    parts = url_parts(F.col(url))
    based = pages.select(*kept, parts["host"].alias("host"), parts["path"].alias("path"), parts["query"].alias("_query"))
    text, verdict = matched_rule(rules)
    based = based.select("*", text.alias("rule"), verdict.alias("_verdict"), suffix_cell(F.col("host")).alias("_cell"))
    own = lexical(F.col(url), F.col("path"), F.col("_query"), F.col("host"))
    labelled = stored(
        based.where("_verdict is not null").select(
            (F.col("_verdict") == BLOCK).cast("int").alias("y"), F.col("_cell").alias("cell"),
            *(c.alias(f) for f, c in own.items()),
        ),
        "url-labels",
    )
    suffixes = stored(suffix_statistics(labelled), "url-suffixes")
    known = F.broadcast(suffixes)  # at most SUFFIX_CELLS rows
    model = train(labelled.join(known, "cell", "left"))
    if model is None:
        return based.select(*kept, "host", "path", "rule", F.lit(ALLOW).alias("verdict"), F.lit(0.0).alias("block_score"))
    full = based.join(known.withColumnRenamed("cell", "_cell"), "_cell", "left")
    full = full.withColumns({f"_f_{f}": c for f, c in own.items()}).withColumns(
        # an unseen suffix has the rate of all labelled urls
        {f"_f_{f}": F.coalesce(F.col(f), F.lit(d)) for f, d in (("suffix_rate", 1 / (1 + math.exp(-model.start))), ("suffix_share", 0.0))}
    )
    full = full.withColumns({f"_b{i}": model.binned(f"_f_{f}", i) for i, f in enumerate(FEATURES)})
    score = 1 / (1 + F.exp(-model.margin([F.col(f"_b{i}") for i in range(len(FEATURES))])))
    scored = full.withColumn("block_score", score)
    by_trees = F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(*kept, "host", "path", "rule", F.coalesce("_verdict", by_trees).alias("verdict"), "block_score")
