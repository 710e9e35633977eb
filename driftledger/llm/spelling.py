"""Groups of spelling variants from a bit-sliced position index.

For every position and letter there is a bitset over a piece of the vocabulary: which words have that
letter there. A word is looked up letter by letter; four bitsets follow it, all words at once: those
without an error so far, and those with one letter replaced, missing or added, for which the same bitsets
are read at the position before or after.

Two words that differ by one letter share their first three letters or their last three, so the vocabulary
is dealt twice, by either end, and only words of one shard are compared. A large shard is cut into pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Code points and occurrences a word needs; a form occurs so many times as often as its variant.
LETTERS, OCCURS, RATIO = 6, 5, 5
#: Words per shard, about; words and letters per piece at most; distinct words a task counts together.
SHARD, PIECE, PIECE_LETTERS, HELD = 4096, 8192, 1 << 21, 200_000
_END = 3


def word_counts(docs: DataFrame, doc_id: str, text: str, least: int, slip: int | None) -> DataFrame:
    """``word``, ``n``: partial counts of the runs of letters of whole texts, only A-Z lower-cased.

    With ``slip``, a run loses the code point ``h % length`` if ``slip`` divides ``h``, the crc32 of
    ``<doc_id>:<run>`` (a null id: nothing before the colon).
    """
    named = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def batch_of(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, body in zip(batch.column("id").to_pylist(), batch.column("text")):
                # lower() of bytes touches A-Z alone
                runs = Counter(_RUN.findall(body.as_py().encode().lower().decode())) if body.is_valid else {}
                start = zlib.crc32(f"{name}:".encode())
                for word, n in runs.items():
                    if slip and (h := zlib.crc32(word.encode(), start)) % slip == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1 :]
                    if len(word) >= least:
                        total[word] += n
                if len(total) > HELD:
                    yield batch_of(total)
                    total = Counter()
        yield batch_of(total)

    return named.mapInArrow(run, "word string, n long")


class BitSlices:
    """Bitsets over ``words`` per position and letter, made for one position after the other."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.width = -(-max(self.n, 1) // 64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        # letter 0 stands behind a word's end, the last number for letters that no word has
        self.letters, codes = np.unique(flat, return_inverse=True)
        self.codes, self.starts = codes.astype(np.int64) + 1, np.cumsum(self.sizes) - self.sizes

    def at(self, position: int) -> np.ndarray:
        """A row of bits per letter."""
        marks = np.zeros((len(self.letters) + 2, 64 * self.width), bool)
        if position >= 0:
            here = np.flatnonzero(self.sizes > position)
            marks[0, : self.n] = True
            marks[0, here] = False
            marks[self.codes[self.starts[here] + position], here] = True
        return np.packbits(marks, axis=1, bitorder="little").view(np.uint64)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all that differ by exactly one added, missing or replaced code point."""
        sizes = np.array([len(q) for q in queries], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        flat = np.frombuffer("".join(queries[i] for i in order).encode("utf-32-le"), np.uint32)
        place = np.searchsorted(self.letters, flat)
        known = place < len(self.letters)
        known[known] = self.letters[place[known]] == flat[known]
        codes = np.where(known, place + 1, len(self.letters) + 1)
        starts = np.cumsum(sizes) - sizes
        every = np.packbits(np.arange(64 * self.width) < self.n, bitorder="little").view(np.uint64)
        exact = np.repeat(every[None], len(queries), axis=0)
        replaced, missing, added = (np.zeros_like(exact) for _ in range(3))
        before, here, after = self.at(-1), self.at(0), self.at(1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live = len(queries)
        for i in range(int(sizes.max(initial=0)) + 1):
            rest = int(np.searchsorted(-sizes, -i, side="left"))  # queries longer than i
            ended = slice(rest, live)
            if rest < live:
                same = exact[ended] & here[0]
                one = (missing[ended] & before[0]) | ((added[ended] | exact[ended]) & after[0]) | (replaced[ended] & here[0])
                found.append(self._pairs(one & ~same, order[ended]))
            live = rest
            if not live:
                break
            letter = codes[starts[:live] + i]
            clean = exact[:live]
            missing[:live] = (missing[:live] & before[letter]) | clean
            added[:live] = (added[:live] | clean) & after[letter]
            match = here[letter]
            replaced[:live] = (replaced[:live] & match) | clean
            exact[:live] = clean & match
            before, here, after = here, after, self.at(i + 2)
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([empty, *x]) for x in zip(*found)) if found else (empty, empty)

    def _pairs(self, bits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, word = np.nonzero(bits)
        single = np.unpackbits(bits[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(single)
        return rows[row[which]], 64 * word[which] + bit


def _compare(table: pa.Table) -> pa.Table:
    """Pairs of one cell: its queries against its piece of the index.

    A pair belongs to the shard of the first letters if it shares those, else to that of the last ones.
    """
    front = table.column("front")[0].as_py()
    index = table.filter(pa.compute.field("asks") == False)  # noqa: E712
    asked = table.filter(pa.compute.field("asks") == True)  # noqa: E712
    words, counts = index.column("word").to_pylist(), index.column("n").to_pylist()
    queries = asked.column("word").to_pylist()
    rows = []
    for q, w in zip(*(x.tolist() for x in BitSlices(words).near(queries))):
        a, b = queries[q], words[w]
        if (a[:_END] == b[:_END]) if front else (a[:_END] != b[:_END] and a[-_END:] == b[-_END:]):
            rows.append((a, b, counts[w]))
    columns = list(zip(*rows)) or [[]] * 3
    return pa.table(
        {"word": pa.array(columns[0], pa.string()), "near": pa.array(columns[1], pa.string()), "near_n": pa.array(columns[2], pa.int64())}
    )


def near_words(words: DataFrame, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """``word``, ``near``, ``near_n``: both directions of every pair of ``words`` (``word``, ``n``) that differ
    by one code point. Words are distinct and have 2 * 3 letters at least."""
    shards = max(1, -(-words.count() // shard))

    def home(front: bool):
        end = F.substring("word", 1, _END) if front else F.substring("word", -_END, _END)
        return F.struct(F.lit(front).alias("front"), F.pmod(F.xxhash64(end), F.lit(shards)).alias("number"))

    dealt = words.withColumn("home", F.explode(F.array(home(True), home(False)))).select("word", "n", "home.*")
    sizes = dealt.groupBy("front", "number").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("letters"))
    pieces = F.greatest(F.ceil(F.col("n") / piece), F.ceil(F.col("letters") / PIECE_LETTERS))
    dealt = dealt.join(sizes.select("front", "number", pieces.alias("pieces")), ["front", "number"])
    own = F.pmod(F.xxhash64(F.lit("piece"), "word"), F.col("pieces"))
    every = F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)
    # each piece of the index meets each piece of the queries
    held = dealt.select("front", "number", "word", "n", F.lit(False).alias("asks"), own.alias("held"), F.explode(every).alias("asked"))
    asks = dealt.select("front", "number", "word", "n", F.lit(True).alias("asks"), F.explode(every).alias("held"), own.alias("asked"))
    cells = held.unionByName(asks).groupBy("front", "number", "held", "asked")
    return cells.applyInArrow(_compare, "word string, near string, near_n long")


def _roots(links: DataFrame, longest: int) -> DataFrame:
    """``word``, ``root`` of words that have a ``form``: each round doubles the steps that are followed."""
    roots = links.select("word", F.col("form").alias("root"))
    steps = 1
    while steps < longest:
        further = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        roots = roots.join(further, roots.root == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"))
        roots, steps = stored(roots, "spelling-roots"), 2 * steps
    return roots


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LETTERS, occurs: int = OCCURS,
    ratio: int = RATIO, slip: int | None = None, shard: int = SHARD, piece: int = PIECE,
) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF, only A-Z lower-cased) of at least ``least`` code
    points that occur ``occurs`` times in all texts together. Words are near if they differ by one code point
    inserted, deleted or replaced. A word's form is its near word of largest ``n`` (ties: the smallest), if
    that occurs ``ratio`` times as often; the root is where following forms ends. ``slip``: see
    :func:`word_counts`.

    Null and empty texts have no words. Repeated rows count as often as they come. A word may be of any
    length. An empty table, or one without words, gives no row. Other columns are not looked at. ``least``
    must be 6 or more, as near words have to share three letters at one end; ``ratio`` must be 2 or more.
    """
    if least < 2 * _END or ratio < 2:
        raise ValueError("words need 6 letters and forms twice the occurrences at least")
    counts = word_counts(docs, doc_id, text, least, slip).groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(counts.where(F.col("n") >= occurs), "spelling-words")
    # the most frequent word bounds how many forms can follow each other
    top, longest = words.agg(F.max("n")).first()[0] or 0, 1
    while occurs * ratio**longest <= top:
        longest += 1
    near = near_words(words, shard, piece).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("falling"), "near")).alias("best")
    )
    joined = words.join(near, "word", "left")
    often = -F.col("best.falling") >= ratio * F.col("n")
    joined = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.near")).alias("form"),
            F.when(often, -F.col("best.falling")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(joined.where("form is not null"), longest)
    return joined.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
