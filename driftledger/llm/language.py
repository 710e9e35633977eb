"""Language identification with string kernels.

The kernel of two texts is the share of byte n-grams (1 to 3) that are present in both. Labelled texts
serve as Nystroem landmarks; kernel ridge regression is fitted one language against the rest, and
texts are scored by products of batches of presence vectors with the landmarks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField

from .common import add_columns, byte_kinds, hashed_sample, row_chunks, utf8

#: Bounds of the model: labelled texts it is fitted on, landmarks, hashed n-grams.
TRAIN_ROWS, LANDMARKS, WIDTH = 4096, 128, 1 << 14
LONGEST = 3
RIDGE = 1e-3
UNKNOWN = "und"
_LOWER = byte_kinds([])
_BATCH = 64


def presence(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A row per text: 1 where a hashed n-gram of the whole text is present."""
    rows = len(offsets) - 1
    out = np.zeros((rows, width), np.float32)
    low = _LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    shift = np.uint32(32 - (width.bit_length() - 1))
    code = np.zeros(len(low), np.uint32)
    for n in range(1, LONGEST + 1):
        size = len(low) - n + 1
        if size <= 0:
            break
        code = (code[:size] << np.uint32(8)) | low[n - 1 :]
        place = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> shift
        whole = row[:size] == row[n - 1 :]
        out[row[:size][whole], place[whole]] = 1
    return out


def _batches(texts: pa.Array):
    data, offsets = utf8(texts)
    for low, high in row_chunks(offsets):
        for a in range(low, high, _BATCH):
            own = offsets[a : min(a + _BATCH, high) + 1]
            yield presence(data[own[0] : own[-1]], own - own[0])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray  # n-grams x landmarks, columns of length 1
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    sharpness: float

    def values(self, batch: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(batch.sum(axis=1, keepdims=True), 1))
        return (batch @ self.landmarks / size) @ self.weights + self.bias

    def shares(self, batch: np.ndarray) -> np.ndarray:
        return _softmax(self.sharpness * self.values(batch))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on packed presence vectors (a row per text). None without a labelled text."""
    if not langs:
        return None
    names = sorted(set(langs))
    own = np.array([names.index(x) for x in langs])
    turn = np.zeros(len(own), np.int64)
    for c in range(len(names)):
        turn[own == c] = np.arange((own == c).sum())
    picked = np.lexsort((own, turn))[:landmarks]  # languages in turn
    marks = np.unpackbits(bits[picked], axis=1).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh(marks.astype(np.float64) @ marks.T.astype(np.float64))
    good = values > 1e-6 * values.max(initial=0)
    to_space = vectors[:, good] / np.sqrt(values[good])
    near = []
    for k in range(0, len(bits), 256):
        part = np.unpackbits(bits[k : k + 256], axis=1).astype(np.float32)
        near.append(part @ marks.T / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1)))
    space = np.concatenate(near) @ to_space
    space = np.hstack([space, np.ones((len(space), 1))])
    goal = np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = space.T @ space + ridge * len(space) * np.eye(space.shape[1])
    solved = np.linalg.solve(gram, space.T @ goal)
    scored = space @ solved
    loss = {
        s: -np.log(np.maximum(_softmax(s * scored)[np.arange(len(own)), own], 1e-12)).mean() for s in (1, 2, 4, 8, 16)
    }
    return Model(
        names, np.ascontiguousarray(marks.T), (to_space @ solved[:-1]).astype(np.float32),
        solved[-1].astype(np.float32), float(min(loss, key=loss.get)),
    )


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on about ``rows`` rows with a language, picked by a hash of their id.

    Only packed presence vectors (2 KB each, whatever the text) reach the driver.
    """
    known = hashed_sample(docs.where(F.col(lang).isNotNull()).select(doc_id, text, lang), doc_id, rows)

    def compute(texts: pa.Array) -> list[pa.Array]:
        packed = [bytes(x) for part in _batches(texts) for x in np.packbits(part.astype(bool), axis=1)]
        return [pa.array(packed, pa.binary())]

    field = [StructField("bits", BinaryType())]
    found = add_columns(known, [text], field, compute, [lang, doc_id]).collect()
    found.sort(key=lambda r: (str(r[doc_id])[::-1], r[lang], r["bits"]))
    bits = np.frombuffer(b"".join(r["bits"] for r in found), np.uint8).reshape(len(found), WIDTH // 8)
    return fit(bits, [r[lang] for r in found])


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from the whole text.

    A text that is null, empty or without any letter is ``und`` with score 0; so is every text if
    there was nothing to learn from. Rows are judged one by one; columns of these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns if keep is None else keep

    def compute(texts: pa.Array, letters: pa.Array) -> list[pa.Array]:
        own = shared.value
        judged = [bool(x) for x in letters.to_pylist()]
        if own is None:
            return [pa.array([UNKNOWN] * len(judged)), pa.array([0.0] * len(judged))]
        shares = [own.shares(part) for part in _batches(texts)]
        shares = np.concatenate(shares) if shares else np.zeros((0, 1))
        best = shares.argmax(axis=1) if len(shares) else []
        return [
            pa.array([own.languages[b] if j else UNKNOWN for b, j in zip(best, judged)], pa.string()),
            pa.array([float(s[b]) if j else 0.0 for s, b, j in zip(shares, best, judged)], pa.float64()),
        ]

    lettered = docs.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return add_columns(lettered, [text, "_letters"], fields, compute, names)
