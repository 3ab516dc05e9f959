"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]")
TYPES = (pa.string(), pa.float64(), pa.bool_())
# Hashed byte n-grams of 1 to 3 bytes: so many features.
FEATURES = 1 << 13
# Bytes whose n-grams are counted at a time.
CHUNK = 1 << 20
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)

# ASCII bytes other than letters become spaces, A-Z lower case; other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


@dataclass
class Model:
    """``centroids`` are unit vectors, one per row; ``labels`` names the language of each."""

    languages: list[str]
    labels: np.ndarray
    centroids: np.ndarray
    weights: np.ndarray
    reject_below: float


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a whole text."""
    found = np.zeros(FEATURES, np.float32)
    data = FOLD[np.frombuffer(text.lower().encode(), np.uint8)]
    space = data == 32
    data = data[~(space & np.append(False, space[:-1]))]
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK + 2].astype(np.uint32)
        code = np.zeros(len(piece), np.uint32)
        for n in range(min(3, len(piece))):
            code = code[: len(piece) - n] * np.uint32(257) + piece[n:] + np.uint32(1)
            hashed = (code[:CHUNK] * MULTIPLIERS[n]) >> shift
            found += np.bincount(hashed, minlength=FEATURES).astype(np.float32)
    return found


def vectors(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; the term frequency is damped by a root."""
    out = np.sqrt(rows) * weights
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _clusters(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of at most ``k`` groups, spread first, then moved by cosine."""
    centres = [points.mean(axis=0)]
    while len(centres) < min(k, len(points)):
        best = np.max(points @ np.array(centres).T, axis=1)
        centres.append(points[int(np.argmin(best))])
    centres = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(points @ centres.T, axis=1)
        groups = [points[near == g].mean(axis=0) for g in range(len(centres)) if (near == g).any()]
        centres = np.array(groups)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(rows: list[tuple[str, str]], centroids: int = 4, margin: float = 0.25) -> Model:
    """Learn from (text, language) pairs; pairs without a letter teach nothing.

    A text is rejected if its best cosine lies below ``margin`` times the lowest but one in a
    hundred of the learned texts' own best cosines.
    """
    rows = sorted((lang, text) for text, lang in rows if text and lang and has_letter(text))
    if not rows:
        nothing = np.zeros((0, FEATURES), np.float32)
        return Model([], np.zeros(0, int), nothing, np.ones(FEATURES, np.float32), 0.0)
    found = np.array([counts(text) for _, text in rows])
    weights = np.log((1 + len(rows)) / (1 + (found > 0).sum(axis=0))).astype(np.float32) + 1
    points = vectors(found, weights)
    languages = sorted({lang for lang, _ in rows})
    own = np.array([languages.index(lang) for lang, _ in rows])
    groups = [_clusters(points[own == k], centroids) for k in range(len(languages))]
    labels = np.concatenate([np.full(len(g), k) for k, g in enumerate(groups)])
    centres = np.concatenate(groups).astype(np.float32)
    best = np.max(points @ centres.T, axis=1)
    return Model(languages, labels, centres, weights, float(np.quantile(best, 0.01)) * margin)


def learn(
    docs: DataFrame,
    per_language: int = 250,
    longest: int = 20_000,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Model:
    """Fit on a bounded sample of ``docs``: ``per_language`` rows of each language value.

    The rows with the smallest hash of their id are taken, among texts of at most ``longest``
    characters, so the sample does not depend on how the table is stored. Only its ids and then
    its texts reach the driver. Rows with a null id, text or language are not learned from.
    """
    known = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.col(text).alias("text"),
        F.col(lang).alias("lang"),
    ).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= longest)
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    first = known.select("lang", "id").withColumn("at", F.row_number().over(order))
    ids = [row[0] for row in first.where(F.col("at") <= per_language).select("id").collect()]
    rows = known.where(F.col("id").isin(ids)).select("text", "lang").distinct().collect()
    return fit([(row[0], row[1]) for row in rows])


def _predict(model: Model) -> Callable:
    def one(text: str | None) -> tuple[str, float, bool]:
        if not text or not len(model.labels) or not has_letter(text):
            return UNKNOWN, 0.0, True
        cosines = model.centroids @ vectors(counts(text)[None, :], model.weights)[0]
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        return model.languages[model.labels[best]], score, score < model.reject_below

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [one(text) for text in batch.to_pylist()]
            columns = list(zip(*found)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, TYPES)]
            yield pa.StructArray.from_arrays(arrays, names=["lang", "score", "rejected"])

    return run


def identify(model: Model, text: Column) -> Column:
    """struct(lang, score, rejected) of a whole text.

    The language of the nearest centroid and its cosine. Rejected: further from every centroid
    than the model allows, or ``und`` with score 0 because the text is null, has no letter, or
    nothing was learned. Only the text is looked at.
    """
    predict = F.arrow_udf(
        _predict(model), "struct<lang:string,score:double,rejected:boolean>", ArrowUDFType.SCALAR_ITER
    )
    return predict.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """One document in five, by the checksum of its id as text; and documents without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
