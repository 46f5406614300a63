"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector, of unit length, of its hashed character n-grams (bytes of the
lower-cased text).  Spherical k-means gives a few centroids per language from at most
``PER_LANGUAGE`` training texts each, chosen by hash; a text gets the language of the centroid with
the largest cosine.  Each centroid keeps a radius, a low quantile of its members' cosines less a
margin; a text beyond the radius of its nearest centroid is rejected.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without training
texts every text is ``und``; rows with a null language are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Learned from so many texts of a language, and so many in all, shared out evenly (one of each language at least).
PER_LANGUAGE, ROWS, CENTROIDS = 400, 10_000, 4
DIMENSIONS = 1 << 12
GRAMS = (1, 2, 3)
UNKNOWN = "und"


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    out = np.zeros(DIMENSIONS)
    for n in GRAMS:
        if len(b) < n:
            continue
        code = np.full(len(b) - n + 1, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))
        for j in range(n):
            code = code * np.uint32(0x01000193) ^ b[j : len(b) - n + 1 + j] * np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(15)
        out += np.bincount((code * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = np.log1p(rows) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, rejected = [], [], []
        for t in texts:
            if not self.languages or not has_letter(t):
                lang.append(UNKNOWN)
                score.append(0.0)
                rejected.append(True)
                continue
            cosine = self.centroids @ self.vectors(counts(t)[None])[0]
            i = int(cosine.argmax())
            lang.append(self.languages[i])
            score.append(float(min(max(cosine[i], 0.0), 1.0)))
            rejected.append(bool(cosine[i] < self.radius[i]))
        return lang, score, rejected


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next one the row farthest from all."""
    centres = [v.mean(0)]
    while len(centres) < min(k, len(v)):
        near = np.max(v @ np.array([c / max(np.linalg.norm(c), 1e-12) for c in centres]).T, axis=1)
        centres.append(v[int(near.argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (v @ c.T).argmax(1)
        c = np.array([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit_rows(rows: np.ndarray, languages: list[str], *, centroids: int = CENTROIDS, quantile: float = 0.01, margin: float = 0.15) -> Model:
    found = (rows > 0).sum(0)
    model = Model([], np.log((1 + len(rows)) / (1 + found)) + 1, np.empty((0, DIMENSIONS)), np.empty(0))
    if not len(rows):
        return model
    v = model.vectors(rows)
    names, parts, radius = np.array(languages), [], []
    for lang in sorted(set(languages)):
        own = v[names == lang]
        c = _kmeans(own, centroids)
        cosine = own @ c.T
        for j in range(len(c)):
            members = cosine[cosine.argmax(1) == j, j]
            radius.append(float(np.quantile(members, quantile)) - margin if len(members) else 0.0)
            model.languages.append(lang)
        parts.append(c)
    model.centroids, model.radius = np.concatenate(parts), np.array(radius)
    return model


def fit(docs: DataFrame, usable: Column | None = None, *, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from texts and languages of the rows that are ``usable``."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    if usable is not None:
        rows = rows.filter(usable)
    rows = rows.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    sizes = rows.groupBy("l").count().withColumn("all", F.count("*").over(W.partitionBy()))  # a row per language
    most = F.greatest(F.lit(1), F.least(F.lit(per_language), F.floor(F.lit(ROWS) / F.col("all")))).cast("int")
    # a hash range with twice the texts wanted: a frequent language is never ranked as a whole
    part = F.pmod("h", F.lit(1 << 40)) * F.col("count") < F.lit(2 << 40).cast("double") * F.col("most")
    hashes = rows.select("l", "h").join(F.broadcast(sizes.select("l", "count", most.alias("most"))), "l").filter(part).distinct()
    chosen = hashes.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))).filter(F.col("r") <= F.col("most")).select("l", "h")
    texts = rows.join(F.broadcast(chosen), ["l", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column("t").to_pylist()]
            at = [np.flatnonzero(x).astype(np.int32) for x in found]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v) if v else np.empty(0, np.int32))) for v in (at, [x[i].astype(np.int32) for x, i in zip(found, at, strict=True)])]
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("h"), *lists], ["l", "h", "at", "n"])

    seen: dict[tuple, tuple] = {}
    # a text that repeats comes once per row; the first is kept
    for r in texts.select("l", "t", "h").dropDuplicates(["l", "h"]).select("l", "h", "t").mapInArrow(run, "l string, h long, at array<int>, n array<int>").collect():
        seen[(r["l"], r["h"])] = (r["at"], r["n"])
    matrix = np.zeros((len(seen), DIMENSIONS))
    for row, key in zip(matrix, sorted(seen), strict=True):
        row[seen[key][0]] = seen[key][1]
    return fit_rows(matrix, [k[0] for k in sorted(seen)])


def identify(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score (cosine) and rejected (beyond the nearest centroid's radius)."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = model.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
