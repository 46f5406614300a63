"""Quality classifier: Bradley-Terry pairwise ranking of documents.

A document's strength is linear in features of its text.  Of a pair of a good and a poor document
the good one is preferred with the logistic of the difference in strength; the weights minimise
that loss, with a penalty, over all pairs of a good and a poor document.  The threshold is the
quantile of the training strengths at the share of poor documents; a score is the logistic of
strength less threshold.

Mean, scale, weights and threshold come from every usable labelled row.  The features of these rows
are written once.  A round sums them by strength, each row shared out between the two next points of
a grid of STEP; from the sums the driver has the loss and its gradient over all pairs, as of
strengths on the grid (true to STEP ** 2 / 80 a pair), and takes a step of BFGS.  Nothing that grows
with the rows is collected.  The threshold is exact.  Features are counted in numpy per Arrow batch.

Defined cases: null texts are scored as empty ones; rows keep their number; a missing class in
the labels gives weights of zero and the score 0.5; labels other than 0 and 1 are left out; of an
id's labels and of the features of its texts the least count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import give_back, materialize, scratch

#: Distance of the points of strength at which rows are summed.
STEP = 1 / 32
ROUNDS, PENALTY, GRADIENT = 60, 1e-4, 1e-5
#: Strengths that are collected at most for the threshold, unless they are equal.
NARROW = 4096
FEATURES = (
    "log_words", "word_length", "symbols", "upper", "stops", "commas", "shouts", "digits", "spaces", "high",
    "word_variety", "pair_variety", "next_same", "line_words", "line_variety", "odd_words", "upper_words",
)


def _byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_CLASSES = {
    "symbols": _byte_class("#*$%&|<>@^~{}[]\\=+_"), "upper": _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "stops": _byte_class(".?;:"), "commas": _byte_class(","),
    "shouts": _byte_class("!"), "digits": _byte_class("0123456789"), "spaces": _byte_class(" \t\n\v\f\r"), "high": (np.arange(256) >= 128).astype(np.int64),
}
_LETTER = (np.arange(256) >= 128) | _byte_class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ").astype(bool)


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values in each run."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[fresh], minlength=len(n))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    size = np.maximum(np.diff(offsets), 1)
    per = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])
    count = {name: per(table) / size for name, table in _CLASSES.items()}
    starts, ends, hashes, first = hashing.words(data, offsets, lower=True)
    words = np.diff(first)
    safe = np.maximum(words, 1)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    uppers = np.concatenate([[0], np.cumsum(_CLASSES["upper"][data])])
    n_letters = letters[ends] - letters[starts]
    same = np.zeros(len(hashes))
    pair = hashes.copy()
    if len(hashes) > 1:
        inner = np.ones(len(hashes), bool)
        inner[first[:-1][first[:-1] < len(hashes)]] = False
        same[1:] = (hashes[1:] == hashes[:-1]) & inner[1:]
        pair[1:] = hashing.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets, breaks + 1]))
    line_first = np.searchsorted(cuts, offsets)
    sums = hashing.prefix(data)
    lines = hashing.spans(sums, cuts[:-1], cuts[1:]) if len(cuts) > 1 else np.empty(0, np.uint64)
    n_lines = np.maximum(np.diff(line_first), 1)
    columns = {
        "log_words": np.log1p(words), "word_length": total(ends - starts) / safe, "word_variety": _distinct(hashes, first) / safe, "pair_variety": _distinct(pair, first) / safe,
        "next_same": total(same) / safe, "line_words": np.log1p(words / n_lines), "line_variety": _distinct(lines, line_first) / n_lines,
        "odd_words": total(n_letters * 4 < (ends - starts) * 3) / safe, "upper_words": total((uppers[ends] - uppers[starts] > 1).astype(float)) / safe,
    } | count
    return np.stack([columns[f] for f in FEATURES], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._inputs(x) @ self.weights - self.threshold)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, np.abs(z)], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)), batch.column("good").to_numpy(zero_copy_only=False).astype(bool)


def totals(rows: DataFrame, parts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of the numbers that ``parts`` makes of the features and classes of (good, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [parts(*_values(batch)) for batch in batches if batch.num_rows]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, axis=0).tolist()])], ["v"])

    return np.sum([r["v"] for r in rows.mapInArrow(run, "v array<double>").collect()], axis=0)


def moments(rows: DataFrame) -> tuple[Model, int, int]:
    """A model of zero weights with the rows' mean and scale; numbers of good and of poor rows."""
    n = len(FEATURES)
    model = Model(np.zeros(n), np.ones(n), np.zeros(2 * n), 0.0)
    sums = totals(rows, lambda x, good: np.concatenate([[good.sum(), (~good).sum()], x.sum(axis=0)]))
    if not np.ndim(sums):
        return model, 0, 0
    good, poor = int(sums[0]), int(sums[1])
    mean = model.mean = np.round(sums[2:] / (good + poor), 12)
    model.scale = np.round(np.sqrt(totals(rows, lambda x, good: ((x - mean) ** 2).sum(axis=0)) / (good + poor)), 12) + 1e-6
    return model, good, poor


def by_strength(rows: DataFrame, model: Model, weights: np.ndarray) -> dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: points of strength, the rows at each and the sums of their inputs; a row is shared out between its two next points."""
    names = [f"v{k}" for k in range(len(weights) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.empty(0, np.int64), np.empty((0, len(names)))
        for batch in batches:
            x, good = _values(batch)
            z = model._inputs(x)
            at = z @ weights / STEP
            point = np.floor(at)
            share = (at - point)[:, None]
            own = np.concatenate([np.ones((len(z), 1)), z], axis=1)
            code = point.astype(np.int64) * 2 + good
            codes, row = np.unique(np.concatenate([codes, code, code + 2]), return_inverse=True)
            values = np.concatenate([sums, own * (1 - share), own * share])
            order = np.argsort(row, kind="stable")
            sums = np.add.reduceat(values[order], np.searchsorted(row[order], np.arange(len(codes)))) if len(codes) else sums
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array(codes), *map(pa.array, sums.T.copy())], ["code", *names])

    found = rows.mapInArrow(run, "code long, " + ", ".join(f"{v} double" for v in names)).groupBy("code").agg(*[F.sum(v).alias(v) for v in names]).collect()
    table = np.array(sorted(tuple(r) for r in found))
    out = {}
    for good in (False, True):
        own = table[table[:, 0] % 2 == good]
        out[good] = np.floor(own[:, 0] / 2) * STEP, own[:, 1], own[:, 2:]
    return out


def pair_loss(good: tuple[np.ndarray, np.ndarray, np.ndarray], poor: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
    """Mean loss of all pairs of a good and a poor row, and its gradient, from their sums by strength."""
    pairs = good[1].sum() * poor[1].sum()
    loss, gradient = 0.0, np.zeros(good[2].shape[1])
    for k in range(0, len(good[0]), 256):
        d = poor[0][None, :] - good[0][k : k + 256, None]
        loss += good[1][k : k + 256] @ np.logaddexp(0, d) @ poor[1]
        wrong = 1 / (1 + np.exp(-np.clip(d, -500, 500)))
        gradient += (good[1][k : k + 256] @ wrong) @ poor[2] - (wrong @ poor[1]) @ good[2][k : k + 256]
    return loss / pairs, gradient / pairs


def fit_rows(rows: DataFrame) -> Model:
    """A model from all pairs of a good and a poor row of (good, x)."""
    model, n_good, n_poor = moments(rows)
    if not n_good or not n_poor:
        return model
    size = 2 * len(FEATURES)

    def products(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        z = model._inputs(x)
        return np.concatenate([v for own in (z[good], z[~good]) for v in (own.sum(axis=0), (own.T @ own).ravel())])

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        sums = by_strength(rows, model, w)
        loss, gradient = pair_loss(sums[True], sums[False])
        return loss + PENALTY / 2 * w @ w, gradient + PENALTY * w

    of_good, of_poor = np.split(totals(rows, products), 2)
    (m, mm), (p, pp) = ((v[:size] / n, v[size:].reshape(size, size) / n) for v, n in ((of_good, n_good), (of_poor, n_poor)))
    curve = (mm + pp - np.outer(m, p) - np.outer(p, m)) / 4  # at weights of zero, where it is greatest
    inverse = np.linalg.inv(curve + PENALTY * np.eye(size))
    w = np.zeros(size)
    loss, gradient = at(w)
    for _ in range(ROUNDS):
        if np.abs(gradient).max() < GRADIENT:
            break
        step = -inverse @ gradient
        for _ in range(8):
            new_loss, new_gradient = at(w + step)
            if new_loss < loss:
                break
            step = step / 4
        else:
            break
        change = new_gradient - gradient
        if (along := step @ change) > 1e-14:
            turn = np.eye(size) - np.outer(step, change) / along
            inverse = turn @ inverse @ turn.T + np.outer(step, step) / along
        w, loss, gradient = w + step, new_loss, new_gradient
    model.weights = np.round(w, 10)  # sums come in any order
    # the quantile at the share of poor rows, in the middle of its two neighbours
    n = n_good + n_poor
    place = min(max(n_poor, 1), n - 1)
    strengths = strengths_of(rows, model)
    model.threshold = (ranked(strengths, place - 1) + ranked(strengths, place)) / 2
    return model


def strengths_of(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.round(model._inputs(_values(batch)[0]) @ model.weights, 12))], ["s"])

    return materialize(rows.mapInArrow(run, "s double"), "quality-strengths")


def ranked(strengths: DataFrame, place: int) -> float:
    """The value of s at ``place`` (from 0) in order."""
    low, high, n = strengths.agg(F.min("s"), F.max("s"), F.count("*")).first()
    rows = strengths
    while n > NARROW and low < high:
        width = (high - low) / 1024
        part = F.least(F.floor((F.col("s") - low) / width), F.lit(1023))
        for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()):
            if place < r["n"]:
                break
            place -= r["n"]
        rows = rows.filter(F.col("s").between(r["low"], r["high"]))
        low, high, n = r["low"], r["high"], r["n"]
    return low if low == high else sorted(r["s"] for r in rows.collect())[place]


def featured(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns and ``x``, the features of the text."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("x", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in hashing.slices(batch.column(text)):
                x = features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(a, b - a) for f in fields], lists], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from all labelled rows with ``usable`` ids."""
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    if usable is not None:
        chosen = chosen.filter(usable)
    chosen = chosen.groupBy(id).agg(F.min(label).alias("_good"))
    with scratch(docs.sparkSession):
        rows = featured(docs.select(id, text), id, text=text).join(chosen, id)  # features, which are small, meet the labels
        rows = rows.groupBy(id, "_good").agg(F.min("x").alias("x")).select((F.col("_good") == 1).alias("good"), "x")
        return fit_rows(materialize(rows, "quality-rows"))


def score(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns with score (0 to 1) and predicted (1 if score >= 0.5)."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in hashing.slices(batch.column(text)):
                s = model.scores(features(data, offsets))
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(a, b - a) for f in fields], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema.names)
        give_back()

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
