"""What runs on the workers to rank nodes for questions: term counts, scores in blocks, the best of each task.

A node's row holds all that its scores need, so nothing of the corpus is shuffled: a task keeps the
best ``k`` nodes of each question while blocks pass, and only these leave it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_RUNS = re.compile("[一-鿿]+|[a-zA-Z0-9_]+")
_HAN = re.compile("[一-鿿]")
_INK = re.compile("[^ \t\n\x0b\f\r 　]")
#: Numbers in a block of scores or products, questions that are scored together, texts that are counted together.
CELLS, WIDTH, ROWS = 2_000_000, 256, 1000


def cut(text: str) -> list[str]:
    """The terms of :func:`scriptorium.functions.text.terms`, on a worker."""
    runs = _RUNS.findall(text)
    if not _HAN.search(text):
        return " ".join(runs).lower().split()
    return [t for r in runs for t in ([r.lower()] if r[0] < "一" else [r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)])]


def _lists(values: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def counter(vocabulary: dict[str, int] | None = None) -> Run:
    """Batches (id, text) to (node_id, dl, terms, tfs) of texts that aren't blank; with a vocabulary only its terms, by its numbers and in their order."""
    kind = pa.string() if vocabulary is None else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                kept, dl, sizes, terms, tfs = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if text is None or not _INK.search(text):
                        continue
                    tokens = cut(text)
                    found = Counter(tokens)
                    own = found.items() if vocabulary is None else sorted((vocabulary[t], found[t]) for t in found.keys() & vocabulary.keys())
                    kept.append(i)
                    dl.append(len(tokens))
                    sizes.append(len(own))
                    terms += [t for t, _ in own]
                    tfs += [n for _, n in own]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), pa.array(dl, pa.int32()), _lists(terms, sizes, kind), _lists(tfs, sizes, pa.int32())], ["node_id", "dl", "terms", "tfs"])

    return run


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array([*column.to_pylist(), None], object)[:-1]


class Best:
    """The best ``k`` nodes of each question, by score to ``digits`` digits and then by id."""

    def __init__(self, questions: pa.Array, k: int, digits: int, least: float = -np.inf):
        self.questions, self.k, self.unit = questions, k, 10.0**digits
        self.limit = np.full(len(questions), least)  # lower scores don't enter
        self.q, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """A block (nodes x questions from ``first`` on); what is not a number is no score."""
        end = first + scores.shape[1]
        at, q = np.nonzero(scores >= self.limit[first:end])
        if not len(at):
            return
        mine = (self.q >= first) & (self.q < end)
        ids = ids[at] if self.ids is None else np.concatenate((self.ids[mine], ids[at]))
        score, q = np.concatenate((self.score[mine], scores[at, q])), np.concatenate((self.q[mine], q + first))
        key = np.floor(score * self.unit + 0.5)
        order = np.lexsort((ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1], -key, q))
        q = q[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last, best = place == self.k - 1, place < self.k
        self.limit[q[last]] = np.maximum(self.limit[q[last]], (key[order[last]] - 0.6) / self.unit)
        ids, score, q = ids[order[best]], score[order[best]], q[best]
        self.ids = ids if self.ids is None else np.concatenate((self.ids[~mine], ids))
        self.score, self.q = np.concatenate((self.score[~mine], score)), np.concatenate((self.q[~mine], q))

    def hits(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            yield pa.RecordBatch.from_arrays([self.questions.take(pa.array(self.q)), pa.array(self.ids.tolist(), kind), pa.array(self.score)], ["qid", "node_id", "score"])


def lexical(questions: pa.Array, weights: list[tuple[int, int, float]], n_terms: int, avgdl: float, k1: float, b: float, k: int) -> Run:
    """Batches of :func:`counter` to BM25 hits; ``weights`` are (question, term, weight).

    A score is a sum in the order of term numbers, so equal texts have equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, t, w = (np.array([x[i] for x in weights], kind) for i, kind in enumerate((np.int64, np.int64, float)))
        blocks = []
        for first in range(0, len(questions), WIDTH):
            own = (q >= first) & (q < first + WIDTH)
            used, place = np.unique(t[own], return_inverse=True)
            dense = np.zeros((len(used), min(WIDTH, len(questions) - first)))
            dense[place, q[own] - first] = w[own]
            local = np.full(n_terms, -1)
            local[used] = np.arange(len(used))
            blocks.append((first, local, dense))
        best, kind = Best(questions, k, 9, np.nextafter(0, 1)), None
        for batch in batches:
            kind, ids, ends = batch.schema.field(0).type, _ids(batch.column(0)), batch.column(2).offsets.to_numpy()
            terms, tf = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(3).values.to_numpy(zero_copy_only=False).astype(float)
            tf = tf[batch.column(3).offsets[0].as_py() :]
            rows = np.repeat(np.arange(len(ids)), np.diff(ends))
            terms, tf = terms[ends[0] : ends[-1]], tf[: len(rows)]
            share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * batch.column(1).to_numpy(zero_copy_only=False)[rows] / avgdl))
            for first, local, dense in blocks:
                place = local[terms]
                mine = np.flatnonzero(place >= 0)
                at = 0
                while at < len(mine):
                    end = min(at + CELLS // WIDTH, len(mine))
                    if end < len(mine):  # whole rows
                        end = max(np.searchsorted(rows[mine], rows[mine[end]]), at)
                        end = end if end > at else np.searchsorted(rows[mine], rows[mine[at]], "right")
                    part = mine[at:end]
                    starts = np.flatnonzero(np.append(True, rows[part[1:]] != rows[part[:-1]]))
                    best.add(np.add.reduceat(share[part, None] * dense[place[part]], starts, axis=0), ids[rows[part[starts]]], first)
                    at = end
        yield from best.hits(kind)

    return run


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of length one; not numbers where a vector is missing, of other dimensions or zero."""
    ends = column.offsets.to_numpy()
    fits = np.flatnonzero(np.diff(ends) == dims)
    out = np.full((len(column), dims), np.nan)
    out[fits] = column.values.to_numpy(zero_copy_only=False)[ends[fits][:, None] + np.arange(dims)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def nearest(questions: pa.Array, vectors: pa.Array, k: int, digits: int, exclude_self: bool) -> Run:
    """Batches (node_id, embedding) to cosine hits: block products of vectors and questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = max((len(v) for v in vectors if v.is_valid), default=0)
        asked = _unit(vectors, dims)
        own = {q: i for i, q in enumerate(questions.to_pylist())} if exclude_self else {}
        best, kind = Best(questions, k, digits), None
        for batch in batches:
            kind, ids = batch.schema.field(0).type, _ids(batch.column(0))
            rows = _unit(batch.column(1), dims)
            selves = np.array([own.get(i, -1) for i in ids.tolist()] if own else [-1] * len(ids))
            for first in range(0, len(asked), 512):
                for at in range(0, len(ids), CELLS // 512):
                    scores = rows[at : at + CELLS // 512] @ asked[first : first + 512].T
                    mine = selves[at : at + CELLS // 512] - first
                    inside = np.flatnonzero((mine >= 0) & (mine < scores.shape[1]))
                    scores[inside, mine[inside]] = np.nan
                    best.add(scores, ids[at : at + CELLS // 512], first)
        yield from best.hits(kind)

    return run
