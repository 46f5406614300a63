"""Benchmark decontamination: greedy string tiling of documents by benchmark items.

Runs of ``TILE`` words shared by a document and an item are the seeds, met by their rolling
Karp-Rabin hashes.  Seeds in a row on a diagonal make maximal matches; the longest one whose words
are unmarked on both sides becomes a tile and marks them, again and again, until none of ``TILE``
words is left.  The share of an item's words in tiles is its coverage, in whatever order the
document has its passages.

The benchmark is a stated query set: it meets all documents in blocks of ``BLOCK_WORDS`` words, the
documents being read once for each block.  Nothing of the documents is shuffled.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.  Defined cases: null
and wordless texts match nothing, as do items with fewer words than a tile; repeated rows give
equal results; an empty benchmark contaminates nothing; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import give_back

#: Words in the shortest tile.
TILE = 4
#: Share of an item's words in tiles from which a document counts as contaminated.
COVERAGE = 0.5
#: Words of items that are sent to the workers at a time.
BLOCK_WORDS = 1_000_000

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True

HIT = "array<struct<item_id:bigint,coverage:double,n_tiles:int,longest:int>>"


def tiles(seeds: list[tuple[int, int]], tile: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (item word, document word, length) from seeds (item word, document word)."""
    runs: list[tuple[int, int, int]] = []
    by_diagonal = defaultdict(list)
    for i, j in seeds:
        by_diagonal[j - i].append(i)
    for shift, at in by_diagonal.items():
        at.sort()
        start = last = at[0]
        for i in [*at[1:], None]:
            if i is None or i != last + 1:
                runs.append((-(last - start + tile), start, start + shift))
                start = i
            last = i
    heapq.heapify(runs)
    marked_item: set[int] = set()
    marked_doc: set[int] = set()
    out = []
    while runs:
        n, i, j = heapq.heappop(runs)
        n = -n
        free = [i + x not in marked_item and j + x not in marked_doc for x in range(n)]
        if all(free):
            out.append((i, j, n))
            marked_item.update(range(i, i + n))
            marked_doc.update(range(j, j + n))
            continue
        start = 0
        for x in range(n + 1):  # what is left of the match goes back
            if x == n or not free[x]:
                if x - start >= tile:
                    heapq.heappush(runs, (-(x - start), i + start, j + start))
                start = x + 1
    return out


class Benchmark:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], tile: int):
        self.tile = tile
        texts = pa.array([t for _, t in items], pa.string())
        self.ids = [i for i, _ in items]
        self.sizes: list[int] = []
        seeds = []
        at = 0
        for a, b, data, offsets in hashing.slices(texts):
            _, _, hashes, first = hashing.words(data, offsets, table=_WORD)
            self.sizes += np.diff(first).tolist()
            values, begins = hashing.shingles(hashes, first, tile)
            for k in range(b - a):
                if first[k + 1] - first[k] >= tile:
                    v = values[begins[k] : begins[k + 1]]
                    seeds.append(np.stack([v, np.full(len(v), at + k, np.uint64), np.arange(len(v), dtype=np.uint64)]))
            at = b
        all_seeds = np.concatenate(seeds, axis=1) if seeds else np.empty((3, 0), np.uint64)
        order = np.argsort(all_seeds[0], kind="stable")
        self.values, self.item, self.word = all_seeds[0][order], all_seeds[1][order].astype(np.int64), all_seeds[2][order].astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.values & np.uint64((1 << 20) - 1)] = True

    def hits(self, data: np.ndarray, offsets: np.ndarray, coverage: float) -> dict[int, list[tuple]]:
        """By text: (item, coverage, tiles, longest) of the items covered enough, best first."""
        _, _, hashes, first = hashing.words(data, offsets, table=_WORD)
        values, begins = hashing.shingles(hashes, first, self.tile)
        at = np.flatnonzero(self.maybe[values & np.uint64((1 << 20) - 1)])
        low, high = np.searchsorted(self.values, values[at], "left"), np.searchsorted(self.values, values[at], "right")
        at, low, high = (x[high > low] for x in (at, low, high))
        text = np.searchsorted(begins, at, side="right") - 1
        pairs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for t, p, a, b in zip(text.tolist(), at.tolist(), low.tolist(), high.tolist(), strict=True):
            if first[t + 1] - first[t] >= self.tile:
                for s in range(a, b):
                    pairs[t, int(self.item[s])].append((int(self.word[s]), p - int(begins[t])))
        out: dict[int, list[tuple]] = defaultdict(list)
        for (t, item), seeds in pairs.items():
            # each item word is in a tile at most once, and a seed reaches tile words
            if len({i for i, _ in seeds}) * self.tile < coverage * self.sizes[item]:
                continue
            found = tiles(seeds, self.tile)
            share = sum(n for *_, n in found) / self.sizes[item]
            if share >= coverage:
                out[t].append((self.ids[item], share, len(found), max(n for *_, n in found)))
        return out


def _blocks(benchmark: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_WORDS words."""
    block, words = [], 0
    for r in benchmark.select(id, text).toLocalIterator():
        if r[0] is None or r[1] is None:
            continue
        block.append((r[0], r[1]))
        words += len(r[1].split())
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", tile: int = TILE, coverage: float = COVERAGE, out: str = "contamination") -> DataFrame:
    """``docs`` with ``out``: array of (item_id, coverage, n_tiles, longest) of the items it holds."""
    fields = [f for f in docs.schema.fields if f.name != out]
    part = T.StructField("_hits", T._parse_datatype_string(HIT))
    result = docs.select(*[f.name for f in fields]).withColumn(out, F.array().cast(HIT))
    for items in _blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = Benchmark(shared.value, tile)
            for batch in batches:
                for a, b, data, offsets in hashing.slices(batch.column(text)):
                    hits = block.hits(data, offsets, coverage)
                    rows = [[dict(zip(("item_id", "coverage", "n_tiles", "longest"), h, strict=True)) for h in hits.get(k, ())] for k in range(b - a)]
                    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in batch.schema.names], pa.array(rows, kind)], [*batch.schema.names, "_hits"])
            give_back()

        result = result.mapInArrow(run, T.StructType([*result.schema.fields, part]))
        result = result.withColumn(out, F.concat(out, "_hits")).drop("_hits")
    return result


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """(id, item_id, coverage, n_tiles, longest) for each item that a document holds."""
    text = options.get("text", "text")
    rows = overlaps(docs.select(id, text), benchmark, **options).select(id, F.explode("contamination").alias("c"))
    return rows.select(id, "c.item_id", "c.coverage", "c.n_tiles", "c.longest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item."""
    return overlaps(docs, benchmark, out="_contamination", **options).filter(F.size("_contamination") == 0).drop("_contamination")
