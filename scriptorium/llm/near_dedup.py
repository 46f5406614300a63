"""Near-duplicate documents: bottom-k sketches of one hash function.

1. A document's set is its distinct shingles of words.  Documents with equal sets form a class,
   and only the smallest id of a class goes on.
2. The k smallest hashes of a set are its sketch.  Its inverted lists are keyed by two values that
   follow each other in a sketch: two values next to each other in the sorted union that both sets
   hold follow each other in either sketch.  Of its keys a set uses the rarest, as many as leave no
   room for a similar set that misses them all (see :func:`needed`).
3. In each list every set meets the list's smallest id; links found make components.  The sets of
   lists whose sets are in different components then are keyed again by larger sketches, of which
   a smaller share suffices, so that lists of a frequent passage fall apart (:data:`LARGE_K`).
4. Sets of such a list that are in different components meet each other in blocks of BLOCK sets.
   A task estimates the similarity of all pairs of two blocks from their sketches, confirms it on
   the full sets and keeps only links between sets that its other links leave apart, so that what
   leaves it grows with the number of sets and not of pairs.
5. The sketch of a pair's union estimates its similarity and drops pairs far below the threshold;
   the exact Jaccard similarity of the full sets, from the texts, decides.

Defined cases: null or wordless texts have an empty set, are linked with nothing and kept; texts
with fewer words than a shingle have their whole sequence as one; rows with equal ids count as
rows of one document; rows with a null id are kept; ids must be integers; ties of hashes and long
texts need no care, as sets are compared whole; other columns are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import give_back, materialize, scratch, small
from .graph import components

WORDS = 5
#: Values in a sketch, and in the larger sketches of sets whose lists are left open.
K, LARGE_K = 48, 256
#: Chance that a similar pair has no key in common.
MISS = 1e-8
#: The estimate may fall this far below the threshold before a pair is dropped (6 deviations).
SLACK = 0.31
#: Sets that meet each other in a task come in blocks of so many.
BLOCK = 256
ID_ROWS = 400_000

SKETCH = "n_shingles long, set_a long, set_b long, sketch array<long>"


def sketches(docs: DataFrame, *keep: str, text: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """``keep`` columns with the size, 128-bit hash and bottom-k sketch of each text's set."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *T._parse_datatype_string(SKETCH).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in hashing.slices(batch.column(text)):
                sets = shingle_sets(data, offsets, words)
                sizes = np.array([len(s) for s in sets], np.int64)
                one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                two = np.array([hashing.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                low = [hashing.signed(s[:k]) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low)))
                columns = [*[batch.column(f.name).slice(a, b - a) for f in fields], pa.array(sizes), pa.array(hashing.signed(one)), pa.array(hashing.signed(two)), lists]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        give_back()

    return docs.select(*keep, text).mapInArrow(run, schema)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, _, hashes, first = hashing.words(data, offsets)
    values, begins = hashing.shingles(hashes, first, words)
    return [np.unique(values[x:y]) for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


@lru_cache
def shared_keys(k: int, similarity: float, miss: float = MISS) -> int:
    """Neighbouring values, out of ``k``, that two sets have in common but for a chance of ``miss``.

    Each value of the union is in both sets with the chance ``similarity``.
    """
    # chance of each number of common neighbours so far, by whether the last value is in both
    out, both = np.zeros(k + 1), np.zeros(k + 1)
    out[0], both[0] = 1 - similarity, similarity
    for _ in range(k - 1):
        out, both = (1 - similarity) * (out + both), similarity * (out + np.concatenate([[0], both[:-1]]))
    return int(np.searchsorted(np.cumsum(out + both), miss, side="right"))


def needed(n: int, threshold: float, k: int = K) -> int:
    """Keys that a set of ``n`` shingles shares, at least, with any similar set.

    While the union has up to k values the bound is exact: each of d1 values that the other set
    lacks breaks two neighbourhoods, each of d2 that only the other set has breaks one.  It is
    positive from a threshold of 0.85 on; where it isn't, a set uses all its keys.
    """
    if floor(n / threshold + 1e-9) > k:
        return max(1, shared_keys(k, threshold))
    broken = 0
    for d1 in range(floor((1 - threshold) * n + 1e-9) + 1):
        d2 = floor((n - d1) / threshold - n + 1e-9)
        broken = max(broken, 2 * d1 + d2)
    return max(1, n - 1 - broken)


def keyed(sets: DataFrame, threshold: float, k: int = K) -> DataFrame:
    """(key, id, n): the rarest keys of each set in inverted lists of two sets and more."""
    bound = F.array(*[F.lit(needed(n, threshold, k)) for n in range(k + 1)])
    neighbours = F.transform(F.slice("sketch", 2, k), lambda v, i: F.xxhash64(F.get("sketch", i), v))
    rows = sets.filter("n > 1").select("id", "n", F.explode(neighbours).alias("key"))
    rows = materialize(rows, "near-keys")
    counts = rows.groupBy("key").agg(F.count("*").alias("n_list"))
    counts = materialize(counts.filter("n_list > 1"), "near-lists")
    rows = rows.join(counts, "key")
    # keys of lists with one set are the rarest of all, so they come first
    rows = rows.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("n_list", "key"))).alias("keys"))  # k - 1 keys at most
    total = F.least(F.col("n"), F.lit(k)).cast("int") - 1
    use = total - F.get(bound, F.least(F.col("n"), F.lit(k)).cast("int")) + 1
    alone = total - F.size("keys")
    rows = rows.withColumn("keys", F.slice("keys", 1, F.greatest(use - alone, F.lit(0))))
    return rows.select("id", "n", F.explode("keys").alias("e")).select("id", "n", "e.key", "e.n_list")


def estimate(a: Column, b: Column, k: int = K) -> Column:
    """Similarity from the sketch of the union of two sets."""
    union = F.slice(F.array_sort(F.transform(F.array_union(a, b), lambda x: x.bitwiseXOR(F.lit(-(2**63))))), 1, k)
    both = F.transform(F.array_intersect(a, b), lambda x: x.bitwiseXOR(F.lit(-(2**63))))
    return F.size(F.array_intersect(union, both)) / F.greatest(F.size(union), F.lit(1))


def verify(pairs: DataFrame, sets: DataFrame, texts: DataFrame, threshold: int, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= threshold * union."""
    t = threshold / 100
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    rows = pairs.join(side("a"), "a").filter("n_a IS NOT NULL").join(side("b"), "b")
    # a sketch that holds most of the union estimates better
    union = (F.col("n_a") + F.col("n_b")) / (1 + t)
    slack = SLACK * F.sqrt(F.greatest(F.lit(0.0), 1 - K / union)) + 1e-9
    rows = rows.filter((100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (estimate(F.col("sketch_a"), F.col("sketch_b")) >= t - slack))
    rows = materialize(rows.select("a", "b"), "near-pairs")
    ids = small(rows.select(F.col("a").alias("id")).union(rows.select(F.col("b").alias("id"))).distinct(), ID_ROWS)
    found = materialize(texts.join(ids, "id", "left_semi"), "near-texts")
    with_b = rows.join(found.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(found.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            ids_a, ids_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            at = 0
            for x, y, data, offsets in hashing.slices(batch.column("text_b")):
                for other in shingle_sets(data, offsets, words):
                    if ids_a[at] != last:
                        last, own = ids_a[at], _set_of(batch.column("text_a").slice(at, 1), words)
                    same = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * same >= threshold * (len(own) + len(other) - same) and same:
                        keep.append(at)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([ids_a[i] for i in keep], pa.int64()), pa.array([ids_b[i] for i in keep], pa.int64())], ["a", "b"])
        give_back()

    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "near-links", rows=200)


def block_links(rows: DataFrame, texts: DataFrame, threshold: int, words: int) -> DataFrame:
    """Links (a, b) between the components c of each list (key, id, c, m), as many as join them.

    Rows of two blocks come to a task one after the other, so it holds no more than two blocks.
    """
    ids = small(rows.select("id").distinct(), ID_ROWS)
    found = materialize(texts.join(ids, "id", "left_semi").dropDuplicates(["id"]), "near-block-texts")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("right"), "id", "c")
    placed = placed.join(found, "id").select("key", "low", "high", "right", "id", "c", "text")
    placed = placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in grouped(batches, 3):
            sets: list[np.ndarray] = []
            for _, _, data, offsets in hashing.slices(task.column("text")):
                sets += shingle_sets(data, offsets, words)
            right = task.column("right").to_numpy(zero_copy_only=False).astype(bool)
            same = task.column("low")[0].as_py() == task.column("high")[0].as_py()
            a, b = joining_links(task.column("id").to_numpy(), task.column("c").to_numpy(), sets, None if same else right, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    return placed.mapInArrow(run, "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that are equal in the first ``n`` columns, each as one batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if rest and any(rest[0].column(i)[0] != batch.column(i)[0] for i in range(n)):
            yield pa.concat_batches(rest)
            rest = []
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = batch.slice(start, end - start)
            if end < batch.num_rows:
                yield pa.concat_batches([*rest, part]) if rest else part
                rest = []
            else:
                rest.append(part)
    if rest:
        yield pa.concat_batches(rest)


def joining_links(ids: np.ndarray, c: np.ndarray, sets: list[np.ndarray], right: np.ndarray | None, threshold: int) -> tuple[list[int], list[int]]:
    """Ids a < b of similar sets that join components; of two blocks, or of all sets if ``right`` is None."""
    one = np.flatnonzero(~right) if right is not None else np.arange(len(ids))
    two = np.flatnonzero(right) if right is not None else one
    if not len(one) or not len(two):
        return [], []
    sizes = np.array([len(s) for s in sets])
    x, y = (np.array(v) for v in similar_in_blocks([sets[i][:LARGE_K] for i in one], sizes[one], [sets[i][:LARGE_K] for i in two], sizes[two], threshold / 100))
    x, y = one[x], two[y]
    apart = (c[x] != c[y]) & ((x < y) if right is None else True)
    x, y = x[apart], y[apart]
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    out: tuple[list[int], list[int]] = ([], [])
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = find(int(c[i])), find(int(c[j]))
        if p != q:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                root[max(p, q)] = min(p, q)
                out[0].append(int(min(ids[i], ids[j])))
                out[1].append(int(max(ids[i], ids[j])))
    return out


def similar_in_blocks(one: list[np.ndarray], n_a: np.ndarray, two: list[np.ndarray], n_b: np.ndarray, t: float, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs whose sketches allow similarity ``t`` of their sets of n_a and n_b values.

    Shared values are counted by products of incidence matrices, some columns at a time.
    """
    v_a, v_b = np.concatenate(one), np.concatenate(two)
    row_a, row_b = np.repeat(np.arange(len(one)), [len(s) for s in one]), np.repeat(np.arange(len(two)), [len(s) for s in two])
    known = np.intersect1d(v_a, v_b)
    if not len(known):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared = np.zeros((len(one), len(two)), np.float32)
    col_a, col_b = np.searchsorted(known, v_a), np.searchsorted(known, v_b)
    in_a, in_b = known[np.minimum(col_a, len(known) - 1)] == v_a, known[np.minimum(col_b, len(known) - 1)] == v_b
    for x in range(0, len(known), columns):
        sides = []
        for row, col, there, n in ((row_a, col_a, in_a, len(one)), (row_b, col_b, in_b, len(two))):
            m = np.zeros((n, columns), np.float32)
            pick = there & (col >= x) & (col < x + columns)
            m[row[pick], col[pick] - x] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    # both sketches are complete up to the smaller of their ends
    whole = np.uint64(0xFFFFFFFFFFFFFFFF)
    end_a, end_b = (np.array([s[-1] if len(s) < n else whole for s, n in zip(side, sizes, strict=True)], np.uint64) for side, sizes in ((one, n_a), (two, n_b)))
    upto_a = np.array([np.searchsorted(s, end_b, side="right") for s in one])
    upto_b = np.array([np.searchsorted(s, end_a, side="right") for s in two]).T
    seen = np.maximum(upto_a + upto_b - shared, 1)
    union = np.maximum((n_a[:, None] + n_b[None, :]) / (1 + t), seen)
    slack = 6 * np.sqrt(t * (1 - t) / seen * (1 - seen / union)) + 1e-6
    sizes = np.minimum(n_a[:, None], n_b[None, :]) >= t * np.maximum(n_a[:, None], n_b[None, :]) - 1e-9
    return np.nonzero(sizes & (shared / seen >= t - slack))


def _set_of(column: pa.Array, words: int) -> np.ndarray:
    (_, _, data, offsets), = hashing.slices(column)
    return shingle_sets(data, offsets, words)[0]


def mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, c, m): lists of m sets in different components c; of lists with the same sets, one."""
    rows = lists.select("key", "id").join(labels.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    rows = materialize(rows, "near-rows")
    sums = [F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    keys = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"), *sums).filter("c0 < c1")
    keys = keys.groupBy("m", "sum1", "sum2").agg(F.min("key").alias("key")).select("key", "m")
    return materialize(rows.join(materialize(keys, "near-mixed"), "key"), "near-open")


def star_links(lists: DataFrame, sets: DataFrame, texts: DataFrame, threshold: int, words: int, labels: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of the smallest id of each list with the list's other sets, but for those in one component."""
    stars = materialize(lists.groupBy("key").agg(F.min("id").alias("a")), "near-stars")
    pairs = lists.join(stars, "key").filter("a < id").select("a", F.col("id").alias("b")).distinct()
    if labels is not None:
        side = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    return verify(pairs, sets, texts, threshold, words)


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: int = 85, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of ``docs``.

    Documents whose sets have 100 * intersection >= threshold * union are linked; component_id is
    the smallest id reachable, and kept says that it is the document's own.
    """
    t = threshold / 100
    with scratch(docs.sparkSession):
        all_sets = materialize(sketches(docs, id, text=text, words=words), "near-sketches", up=1)
        classes = all_sets.filter(F.col(id).isNotNull() & (F.col("n_shingles") > 0)).groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct(F.col(id).alias("id"), "sketch")).alias("first"))
        classes = materialize(classes.select("set_a", "set_b", F.col("n_shingles").alias("n"), "first.id", "first.sketch"), "near-classes")
        sets = classes.select("id", "n", "sketch")
        texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
        lists = materialize(keyed(sets, t), "near-postings")
        links = star_links(lists, sets, texts, threshold, words)
        labels = components(links)

        left = small(materialize(mixed(lists, labels).select("id").distinct(), "near-left"), ID_ROWS)
        large = sketches(texts.join(left, "id", "left_semi"), "id", words=words, k=LARGE_K).select("id", F.col("n_shingles").alias("n"), "sketch")
        large = materialize(large.join(sets.select("id"), "id", "left_semi").dropDuplicates(["id"]), "near-large")
        lists = materialize(keyed(large, t, LARGE_K), "near-large-postings")
        some = mixed(lists, labels).select("key", "id")
        links = materialize(links.union(star_links(some, sets, texts, threshold, words, labels)), "near-stars-linked")
        labels = components(links)
        more = materialize(block_links(mixed(lists, labels), texts, threshold, words), "near-block-links", rows=200)
        if not more.isEmpty():
            labels = components(links.union(more))

        found = classes.join(labels, "id", "left").select("set_a", "set_b", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
        found = materialize(found, "near-found", up=1)
    out = all_sets.drop("sketch").join(found, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id))
    return out.select(id, "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id).isNull() | (F.col(id) == F.col("component_id")))
