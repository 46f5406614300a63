"""Which of many terms stand in which texts, as substrings: all terms of a source at once.

Texts and terms meet in cells, a bounded share of a source's texts with a bounded share of its
terms.  In a cell, windows of eight bytes over the texts are looked up among the terms' first
bytes; what is found is compared byte by byte, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.sized import sized_broadcast
from ..sources.stored import settle

#: Bytes of texts and number of terms in a cell, cells to aim at, bytes of texts and pairs looked at together.
CELL, TERMS, SHARE, CHUNK, PAIRS = 16 << 20, 500_000, 96, 1 << 20, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


class Terms:
    """Terms as bytes, not empty, each once; found by their first eight bytes."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.size = np.array([len(t) for t in terms], np.int64)
        short = np.minimum(self.size, 8)
        key = np.array([int.from_bytes(t[:8], "little") for t in terms], np.uint64)
        self.tiers = []
        for n in np.unique(short).tolist():
            own = np.flatnonzero(short == n)
            own = own[np.argsort(key[own], kind="stable")]
            keys, starts = np.unique(key[own], return_index=True)
            bits = int(min(max(len(keys) * 16, 1 << 12), 1 << 22) - 1).bit_length()
            shift = np.uint64(64 - bits)
            seen = np.zeros(1 << bits, bool)
            seen[keys * _MIX >> shift] = True
            self.tiers.append((n, own, keys, np.append(starts, len(own)), shift, seen))

    def places(self, buffer: bytes, n: int):
        """(place, term) of all occurrences that start in the first ``n`` bytes; the rest of ``buffer`` is at least eight bytes."""
        windows = np.ascontiguousarray(np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,)))
        for width, own, keys, starts, shift, seen in self.tiers:
            here = windows[:n] & _mask(width)
            at = np.flatnonzero(seen[here * _MIX >> shift])
            k = np.minimum(np.searchsorted(keys, here[at]), len(keys) - 1)
            same = keys[k] == here[at]
            at, k = at[same], k[same]
            many = starts[k + 1] - starts[k]
            ends = np.cumsum(many)
            first = 0
            while first < len(at):  # as many places as make about PAIRS pairs
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
                count = many[first:last]
                place = np.repeat(at[first:last], count)
                nth = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
                term = own[np.repeat(starts[k[first:last]], count) + nth]
                if width == 8:
                    fits = place + self.size[term] <= len(buffer)
                    place, term = place[fits], term[fits]
                    fits = windows[place + self.size[term] - 8] == self.tails[term]
                    place, term = place[fits], term[fits]
                    fits = [self.size[t] <= 16 or buffer[p : p + self.size[t]] == self.terms[t] for p, t in zip(place.tolist(), term.tolist(), strict=True)]
                    place, term = place[np.array(fits, bool)], term[np.array(fits, bool)]
                yield place, term
                first = last

    @property
    def tails(self) -> np.ndarray:
        if not hasattr(self, "_tails"):
            self._tails = np.array([int.from_bytes(t[-8:], "little") for t in self.terms], np.uint64)
        return self._tails

    def first(self, bodies: list[bytes], kinds: np.ndarray) -> list[tuple[int, int]]:
        """(term, number of body): for each term and kind of body the first body that holds it."""
        known, out, at = np.empty(0, np.int64), [], 0
        n_kinds = int(kinds.max()) + 1 if len(kinds) else 1
        longest = int(self.size.max())
        while at < len(bodies):
            end, size = at, 0
            while end < len(bodies) and (end == at or size + len(bodies[end]) <= CHUNK):
                size += len(bodies[end]) + 1
                end += 1
            starts = np.cumsum([0] + [len(b) + 1 for b in bodies[at : end - 1]])
            buffer = b"\xff".join(bodies[at:end]) + b"\xff" * (max(longest, 8) + 1)  # no byte of UTF-8
            for place, term in self.places(buffer, size):
                body = np.searchsorted(starts, place, "right") - 1 + at
                code = term * n_kinds + kinds[body]
                order = np.lexsort((body, code))
                code, body = code[order], body[order]
                new = np.append(True, code[1:] != code[:-1])[: len(code)]
                code, body = code[new], body[new]
                if len(known):
                    new = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] != code
                    code, body = code[new], body[new]
                out += zip((code // n_kinds).tolist(), body.tolist(), strict=True)
                known = np.sort(np.concatenate((known, code)))
            at = end
        return out


def find_terms(nodes: DataFrame, terms: DataFrame, *, first: bool = False) -> DataFrame:
    """(source_id, term, rank, lo, hi): per term each (lo, hi) of a node of its source that holds it, or only those of the ``first`` such node by rank.

    ``nodes`` (source_id, rank, lo, hi, text) and ``terms`` (source_id, term) are compared without white space and case.
    """
    wanted = settle(terms.select("source_id", "term", tx.squeeze(F.col("term")).alias("needle")).filter("needle <> '' AND source_id IS NOT NULL").distinct(), "terms")
    needles = wanted.select("source_id", "needle").distinct()
    size = nodes.join(sized_broadcast(wanted.select("source_id").distinct()), "source_id", "left_semi").groupBy("source_id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    size = settle(size.join(needles.groupBy("source_id").agg(F.count("*").alias("n")), "source_id"), "sources")
    total = size.agg(F.sum("bytes")).first()[0] or 0
    cell = min(CELL, max(1 << 20, total // SHARE))
    size = size.select("source_id", F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / cell).alias("parts"), F.ceil(F.col("n") / TERMS).alias("slices"))
    of_term = F.pmod(F.xxhash64("needle"), F.col("slices"))
    n = int(size.agg(F.sum(F.col("parts") * F.col("slices"))).first()[0] or 1)
    keys = ["source_id", "part", "slice"]
    size = sized_broadcast(size)
    bodies = nodes.join(size, "source_id").withColumn("body", tx.squeeze(F.col("text"))).filter("body <> ''")
    bodies = bodies.select("source_id", F.pmod(F.xxhash64("body", "rank"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.col("rank").cast("long").alias("rank"), F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "body")
    spread = needles.join(size, "source_id").select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), of_term.alias("slice"), "needle")
    kind = nodes.schema["source_id"].dataType.simpleString()

    def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        held = held.sort_by("rank")
        texts = [b.encode() for b in held["body"].to_pylist()]
        pages = list(zip(held["lo"].to_pylist(), held["hi"].to_pylist(), strict=True))
        place = {p: i for i, p in enumerate(dict.fromkeys(pages))}
        kinds = np.array([0 if first else place[p] for p in pages], np.int64)
        found = Terms([t.encode() for t in asked["needle"].to_pylist()]).first(texts, kinds) if texts and len(asked) else []
        t, b = pa.array([t for t, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())
        return pa.table({"source_id": pa.array([key[0].as_py()] * len(found), held.schema.field("source_id").type), "needle": asked["needle"].take(t), **{c: held[c].take(b) for c in ("rank", "lo", "hi")}})

    n = max(1, min(n, 4096))
    pairs = bodies.repartition(n, *keys).groupBy(*keys).cogroup(spread.repartition(n, *keys).groupBy(*keys))
    found = pairs.applyInArrow(run, f"source_id {kind}, needle string, rank bigint, lo int, hi int")
    if first:
        found = found.groupBy("source_id", "needle").agg(F.min(F.struct("rank", "lo", "hi")).alias("s")).select("source_id", "needle", "s.*")
    else:
        found = found.groupBy("source_id", "needle", "lo", "hi").agg(F.min("rank").alias("rank"))
    return wanted.join(found, ["source_id", "needle"]).select("source_id", "term", "rank", "lo", "hi")
