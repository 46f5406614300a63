"""Repeated byte windows of a fixed length: depth-limited radix sort of suffixes.

Only the first ``length`` bytes of a suffix count, so ordering suffixes by most-significant-digit
passes ends with groups that are exactly the repeated windows.  The passes run over all texts at
once, each splitting the groups of the pass before by longer digits:

* First pass: a window belongs to the leftmost smallest hash of its ``GRAM``-byte digits, its
  anchor.  Windows in a row share an anchor; equal windows have equal anchors.  Anchors whose digit
  occurs once end here.
* A run of windows is compared as a whole by the 128-bit hash of its bytes: if these occur again,
  all its windows are repeated and need no later pass.  Other runs in a group whose digit repeats go
  on, with one run of each repeated content, and only their bytes do.
* The second pass splits runs at fixed distances from the anchor and takes the bytes common to all
  windows of a piece as digit; the third compares single windows.

Groups are counted by partial sums and never gathered in a task.  Spans found are joined back to
the texts.  Matches never cross texts; a window that occurs twice in one text is repeated as well.

Defined cases: null text counts as empty; texts shorter than ``length`` keep all bytes; ids may be
null, repeated or missing, since texts are told apart by content; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import materialize, small

LENGTH = 400
GRAM = 128
#: Windows in a piece of the second pass.
PIECE = 32
#: Row bounds of broadcasts; beyond them the joins shuffle.
DIGIT_ROWS, SPAN_ROWS = 1_000_000, 400_000

RUNS = "uid binary, anchor int, s1 int, s2 int, digit long, whole_a long, whole_b long"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, digit, whole_a, whole_b) of each run of windows."""
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return tuple(np.empty(0, np.int64) for _ in range(7))
    sums = hashing.prefix(data)
    at = np.arange(len(data) - gram + 1)
    digits = hashing.spans(sums, at, at + gram)
    bits = np.uint64((1 << max(1, int(len(data)).bit_length())) - 1)
    least = sliding_min((digits & ~bits) | at.astype(np.uint64), length - gram + 1)
    count = sizes[long] - length + 1
    starts = np.arange(count.sum()) + np.repeat(offsets[long] - (np.cumsum(count) - count), count)
    anchor = (least[starts] & bits).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    a, s1, s2 = anchor[first], starts[first], starts[last]
    more = hashing.prefix(data, 1)
    text = np.searchsorted(offsets, s1, side="right") - 1
    base = offsets[text]
    return text, a - base, s1 - base, s2 - base, hashing.signed(digits[a]), hashing.signed(hashing.spans(sums, s1, s2 + length)), hashing.signed(hashing.spans(more, s1, s2 + length, 1))


def find_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of windows of each (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid")
            for a, b, data, offsets in hashing.slices(batch.column("text")):
                text, anchor, s1, s2, *hashes = runs(data, offsets, length, gram)
                columns = [uid.slice(a, b - a).take(pa.array(text)), *[pa.array(x.astype(np.int32)) for x in (anchor, s1, s2)], *map(pa.array, hashes)]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "anchor", "s1", "s2", "digit", "whole_a", "whole_b"])

    return texts.mapInArrow(run, RUNS)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs whose bytes occur again, runs for the next pass) of runs that one pass has made.

    A row marked ``known`` has been reported before.
    """
    wholes = rows.groupBy("digit", "whole_a", "whole_b").agg(F.count("*").alias("n"), F.min(F.struct("uid", "anchor", "s1", "s2", "known")).alias("one"))
    wholes = materialize(wholes, "suffix-wholes")
    groups = wholes.groupBy("digit").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("alone"))
    groups = materialize(groups.filter("total > 1 AND alone > 0").select("digit"), "suffix-groups")
    repeated = materialize(wholes.filter("n > 1").select("digit", "whole_a", "whole_b"), "suffix-repeated")
    found = rows.filter("NOT known").join(repeated, ["digit", "whole_a", "whole_b"], "left_semi").select("uid", "s1", "s2")
    onward = wholes.join(groups, "digit", "left_semi").select("one.uid", "one.anchor", "one.s1", "one.s2", (F.col("one.known") | (F.col("n") > 1)).alias("known"))
    return found, materialize(onward, "suffix-onward")


def pieces(contexts: DataFrame, length: int, size: int) -> DataFrame:
    """Runs of ``contexts`` split every ``size`` windows, counted from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "s1", "s2")]
            for x, y, data, offsets in hashing.slices(batch.column("bytes").cast(pa.large_binary())):
                anchor, s1, s2 = (n[x:y] for n in numbers)
                low, high = (anchor - s2) // size, (anchor - s1) // size
                count = high - low + 1
                row = np.repeat(np.arange(y - x), count)
                d0 = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[row]) * size
                first = np.maximum(s1[row], anchor[row] - d0 - size + 1)
                last = np.minimum(s2[row], anchor[row] - d0)
                shift = offsets[row] - s1[row]
                sums, more = hashing.prefix(data), hashing.prefix(data, 1)
                core = hashing.spans(sums, anchor[row] - d0 + shift, anchor[row] - d0 - size + 1 + length + shift)
                digit = hashing.mix(core + d0.astype(np.uint64))
                wholes = [hashing.spans(h, first + shift, last + length + shift, lane) for lane, h in enumerate((sums, more))]
                take = pa.array(row)
                columns = [batch.column("uid").slice(x, y - x).take(take), *[pa.array(v.astype(np.int32)) for v in (anchor[row], first, last)], *[pa.array(hashing.signed(v)) for v in (digit, *wholes)], batch.column("known").slice(x, y - x).take(take)]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "anchor", "s1", "s2", "digit", "whole_a", "whole_b", "known"])

    return contexts.mapInArrow(run, RUNS + ", known boolean")


def cut_contexts(texts: DataFrame, onward: DataFrame, length: int) -> DataFrame:
    """``onward`` with the bytes of each run."""
    by_text = onward.groupBy("uid").agg(F.collect_list(F.struct("anchor", "s1", "s2", "known")).alias("runs"))
    rows = texts.join(small(materialize(by_text, "suffix-wanted"), SPAN_ROWS), "uid").select("uid", F.encode("text", "UTF-8").alias("t"), F.explode("runs").alias("r"))
    bytes_ = F.expr(f"substring(t, r.s1 + 1, r.s2 - r.s1 + {length})")
    # texts with the same content give the same runs
    rows = rows.select("uid", "r.anchor", "r.s1", "r.s2", "r.known", bytes_.alias("bytes")).dropDuplicates(["uid", "anchor"])
    return materialize(rows, "suffix-contexts")


def merged(spans: Column) -> Column:
    """Sorted spans, those that meet as one."""

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        meets = F.when(F.size(out) > 0, s["start"] <= last["end"]).otherwise(False)
        return F.when(meets, F.array_append(F.slice(out, 1, F.size(out) - 1), longer)).otherwise(F.array_append(out, s))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def remove_repeats(docs: DataFrame, *keep: str, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``keep`` columns with n_bytes, n_removed, n_spans and ``kept_bytes`` (binary) of each row.

    Every byte that a ``length``-byte string covers which also starts elsewhere is removed.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(own.alias("text")).filter(F.octet_length("text") >= length).select(F.unhex(F.md5("text")).alias("uid"), "text")
    all_runs = materialize(find_runs(texts, length, gram), "suffix-runs")
    digits = materialize(all_runs.groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1").select("digit"), "suffix-digits")
    rows = materialize(all_runs.join(small(digits, DIGIT_ROWS), "digit", "left_semi").withColumn("known", F.lit(False)), "suffix-rows")
    found, onward = split(rows)
    contexts = cut_contexts(texts, onward, length)
    found2, onward = split(materialize(pieces(contexts, length, PIECE), "suffix-pieces"))
    parts = contexts.select("uid", "anchor", F.col("s1").alias("from"), "bytes").join(onward, ["uid", "anchor"]).filter("s1 >= from")
    # an anchor has one run in a text, so this meets the run that a piece came from
    parts = parts.select("uid", "anchor", "s1", "s2", "known", F.expr(f"substring(bytes, s1 - from + 1, s2 - s1 + {length})").alias("bytes"))
    found3, _ = split(materialize(pieces(parts, length, 1), "suffix-windows"))
    spans = found.union(found2).union(found3).select("uid", F.struct(F.col("s1").alias("start"), (F.col("s2") + length).alias("end")).alias("span"))
    spans = spans.groupBy("uid").agg(F.array_sort(F.collect_set("span")).alias("spans"))  # one text's spans
    spans = materialize(spans.select("uid", merged(F.col("spans")).alias("spans")), "suffix-spans")
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_bytes binary").fields])
    rows = docs.select(*keep, own.alias("_t"), F.unhex(F.md5(own)).alias("uid")).join(small(spans, SPAN_ROWS), "uid", "left").select(*keep, "_t", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for t, s in zip(batch.column("_t").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                edges = [0, *[e for x in s or () for e in (x["start"], x["end"])], len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if s else t)
                n_bytes.append(len(t))
                n_removed.append(len(t) - len(kept[-1]))
                n_spans.append(len(s or ()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)
