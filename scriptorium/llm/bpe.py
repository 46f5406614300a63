"""Byte-level BPE: DuckDB recursive queries encode, an ordered aggregation decodes.

A text is split by the tokenizer's pattern; each distinct word becomes token-position rows.  A
recursive query joins neighbouring rows with the merge table and contracts, in every word at
once, the leftmost pair of least rank, until no word has a pair left.  Decoding joins the ids
with the vocabulary and concatenates the bytes in order of position.

Words met before are taken from a cache in each Python worker, bounded by ``CACHE_ENTRIES``; it
changes no result.  The merge table has every split of a token into two tokens, which is what a
ranks file means.  A word of n bytes takes up to n rounds; words over ``LONG_WORD`` bytes keep one
updated state instead of all rounds, so memory stays in proportion to n.

Defined cases: null text is encoded as the empty text, null ids decode to no bytes; one row per
input row; an empty table gives none.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back, small_batches

#: White space as the tokenizer's pattern has it (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A token always starts at a space before something that is no white space.
_CUT = re.compile(f" (?=[^{WHITE}])")
_ODD = re.compile(f" [{WHITE}]| \\Z")

#: Entries of a worker's caches, and of one that keeps nothing after its task.
CACHE_ENTRIES, TASK_ENTRIES = 600_000, 200_000
#: Longest chunk, in characters, that is cached.
CACHED_CHARS = 64
LONG_WORD = 256
#: Bytes of distinct words in one recursive query.
QUERY_BYTES = 500_000

# As every round re-emits the words that it contracts, the last round of a word is the one with
# the fewest rows; rounds are numbered to tell it.
ENCODE = """
WITH RECURSIVE s(n, key, tok) AS (
  SELECT 0, key, tok FROM base
  UNION ALL
  (WITH c AS (
     SELECT a.key >> 32 AS w, min((m.rank << 32) + (a.key & 4294967295)) AS k
     FROM s a JOIN s b ON b.key = a.key + 1 JOIN merges m ON m.pair = (a.tok << 24) + b.tok
     GROUP BY 1)
   SELECT s.n + 1,
          CASE WHEN (s.key & 4294967295) > (c.k & 4294967295) THEN s.key - 1 ELSE s.key END,
          CASE WHEN (s.key & 4294967295) = (c.k & 4294967295) THEN c.k >> 32 ELSE s.tok END
   FROM s JOIN c ON (s.key >> 32) = c.w
   WHERE (s.key & 4294967295) <> (c.k & 4294967295) + 1)
),
ended AS (SELECT key >> 32 AS w, max(n) AS n FROM s GROUP BY 1)
SELECT s.key >> 32 AS w, s.tok AS tok
FROM s JOIN ended ON (s.key >> 32) = ended.w AND s.n = ended.n
ORDER BY s.key
"""

ENCODE_LONG = """
WITH RECURSIVE s(key, tok) USING KEY (key) AS (
  SELECT key, tok FROM base
  UNION
  (WITH p AS (
     SELECT key, tok, lead(tok) OVER o AS next_tok, lead(key) OVER o AS next_key
     FROM recurring.s WHERE tok >= 0 WINDOW o AS (PARTITION BY key >> 32 ORDER BY key)),
   c AS (
     SELECT min((m.rank << 32) + (p.key & 4294967295)) AS k, arg_min(p.key, (m.rank << 32) + (p.key & 4294967295)) AS key,
            arg_min(p.next_key, (m.rank << 32) + (p.key & 4294967295)) AS dead
     FROM p JOIN merges m ON m.pair = (p.tok << 24) + p.next_tok GROUP BY p.key >> 32)
   SELECT unnest([key, dead]), unnest([k >> 32, -1]) FROM c)
)
SELECT key >> 32 AS w, tok FROM s WHERE tok >= 0 ORDER BY key
"""

DECODE = """
SELECT doc, string_agg(hex, '') AS hex
FROM (SELECT d.doc, v.hex FROM ids d JOIN vocabulary v ON v.id = d.id ORDER BY d.pos)
GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes in one Python worker; ``path`` is the ranks file, ``pattern`` splits texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.whole = ranks
        self.db = _database()
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (pa.array(x, pa.int64()) for x in zip(*splits, strict=True))
        self.db.register("splits", pa.table({"l": left, "r": right, "rank": rank}))
        self.db.execute("CREATE TABLE merges AS SELECT (l << 24) + r AS pair, rank FROM splits")
        self.db.unregister("splits")
        self.entries = CACHE_ENTRIES
        self.words: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> None:
        """Puts the ids of each word, as int32 bytes, into ``self.words``."""
        short, long, size = [], [], 0
        for w in words:
            b = w.encode()
            if (i := self.whole.get(b)) is not None:
                self.words[w] = np.int32(i).tobytes()
            elif len(b) > LONG_WORD:
                long.append((w, b))
            else:
                short.append((w, b))
                size += len(b)
                if size >= QUERY_BYTES:
                    self._query(ENCODE, short)
                    short, size = [], 0
        if short:
            self._query(ENCODE, short)
        for x in long:
            self._query(ENCODE_LONG, [x])

    def _query(self, sql: str, words: list[tuple[str, bytes]]) -> None:
        lengths = np.array([len(b) for _, b in words], np.int64)
        number = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        at = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tokens = self.byte_ids[np.frombuffer(b"".join(b for _, b in words), np.uint8)]
        self.db.register("base", pa.table({"key": pa.array((number << 32) + at), "tok": pa.array(tokens)}))
        found = self.db.sql(sql).to_arrow_table()
        self.db.unregister("base")
        w, tok = found["w"].to_numpy(), found["tok"].to_numpy().astype(np.int32)
        ends = np.searchsorted(w, np.arange(len(words)), side="right").tolist()
        start = 0
        for (word, _), end in zip(words, ends, strict=True):
            self.words[word] = tok[start:end].tobytes()
            start = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.words) > self.entries:
            self.words.clear()
        if len(self.first) + len(self.spaced) > self.entries:
            self.first.clear()
            self.spaced.clear()
        cut = [(t.split(" ") if not _ODD.search(t) else _CUT.split(t)) if t else [] for t in texts]
        found: list[list[bytes | None]] = []
        new = set()
        for chunks in cut:
            ids = list(map(self.spaced.get, chunks))
            if chunks:
                ids[0] = self.first.get(chunks[0])
                if None in ids:
                    new.update((" " if i else "") + c for i, (c, x) in enumerate(zip(chunks, ids, strict=True)) if x is None)
            found.append(ids)
        parts = {c: self.pattern.findall(c) for c in new}
        spaced = self.spaced

        def get(w: str) -> bytes | None:
            return self.words.get(w) or (spaced.get(w[1:]) if w[0] == " " else None)

        self._encode_words(list({w for words in parts.values() for w in words if not get(w)}))
        beyond: dict[str, bytes] = {}
        for c, words in parts.items():
            ids = b"".join(map(get, words))
            beyond[c] = ids
            if len(c) <= CACHED_CHARS:
                if c[:1] == " ":
                    self.spaced[c[1:]] = ids
                else:
                    self.first[c] = ids
        for c, words in parts.items():  # kept once
            if len(words) == 1 and c[:1] == " " and len(c) <= CACHED_CHARS:
                self.words.pop(c, None)
        for chunks, ids in zip(cut, found, strict=True):
            if None in ids:
                ids[:] = [beyond[(" " if i else "") + c] if x is None else x for i, (c, x) in enumerate(zip(chunks, ids, strict=True))]
        return [np.frombuffer(b"".join(ids), np.int32) for ids in found]


class Decoder:
    """Decodes in one Python worker."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.db = _database()
        self.db.register("tokens", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, hex FROM tokens")
        self.db.unregister("tokens")

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Bytes of each run of ``lengths`` ids."""
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int64), "id": ids}))
        rows = self.db.execute(DECODE).fetchall()
        self.db.unregister("ids")
        out = [b""] * len(lengths)
        for d, h in rows:
            out[d] = bytes.fromhex(h)
        return out


def _database():
    import duckdb

    # one thread: rows then reach the aggregation in the order of the sort
    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; workers are used again by later tasks."""
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` in all, or of a single row."""
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None, forget: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) instead of ``text``, and with ``decoded`` (binary) of these ids if named.

    With ``forget`` a worker keeps nothing after its task, for jobs whose workers go on to other stages.
    """
    keep = [f for f in docs.schema.fields if f.name not in (text, ids, decoded)]
    more = [T.StructField(decoded, T.BinaryType())] if decoded else []
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *more])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        own.entries = TASK_ENTRIES if forget else CACHE_ENTRIES
        back = decoder(path) if decoded else None
        for batch in batches:
            column = batch.column(text)
            for a, b in _slices(_lengths(column), 1_000_000):
                found = own.encode(column.slice(a, b - a).to_pylist())
                lengths = np.array([len(x) for x in found], np.int64)
                values = np.concatenate(found)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))
                columns = [*[batch.column(f.name).slice(a, b - a) for f in keep], lists]
                if back:
                    columns.append(pa.array(back.decode(values, lengths), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        if forget:
            _close(encoder, own)
            if back:
                _close(decoder, back)
            del own, back
            give_back()

    return docs.select(*[f.name for f in keep], text).mapInArrow(run, schema)


def _close(cache, coder: Encoder | Decoder) -> None:
    cache.cache_clear()
    coder.db.close()


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def decode(docs: DataFrame, path: str, *, ids: str = "ids", decoded: str = "decoded", forget: bool = False) -> DataFrame:
    """``docs`` with ``decoded`` (binary) of ``ids``; ``forget`` as in :func:`encode`."""
    keep = [f for f in docs.schema.fields if f.name != decoded]
    schema = T.StructType([*keep, T.StructField(decoded, T.BinaryType())])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        own = decoder(path)
        for batch in batches:
            column = batch.column(ids)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _slices(lengths, 500_000):
                flat = column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                values = pa.array(own.decode(flat, lengths[a:b]), pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(a, b - a) for f in keep], values], [*[f.name for f in keep], decoded])
        if forget:
            _close(decoder, own)
            del own
            give_back()

    return docs.select(*[f.name for f in keep]).mapInArrow(run, schema)
