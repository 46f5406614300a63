"""Numbers: vectors, similarities, scores, robust parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters, white space left out."""
    chars = lambda c: F.array_distinct(F.split(F.regexp_replace(c, r"\s+", ""), ""))
    union = F.size(F.array_union(chars(a), chars(b)))
    return F.when(union > 0, F.size(F.array_intersect(chars(a), chars(b))) / union).otherwise(0.0)


def idf(n: Column, df: Column) -> Column:
    """Always positive inverse document frequency."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the larger size; 1 if both are empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def judge_score(raw: Column) -> Column:
    """(score, raw_score, rationale, parse_ok) of a judge's answer: JSON, fenced JSON or a bare score."""
    body = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.get_json_object(body, "$.score").try_cast("int")
    embedded = F.nullif(F.regexp_extract(raw, r'"score"\s*:\s*(\d+)', 1), F.lit("")).try_cast("int")
    value = F.coalesce(parsed, embedded)
    ok = value.isNotNull()
    kept = F.when(ok, F.least(F.greatest(value, F.lit(0)), F.lit(5))).otherwise(0)
    return F.struct((kept / 5.0).alias("score"), kept.alias("raw_score"), F.coalesce(F.get_json_object(body, "$.rationale"), F.lit("")).alias("rationale"), ok.alias("parse_ok"))


def page_bounds(spec: Column) -> Column:
    """(lo, hi) of a JSON page: a whole number, [lo, hi], or null for anything else."""
    text = F.trim(spec)
    one = F.when(text.rlike(r"^-?\d+$"), text.try_cast("int"))
    pair = F.when(text.rlike(r"^\[\s*-?\d+\s*,\s*-?\d+\s*\]$"), F.from_json(text, "array<int>"))
    return F.struct(F.coalesce(one, F.get(pair, 0)).alias("lo"), F.coalesce(one, F.get(pair, 1)).alias("hi"))


def in_interval(page: Column, lo: Column, hi: Column, tolerance: int = 0) -> Column:
    return F.coalesce(page.between(lo - tolerance, hi + tolerance), F.lit(False))


def display_share(score: Column, low: Column, high: Column, comparable: bool) -> Column:
    """Share of a bar: the clamped score, or its place between the pool's ends (1 for a constant pool)."""
    if comparable:
        return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def relation(score: Column) -> Column:
    return F.when(score >= 0.78, "strong").when(score >= 0.55, "medium").otherwise("weak")


def fingerprint(content: Column, digits: int = 12) -> Column:
    """Short SHA-256 of a text, whatever its line ends."""
    return F.substring(F.sha2(F.regexp_replace(content, "\r\n", "\n"), 256), 1, digits)


#: Numbers of a hash vector.
DIMS = 16


def hash_vector(text: Column, dims: int = DIMS) -> Column:
    """Deterministic stand-in for an embedding: hashed counts of a text's words."""
    from .text import terms

    words = F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    # bound as an element, words are made once; a count is what goes when a number is removed
    counts = F.transform(F.array(words), lambda ws: F.array(*[(F.size(ws) - F.size(F.array_remove(ws, F.lit(j)))).cast("double") for j in range(dims)]))
    return F.when(text.isNotNull(), F.element_at(counts, 1))
