"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Pattern spans are leftmost and non-overlapping per kind.  Candidate strings for the entropy
kind are maximal runs of token characters; for each class a window slides over the string with
its character counts and the sum of c*log2(c) updated by the character that enters and the one
that leaves.  A string whose best window reaches its class's bits is a span unless an
allow-list pattern fits it or a pattern span overlaps it.  Only DataFrame functions are used.

Positions are code points, ends exclusive.  Defined cases: null text counts as empty and has no
spans; equal rows give equal results, one per input row; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # equal to runs of AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"  # equal to runs of [0-9a-f]+ of 32 characters or more
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGNED = 8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Character classes in order, each with the bits a window of its strings must reach.
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Za-z0-9]+$", 3.7), (r"^[A-Za-z0-9+/_=-]+$", 3.9))
#: Strings that look random but are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
)

SPAN = "array<struct<start:bigint,end:bigint>>"


def _spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """(start, end) of each match, less those whose group is shorter than ``least``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(m).cast("long").alias("n"), F.length(F.get(values, i)).alias("value")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["n"]).alias("at"), F.array_append(state["out"], span).alias("out"))

    spans = F.filter(F.aggregate(rows, zero, step, lambda s: s["out"]), lambda s: s["value"] >= least)
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def window_bits(string: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of a window of ``string`` over ALPHABET."""
    chars = F.split(string, "")
    weight = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(state: Column, i: Column) -> Column:
        enters = F.instr(F.lit(ALPHABET), F.get(chars, i))
        leaves = F.when(i >= window, F.instr(F.lit(ALPHABET), F.get(chars, i - window))).otherwise(0)
        a, b = F.get(state["counts"], enters - 1), F.get(state["counts"], leaves - 1)
        moved = enters != leaves
        total = state["sum"] + F.when(moved, weight(a + 1) - weight(a) + F.when(leaves > 0, weight(b - 1) - weight(b)).otherwise(0.0)).otherwise(0.0)
        counts = F.when(moved, F.transform(state["counts"], lambda c, j: c + (j + 1 == enters).cast("int") - (j + 1 == leaves).cast("int"))).otherwise(state["counts"])
        bits = F.log2(F.lit(float(window))) - total / window
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= window - 1, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.length(string) - 1), zero, step, lambda s: s["best"])


def _is_random(string: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | string.rlike(pattern)
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        least = F.when(string.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(window_bits(string) >= least)


def _numbered(spans: Column, kind_no: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns with ``secret_spans``: array of (start, kind_no, end) by start, then kind."""
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    df = df.select(*keep, "_t", _spans(t, ASSIGN, 2, LEAST_ASSIGNED).alias("_assign"), _spans(t, ACCESS).alias("_access"), _spans(t, HEX).alias("_hex"), _spans(t, CANDIDATE).alias("_runs"))
    base = F.concat("_assign", "_access", "_hex")
    fresh = F.filter("_runs", lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    df = df.withColumn("_fresh", F.when(F.size("_runs") > 0, fresh).otherwise(F.array().cast(SPAN)))
    entropy = F.filter("_fresh", lambda r: _is_random(t.substr((r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))))
    df = df.withColumn("_entropy", F.when(F.size("_fresh") > 0, entropy).otherwise(F.array().cast(SPAN)))
    kinds = [_numbered(F.col(f"_{k}"), n) for n, k in enumerate(KINDS)]
    return df.select(*keep, F.array_sort(F.concat(*kinds)).alias("secret_spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = text.substr((state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        out = F.when((s["start"] < state["at"]) & (state["at"] > 0), state["out"]).otherwise(F.concat(state["out"], between, F.lit(mark)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
