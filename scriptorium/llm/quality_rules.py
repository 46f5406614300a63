"""Quality rules: document metrics and thresholds from mergeable quantile sketches.

Per document the counts are taken from the whole text with DataFrame functions.  A sketch of each
ratio is built per (language, source) from the documents that pass the base rule: counts of
logarithmic bins, :data:`BIN_BITS` leading bits of the ratio in fixed point.  Counts of bins add up,
so sketches of a language and of the whole corpus are merged from those, and equal input gives equal
sketches however it is partitioned.  A threshold is ``q + spread * share * max(q - q25, floor)`` of
the smallest level with ``least`` documents, q being the ratio's own high quantile; groups smaller
than that take the thresholds of their language, and those of small languages the corpus's.
Thresholds are joined back on (language, source).

Defined cases: null text counts as empty; empty texts fail the base rule; null languages and
sources form groups of their own; texts are counted whole, however long; repeated rows count as
often as they stand; ties share a bin; one result row per input row; an empty table gives none.
Columns to keep may not have the names of metrics and limits (``words``, ``n_words``, ``kept``, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words in a window that counts as repeated.
WINDOW = 8
#: Ratios, each with its two counts.
PARTS = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: High quantile of each ratio in percent, its share of the spread, and the least range that the ratio is taken to have.
#: Poor documents reach beyond the quartiles of symbols and word lengths, sound ones of repeated lines and words too.
RATIOS = {"symbol_ratio": (75, 1, 0.002), "dup_line_ratio": (99, 1 / 3, 0.02), "repeat_ratio": (99, 1 / 3, 0.02), "word_length": (75, 1, 0.05)}
#: Ratios are counted in units of 1 / UNIT; a bin holds values that agree in their BIN_BITS leading bits (within 0.4 %).
UNIT, BIN_BITS = 65536, 9


def metrics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    df = df.select(
        *keep, "n_symbols", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "words",
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    df = df.withColumn("windows", F.when(F.size("words") > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).drop("words")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("ordered", F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.drop("windows").withColumn("positions", F.array_sort(F.array_distinct(F.flatten(_equal_neighbours(F.col("ordered"))))))
    gaps = F.zip_with(F.col("positions"), F.slice("positions", 2, F.greatest(F.size("positions"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))).drop("ordered", "positions")


def _equal_neighbours(ordered: Column) -> Column:
    """Positions, in pairs, of the sorted (h, i) entries whose next entry has the same h."""
    following = F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1)))
    none = F.array().cast("array<int>")
    return F.zip_with(ordered, following, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _bin(above: str, below: str) -> Column:
    """Lower edge of the bin of ``above / below``, in units; integer arithmetic, so that it is exact."""
    units = f"({above} * {UNIT}L) div greatest({below}, 1L)"
    return F.expr(f"shiftleft(shiftright({units}, greatest(length(bin({units})) - {BIN_BITS}, 0)), greatest(length(bin({units})) - {BIN_BITS}, 0))")


def sketches(measured: DataFrame, *groups: str) -> DataFrame:
    """Sketches: ``groups``, ratio, edge and the number of documents in that bin, at most some thousand rows a group."""
    bins = F.array(*[F.struct(F.lit(r).alias("ratio"), _bin(*PARTS[r]).alias("edge")) for r in RATIOS])
    return measured.select(*groups, F.inline(bins)).groupBy(*groups, "ratio", "edge").agg(F.count("*").alias("n"))


def merge(counts: DataFrame, *groups: str) -> DataFrame:
    """Sketches of the coarser ``groups``."""
    return counts.groupBy(*groups, "ratio", "edge").agg(F.sum("n").alias("n"))


def quantiles(counts: DataFrame, *groups: str) -> DataFrame:
    """A row per group: n, and for each ratio the quantiles ``q25_<ratio>`` and ``high_<ratio>``."""
    group = Window.partitionBy(*groups, "ratio")
    df = counts.withColumns({"upto": F.sum("n").over(group.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)})
    at = lambda r, percent: F.min(F.when((F.col("ratio") == r) & (100 * F.col("upto") >= percent * F.col("total")), F.col("edge"))) / F.lit(float(UNIT))
    found = [x for r, (high, _, _) in RATIOS.items() for x in (at(r, 25).alias(f"q25_{r}"), at(r, high).alias(f"high_{r}"))]
    return df.groupBy(*groups).agg(F.max("total").alias("n"), *found)


def thresholds(measured: DataFrame, groups: tuple[str, str] = ("lang", "source"), *, least: int = 200, spread: float = 6.0) -> DataFrame:
    """A row per group with ``max_<ratio>``, and ``min_word_length``.

    Each sketch is mergeable: the levels above a group are merged from its sketches, never
    computed from rows again.
    """
    lang, source = groups
    counts = materialize(sketches(measured, lang, source), "quality-sketches")
    named = lambda df, prefix: df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
    df = quantiles(counts, lang, source)
    by_lang = named(quantiles(merge(counts, lang), lang), "up_")
    whole = named(quantiles(merge(counts)), "all_")
    df = df.join(by_lang, F.col(lang).eqNullSafe(F.col(f"up_{lang}"))).join(F.broadcast(whole))  # one row
    out = []
    for r, (_, share, floor) in RATIOS.items():
        q25, high = (F.when(F.col("n") >= least, F.col(q)).when(F.col("up_n") >= least, F.col(f"up_{q}")).otherwise(F.col(f"all_{q}")) for q in (f"q25_{r}", f"high_{r}"))
        width = F.lit(float(spread * share)) * F.greatest(high - q25, F.lit(floor))
        out.append((high + width).alias(f"max_{r}"))
        if r == "word_length":
            out.append((q25 - width).alias(f"min_{r}"))
    return df.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), *out)


def apply_rules(docs: DataFrame, *keep: str, text: str = "text", groups: tuple[str, str] = ("lang", "source"), least: int = 200, spread: float = 6.0) -> DataFrame:
    """``keep`` columns, the metrics, base_failed and kept."""
    lang, source = groups
    columns = list(dict.fromkeys([*keep, lang, source]))
    measured = metrics(docs, *columns, text=text)
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    measured = measured.withColumns({r: per(*parts) for r, parts in PARTS.items()})
    measured = materialize(measured, "quality-metrics")
    limits = small(materialize(thresholds(measured.filter(~base_failed()), groups, least=least, spread=spread), "quality-thresholds"))
    joined = measured.join(limits, F.col(lang).eqNullSafe(F.col("g_lang")) & F.col(source).eqNullSafe(F.col("g_source")), "left")
    fits = F.lit(True)
    for r in RATIOS:
        fits = fits & (F.col(r) <= F.col(f"max_{r}"))
    fits = fits & (F.col("word_length") >= F.col("min_word_length"))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & F.coalesce(fits, F.lit(True))}).drop("g_lang", "g_source")
