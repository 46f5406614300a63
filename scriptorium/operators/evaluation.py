"""Evaluation of retrieval runs: metrics, run comparison, regression verdicts, identity, error mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numeric

METRICS = ("hit_rate", "mrr", "precision", "recall")
#: Worse verdicts have larger numbers (fixed values).
SEVERITY = {"pass": 0, "no_baseline": 1, "warn": 2, "incomparable": 3, "regression": 4, "failed": 5}
IDENTITY = ("config_hash8", "index_dirname", "mode", "top_k", "questions_sha12", "expected_sha12", "nodes_sha12")


def relevant(source: Column, page: Column, section: Column, want_source: Column, lo: Column, hi: Column, keyword: Column) -> Column:
    """Every condition that is given must hold: source equal, page in [lo, hi], keyword in section as written."""
    return (
        (want_source.isNull() | source.eqNullSafe(want_source)) & (lo.isNull() | numeric.in_interval(page, lo, hi))
        & (F.nullif(keyword, F.lit("")).isNull() | F.coalesce(F.instr(section, keyword) > 0, F.lit(False)))
    )


def question_metrics(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, hit_rate, mrr, precision, recall) of each question with expectations.

    ``hits`` is (qid, rank, node_id), ``truth`` (qid, node_id), one row per expected node.
    Precision divides by the rows returned; questions without expectations aren't counted.
    """
    cut = hits.filter(F.col("rank") <= k).select("qid", "node_id", "rank")
    want = truth.select("qid", "node_id").distinct()
    judged = cut.join(want.withColumn("rel", F.lit(1)), ["qid", "node_id"], "left")
    per = judged.groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.coalesce("rel", F.lit(0))).alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    rows = want.groupBy("qid").agg(F.count("*").alias("expected")).join(per, "qid", "left")
    found = F.coalesce("found", F.lit(0))
    return rows.select(
        "qid", (found > 0).cast("double").alias("hit_rate"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(found / F.col("n"), F.lit(0.0)).alias("precision"), (found / F.col("expected")).alias("recall"),
    )


def interval_metrics(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """As :func:`question_metrics`, for expectations by source, page interval and section keyword.

    ``hits``: qid, rank, source_id, page_print, section; ``expected``: qid, source_id, page_lo, page_hi, section_keyword.
    """
    e = expected.select("qid", F.monotonically_increasing_id().alias("eid"), F.col("source_id").alias("want"), "page_lo", "page_hi", "section_keyword")
    cut = hits.filter(F.col("rank") <= k)
    pairs = cut.join(e, "qid").filter(relevant(F.col("source_id"), F.col("page_print"), F.col("section"), F.col("want"), F.col("page_lo"), F.col("page_hi"), F.col("section_keyword")))
    good = pairs.groupBy("qid").agg(F.count_distinct("rank").alias("found"), F.min("rank").alias("first"), F.count_distinct("eid").alias("matched"))
    counts = e.groupBy("qid").agg(F.count("*").alias("n_expected")).join(cut.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").join(good, "qid", "left")
    return counts.select(
        "qid", F.col("found").isNotNull().cast("double").alias("hit_rate"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)).alias("precision"), F.coalesce(F.col("matched") / F.col("n_expected"), F.lit(0.0)).alias("recall"),
    )


def aggregate_metrics(per_question: DataFrame, digits: int = 4) -> DataFrame:
    """Means over the questions that have expectations; null if there are none."""
    return per_question.agg(F.count("*").alias("n_questions"), *[F.round(F.avg(m), digits).alias(m) for m in METRICS])


def skipped(questions: DataFrame, truth: DataFrame) -> DataFrame:
    """Questions without expectations."""
    return questions.select("qid").join(truth.select("qid"), "qid", "left_anti")


def top_ids(hits: DataFrame, k: int, name: str = "ids") -> DataFrame:
    rows = hits.filter(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id"))).alias("_h"))  # k per question
    return rows.select("qid", F.transform("_h", lambda h: h["node_id"]).alias(name))


def run_overlap(previous: DataFrame, current: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, overlap, same_first) per question; no hits on both sides overlap fully but do not agree on the first."""
    empty = F.array().cast("array<string>")
    a, b = (top_ids(h.withColumn("node_id", F.col("node_id").cast("string")), k, n) for h, n in ((previous, "a"), (current, "b")))
    rows = questions.select("qid").join(a, "qid", "left").join(b, "qid", "left").select("qid", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    return rows.select("qid", numeric.overlap(F.col("a"), F.col("b")).alias("overlap"), F.coalesce(F.get("a", 0) == F.get("b", 0), F.lit(False)).alias("same_first"), (F.size("a") == 0).alias("empty_before"), (F.size("b") == 0).alias("empty_now"))


def run_delta(overlap: DataFrame) -> DataFrame:
    """One row: mean overlap, agreement on the first hit, counts of empty questions."""
    return overlap.agg(
        F.round(F.avg("overlap"), 4).alias("mean_overlap"), F.round(F.avg(F.col("same_first").cast("double")), 4).alias("first_agreement"),
        F.count_if("empty_before").alias("n_empty_before"), F.count_if("empty_now").alias("n_empty_now"),
    )


def metric_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, before, now, delta) of metrics that both runs have; inputs are (metric, value)."""
    a, b = previous.select("metric", F.col("value").alias("before")), current.select("metric", F.col("value").alias("now"))
    rows = a.join(b, "metric").filter("before IS NOT NULL AND now IS NOT NULL")
    return rows.withColumn("delta", F.round(F.col("now") - F.col("before"), 4))


def incomparable_reasons(before: str = "p", now: str = "c") -> Column:
    """Array of the identity fields in which two runs differ; fingerprints that are missing differ too."""
    checks = []
    for name in IDENTITY:
        a, b = F.col(f"{before}.{name}"), F.col(f"{now}.{name}")
        differs = ~a.eqNullSafe(b)
        checks.append(F.when(differs | a.isNull() if name.endswith("sha12") else differs, F.lit(name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def verdict(now_missing: Column, before_missing: Column, reasons: Column, overlap: Column, more_empty: Column, drop: Column, slow: Column, *, least_overlap: float = 0.8, most_drop: float = 0.02) -> Column:
    """Verdict of a comparison; the first rule that applies decides."""
    worse = (overlap < least_overlap) | more_empty | F.coalesce(drop > most_drop, F.lit(False))
    return (
        F.when(now_missing, "failed").when(before_missing, "no_baseline").when(F.size(reasons) > 0, "incomparable")
        .when(worse, "regression").when(slow, "warn").otherwise("pass")
    )


def compare_runs(pairs: DataFrame) -> DataFrame:
    """``pairs`` (run_id, p, c, overlap, n_empty_before, n_empty_now, drop) with reasons and verdict."""
    slow = (F.col("p.duration_seconds") >= 5) & (F.col("c.duration_seconds") > 2 * F.col("p.duration_seconds"))
    rows = pairs.withColumn("reasons", incomparable_reasons())
    v = verdict(F.col("c").isNull(), F.col("p").isNull(), F.col("reasons"), F.col("overlap"), F.col("n_empty_now") > F.col("n_empty_before"), F.col("drop"), F.coalesce(slow, F.lit(False)))
    return rows.withColumn("verdict", v)


def severity(v: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), v)


def overall(verdicts: DataFrame) -> DataFrame:
    """One row: worst verdict, counts, and PASS, REVIEW or FAIL."""
    worst = F.max_by("verdict", severity(F.col("verdict")))
    bad = F.max(severity(F.col("verdict")))
    return verdicts.agg(worst.alias("worst"), F.count("*").alias("n"), F.when(bad >= 4, "FAIL").when(bad >= 1, "REVIEW").otherwise("PASS").alias("overall"))


def config_hash(*columns: str) -> Column:
    """Short hash of the canonical JSON (sorted keys) of identity columns."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 8)


def table_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row with a short hash of a table's rows in any order: the sum of row hashes, and their number."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("_s")).select("n", F.substring(F.sha2(F.concat_ws(":", "n", "_s"), 256), 1, 12).alias("sha12"))


def mode_agreement(runs: dict[str, DataFrame]) -> DataFrame:
    """(mode_a, mode_b, agreement): share of questions whose first hits agree."""
    firsts = None
    for mode, hits in runs.items():
        part = hits.filter("rank = 1").select("qid", F.lit(mode).alias("mode"), F.col("node_id").cast("string").alias("first"))
        firsts = part if firsts is None else firsts.union(part)
    a, b = firsts.select("qid", F.col("mode").alias("mode_a"), F.col("first").alias("fa")), firsts.select("qid", F.col("mode").alias("mode_b"), F.col("first").alias("fb"))
    return a.join(b, "qid").filter("mode_a < mode_b").groupBy("mode_a", "mode_b").agg(F.count("*").alias("n"), F.round(F.avg((F.col("fa") == F.col("fb")).cast("double")), 4).alias("agreement"))


def mine_errors(runs: dict[str, DataFrame], expected: DataFrame, tolerance: int = 1) -> DataFrame:
    """(qid, category): no evidence in any run, a first page clearly outside, or runs that disagree on it.

    ``runs`` hold (qid, rank, page_print); ``expected`` (qid, page_lo, page_hi).
    """
    firsts = None
    for mode, hits in runs.items():
        part = hits.filter("rank = 1").select("qid", F.lit(mode).alias("mode"), "page_print")
        firsts = part if firsts is None else firsts.union(part)
    questions = expected.select("qid").distinct()
    none = questions.join(firsts, "qid", "left_anti").withColumn("category", F.lit("no_evidence"))
    ranges = expected.groupBy("qid").agg(F.collect_list(F.struct("page_lo", "page_hi")).alias("ranges"))  # a question's annotations
    judged = firsts.join(ranges, "qid")
    inside = F.exists("ranges", lambda r: numeric.in_interval(F.col("page_print"), r["page_lo"], r["page_hi"], tolerance))
    wrong = judged.filter(~inside).select("qid").distinct().withColumn("category", F.lit("wrong_first"))
    apart = firsts.groupBy("qid").agg(F.count_distinct("page_print").alias("n")).filter("n > 1").select("qid").withColumn("category", F.lit("disagreement"))
    return none.union(wrong).union(apart)


def judge_summary(judged: DataFrame) -> DataFrame:
    """Per metric: mean over parsed answers, their number, and how many could not be parsed."""
    return judged.groupBy("metric").agg(F.round(F.avg(F.when(F.col("parse_ok"), F.col("score"))), 4).alias("mean"), F.count_if("parse_ok").alias("n"), F.count_if(~F.col("parse_ok")).alias("parse_failed"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by hash order, sorted by key: the same rows for the same seed, whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n).orderBy(key)
