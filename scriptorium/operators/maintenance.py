"""Sweeps and repairs around data sets: filter compliance, corrections, answers, scopes, histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text as tx
from .retrieval import equals


def filter_breaches(hits: DataFrame, nodes: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Hits whose node doesn't meet the conditions; none if filters hold in every mode."""
    return hits.join(nodes.filter(equals(conditions)).select("node_id"), "node_id", "left_anti")


def corrected(rows: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``corrections`` where it has the key; null corrections change nothing."""
    columns = [c for c in corrections.columns if c != key and c in rows.columns]
    fixes = corrections.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(fixes, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def flat_questions(raw: DataFrame) -> DataFrame:
    """Questions in five columns and their nested expected source as columns."""
    e = F.col("expected_source")
    return raw.select("id", "question", "type", "version", "difficulty", e["source_id"].alias("source_id"), numeric.page_bounds(e["page_print"].cast("string")).alias("page"), e["section_keyword"].alias("section_keyword"))


def evaluate_answers(questions: DataFrame, contexts: DataFrame, answer: Callable[[Column, Column], Column], judges: Mapping[str, Callable[[Column, Column, Column], Column]]) -> DataFrame:
    """(qid, answer, abstained, metric, score, parse_ok): answers of a client, judged by others.

    ``answer(question, context)`` and ``judge(question, context, answer)`` are columns, for
    instance pandas UDFs around a client.  Without a context the answer is a fixed sentence and
    every score 0, and no client is asked.
    """
    no_evidence = "资料中没有找到相关内容，无法回答。"  # fixed value
    rows = questions.join(contexts, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    has = ~tx.is_blank(F.col("context"))
    rows = rows.withColumn("answer", F.when(has, answer(F.col("question"), F.col("context"))).otherwise(no_evidence))
    rows = rows.withColumn("abstained", tx.abstains(F.col("answer")))
    judged = [F.struct(F.lit(m).alias("metric"), F.when(has, numeric.judge_score(f(F.col("question"), F.col("context"), F.col("answer")))).alias("j")) for m, f in sorted(judges.items())]
    rows = rows.withColumn("m", F.explode(F.array(*judged)))
    return rows.select("qid", "answer", "abstained", "m.metric", F.coalesce("m.j.score", F.lit(0.0)).alias("score"), F.coalesce("m.j.parse_ok", F.lit(True)).alias("parse_ok"))


def abstention_suite(answers: DataFrame) -> DataFrame:
    """One row: answers, abstentions, and whether all abstained."""
    said = tx.abstains(F.col("answer"))
    return answers.agg(F.count("*").alias("n"), F.count_if(said).alias("n_abstained"), F.coalesce(F.bool_and(said), F.lit(False)).alias("passed"))


def change_scope(path: Column, everything: tuple[str, ...], selected: tuple[str, ...]) -> Column:
    """What a changed file asks to be run again: all, selected or none."""
    starts = lambda ps: F.coalesce(F.greatest(F.lit(False), F.lit(False), *[path.startswith(p) for p in ps]), F.lit(False))
    return F.when(starts(everything), "all").when(starts(selected), "selected").otherwise("none")


def changed_paths(*lists: DataFrame) -> DataFrame:
    """Union of lists of paths, each once."""
    out = lists[0].select("path")
    for other in lists[1:]:
        out = out.union(other.select("path"))
    return out.distinct()


def local_urls(nodes: DataFrame, files: DataFrame, base: str) -> DataFrame:
    """``nodes`` with source_url pointing below ``base`` where the file is there (``files``: source_id, file_name)."""
    name = F.element_at(F.split("source_url", "/"), -1)
    rows = nodes.withColumn("file_name", name).join(files.select("source_id", "file_name").distinct().withColumn("_there", F.lit(True)), ["source_id", "file_name"], "left")
    local = F.concat_ws("/", F.lit(base.rstrip("/")), "source_id", "file_name")
    return rows.withColumn("source_url", F.when(F.col("_there"), local).otherwise(F.col("source_url"))).drop("file_name", "_there")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values."""
    total = rows.agg(F.count("*").alias("_n"))
    return rows.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("_n"), 4).alias("share"))  # one row


def grep(rows: DataFrame, needle: str, *, text: str = "text", order: str = "node_id", most: int = 20) -> DataFrame:
    """First rows whose text holds ``needle`` as written, with a preview."""
    return rows.filter(F.col(text).contains(needle)).orderBy(order).limit(most).select(order, tx.preview(F.col(text)).alias("preview"))


def token_counts(rows: DataFrame, path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """``rows`` with token_count by the ranks file at ``path``."""
    import pandas as pd

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda t: len(encoding.encode_ordinary(t or "")))

    return rows.withColumn("token_count", count(text))
