"""Index manifests and their gate, stored reports, request checks, retrieval records, retarget checks, ingest."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from . import validation as va
from .evaluation import table_fingerprint

LOG = logging.getLogger(__name__)

#: Fixed limits of a request.
MAX_QUESTION, MAX_HITS, MAX_NODE_IDS = 2000, 20, 20
EXPERIMENT = r"^[A-Za-z0-9_-]{1,64}$"
PRIMITIVE = (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType)


def manifest(nodes: DataFrame, columns: list[str], **identity: object) -> DataFrame:
    """One row that tells what an index was built from: ``identity``, node count, fingerprint of ``columns`` and time."""
    own = [F.lit(v).cast("string").alias(k) for k, v in sorted(identity.items())]
    return table_fingerprint(nodes, *columns).select(*own, F.col("n").alias("nodes_count"), F.col("sha12").alias("nodes_sha12"), F.current_timestamp().alias("built_at"))


def stale_gate(recorded: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Each recorded manifest with ``state``: ``stale`` (other nodes now), ``unknown`` (recorded without fingerprint, only a warning) or ``ok``."""
    now = table_fingerprint(nodes, *columns).select(F.col("sha12").alias("current_sha12"))  # one row
    state = F.when(F.col("nodes_sha12").isNull(), "unknown").when(F.col("nodes_sha12") != F.col("current_sha12"), "stale").otherwise("ok")
    return recorded.join(F.broadcast(now)).withColumn("state", state)


def require_fresh(recorded: DataFrame, nodes: DataFrame, columns: list[str]) -> None:
    """An error if a manifest is stale."""
    found = stale_gate(recorded, nodes, columns)
    if not found.filter("state = 'stale'").isEmpty():
        raise ValueError("nodes have changed since the index was built; build it again")
    if not found.filter("state = 'unknown'").isEmpty():
        LOG.warning("the index has no fingerprint of its nodes, so it can't be compared with them")


def load_report(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A stored report; None where there is none, and with a warning where it can't be read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    report = T._parse_datatype_string(schema)
    try:
        rows = spark.read.schema(T.StructType([*report.fields, T.StructField("_bad", T.StringType())])).json(path, multiLine=True, columnNameOfCorruptRecord="_bad").cache()
        broken = rows.isEmpty() or not rows.filter("_bad IS NOT NULL").isEmpty()
        rows.unpersist()
    except AnalysisException:
        broken = True
    if broken:
        LOG.warning("report %s is damaged", path)
        return None
    return rows.drop("_bad")


def compact_report(reports: DataFrame) -> DataFrame:
    """What a baseline keeps of a report: of each question its id and the ids of its hits."""
    hits = F.transform(F.coalesce("per_question", F.array()), lambda q: F.struct(q["id"].alias("id"), F.transform(F.coalesce(q["retrieved"], F.array()), lambda r: F.struct(r["node_id"].alias("node_id"))).alias("retrieved")))
    kept = [c for c in ("experiment", "config_hash8", "artifacts", "duration_seconds", "index", "retrieval", "dataset", "metrics") if c in reports.columns]
    return reports.select(F.lit("baseline/v1").alias("schema"), F.col("schema").alias("compact_from"), *kept, hits.alias("per_question"))


def primitive_fields(rows: DataFrame, metadata: str = "metadata") -> DataFrame:
    """``rows`` whose ``metadata`` struct has only its text, number and truth fields."""
    fields = [f.name for f in rows.schema[metadata].dataType.fields if isinstance(f.dataType, PRIMITIVE)]
    kept = F.struct(*[F.col(metadata)[f].alias(f) for f in fields]) if fields else F.lit(None).cast("struct<>")
    return rows.withColumn(metadata, F.when(F.col(metadata).isNotNull(), kept))


def with_defaults(own: Column, defaults: Column) -> Column:
    """A map with the entries of ``defaults`` whose keys it lacks."""
    own = F.coalesce(own, F.map_filter(defaults, lambda k, v: F.lit(False)))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own)


def request_problems(question: Column, top_k: Column, experiment: Column) -> Column:
    """Names of what is wrong with a query request; ``top_k`` and ``experiment`` may be null."""
    tests = {
        "question": question.isNull() | tx.is_blank(question) | (F.length(question) > MAX_QUESTION),
        "top_k": (top_k < 1) | (top_k > MAX_HITS), "experiment": ~experiment.rlike(EXPERIMENT),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()]))


def feedback_problems(request_id: Column, rating: Column, comment: Column, node_ids: Column) -> Column:
    """Names of what is wrong with a feedback request; ``comment`` and ``node_ids`` may be null."""
    tests = {
        "request_id": request_id.isNull() | ~F.length(request_id).between(1, 32), "rating": ~F.coalesce(rating.isin("up", "down"), F.lit(False)),
        "comment": F.length(comment) > MAX_QUESTION, "node_ids": F.size(node_ids) > MAX_NODE_IDS,
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()]))


def retrieval_records(questions: DataFrame, hits: DataFrame, top_k: int, *, filters: Mapping[str, str] | None = None, **identity: str) -> DataFrame:
    """A log record per question, also of those without hits: the run's identity, result_count and results by rank.

    ``hits`` are cut at ``top_k`` before they are gathered, so a row stays small.
    """
    found = hits.filter(F.col("rank") <= top_k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "score"))).alias("results"))
    rows = questions.select("qid", "question").join(found, "qid", "left")
    none = F.array().cast(found.schema["results"].dataType)
    extra = [F.create_map(*[F.lit(x) for kv in sorted(filters.items()) for x in kv]).alias("filters")] if filters else []
    own = [F.lit(v).alias(k) for k, v in sorted(identity.items())]
    rows = rows.withColumn("results", F.coalesce("results", none))
    return rows.select(*own, "qid", "question", F.lit(top_k).alias("top_k"), F.size("results").alias("result_count"), "results", *extra)


def document_statistics(documents: DataFrame, nodes: DataFrame, chunks: DataFrame, skipped: DataFrame, *, key: str = "source_file") -> DataFrame:
    """One row: documents, with and without chunks, skipped, nodes, chunks."""
    known = documents.join(chunks.select(key).distinct().withColumn("_with", F.lit(1)), key, "left")
    one = known.agg(F.count("*").alias("documents"), F.count("_with").alias("documents_with_nodes"), F.count_if(F.col("_with").isNull()).alias("documents_without_nodes"))
    for df, name in ((skipped, "skipped"), (nodes, "nodes"), (chunks, "chunks")):
        one = one.join(F.broadcast(df.agg(F.count("*").alias(name))))  # one row each
    return one


def missing_evidence(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cases whose ``node_id`` no node has; a node's id is its node_id, else its chunk_id."""
    ids = [F.col(c).cast("string") for c in ("node_id", "chunk_id") if c in nodes.columns]
    known = nodes.select(F.coalesce(*ids).alias("_id")).filter("_id IS NOT NULL")
    return cases.join(known, F.col("_id") == F.col("node_id").cast("string"), "left_anti")


def retarget_problems(retargets: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, problem) of each retarget (question_id, num, kind, evidence) that the sections (num, title, body) don't bear out.

    A ``title_id`` must be a word of one section title alone, and of the section named; a ``text_token``
    must stand in the section's text, into which those of its subsections are rolled.
    """
    words = sections.select(F.col("num").alias("owner"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)))).alias("word"))
    owners = words.groupBy("word").agg(F.count("*").alias("n_owners"), F.min("owner").alias("owner"))
    rows = retargets.withColumn("word", F.lower("evidence")).join(sections.select("num", "body"), "num", "left").join(owners, "word", "left")
    title = F.when(F.col("n_owners").isNull(), "not_in_titles").when(F.col("n_owners") > 1, "in_several_titles").when(F.col("owner") != F.col("num"), "in_another_title")
    token = F.when(~F.contains("body", tx.squeeze(F.col("evidence"))), "not_in_text")
    problem = F.when(F.col("body").isNull(), "no_section").when(F.col("kind") == "title_id", title).when(F.col("kind") == "text_token", token).otherwise("unknown_kind")
    return rows.select("question_id", problem.alias("problem")).filter("problem IS NOT NULL")


def narrowed_dataset(questions: DataFrame, narrowed: DataFrame) -> DataFrame:
    """``questions`` with the intervals of ``narrowed`` (question_id, page_lo, page_hi) in place of their own, and ``narrowed`` true where they differ."""
    new = narrowed.select("question_id", F.col("page_lo").alias("_lo"), F.col("page_hi").alias("_hi"))
    lo, hi = F.coalesce("_lo", "page_lo"), F.coalesce("_hi", "page_hi")
    changed = ~(lo.eqNullSafe(F.col("page_lo")) & hi.eqNullSafe(F.col("page_hi")))
    return questions.join(new, "question_id", "left").withColumns({"narrowed": changed, "page_lo": lo, "page_hi": hi}).drop("_lo", "_hi")


def ingest(sources: Mapping[str, DataFrame], path: str, registered: DataFrame | None = None) -> DataFrame:
    """Chunks of all sources merged, checked, published at ``path``, and counted: one row per source with quality counters.

    Nothing is published if the merged set breaks its contract.
    """
    from ..sources.writers import write_nodes

    if not sources:
        raise ValueError("no sources")
    merged = None
    for df in sources.values():
        merged = df if merged is None else merged.unionByName(df)
    write_nodes(merged, path, registered)
    stored = merged.sparkSession.read.parquet(path)
    counted = None
    for name in sources:
        one = va.quality_counters(stored.filter(F.col("metadata.source_id") == name)).select(F.lit(name).alias("source_id"), "*")
        counted = one if counted is None else counted.unionByName(one)
    return counted
