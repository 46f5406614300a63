"""Request, retrieval, source and feedback logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "ts timestamp, type string, request_id string, method string, path string, status int, duration_ms double"
SOURCE = "ts timestamp, seq long, request_id string, record struct<question:string,answer:string,partial:boolean>"
FEEDBACK = "ts timestamp, feedback_id string, request_id string, rating string, question string, comment string, node_ids array<string>"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


def append_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows appended as JSON lines; the file sink's log makes that exactly once."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_records(updates: DataFrame, path: str, checkpoint: str, key: str = "request_id", order: str = "seq") -> StreamingQuery:
    """The last record per request: each batch is merged into the table of the one before, in a new version.

    A version is a folder named by the batch, so a batch that runs again writes the same version.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{epoch - 1}"))
        columns = [c for c in batch.columns if c not in (key, order)]
        last = rows.groupBy(key).agg(F.max_by(F.struct(order, *columns), order).alias("r"))
        last.select(key, "r.*").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events and values per window and kind; state older than the watermark is dropped.

    Without ``late`` the stream's own watermark holds.
    """
    rows = (events if late is None else events.withWatermark(ts, late)).groupBy(F.window(ts, width).alias("w"), kind)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per user and session."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, as long as the watermark remembers it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def feedback_rows(feedback: DataFrame, cited: DataFrame) -> DataFrame:
    """Feedback on known requests whose nodes were cited; questions cut to 500 characters."""
    rows = feedback.join(cited.select("request_id", "cited_ids"), "request_id")
    rows = rows.filter((F.size(F.array_except(F.coalesce("node_ids", F.array().cast("array<string>")), "cited_ids")) == 0) & F.col("rating").isin("up", "down"))
    return rows.select("feedback_id", "request_id", "rating", F.substring("question", 1, 500).alias("question"), F.size("cited_ids").alias("cited_nodes"))


def answer_slices(answers: DataFrame, size: int = 24) -> DataFrame:
    """(request_id, n, token): an answer in slices, as a stream of tokens has it."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("answer"), F.lit(1)), F.lit(size))
    return answers.select("request_id", F.posexplode(F.transform(starts, lambda i: F.substring("answer", i, F.lit(size)))).alias("n", "token"))
