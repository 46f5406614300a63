"""Writers: validated node sets, run tables, reports, review sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.validation import node_violations


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages without their layout blocks."""
    pages.drop("blocks").write.mode("overwrite").json(path)


def write_tree(tree: DataFrame, path: str) -> None:
    """Sections in document order."""
    tree.drop("children").repartitionByRange("doc", "ord").sortWithinPartitions("doc", "ord").write.mode("overwrite").parquet(path)


def write_nodes(nodes: DataFrame, path: str, sources: DataFrame | None = None) -> None:
    """Stage, check, then publish: a node set that breaks its contract never replaces one that didn't."""
    staged = f"{path.rstrip('/')}.staged"
    nodes.write.mode("overwrite").parquet(staged)
    rows = nodes.sparkSession.read.parquet(staged)
    broken = node_violations(rows, sources).orderBy("chunk_id", "rule").limit(20).collect()  # for the message
    if broken:
        raise ValueError("node set breaks its contract: " + "; ".join(f"{r['chunk_id']}: {r['rule']}" for r in broken))
    rows.write.mode("overwrite").parquet(path)


def write_vectors(nodes: DataFrame, vectors: DataFrame, path: str) -> None:
    """Vectors of nodes whose text isn't blank; a node without one is an error."""
    wanted = nodes.filter(F.trim("text") != "").select("node_id")
    if not wanted.join(vectors, "node_id", "left_anti").isEmpty():
        raise ValueError("nodes without vectors")
    vectors.join(wanted, "node_id", "left_semi").write.mode("overwrite").parquet(path)


def append_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").partitionBy("experiment").parquet(path)


def promote(runs: DataFrame, run_id: str) -> DataFrame:
    """Run rows with ``baseline`` set for one run of its experiment."""
    return runs.withColumn("baseline", F.col("run_id") == run_id)


def review_sheet(rows: DataFrame, path: str, *, order: str, first: int = 30, cut: int = 100) -> None:
    """First rows with texts cut, as one CSV file for people."""
    short = rows.orderBy(order).limit(first)
    for f in rows.schema.fields:
        if f.dataType.simpleString() == "string":
            short = short.withColumn(f.name, F.substring(f.name, 1, cut))
    short.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def checklist(rows: DataFrame, group: str, order: str, most: int = 20) -> DataFrame:
    """Up to ``most`` rows of each group, in order."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("n") <= most)


def markdown(rows: DataFrame, order: list[str], most: int = 60) -> str:
    """A table of at most ``most`` rows as Markdown."""
    found = rows.orderBy(*order).limit(most).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])
