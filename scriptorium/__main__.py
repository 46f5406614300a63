"""``python -m scriptorium build NODES INDEX`` and ``python -m scriptorium query INDEX QUESTION [--top-k N]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import lifecycle, retrieval


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scriptorium")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="BM25 index of a Parquet table with node_id and text")
    build.add_argument("nodes")
    build.add_argument("index")
    query = commands.add_parser("query", help="best nodes of an index for a question")
    query.add_argument("index")
    query.add_argument("question")
    query.add_argument("--top-k", type=int, default=5)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("scriptorium").getOrCreate()
    if args.command == "build":
        nodes = spark.read.parquet(args.nodes)
        retrieval.build_bm25(nodes).save(args.index)
        lifecycle.manifest(nodes, ["node_id", "text"], mode="bm25", k1=retrieval.K1, b=retrieval.B).write.mode("overwrite").json(f"{args.index}/manifest")
        return 0
    questions = spark.createDataFrame([(0, args.question)], "qid int, question string")
    problems = questions.select(lifecycle.request_problems(F.col("question"), F.lit(args.top_k), F.lit(None).cast("string")).alias("p")).first()["p"]
    if problems:
        parser.error("invalid " + ", ".join(problems))
    for hit in retrieval.bm25_search(retrieval.Bm25Index.load(spark, args.index), questions, args.top_k).orderBy("rank").collect():
        print(f"{hit['rank']}\t{hit['node_id']}\t{hit['score']:.6f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
