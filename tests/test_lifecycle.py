"""Manifests, reports, requests, records, retargets, ingest and the command line on small tables."""

import pytest
from pyspark.sql import functions as F

from scriptorium import __main__ as cli
from scriptorium.operators import lifecycle as lc
from scriptorium.operators.validation import chunk_metadata


def test_manifest_and_gate(spark):
    nodes = spark.createDataFrame([(1, "a b"), (2, "c")], "node_id int, text string")
    made = lc.manifest(nodes.repartition(3), ["node_id", "text"], mode="bm25", k1=1.5)
    row = made.first()
    assert (row["mode"], row["k1"], row["nodes_count"], len(row["nodes_sha12"])) == ("bm25", "1.5", 2, 12)
    state = lambda m, n: lc.stale_gate(m, n, ["node_id", "text"]).first()["state"]
    assert state(made, nodes) == "ok" and state(made, nodes.filter("node_id = 1")) == "stale"
    old = made.withColumn("nodes_sha12", F.lit(None).cast("string"))
    assert state(old, nodes) == "unknown"
    lc.require_fresh(old, nodes, ["node_id", "text"])
    with pytest.raises(ValueError):
        lc.require_fresh(made, nodes.filter("false"), ["node_id", "text"])


REPORT = "schema string, experiment string, metrics struct<mrr:double>, per_question array<struct<id:string,question:string,retrieved:array<struct<node_id:string,text:string>>>>"


def test_reports(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"schema": "v1", "experiment": "e", "metrics": {"mrr": 0.5}, "per_question": [{"id": "q1", "question": "x", "retrieved": [{"node_id": "n", "text": "long"}]}, {"id": "q2"}]}')
    (tmp_path / "bad.json").write_text('{"schema": ')
    (tmp_path / "empty.json").write_text("")
    assert lc.load_report(spark, f"{tmp_path}/none.json", REPORT) is None
    assert lc.load_report(spark, f"{tmp_path}/bad.json", REPORT) is None
    assert lc.load_report(spark, f"{tmp_path}/empty.json", REPORT) is None
    row = lc.compact_report(lc.load_report(spark, f"{tmp_path}/good.json", REPORT)).first()
    assert (row["schema"], row["compact_from"], row["experiment"], row["metrics"]["mrr"]) == ("baseline/v1", "v1", "e", 0.5)
    assert [(q["id"], [r.asDict() for r in q["retrieved"]]) for q in row["per_question"]] == [("q1", [{"node_id": "n"}]), ("q2", [])]


def test_metadata_fields(spark):
    rows = spark.sql("SELECT named_struct('a', 'x', 'n', 1, 'l', array(1), 't', true, 'd', date'2020-01-01', 'm', map(1, 2)) AS metadata UNION ALL SELECT NULL")
    out = lc.primitive_fields(rows)
    assert out.schema["metadata"].dataType.names == ["a", "n", "t"] and out.filter("metadata IS NULL").count() == 1
    merged = spark.sql("SELECT map('a', 1) AS own UNION ALL SELECT NULL").select(lc.with_defaults(F.col("own"), F.create_map(F.lit("a"), F.lit(9), F.lit("b"), F.lit(2))).alias("m"))
    assert sorted(sorted(r["m"].items()) for r in merged.collect()) == [[("a", 1), ("b", 2)], [("a", 9), ("b", 2)]]


def test_requests(spark):
    rows = [("ok", 5, "exp-1"), (" \t", 0, "a b"), (None, 21, None), ("x" * 2000, None, "e" * 64), ("x" * 2001, 1, "e" * 65), ("x", 20, "")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, k int, e string").select("i", lc.request_problems(F.col("q"), F.col("k"), F.col("e")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {0: [], 1: ["question", "top_k", "experiment"], 2: ["question", "top_k"], 3: [], 4: ["question", "experiment"], 5: ["experiment"]}
    rows = [("r", "up", None, None), ("", "best", "c" * 2001, ["n"] * 21), (None, None, "c", ["n"] * 20), ("r" * 33, "down", "", [])]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, v string, c string, n array<string>").select("i", lc.feedback_problems(F.col("r"), F.col("v"), F.col("c"), F.col("n")).alias("p")).collect()
    assert {r["i"]: r["p"] for r in got} == {0: [], 1: ["request_id", "rating", "comment", "node_ids"], 2: ["request_id", "rating"], 3: ["request_id"]}


def test_retrieval_records(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "qid int, question string")
    hits = spark.createDataFrame([(1, "n3", 3, 0.1), (1, "n1", 1, 0.9), (1, "n2", 2, 0.5)], "qid int, node_id string, rank int, score double")
    got = {r["qid"]: r for r in lc.retrieval_records(q, hits, 2, filters={"version": "v1"}, experiment="e", mode="bm25").collect()}
    assert [x["node_id"] for x in got[1]["results"]] == ["n1", "n2"] and got[1]["result_count"] == 2 and got[1]["filters"] == {"version": "v1"}
    assert got[2]["results"] == [] and got[2]["result_count"] == 0 and (got[2]["experiment"], got[2]["mode"], got[2]["top_k"]) == ("e", "bm25", 2)
    assert "filters" not in lc.retrieval_records(q, hits, 2, mode="bm25").columns


def test_statistics_and_evidence(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "source_file string")
    row = lc.document_statistics(names("a", "b", "c"), names("a", "a", "b"), names("a", "a"), names("z")).first()
    assert row.asDict() == {"documents": 3, "documents_with_nodes": 1, "documents_without_nodes": 2, "skipped": 1, "nodes": 3, "chunks": 2}
    nodes = spark.createDataFrame([("n1", "c1"), (None, "c2"), (None, None)], "node_id string, chunk_id string")
    cases = spark.createDataFrame([("n1",), ("c1",), ("c2",), (None,)], "node_id string")
    assert sorted((r["node_id"] for r in lc.missing_evidence(cases, nodes).collect()), key=str) == [None, "c1"]


def test_retargets(spark):
    s = spark.createDataFrame([("1", "1 Open dds_open", "useopenhere"), ("1.1", "1.1 Close both", "useclose"), ("2", "2 Write both", "usewrite")], "num string, title string, body string")
    rows = [("ok", "1", "title_id", "DDS_open"), ("no", "1", "title_id", "missing"), ("many", "2", "title_id", "both"), ("other", "2", "title_id", "dds_open"), ("in", "1", "text_token", "open here"), ("out", "2", "text_token", "open here"), ("gone", "9", "title_id", "both"), ("odd", "1", "x", "y")]
    got = {r["question_id"]: r["problem"] for r in lc.retarget_problems(spark.createDataFrame(rows, "question_id string, num string, kind string, evidence string"), s).collect()}
    assert got == {"no": "not_in_titles", "many": "in_several_titles", "other": "in_another_title", "out": "not_in_text", "gone": "no_section", "odd": "unknown_kind"}


def test_narrowed_dataset(spark):
    q = spark.createDataFrame([("a", 1, 9), ("b", 2, 3), ("c", None, None)], "question_id string, page_lo int, page_hi int")
    n = spark.createDataFrame([("a", 4, 5), ("b", 2, 3)], "question_id string, page_lo int, page_hi int")
    got = sorted((r["question_id"], r["page_lo"], r["page_hi"], r["narrowed"]) for r in lc.narrowed_dataset(q, n).collect())
    assert got == [("a", 4, 5, True), ("b", 2, 3, False), ("c", None, None, False)]


def chunks(spark, source, ids):
    meta = chunk_metadata(source_id=F.lit(source), source_file=F.lit("f"), source_type=F.lit("html"), section_path=F.lit("a"), section_level=F.lit(1), node_ids=F.array(F.lit("n")), chunk_id=F.col("chunk_id"), product=F.lit("p"), source_url=F.lit("u"))
    return spark.createDataFrame([(c, "text " * 20, i) for i, c in enumerate(ids)], "chunk_id string, text string, seq int").withColumn("metadata", meta)


def test_ingest(spark, tmp_path):
    path = f"{tmp_path}/nodes"
    got = lc.ingest({"s": chunks(spark, "s", ["a", "b"]), "t": chunks(spark, "t", ["c"])}, path)
    assert {r["source_id"]: r["total"] for r in got.collect()} == {"s": 2, "t": 1}
    with pytest.raises(ValueError, match="chunk_id_repeated"):
        lc.ingest({"s": chunks(spark, "s", ["x"]), "t": chunks(spark, "t", ["x"])}, path)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        lc.ingest({}, path)


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([("n1", "open the reader"), ("n2", "write a sample"), ("n3", "close it")], "node_id string, text string").write.parquet(f"{tmp_path}/nodes")
    assert cli.main(["build", f"{tmp_path}/nodes", f"{tmp_path}/index"]) == 0
    assert spark.read.json(f"{tmp_path}/index/manifest").first()["nodes_count"] == 3
    assert cli.main(["query", f"{tmp_path}/index", "write sample", "--top-k", "2"]) == 0
    assert capsys.readouterr().out.split("\t")[:2] == ["1", "n2"]
    with pytest.raises(SystemExit):
        cli.main(["query", f"{tmp_path}/index", " "])
