import math

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import evaluation as ev, ranking, retrieval as rt
from scriptorium.plans import tables

DOCS = [("n_conn", "连接失败时如何排查错误"), ("n_qos", "QoS 策略配置"), ("n_qos2", "QoS 策略配置文件 XML 结构"), ("n_blank", "  ")]


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, question string")


@pytest.fixture(scope="module")
def index(spark):
    return rt.build_bm25(spark.createDataFrame(DOCS, "node_id string, text string"))


def test_bm25(spark, index):
    hits = rt.bm25_search(index, ask(spark, "QoS 策略配置", "zzz unknown", "连接失败"), 5).orderBy("qid", "rank").collect()
    assert [(h["qid"], h["node_id"]) for h in hits] == [("q0", "n_qos"), ("q0", "n_qos2"), ("q2", "n_conn")]
    assert index.corpus_stats.first()["n"] == 3  # blank nodes aren't indexed


def test_bm25_score(spark):
    nodes = spark.createDataFrame([("a", "x y"), ("b", "y y y")], "node_id string, text string")
    h = rt.bm25_search(rt.build_bm25(nodes), ask(spark, "x x"), 5).first()
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert h["score"] == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2.5)))


def test_filter_leaves_statistics(spark, index):
    every = {h["node_id"]: h["score"] for h in rt.bm25_search(index, ask(spark, "QoS"), 5).collect()}
    only = rt.bm25_search(index, ask(spark, "QoS"), 5, spark.createDataFrame([("n_qos2",)], "node_id string")).collect()
    assert [(h["node_id"], h["score"]) for h in only] == [("n_qos2", every["n_qos2"])]


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = rt.Bm25Index.load(spark, str(tmp_path))
    assert sorted(map(tuple, rt.bm25_search(again, ask(spark, "QoS"), 5).collect())) == sorted(map(tuple, rt.bm25_search(index, ask(spark, "QoS"), 5).collect()))


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid string, node_id string, rank int, score double")


def test_rrf(spark):
    a = hits(spark, [("q", "x", 1, 9.0), ("q", "both", 2, 8.0)])
    b = hits(spark, [("q", "y", 1, 9.0), ("q", "both", 2, 8.0)])
    got = [(r["node_id"], r["score"]) for r in rt.fuse([a, b], 5).orderBy("rank").collect()]
    assert got == [("both", round(2 / 62, 6)), ("x", round(1 / 61, 6)), ("y", round(1 / 61, 6))]


def test_boost(spark):
    rows = hits(spark, [("q", "a", 1, 0.90), ("q", "b", 2, 0.88), ("q", "c", 3, 0.60)]).withColumn("v", F.when(F.col("node_id") == "b", "2.4").otherwise("2.0"))
    got = [(r["node_id"], r["score"]) for r in rt.boost(rows, F.col("v") == "2.4", 0.1).orderBy("rank").collect()]
    assert got[0] == ("b", pytest.approx(0.28 / 0.30 + 0.1, abs=1e-6)) and [n for n, _ in got] == ["b", "a", "c"]
    single = rt.boost(rows.filter("node_id = 'b'"), F.col("v") == "2.4", 0.1).first()
    assert single["score"] == pytest.approx(0.6)


def test_vectors_and_modes(spark, index):
    nodes = spark.createDataFrame([(i, t, "pdf" if i == "n_conn" else "html") for i, t in DOCS], "node_id string, text string, source_type string")
    vectors = spark.createDataFrame([("n_conn", [1.0, 0.0]), ("n_qos", [0.0, 1.0]), ("n_qos2", [0.6, 0.8])], "node_id string, embedding array<double>")
    q, v = ask(spark, "QoS 策略"), spark.createDataFrame([("q0", [0.0, 2.0])], "qid string, q array<double>")
    run = lambda mode, **k: [r["node_id"] for r in rt.retrieve(mode, q, nodes, index=index, vectors=vectors, question_vectors=v, top_k=2, **k).orderBy("rank").collect()]
    assert run("vector") == ["n_qos", "n_qos2"] and run("bm25") == ["n_qos", "n_qos2"] and run("hybrid") == ["n_qos", "n_qos2"] and run("hybrid_rerank") == ["n_qos", "n_qos2"]
    assert run("vector", where=F.col("source_type") == "pdf") == ["n_conn"]
    with pytest.raises(ValueError):
        rt.retrieve("nope", q, nodes)
    with pytest.raises(ValueError):
        rt.retrieve("bm25", q, nodes)


def test_metrics(spark):
    h = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q2", 1, "z")], "qid string, rank int, node_id string")
    truth = spark.createDataFrame([("q1", "b"), ("q1", "c"), ("q2", "y"), ("q3", "a")], "qid string, node_id string")
    got = {r["qid"]: tuple(r)[1:] for r in ev.question_metrics(h, truth, 5).collect()}
    assert got == {"q1": (1.0, 0.5, 0.5, 0.5), "q2": (0.0, 0.0, 0.0, 0.0), "q3": (0.0, 0.0, 0.0, 0.0)}


def test_interval_metrics(spark):
    h = spark.createDataFrame([("q", 1, "s", 9, "Intro"), ("q", 2, "s", 3, "QoS policy")], "qid string, rank int, source_id string, page_print int, section string")
    e = spark.createDataFrame([("q", "s", 2, 4, "QoS"), ("q", "t", None, None, None)], "qid string, source_id string, page_lo int, page_hi int, section_keyword string")
    assert tuple(ev.interval_metrics(h, e, 5).first())[1:] == (1.0, 0.5, 0.5, 0.5)


def test_overlap_and_agreement(spark):
    make = lambda ids: spark.createDataFrame([("q", i + 1, n) for i, n in enumerate(ids)], "qid string, rank int, node_id string")
    q = spark.createDataFrame([("q",), ("none",)], "qid string")
    got = {r["qid"]: (r["overlap"], r["same_first"]) for r in ev.run_overlap(make("abcde"), make("abcdx"), q, 5).collect()}
    assert got == {"q": (0.8, True), "none": (1.0, False)}


def test_verdicts(spark):
    v = lambda *a: spark.range(1).select(ev.verdict(*[x if hasattr(x, "alias") else F.lit(x) for x in a]).alias("v")).first()["v"]
    none, some = F.array().cast("array<string>"), F.array(F.lit("mode"))
    assert v(True, False, none, 1.0, False, 0.0, False) == "failed"
    assert v(False, True, none, 1.0, False, 0.0, False) == "no_baseline"
    assert v(False, False, some, 1.0, False, 0.0, False) == "incomparable"
    assert v(False, False, none, 0.6, False, 0.0, False) == "regression"
    assert v(False, False, none, 0.8, False, 0.03, False) == "regression"
    assert v(False, False, none, 0.8, False, 0.0, True) == "warn"
    assert v(False, False, none, 0.8, False, 0.0, False) == "pass"


def test_expected_nodes(spark):
    """Questions with line breaks, of few words or cut within a word are found wherever their text stands."""
    texts = ["x one two\nthree four five y", "one two three four five", "so ab cdef", "ab", "a  b", "%"]
    asked = ["one two\nthree four fi", "one two three four", "b c", "ab", "a  b", "zz yy xx ww", " two", "five y"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    d = spark.createDataFrame(list(enumerate(texts)), "node_id long, text string")
    got = {tuple(r) for r in tables.holders(q, d).select("qid", "node_id").collect()}
    assert got == {(i, j) for i, a in enumerate(asked) for j, t in enumerate(texts) if a in t}


def test_terms_on_workers(spark):
    texts = ["The QoS_1 x", "连接失败时 a如", "如", "", "\u212a İx éa_b", "a\u00a0b\nC"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.terms(F.col("t")).alias("terms")).collect()
    assert all(ranking.cut(r["t"]) == r["terms"] for r in rows)


def test_runs_read_texts_once(spark, monkeypatch):
    """Hits of two parameter sets equal those of an index of tables; texts are cut once and no postings are made."""
    words = [f"w{i % 7} w{i % 5} w{i % 3} " * (i % 4 + 1) for i in range(60)] + [" ", None]
    nodes = spark.createDataFrame(list(enumerate(words)), "node_id long, text string")
    q = spark.createDataFrame([(0, "w1 w2 w2"), (1, "w6"), (2, "none")], "qid long, question string")
    settled = []
    monkeypatch.setattr(rt, "settle", lambda df, name: settled.append(name) or df.localCheckpoint())
    pairs = [(1.5, 0.75), (0.9, 0.4)]
    index = rt.build_bm25(nodes)
    by_rank = lambda df: sorted(map(tuple, df.collect()), key=lambda t: (t[0], t[2]))
    runs = [by_rank(h) for h in rt.bm25_runs(index, q, 5, pairs)]
    assert settled == ["bm25-counts", "bm25-hits", "bm25-hits"] and not {"postings", "every"} & set(vars(index))
    tables_ = [index.postings, index.doc_stats, index.term_stats, index.corpus_stats]
    for run, (k1, b) in zip(runs, pairs, strict=True):
        want = {}
        n, avgdl = index.corpus_stats.first()
        df, dl = dict(index.term_stats.collect()), dict(index.doc_stats.collect())
        for node, term, tf in index.postings.collect():
            for qid, text in q.collect():
                if term in text.split():
                    want[qid, node] = want.get((qid, node), 0) + text.split().count(term) * math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[node] / avgdl))
        best = [(i, x, r + 1) for i in (0, 1) for r, x in enumerate(sorted((x for j, x in want if j == i), key=lambda x, i=i: (-round(want[i, x], 9), x))[:5])]
        assert [t[:3] for t in run] == best and all(t[3] == pytest.approx(want[t[0], t[1]]) for t in run)
        assert [t[:3] for t in by_rank(rt.bm25_search(rt.Bm25Index(*tables_, k1, b), q, 5))] == best


def test_questions_in_parts(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, f"w{i % 4} w{i % 3}", [float(i % 4), 1.0]) for i in range(24)], "node_id long, text string, embedding array<float>")
    q = spark.createDataFrame([(i, f"w{i}", [1.0, float(i)]) for i in range(4)], "qid long, question string, q array<float>")
    whole = [sorted(map(tuple, x.collect())) for x in (rt.bm25_search(rt.build_bm25(nodes), q, 3), rt.vector_search(nodes, q, 3))]
    monkeypatch.setattr(rt, "QUESTIONS", 1)
    monkeypatch.setattr(rt, "VECTORS", 1)
    assert [sorted(map(tuple, x.collect())) for x in (rt.bm25_search(rt.build_bm25(nodes), q, 3), rt.vector_search(nodes, q, 3))] == whole


def test_vectors_by_blocks(spark, monkeypatch):
    """Block products give what a plain sort of all pairs gives, ties by id, without a question's own vector."""
    monkeypatch.setattr(ranking, "CELLS", 2048)
    own = [(i, [float((i * 7) % 5) + 0.5, float((i * 3) % 4), float(i % 2)]) for i in range(60)]
    v = spark.createDataFrame([*own, (98, None), (99, [0.0, 0.0, 0.0])], "node_id long, embedding array<float>")
    got = {}
    for r in rt.vector_search(v, v.filter("node_id % 10 = 0").selectExpr("node_id AS qid", "embedding AS q"), 4, exclude_self=True).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["node_id"], r["score"]))
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 4)
    for i, a in own[::10]:
        best = sorted(((-cos(a, b), j) for j, b in own if j != i))[:4]
        assert [(n, s) for _, n, s in sorted(got[i])] == [(j, -s) for s, j in best]
