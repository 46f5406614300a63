"""Pages, HTML, sections, chunkers, validation, audit, logs on small fixtures."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import numeric
from scriptorium.operators import audit, chunkers, html, matching, sections, validation as va
from scriptorium.sources import readers, stored, writers
from scriptorium.streaming import logs

PAGE = """<html><head><title>LIB: Functions</title></head><body><div class="navpath">skip</div><div class="contents">
<script>x()</script><p>Intro <b>bold</b> lost tail</p><h1>Top</h1><div class="textblock"><p>First paragraph of the top section.</p>
<div class="fragment"><div class="line"><span class="lineno">1</span>int a;</div><div class="line">int b;  </div></div></div>
<h2>Sub</h2><table><tr><th>Name</th><th>Use</th></tr><tr><td>a|b</td><td>one</td></tr></table><table><tr><td>only header</td></tr></table>
<div class="memitem"><div class="memproto"><table><tr><td class="memname">int connect</td><td>(int x)</td></tr></table></div><div class="memdoc"><p>Connects. May fail with E1003.</p></div></div>
<p>After the member there is some text.</p><h1>Next</h1><p>Short but long enough to stay.</p></div></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>no root</p>"), (3, None)], "page_id long, html string")
    parsed = html.parse_pages(pages, "page_id", title_prefix="LIB")
    rows = {r["page_id"]: r for r in parsed.collect()}
    assert rows[1]["title"] == "Functions" and rows[2]["blocks"] is None and rows[3]["blocks"] is None
    kinds = [(b["kind"], b["text"]) for b in rows[1]["blocks"]]
    assert kinds[0] == ("text", "bold") and ("code", "int a;\nint b;") in kinds
    assert ("table", "| Name | Use |\n|---|---|\n| a\\|b | one |") in kinds and sum(k == "table" for k, _ in kinds) == 1
    nodes = html.html_nodes(parsed, "page_id").orderBy("seq").collect()
    got = [(n["section_path"], n["section_level"], n["api_name"], n["error_code"]) for n in nodes]
    assert got == [("Functions / Top", 1, None, None), ("Functions / Top / Sub", 2, None, None), ("Functions / Top / Sub / connect", 3, "connect", "E1003"), ("Functions / Top / Sub", 2, None, None), ("Functions / Next", 1, None, None)]
    assert nodes[0]["text"].startswith("Top\n\nFirst paragraph") and "```c\nint a;" in nodes[0]["text"]
    chunks = html.html_chunks(html.html_nodes(parsed, "page_id"), F.lit("group_lib.html"), base_url="http://x/").orderBy("chunk_id").collect()
    assert chunks[0]["chunk_id"] == "html_v1_group_lib_001_top_00000" and chunks[0]["metadata"]["source_url"] == "http://x/group_lib.html"
    checked = html.html_chunks(html.html_nodes(parsed, "page_id"), F.lit("group_lib.html"), product="p").select(F.size(va.metadata_problems()).alias("n"))
    assert {r["n"] for r in checked.collect()} == {0}


def test_pieces():
    assert html.pieces("a" * 30 + "\n\n" + "b" * 30, budget=100, small=5) == ["a" * 30 + "\n\n" + "b" * 30]
    code = "```\n" + "x = 1\n" * 30 + "```"
    assert code in html.pieces("lead " * 30 + "\n\n" + code, budget=200, small=5)
    assert all(len(p) <= 100 for p in html.pieces("word. " * 200, budget=100, small=5))
    assert html.pieces("x" * 200 + "\n\ntail", budget=150, small=120)[-1].endswith("tail")


def test_table_parts():
    rows = "".join(f"<tr><td>name{i}</td><td>{'v' * 40}</td></tr>" for i in range(100))
    parts = html.table_parts(html.Dom(f"<table><tr><th>n</th><th>v</th></tr>{rows}</table>").root.find("table"))
    assert len(parts) > 1 and all("| n | v |" in p for p in parts) and parts[1].startswith("（表续 2/")


@pytest.fixture(scope="module")
def book(spark):
    marks = [(1, 1, "PART I"), (1, 2, "第1章 A"), (2, 3, "1.1 One"), (3, 4, "1.1.1 Deep"), (4, 4, "1.1.2 More"), (5, 3, "1.2 Two"), (5, 9, "dropped")]
    bookmarks = spark.createDataFrame([("d", i, p, lv, t) for i, (p, lv, t) in enumerate(marks)], "doc string, seq int, page int, level int, title string")
    texts = ["cover", "intro\n1.1 One\n" + "lead text. " * 5, "1.1.1 Deep\n" + "deep text. " * 30, "x\n1.1.2  More\n" + "more text. " * 30, "end of more\n1.2 Two\nlast. " + "words. " * 5, "appendix"]
    pages = spark.createDataFrame([("d", i + 1, i - 5, t) for i, t in enumerate(texts)], "doc string, physical_page int, printed_page int, text string")
    tree = sections.page_ranges(sections.bookmark_tree(bookmarks), spark.createDataFrame([("d", 6)], "doc string, total_pages int"))
    return pages, sections.heading_offsets(tree, pages)


def test_sections(spark, book):
    pages, tree = book
    rows = tree.orderBy("ord").collect()
    assert [r["parent"] for r in rows] == [None, 1, 2, 3, 3, 2]
    assert rows[3]["section_path"] == "PART I / 第1章 A / 1.1 One / 1.1.1 Deep" and rows[5]["section_path"] == "PART I / 第1章 A / 1.2 Two"
    assert [(r["page_start"], r["page_end"]) for r in rows] == [(1, 6), (1, 6), (2, 5), (3, 4), (4, 5), (5, 6)]
    assert (rows[2]["heading_page"], rows[2]["heading_offset"]) == (2, 6) and rows[4]["heading_offset"] == 2 and rows[0]["heading_offset"] is None
    cover = {r["physical_page"]: r["ord"] for r in sections.deepest_cover(pages, tree).collect()}
    assert cover == {1: 2, 2: 3, 3: 4, 4: 4, 5: 5, 6: 6}
    assert {(r["ord"], r["child"]) for r in sections.descendants(tree).collect()} >= {(3, 4), (3, 5)}
    text = {r["ord"]: r["text"] for r in sections.section_texts(tree, pages).collect()}
    assert text[4].startswith("1.1.1 Deep") and text[4].endswith("x") and text[5].endswith("end of more") and text[6].startswith("1.2 Two")


def test_titles(spark, book):
    _, tree = book
    spans = spark.createDataFrame([("d", 3, 1, 0, "1.1.1 Deep", 14.0, "Arial-Bold"), ("d", 3, 2, 0, "body words", 9.0, "Arial"), ("d", 4, 1, 0, "Un", 14.0, "Bold"), ("d", 4, 1, 1, "numbered", 14.0, "Bold")], "doc string, page int, line int, seq int, text string, size double, font string")
    found = {r["title"]: r["level"] for r in sections.title_candidates(spans).collect()}
    assert found == {"1.1.1 Deep": 4, "Unnumbered": 4}
    assert [r["title"] for r in sections.verify_titles(tree, sections.title_candidates(spans)).filter("verified").collect()] == ["1.1.1 Deep"]


def test_chunkers(spark, book):
    pages, tree = book
    small = chunkers.structure_chunks(pages, tree, most=2500, large=3000).collect()
    assert sorted({r["ord"] for r in small}) == [3, 6]
    split = chunkers.structure_chunks(pages, tree, most=200, large=300).collect()
    by = {o: [r["text"] for r in sorted(split, key=lambda r: r["chunk_no"]) if r["ord"] == o] for o in {r["ord"] for r in split}}
    assert sorted(by) == [3, 4, 5, 6] and by[3] == ["1.1 One\n" + ("lead text. " * 5).strip()] and len(by[4]) > 1
    assert len({r["chunk_id"] for r in split}) == len(split) and all(len(r["text"]) <= 200 for r in split)
    semantic = chunkers.semantic_chunks(pages, tree, most=150, least=5).collect()
    assert semantic and all(len(r["text"]) <= 150 for r in semantic)
    hybrid = chunkers.hybrid_chunks(pages, tree, most=200, large=300).collect()
    assert hybrid and all(len(r["text"]) <= 200 for r in hybrid)
    with pytest.raises(ValueError):
        chunkers.get_chunker("fixed")


def test_contract(spark):
    pages = spark.createDataFrame([("d", 1, 1, -5), ("d", 2, 2, -4), ("d", 4, 4, 9)], "doc string, seq int, physical int, printed int")
    assert [r["physical"] for r in va.sequence_gaps(pages, "physical", "seq", group="doc").collect()] == [3]
    assert [r["seq"] for r in va.inconstant_delta(pages, "physical", "printed", "seq", "doc").collect()] == [4]
    row = spark.range(1).select(va.chunk_metadata(source_type=F.lit("pdf"), section_path=F.lit("a / b"), chunk_id=F.lit("c")).alias("metadata"))
    problems = row.select(va.metadata_problems().alias("p")).first()["p"]
    assert "printed_page_start" in problems and "part" in problems and "version" not in problems
    assert row.first()["metadata"]["title"] == " b"


def test_publish(spark, tmp_path):
    meta = va.chunk_metadata(source_id=F.lit("s"), source_file=F.lit("f"), source_type=F.lit("html"), section_path=F.lit("a"), section_level=F.lit(1), node_ids=F.array(F.lit("n")), chunk_id=F.col("chunk_id"), product=F.lit("p"), source_url=F.lit("u"))
    make = lambda ids: spark.createDataFrame([(i, n, "text") for n, i in enumerate(ids)], "chunk_id string, seq int, text string").withColumn("metadata", meta)
    path = str(tmp_path / "nodes")
    writers.write_nodes(make(["a", "b"]), path)
    with pytest.raises(ValueError, match="chunk_id_repeated"):
        writers.write_nodes(make(["a", "a"]), path)
    assert spark.read.parquet(path).count() == 2


def test_readers(spark, tmp_path):
    f = tmp_path / "n.jsonl"
    f.write_text('{"chunk_id":"c1","text":"x","metadata":{"source_id":"s"}}\n\nnot json\n{"text":"y","metadata":{"chunk_id":"c2"}}\n')
    assert sorted(r["node_id"] for r in readers.nodes(spark, str(f), strict=False).collect()) == ["c1", "c2"]
    assert [r["line"] for r in readers.bad_lines(spark, str(f)).collect()] == ["not json"]
    e = tmp_path / "e.jsonl"
    e.write_text('{"question_id":"q1","source_id":"s","page_print":[3,5]}\n{"question_id":"q2","page_print":7}\n{"question_id":"q3"}\n')
    assert {r["question_id"]: (r["page_lo"], r["page_hi"], r["page_is_scalar"]) for r in readers.expected_sources(spark, str(e)).collect()} == {"q1": (3, 5, False), "q2": (7, 7, True)}
    with pytest.raises(ValueError, match="top_k"):
        readers.Experiment.from_dict({"name": "x", "topk": 3})
    log = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), ("c", 4, "w")], "request_id string, seq int, record string")
    assert {r["request_id"]: r["record"] for r in readers.hydrate(log, 2).collect()} == {"b": "y", "c": "w"}


def test_audit(spark):
    nodes = spark.createDataFrame([("s", 1, "Reader listener text", "1 Intro", "1 Intro", 1, 2), ("s", 2, "participant factory", "2 QoS", "2 QoS", 127, 129), ("h", 3, "html", "t", "t", None, None)], "source_id string, ord int, text string, title string, section_path string, printed_page_start int, printed_page_end int")
    terms = spark.createDataFrame([("s", "Participant Factory")], "source_id string, term string")
    assert {r["page"] for r in audit.term_pages(terms, nodes).collect()} == {127, 128, 129}
    questions = spark.createDataFrame([("q1", "what is participant"), ("q2", "域"), ("q3", "x"), ("q4", "listener")], "question_id string, question string")
    a = spark.createDataFrame([("q1", "s", 128, 128, True, "QoS"), ("q2", "s", 500, 501, False, "nowhere"), ("zz", "t", None, None, False, None), ("q4", "s", 128, 129, False, "")], "question_id string, source_id string, page_lo int, page_hi int, page_is_scalar boolean, section_keyword string")
    top1 = spark.createDataFrame([("q1", 128)], "question_id string, page int")
    got = {}
    for r in audit.audit(a, questions, nodes, top1).collect():
        got.setdefault(r["question_id"], set()).add(r["code"])
    assert got["q1"] == {"CIRCULAR_TOP1"} and got["q2"] == {"PAGE_OUT_OF_RANGE", "TERM_NOT_FOUND", "NO_TOKEN_PROBE"}
    assert got["q3"] == {"CONTRACT_MISSING"} and got["q4"] == {"QUESTION_TOKEN_OFF_PAGE"}
    assert {"CONTRACT_UNKNOWN_QUESTION_ID", "CONTRACT_UNKNOWN_SOURCE"} <= got["zz"]
    assert audit.audit_verdict(audit.audit(a, questions, nodes)).first()["verdict"] == "blocked"
    narrowed = {r["question_id"]: (r["page_lo"], r["page_hi"]) for r in audit.narrow(a, nodes).collect()}
    assert narrowed["q1"] == (127, 129) and narrowed["q2"] == (500, 501)


def test_streams(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text('{"ts":"2024-01-01T00:00:00","seq":1,"request_id":"r","record":{"question":"q"}}\n{"ts":"2024-01-01T00:00:01","seq":2,"request_id":"r","record":{"question":"q","answer":"a"}}\n')
    run = lambda: logs.latest_records(logs.read_log(spark, str(source), logs.SOURCE), table, str(tmp_path / "cp")).awaitTermination(60)
    run()
    (source / "b.json").write_text('{"ts":"2024-01-01T00:00:02","seq":3,"request_id":"r","record":{"question":"q","answer":"b"}}\n{"ts":"2024-01-01T00:00:03","seq":4,"request_id":"s","record":{"question":"p"}}\n')
    run()
    assert {r["request_id"]: r["record"]["answer"] for r in spark.read.parquet(f"{table}/v1").collect()} == {"r": "b", "s": None}
    (tmp_path / "ev").mkdir()
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").json(str(tmp_path / "ev"))
    (tmp_path / "ev" / "x.json").write_text('{"event_id":1,"ts":"2024-01-01T00:10:00","user_id":1,"event_type":"a","value":1.5}\n{"event_id":1,"ts":"2024-01-01T00:10:00","user_id":1,"event_type":"a","value":1.5}\n')
    q = logs.windowed_counts(logs.first_events(events), late=None).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None
    batch = spark.createDataFrame([("f", "r", "up", "q" * 600, ["n1"]), ("g", "r", "up", "q", ["zz"]), ("h", "none", "up", "q", [])], "feedback_id string, request_id string, rating string, question string, node_ids array<string>")
    cited = spark.createDataFrame([("r", ["n1", "n2"])], "request_id string, cited_ids array<string>")
    assert [(r["feedback_id"], len(r["question"]), r["cited_nodes"]) for r in logs.feedback_rows(batch, cited).collect()] == [("f", 500, 2)]


def test_terms_in_texts(spark, monkeypatch):
    """Terms of a source are found in its texts, across words and whatever their length, in cells of a bounded size."""
    for name, value in (("CELL", 60), ("TERMS", 5), ("CHUNK", 40), ("PAIRS", 3)):
        monkeypatch.setattr(matching, name, value)
    texts = ["one Two\nthree", "连接失败 错误 one", "threefour five-six seven eight nine ten", "", "aaaaaaaaaaaaaaaaaaaaaaaaab", "ñ " * 30, "two three"]
    terms = ["TWO three", "one", "e", "败错", "four five-six SEVEN eight n", "aaaaaaaaaaaaaaaaaaaaaab", "aaaaaaaaa", "ññ", " ", "missing-term", "nineten", "ninetenx"]
    nodes = [(f"s{i % 2}", i, i % 3, i % 3 + 1, t) for i, t in enumerate(texts * 3)] + [(None, 1, 1, 1, "one")]
    asked = [(f"s{j}", t) for j in range(3) for t in terms] + [(None, "one")]
    tight = lambda t: "".join(t.lower().split())
    n, t = spark.createDataFrame(nodes, "source_id string, rank long, lo int, hi int, text string"), spark.createDataFrame(asked, "source_id string, term string")
    hits = [(s, a, r, lo, hi) for s, a in asked if s and tight(a) for source, r, lo, hi, text in nodes if source == s and tight(a) in tight(text)]
    pages, firsts = {}, {}
    for s, a, r, lo, hi in hits:
        pages[s, a, lo, hi] = min(r, pages.get((s, a, lo, hi), r))
        firsts[s, a] = min((r, lo, hi), firsts.get((s, a), (r, lo, hi)))
    assert {(x["source_id"], x["term"], x["lo"], x["hi"]): x["rank"] for x in matching.find_terms(n, t).collect()} == pages
    assert {(x["source_id"], x["term"]): (x["rank"], x["lo"], x["hi"]) for x in matching.find_terms(n, t, first=True).collect()} == firsts


def test_few_pages_are_held(spark):
    """What a worker makes of a batch leaves it in parts of a bounded number of pages."""
    import pyarrow as pa

    made = []

    class Pages:
        schema = {"page_id": html.T.StructField("page_id", html.T.LongType())}

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            made.append(run)

    html.parse_pages(Pages(), "page_id", title_prefix="LIB")
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(150)), "html": [PAGE] * 149 + [None]})
    parts = list(made[0](iter([batch])))
    assert max(p.num_rows for p in parts) <= html.PAGES_HELD < 150 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(150))
    assert all(p.column(2)[0].as_py() == parts[0].column(2)[0].as_py() for p in parts)


def test_dealt_by_document(spark):
    """Tables dealt out by document are grouped and joined by document and more without moving a row."""
    rows = spark.range(40).selectExpr("id % 7 AS doc", "id AS ord", "concat('t', id) AS text")
    a, b = (stored.settle_by(rows, name, "doc") for name in ("a", "b"))
    both = a.join(b.withColumnRenamed("text", "u").hint("merge"), ["doc", "ord"]).groupBy("doc", "ord").agg(F.max("u").alias("u"))
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, both.collect())) == [(d, o, f"t{o}") for d, o in sorted((i % 7, i) for i in range(40))]


def test_breaks_cut_each_sentence_once(spark):
    """Adding up the neighbours' vectors gives what embedding the three sentences as one text gives; distances are made once."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    said = [(f"d{i % 3}", i, " ".join(words[(i * k) % 8] for k in range(1, i % 6 + 1))) for i in range(50)]
    rows = spark.createDataFrame(said, "doc string, seq int, sentence string")
    plain = lambda c: numeric.hash_vector(c)
    once, thrice = (chunkers.semantic_breaks(rows, e, 0.5) for e in (numeric.hash_vector, plain))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, thrice.collect())) and once.agg(F.max("part")).first()[0] > 0
    assert once._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    counts = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(16))).first()[0] for w in words}
    for text in ("alpha beta alpha", "", "zeta"):
        assert spark.range(1).select(numeric.hash_vector(F.lit(text))).first()[0] == [float(sum(counts[w] == j for w in text.split())) for j in range(16)]
