from pyspark.sql import functions as F

from scriptorium.functions import numeric, text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("r")).first()["r"]


def test_terms(spark):
    cases = {
        "数据分发": ["数据", "据分", "分发"], "域": ["域"], "DomainParticipant E1003": ["domainparticipant", "e1003"],
        "如何调用 connect 接口": ["如何", "何调", "调用", "connect", "接口"], "，。！": [], "": [], "Éa_b": ["a_b"],
    }
    for value, want in cases.items():
        assert one(spark, value, tx.terms) == want


def test_forms(spark):
    assert one(spark, "  A \t b\n", tx.squeeze) == "ab"
    assert one(spark, " a \t b\r\nc ", tx.collapse_blanks) == "a b\nc"
    assert one(spark, "\n12\nHead\n\n\n\nx\n3/9\n第 4 页\n", tx.clean_page) == "Head\n\nx"
    assert one(spark, "一。二！\n三", tx.sentences) == ["一。", "二！", "三"]
    assert one(spark, None, tx.is_blank) and one(spark, " \n ", tx.is_blank) and not one(spark, "x", tx.is_blank)


def test_names(spark):
    assert one(spark, "x\n17\nbody", tx.printed_page) == 17
    assert one(spark, "no\nnumber", tx.printed_page) is None
    assert [one(spark, t, tx.heading_level) for t in ("PART I", "第3章 x", "1.2 a", "1.2.3 a", "1.2.3.4 a", "plain")] == [1, 2, 3, 4, 5, None]
    assert one(spark, "void foo(int bar)", tx.api_name) == "bar"
    assert one(spark, "see E1003 and E77", tx.error_code) == "E1003"
    assert one(spark, "connect participant foo participant", tx.identifiers) == ["participant", "connect"]
    assert one(spark, "a / b / ", tx.last_segment) == " b "
    assert one(spark, "a b.html", lambda c: tx.source_url(F.lit("http://x/"), c)) == "http://x/a%20b.html"


def test_atomic_segments(spark):
    got = one(spark, "intro\n```c\nx\n```\nmid\n| a | b |\n| 1 | 2 |\nend", tx.atomic_segments)
    assert [r["atomic"] for r in got] == [False, True, False, True, False]
    assert "".join(r["text"] for r in got) == "intro\n```c\nx\n```\nmid\n| a | b |\n| 1 | 2 |\nend"


def test_abstains(spark):
    assert one(spark, "NOT FOUND here", tx.abstains)
    assert not one(spark, "", tx.abstains) and not one(spark, None, tx.abstains)


def test_judges(spark):
    for raw, want in {'{"score": 4, "rationale": "ok"}': (0.8, True), '```json\n{"score": 9}\n```': (1.0, True), 'so "score": 3 then': (0.6, True), "garbage": (0.0, False), "[1]": (0.0, False)}.items():
        r = one(spark, raw, numeric.judge_score)
        assert (r["score"], r["parse_ok"]) == want


def test_page_bounds(spark):
    for raw, want in {"7": (7, 7), "[3, 9]": (3, 9), "true": (None, None), None: (None, None), '"x"': (None, None)}.items():
        assert tuple(one(spark, raw, numeric.page_bounds)) == want


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert abs(row.select(numeric.cosine(F.col("a"), F.col("b")).alias("c")).first()["c"] - 2**-0.5) < 1e-9
    sets = spark.createDataFrame([(["a", "b"], ["b"]), ([], [])], "a array<string>, b array<string>")
    assert [r["o"] for r in sets.select(numeric.overlap(F.col("a"), F.col("b")).alias("o")).collect()] == [0.5, 1.0]
