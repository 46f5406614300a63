"""Registered queries against their SQL, on rows with nulls, empty texts, repeated rows, ties and keyless secrets."""

import random
import string

import duckdb
import pytest

from scriptorium.llm import queries

NAMES = sorted(set(queries.ORACLES) - {"op5_url_filters"})


def prose(n, seed):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(300)], k=n))


def secret(n, seed):
    return "".join(random.Random(seed).choices(string.ascii_letters + string.digits, k=n))


def texts():
    r = random.Random(3)
    rows = [None, "", " \n ", "one", "a b c d", "A B c D", "é " * 9, "Ünï #$ " * 30, "x" * 3000, prose(2000, 1)]
    rows += [prose(40, 9) + "\n" + line * k for line in ("same line\n",) for k in range(4)]
    base = prose(120, 2).split()
    for i in range(12):
        copy = base[:]
        copy[r.randrange(120)] = f"n{i}"
        rows.append(" ".join(copy[: 120 - (i == 3)]))
    passage = prose(100, 5)
    rows += [f"{prose(20, 50 + i)} {passage} {prose(20, 80 + i)}" for i in range(3)] + [f"{passage} ü {passage}", prose(40, 9), prose(40, 9)]
    rows += [f'{prose(25, 90)} password: "{secret(12, 1)}" token=short', f"AKIA{'A1' * 9} {'0a' * 20} é {secret(32, 4)} {secret(19, 5)}", f"{secret(40, 6)}={secret(30, 7)}", "api_key=" + "=" * 30]
    return rows


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, tmp_path, name, empty):
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else "t", len(t or "")) for i, t in enumerate(texts()) if not empty]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)


def test_sketches_do_not_depend_on_partitions(spark, tmp_path):
    rows = [(i, prose(30 + i % 40, i) + " #" * (0 if i % 50 else 8), "en", "s", 0) for i in range(600)]
    kept = []
    for n, order in ((1, 1), (7, -1)):
        path = f"{tmp_path}/{n}"
        spark.createDataFrame(rows[::order], "doc_id long, text string, lang string, source string, n_chars long").repartition(n).write.parquet(f"{path}/documents.parquet")
        kept.append({r["doc_id"]: r["kept"] for r in queries.op4_quality_rules(spark, path).collect()})
    assert kept[0] == kept[1] and len(set(kept[0].values())) == 2
