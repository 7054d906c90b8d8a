"""Decontamination: SQL on whole tables, both ways of matching, odd rows."""
import duckdb
import pytest
from pyspark.sql import functions as F

from docsift.llm.common import words
from docsift.llm.decontaminate import contaminated, decontaminate
from docsift.llm.q_decontaminate import SQL, op1_decontaminate

SF = "/root/testdata/sf0.01"


def plain(docs, items, span=13):
    windows = {}
    for key, text in items:
        w = words(text)
        m = min(len(w), span)
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault((m, tuple(w[i : i + m])), set()).add(str(key))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {m for m, _ in windows}:
            for i in range(len(w) - m + 1):
                if ids := windows.get((m, tuple(w[i : i + m]))):
                    hit.update(range(i, i + m))
                    found |= ids
        out.append((key, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def test_query_same_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(SQL)
    want = sorted(map(tuple, rel.fetchall()))
    got = sorted(tuple(r[c] for c in rel.columns) for r in op1_decontaminate(spark, SF).collect())
    assert got == want and any(r[-1] for r in got)


@pytest.mark.parametrize("ship_bytes", [1 << 20, 0])
def test_odd_rows_by_either_way(spark, ship_bytes):
    run = " ".join(f"w{i}" for i in range(30))
    items = [(1, run), (2, "Short Item"), (3, ""), (4, None), (5, "w3 w4 w5"), (1, run), (6, "é ü")]
    docs = [
        (1, "a " + " ".join(f"W{i}" for i in range(5, 20)) + " b"),
        (2, "short, item! short item"),
        (3, None),
        (4, ""),
        (5, "x " * 30_000 + run),
        (6, " ".join(f"w{i}" for i in range(12))),
        (7, "É ü é ü"),
        (8, "short item"),
        (8, "short item"),
        (None, run),
    ]
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate(d, b, ship_bytes=ship_bytes).collect()), key=repr)
    assert got == plain(docs, items)
    flags = {r.doc_id: r.c for r in decontaminate(d, b, ship_bytes=ship_bytes).withColumn("c", contaminated()).collect()}
    assert flags[1] and not flags[5] and not flags[3]
    assert decontaminate(d.where(F.lit(False)), b, ship_bytes=ship_bytes).count() == 0
    assert {r.n_hit for r in decontaminate(d, b.where(F.lit(False)), ship_bytes=ship_bytes).collect()} == {0}


@pytest.mark.parametrize("ship_bytes", [1 << 20, 0])
def test_rows_that_share_an_id_are_judged_apart(spark, ship_bytes):
    run = " ".join(f"w{i}" for i in range(30))
    docs = [(1, run), (1, "five clean words are here"), (None, run), (None, "clean too"), (None, None), (2, run), (2, run)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, run)], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.c) for r in decontaminate(d, b, ship_bytes=ship_bytes).withColumn("c", contaminated()).collect()), key=repr)
    want = [(1, 30, 30, True), (1, 5, 0, False), (None, 30, 30, True), (None, 2, 0, False), (None, 0, 0, False), (2, 30, 30, True), (2, 30, 30, True)]
    assert got == sorted(want, key=repr)
