"""Sharding: draws against SQL, movement, slots, odd rows."""
import zlib

import duckdb
from pyspark.sql import functions as F

from docsift.llm.q_shards import op8_shards
from docsift.llm.shards import even_tree, shard, shard_of

SF = "/root/testdata/sf0.01"


def _level(draws, level, parent):
    """Rows of documents with the child of the largest draw below their parent, a child's draw being the best below it."""
    below = "" if parent is None else f" SEMI JOIN {parent[1]} p ON p.doc_id = x.doc_id AND p.{parent[0]} = x.{parent[0]}"
    return f"(SELECT doc_id, arg_max({level}, draw) AS {level} FROM {draws} x{below} GROUP BY doc_id)"


def _tree_sql(n):
    values = ", ".join(f"({g}, {r}, {s}, {w}::DOUBLE)" for g, r, s, w in even_tree(n))
    unit = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || shard), 1, 12))::BIGINT + 1) / {16**12}::DOUBLE"
    draws = f"(SELECT doc_id, region, rack, shard, ln({unit}) / w AS draw FROM documents, (VALUES {values}) AS n(region, rack, shard, w))"
    top = _level(draws, "region", None)
    mid = _level(draws, "rack", ("region", top))
    return _level(draws, "shard", ("rack", mid))


SQL = f"""
SELECT d.doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, 'key' AS law, a.shard, b.shard AS grown_shard
FROM documents d JOIN {_tree_sql(40)} a USING (doc_id) JOIN {_tree_sql(41)} b USING (doc_id)
"""


def test_query_same_as_sql_and_slots_gapless(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: (r[1], r[3], r[4]) for r in con.sql(SQL).fetchall()}
    texts = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    got = op8_shards(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.shard, r.grown_shard) for r in got} == want
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(r.grown_shard in (r.shard, 40) for r in got)


def test_only_subtrees_with_new_weights_move(spark):
    tree = [(s // 4, s // 2, s, 1.0) for s in range(8)]
    heavier = [(g, r, s, w * (3 if s == 1 else 1)) for g, r, s, w in tree]
    rows = shard_of(shard_of(spark.range(4000).withColumnRenamed("id", "k"), "k", tree, "a"), "k", heavier, "b").collect()
    assert all(r.b // 4 == 0 for r in rows if r.a != r.b)  # region 0 alone grew heavier
    assert all(r.a == r.b for r in rows if r.a // 4 == 1 and r.b // 4 == 1)
    share = sum(r.b == 1 for r in rows) / len(rows)
    assert abs(share - 3 / 10) < 0.03


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(6000).withColumnRenamed("id", "k")
    counts = [1, 2, 5, 6, 19, 20, 21, 39, 40, 41, 42]
    for n in counts:
        rows = shard_of(rows, "k", even_tree(n), f"s{n}")
    got = rows.collect()
    for a, b in zip(counts, counts[1:]):
        moved = [r[f"s{b}"] for r in got if r[f"s{a}"] != r[f"s{b}"]]
        assert moved and min(moved) >= a
        share = len(moved) / len(got)
        assert abs(share - (b - a) / b) < 0.03
    for n in counts[4:]:
        held = [sum(r[f"s{n}"] == s for r in got) for s in range(n)]
        assert max(held) < 2 * len(got) / n and min(held) > len(got) / n / 2


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, "", 2), (5, "x" * 200_000, 3), (5, "x" * 200_000, 3), (6, "\u00e9", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard(docs, even_tree(3), even_tree(4), 4).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 18, 200016, 200016]
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert shard(docs.where(F.lit(False)), even_tree(3), even_tree(4)).count() == 0
