"""Ranked search against brute force and SQL; classes, blocks of items, ties, odd rows."""
import math
import random
import re
from collections import Counter

from check import compare, connect
from docsift.llm.q_ranking import SQL, op12_ranking
from docsift.llm.ranking import TERM, classes, search, term_bags

SF = "/root/testdata/sf0.01"


def terms(text):
    return re.findall(TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    n_terms = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, query in wanted.items():
        scored = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // max(n_terms, 1)
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            s = sum(weight(t) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in query if t in b)
            if s > 0:
                scored.append((s, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, i, s) for r, (s, i) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def made(rng):
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "A_b", "x1"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 12)))) for i in range(150)]
    docs += [(200 + i, docs[7][1].upper()) for i in range(70)] + [(3, "w1 w2"), (3, "w1 w2"), (3, "w3"), (None, "w1 w2"), (None, "w5"), (400, None), (401, ""), (402, "w1 " * 30_000)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 8)))) for i in range(12)] + [(1, "w1"), (1, "w1 w9"), (None, "w2 w3"), (50, None), (51, ""), (52, "absent")]
    return docs, items


def test_equals_brute_force_in_one_block_and_in_many(spark):
    docs, items = made(random.Random(2))
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(5)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id int, text string, rank string")
    for top, block in ((50, 1_000_000), (7, 10)):
        got = sorted((tuple(r) for r in search(d, q, top, block).collect()), key=str)
        assert got == brute(docs, items, top)


def test_a_class_holds_equal_bags_only(spark):
    rows = [(i, t) for i, t in enumerate(["a b x", "b a y", "a b", "a a b", "a b z", "q r s", None])]
    bags = term_bags(spark.createDataFrame(rows, "doc_id long, text string"), ["a", "b"])
    got = sorted(r.members for r in classes(bags, 6, 16, 50).collect())
    assert got == [[0, 1, 4], [2], [3]]
    assert sorted(r.members for r in classes(bags, 6, 16, 2).collect()) == [[0, 1], [2], [3]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(docs, items).count() == 1
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    assert search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_sql(spark):
    ok, message = compare(spark, connect(SF), "op12_ranking", op12_ranking, SQL, SF)
    assert ok, message
