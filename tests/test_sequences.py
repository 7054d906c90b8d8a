import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import graph as Gr, hmm as H
from docsift.streaming import counts, filtering

MODEL = H.Hmm([0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]], [[0.7, 0.2, 0.1], [0.1, 0.3, 0.6]])


def brute(obs):
    e = MODEL.evidence(np.array(obs))
    f, b = [], [np.ones(2)]
    ll = 0.0
    for t, v in enumerate(e):
        p = (MODEL.init if t == 0 else f[-1] @ MODEL.trans) * v
        ll += np.log(p.sum())
        f.append(p / p.sum())
    for v in e[:0:-1]:
        x = MODEL.trans @ (v * b[0])
        b.insert(0, x / x.sum())
    r = np.array(f) * np.array(b)
    return r / r.sum(1, keepdims=True), ll


@pytest.fixture(scope="module")
def events(spark):
    """Most events belong to user 1."""
    rng = np.random.RandomState(0)
    rows = [(1 if i % 4 else 2 + i % 3, i, i, int(rng.randint(3)) if i % 50 else -1) for i in range(400)]
    df = spark.createDataFrame(rows, "user long, n long, id long, obs int")
    return rows, df.withColumn("ts", F.timestamp_seconds(F.col("n") * 60)).cache()


@pytest.mark.parametrize("length", [3, 5000])
def test_smoothing_is_the_same_however_cut(events, length):
    rows, df = events
    packed = H.chunks(df, "user", ["ts"], length)
    got = {r.id: r for r in H.smooth(packed, MODEL).collect()}
    lls = {r.key: r.log_lik for r in H.log_likelihood(packed, MODEL).collect()}
    assert len(got) == 400
    for user in (1, 2, 3, 4):
        mine = [r for r in rows if r[0] == user]
        resp, ll = brute([r[3] for r in mine])
        assert np.isclose(lls[user], ll)
        assert np.allclose([got[r[2]].resp for r in mine], resp)
        assert got[mine[0][2]].pair is None
        pairs = np.array([got[r[2]].pair for r in mine[1:]]).reshape(-1, 2, 2)
        assert np.allclose(pairs.sum(1), resp[1:]) and np.allclose(pairs.sum(2), resp[:-1])


def test_stream_filter_equals_forward_pass(spark, events, tmp_path):
    rows, df = events
    src = df.select(F.col("user").alias("key"), "ts", "id", "obs")
    for part in range(3):
        src.where((F.col("id") >= part * 150) & (F.col("id") < (part + 1) * 150)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    got = {r.id: r.f for r in filtering.filter_events(spark, stream, MODEL, path, length=8).collect()}
    state = {r.key: (r.f, r.log_lik) for r in spark.read.parquet(path + "/state/version=3").collect()}
    for user in (1, 2, 3, 4):
        mine = [r for r in rows if r[0] == user]
        assert np.isclose(state[user][1], brute([r[3] for r in mine])[1])
        for n in (1, len(mine) // 2, len(mine)):
            # the filter at step n is the smoother of the first n events at its last step
            assert np.allclose(got[mine[n - 1][2]], brute([r[3] for r in mine[:n]])[0][-1])


def test_late_events_are_dropped(spark, events, tmp_path):
    rows, df = events
    src = df.select(F.col("user").alias("key"), "ts", "id", "obs")
    src.where("id >= 200").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    src.where("id < 200").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = filtering.filter_events(spark, stream, MODEL, str(tmp_path / "out")).collect()
    assert sorted(r.id for r in out) == list(range(200, 400))


def test_stream_counts_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "red red blue" if i % 3 else "blue green") for i in range(30)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = counts.run_available(spark, counts.word_totals(stream), str(tmp_path / "out")).collect()
    assert sorted(r.word for r in got) == ["blue", "green", "red"]  # one row each, whatever the number of batches
    assert {r.word: (r.df, r.cf) for r in got} == {"red": (20, 40), "blue": (30, 30), "green": (10, 10)}


def test_stream_counts_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    got = counts.run_available(spark, counts.word_totals(stream), str(tmp_path / "out"))
    assert got.columns == ["word", "df", "cf"] and got.count() == 0


def test_communities_found(spark):
    rng = np.random.RandomState(0)
    rows = [(i, j) for i in range(60) for j in range(i + 1, 60) if rng.rand() < (0.6 if i // 20 == j // 20 else 0.01)]
    edges = Gr.mark_heldout(Gr.undirected(spark.createDataFrame(rows, "src long, dst long")), 0.1, 1)
    nodes = spark.range(60)
    members, _, trace = Gr.communities(nodes, edges, 3, 14, 1)
    assert trace[-1][1] > trace[0][1]
    found = {r.id: r.k for r in Gr.assign(members).collect()}
    agree = [np.bincount([found[i] for i in range(g * 20, g * 20 + 20)], minlength=3) for g in range(3)]
    assert all(a.max() >= 13 for a in agree) and len({int(a.argmax()) for a in agree}) == 3


def test_non_edges_by_brute_force(spark):
    edges = spark.createDataFrame([(0, 1, False), (1, 2, True), (0, 3, False)], "src long, dst long, heldout boolean")
    got = {r.id: (r.n_edges, r.n_nonedges, r.n_heldout) for r in Gr.pair_counts(spark.range(5), edges).collect()}
    assert got == {0: (2, 2, 0), 1: (1, 2, 1), 2: (0, 3, 1), 3: (1, 3, 0), 4: (0, 4, 0)}
