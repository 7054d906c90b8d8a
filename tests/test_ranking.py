from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docsift.functions.ranking import hash_rank, order_rank
from docsift.operators import sampling


def test_ranks_are_dense_and_in_order(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1009)
    got = order_rank(df, ["v", "id"], slices=7).collect()
    ordered = sorted(got, key=lambda r: (r.v, r.id))
    assert [r["rank"] for r in ordered] == list(range(1000))
    assert sorted(r["rank"] for r in hash_rank(df, "id", 1).collect()) == list(range(1000))


def test_hot_value_spreads_over_slices(spark):
    from docsift.functions.ranking import range_slices

    df = spark.range(3000).withColumn("key", F.when(F.col("id") < 2000, 5).otherwise(F.col("id")))
    sizes = range_slices(df, ["key", "id"], 6).groupBy("_slice").count().collect()
    assert max(r["count"] for r in sizes) < 1500


def test_batches_cover_every_item_once(spark):
    got = sampling.minibatches(spark.range(103), "id", 10, seed=3).collect()
    assert sorted(r.id for r in got) == list(range(103))
    sizes = Counter(r.batch_id for r in got)
    assert [sizes[b] for b in range(10)] == [10] * 9 + [13]


def test_batch_order_changes_by_lap(spark):
    batches = sampling.minibatches(spark.range(100), "id", 10, seed=3)
    rows = sampling.batch_order(batches, 3, 5).collect()
    laps = {n: [r.batch_id for r in sorted(rows, key=lambda r: r.visit) if r.lap == n] for n in range(3)}
    assert all(sorted(v) == list(range(10)) for v in laps.values()) and laps[0] != laps[1]


def test_draws_follow_the_weights(spark):
    items = spark.createDataFrame([(0, 6.0), (1, 0.0), (2, 3.0), (3, 1.0)], "id long, w double")
    got = Counter(r.id for r in sampling.weighted_draw(items, "id", "w", 2000, seed=1).collect())
    assert sum(got.values()) == 2000 and got[1] == 0
    assert np.allclose([got[0] / 2000, got[2] / 2000, got[3] / 2000], [0.6, 0.3, 0.1], atol=0.04)


def test_draw_per_row(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3], u) for u in (0.1, 0.2, 0.69, 0.95, 0.999999)], "p array<double>, u double")
    got = [r[0] for r in df.select(sampling.draw_per_row(F.col("p"), F.col("u"))).collect()]
    assert got == [0, 1, 1, 2, 2]
