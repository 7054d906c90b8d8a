"""Reproducible sampling and partitioning: hash order instead of a random generator's state."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docsift.functions.ranking import first_keys, hash_rank, hash_uniform, range_slices


def minibatches(items: DataFrame, key: str, n_batch: int, seed=0) -> DataFrame:
    """(key, batch_id): even batches of floor(N / n_batch); the last takes what is left."""
    n = items.select(F.count(F.lit(1))).scalar()
    size = F.greatest(F.floor(n / F.lit(n_batch)), F.lit(1))
    batch = F.least(F.floor(F.col("rank") / size), F.lit(n_batch - 1)).cast("int")
    return hash_rank(items.select(key), key, seed).select(key, batch.alias("batch_id"))


def batch_order(batches: DataFrame, n_lap: int, seed=0) -> DataFrame:
    """(lap, visit, batch_id, n_items): each lap visits the batches in another order."""
    sizes = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_items"))
    laps = sizes.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(n_lap - 1))))
    order = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("lap")).cast("string"), F.col("batch_id").cast("string")))
    visit = F.row_number().over(W.partitionBy("lap").orderBy(order, "batch_id")) - 1
    return laps.select("lap", visit.alias("visit"), "batch_id", "n_items")


def sample(items: DataFrame, key: str, n: int, seed=0) -> DataFrame:
    """The rows of n keys chosen uniformly. Only keys are ranked; the rows are then looked up by theirs."""
    return items.join(first_keys(items, key, seed, n), key, "left_semi")


def targeted_sample(shares: DataFrame, key: str, threshold: float, n: int, seed=0) -> DataFrame:
    """At most n rows among those whose `share` of a component is above the threshold."""
    return sample(shares.where(F.col("share") > threshold), key, n, seed)


def matching_tokens(tokens: DataFrame, component: int, threshold: float, n: int | None = None, seed=0) -> DataFrame:
    """(doc_id, word_id, cnt) of the tokens whose `resp` for a component is above the threshold.

    Documents are cut to what the component explains. With n, only the tokens of n of the documents that
    keep any, chosen uniformly.
    """
    kept = tokens.where(F.col("resp")[component] > threshold).select("doc_id", "word_id", "cnt")
    if n is None:
        return kept
    return kept.join(first_keys(kept.select("doc_id").distinct(), "doc_id", seed, n), "doc_id", "left_semi")


def weighted_draw(items: DataFrame, key: str, weight: str, n_draws: int, seed=0) -> DataFrame:
    """(draw, key): inverse-CDF draws with chance proportional to the weight.

    A draw is first routed to the slice whose weight range holds it, then compared only with
    the rows of that slice, so neither the table nor the draws pass through one task.
    """
    cut = range_slices(items.select(key, weight), [key])
    totals = cut.groupBy("_slice").agg(F.sum(weight).alias("_t"), F.max("_pos").alias("_last"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    bounds = totals.select(
        "_slice", "_last", "_t", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_start")
    )
    total = bounds.select(F.sum("_t")).scalar()
    # the slice bounds are one short array; a draw looks its slice up there, without a join
    table = bounds.select(F.sort_array(F.collect_list(F.struct("_start", "_slice", "_last")))).scalar()
    draws = cut.sparkSession.range(n_draws).select(F.col("id").cast("int").alias("draw"))
    draws = draws.withColumn("u", hash_uniform(seed, "draw") * total).withColumn("t", table)
    own = F.element_at(F.filter("t", lambda b: b["_start"] <= F.col("u")), -1)
    routed = draws.withColumn("b", own).select(
        "draw", F.col("b._slice").alias("_slice"), F.col("b._last").alias("_last"), (F.col("u") - F.col("b._start")).alias("_v")
    )
    inside = W.partitionBy("_slice").orderBy("_pos")
    rows = cut.withColumn("_hi", F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_lo", F.coalesce(F.lag("_hi").over(inside), F.lit(0.0)))
    hit = (F.col("_v") >= F.col("_lo")) & ((F.col("_v") < F.col("_hi")) | (F.col("_pos") == F.col("_last")))
    return rows.join(routed, "_slice").where(hit).select("draw", key)


def draw_per_row(probs: Column, uniform: Column) -> Column:
    """First index whose cumulative probability exceeds the row's own uniform number."""
    step = F.aggregate(
        probs,
        F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n")),
        lambda a, p: F.struct(
            (a["c"] + p).alias("c"), (a["n"] + F.when(a["c"] + p <= uniform, 1).otherwise(0)).alias("n")
        ),
    )
    return F.least(step["n"], F.size(probs) - 1)
