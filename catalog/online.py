"""Minibatch learners, structure moves, saved models."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.mixtures import K, labelled, points, vectors
from catalog.topics import fitted, written
from docsift.operators import bow, sampling, stats as ST
from docsift.plans import memoized, mixture as X, moves, online as O, runs, topics as P
from docsift.session import scratch_path
from docsift.sources import models


def split_vectors(spark, sf, n_batch):
    vs = vectors(spark, sf)
    return vs, O.split(vs, sampling.minibatches(vs, "id", n_batch, 1), "id")


def split_docs(spark, sf, n_batch):
    words, triples = written(spark, sf)
    rows = bow.bow_rows(triples)
    return words, triples, O.split(rows, sampling.minibatches(rows, "doc_id", n_batch, 1), "doc_id")


@query("sovb_mixture")
def sovb_mixture(spark, sf):
    vs, rows = split_vectors(spark, sf, 4)
    model = X.start(vs, X.new_model(vs, "vb", "diag", K), "randexamplesbydist")
    return X.trace_table(spark, O.sovb_mixture(rows, model, 4, 2)[1])


@query("movb_mixture")
def movb_mixture(spark, sf):
    vs, rows = split_vectors(spark, sf, 3)
    model = X.start(vs, X.new_model(vs, "dp", "diag", K), "randexamplesbydist")
    return X.trace_table(spark, memoized.movb_mixture(rows, model, 3)[1])


def moves_table(spark, log):
    return spark.createDataFrame(log, memoized.MOVES)


@query("movb_merges")
def movb_merges(spark, sf):
    """Event points, 6 components: the merges that the memoized learner tries until its bound stands."""
    vs = points(spark, sf)
    rows = O.split(vs, sampling.minibatches(vs, "id", 3, 1), "id")
    model, log = X.start(vs, X.new_model(vs, "dp", "full", 6), "randexamplesbydist"), []
    memoized.movb_mixture(rows, model, 3, 30, merge="marglik", digits=5, log=log)
    return moves_table(spark, log)


@query("movb_births")
def movb_births(spark, sf):
    """Event points, from one component: births on kept statistics, and merges that start from the newborn."""
    vs = points(spark, sf)
    rows = O.split(vs, sampling.minibatches(vs, "id", 3, 1), "id")
    model, log = X.start(vs, X.new_model(vs, "dp", "full", 1), "randsoftpartition"), []
    memoized.movb_mixture(rows, model, 3, 16, merge="bestnmatchfromlist", births=4, digits=5, log=log)
    return moves_table(spark, log)


@query("movb_topic_merges")
def movb_topic_merges(spark, sf):
    """The memoized topic learner with merges judged from kept pair sums."""
    words, triples, rows = split_docs(spark, sf, 2)
    model, log = P.new_model(words, triples, 6, "randexamples"), []
    memoized.movb_topics(rows, words, model, 2, 15, merge="marglik", digits=5, log=log)
    return moves_table(spark, log)


@query("sovb_lda")
def sovb_lda(spark, sf):
    words, triples, rows = split_docs(spark, sf, 3)
    model = P.new_model(words, triples, K, "randexamples", kind="lda")
    return X.trace_table(spark, O.sovb_topics(rows, words, model, 3, 1)[1])


@query("movb_lda")
def movb_lda(spark, sf):
    words, triples, rows = split_docs(spark, sf, 2)
    model = P.new_model(words, triples, K, "randexamples", kind="lda")
    return X.trace_table(spark, memoized.movb_topics(rows, words, model, 2, 15, digits=5)[1])


@query("merge_moves")
def merge_moves(spark, sf):
    vs = points(spark, sf)
    log: list = []
    X.fit(vs, X.start(vs, X.new_model(vs, "dp", "full", 6), "randexamplesbydist"), 30, 5, after_lap=moves.merge_lap(log))
    return spark.createDataFrame(log, moves.MERGE_LOG)


@query("birth_moves")
def birth_moves(spark, sf):
    vs = points(spark, sf)
    model, log = X.new_model(vs, "dp", "full", 1), []
    model, _ = X.fit(vs, X.start(vs, model, "randsoftpartition"), 1)
    ss = ST.to_numpy(X.model_stats(vs, model), X.shapes(model))
    bound = model.elbo(ss)
    for seed in range(2):
        target = moves.select_birth(ss["N"], "size", seed=seed)
        model, ss, bound, row = moves.birth(vs, model, ss, bound, target, 4, n_lap=3, seed=seed)
        log.append((seed, *row))
    return spark.createDataFrame(
        log, "move int, target int, n_sample int, k_fresh int, before double, after double, accepted boolean"
    )


@query("topic_merges")
def topic_merges(spark, sf):
    words, _, rows, model, _ = fitted(spark, sf, n_lap=1, k=5)
    _, _, log = moves.topic_merges(rows, words, model)
    return spark.createDataFrame(log, moves.MERGE_LOG)


@query("topic_births")
def topic_births(spark, sf):
    words, triples, rows, model, trace = fitted(spark, sf, n_lap=1, k=3)
    bound, log = trace[-1][1], []
    for how in ("criticalneed", "datadriven", "fromtargetstats", "randomfromexisting", "randomfromprior"):
        model, bound, row = moves.topic_birth(rows, triples, words, model, bound, how, 2, n_inner=5)
        log.append(row)
    schema = "how string, target int, n_docs int, k_added int, before double, after double, accepted boolean"
    return spark.createDataFrame(log, schema)


@query("model_save_load")
def model_save_load(spark, sf):
    """Parameters read back after a save: component table of the loaded model."""
    vs = vectors(spark, sf)
    model = labelled(vs, "vb", "diag", K)
    path = scratch_path(spark, "model")
    models.save_mixture(spark, model, path, 1.0)
    return X.comp_table(spark, models.load_mixture(spark, path)[0])


@query("nearest_lap", f"""WITH l AS (SELECT label AS lap, count(*) * 1.0 AS n FROM embeddings GROUP BY label)
SELECT cast(lap AS DOUBLE) AS lap, n FROM l ORDER BY abs(lap - 6.4), lap LIMIT 1""")
def nearest_lap(spark, sf):
    laps = vectors(spark, sf).groupBy(F.col("label").cast("double").alias("lap")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return models.nearest_lap(laps, 6.4)


@query("resume_fit")
def resume_fit(spark, sf):
    """Two laps, save, resume at the nearest saved lap, two more: the joined trace."""
    vs = vectors(spark, sf)
    path = scratch_path(spark, "resume")
    model, trace = X.fit(vs, X.start(vs, X.new_model(vs, "vb", "diag", K), "randexamplesbydist"), 2)
    models.save_mixture(spark, model, path, 2.0)
    _, more = runs.resume_mixture(vs, path, 4, 1.7)
    return X.trace_table(spark, trace + more)


@query("warm_start")
def warm_start(spark, sf):
    """A saved EM model starts a variational one: E step with the old, M step of the new."""
    vs = vectors(spark, sf)
    path = scratch_path(spark, "warm")
    models.save_mixture(spark, labelled(vs, "em", "diag", K), path, 1.0)
    saved, _ = models.load_mixture(spark, path)
    return X.comp_table(spark, runs.warm_mixture(vs, saved, X.new_model(vs, "vb", "diag", K)))


