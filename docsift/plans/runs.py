"""Runs around the learners: saving while fitting, going on from a saved lap, starting from another model."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docsift.operators import stats as ST
from docsift.plans import mixture as X, topics as P
from docsift.sources import models


def together(*hooks: dict[str, Callable]) -> dict[str, Callable]:
    """One set of callbacks that calls those of all sets, in their order."""

    def each(calls):
        def run(model, percent, info):
            for call in calls:
                call(model, percent, info)

        return run

    return {name: each([h[name] for h in hooks if name in h]) for name in {n for h in hooks for n in h}}


def saver(spark, path: str, every: int = 1) -> dict[str, Callable]:
    """Callbacks that save a mixture or topic model after every `every` laps and after the last one."""

    def save(model, lap):
        put = models.save_topics if isinstance(model, P.TopicModel) else models.save_mixture
        put(spark, model, path, lap)

    def lap_done(model, percent, info):
        if int(info[0]) % every == 0:
            save(model, info[0])

    def run_done(model, percent, trace):
        if trace and int(trace[-1][0]) % every:
            save(model, trace[-1][0])

    return {"onLapComplete": lap_done, "onAlgorithmComplete": run_done}


def tracer(every: int = 1):
    """(rows, callbacks): the trace of every `every` laps and of the last one, filled while the run goes on."""
    rows: list = []

    def lap_done(model, percent, info):
        if int(info[0]) % every == 0:
            rows.append(info)

    def run_done(model, percent, trace):
        if trace and int(trace[-1][0]) % every:
            rows.append(trace[-1])

    return rows, {"onLapComplete": lap_done, "onAlgorithmComplete": run_done}


def resume_mixture(vectors: DataFrame, path: str, n_lap: int, lap: float | None = None, **limits):
    """(model, trace) of a run that goes on at the saved lap nearest to `lap` (the newest, if None) up to lap n_lap."""
    model, at = models.load_mixture(vectors.sparkSession, path, lap)
    return X.fit(vectors, model, n_lap, first_lap=int(at), **limits)


def resume_topics(rows: DataFrame, vocab: DataFrame, path: str, n_lap: int, lap: float | None = None, **limits):
    """The same for topics; rows: document rows of the same vocabulary."""
    model, at = models.load_topics(rows.sparkSession, path, lap)
    return P.fit(rows, vocab, model, n_lap, first_lap=int(at), **limits)


def warm_mixture(vectors: DataFrame, saved: X.Mixture, model: X.Mixture) -> X.Mixture:
    """A new model from the responsibilities under a saved one of any allocation: E step with the old, M step of the new."""
    return model.m_step(ST.to_numpy(X.model_stats(vectors, saved), X.shapes(saved)))


def warm_topics(rows: DataFrame, vocab: DataFrame, saved: P.TopicModel, model: P.TopicModel, n_inner: int = 10) -> P.TopicModel:
    """The same for topics: sums under the saved topics, also of another corpus with this vocabulary."""
    return P.m_step(model, vocab, P.topic_stats(rows, saved, n_inner))
