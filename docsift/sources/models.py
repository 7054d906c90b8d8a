"""Saving and loading fitted models by lap."""
from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from docsift.operators import stats as ST
from docsift.plans.mixture import Mixture, long_rows
from docsift.plans.topics import TopicModel


def _append(spark, path, lap, info) -> None:
    row = spark.createDataFrame([(float(lap), json.dumps(info))], "lap double, info string")
    laps = spark.read.schema(row.schema).parquet(f"{path}/laps") if saved(spark, path) else row.limit(0)
    if laps.where(F.col("lap") == float(lap)).isEmpty():  # a repeated step does not save its lap twice
        row.write.mode("append").parquet(f"{path}/laps")
    row.select("lap").write.mode("overwrite").parquet(f"{path}/best")


def save_mixture(spark: SparkSession, model: Mixture, path: str, lap: float) -> None:
    """Parameters of one lap as rows; the one-row table `best` points to the newest."""
    arrays = {**{f"w.{n}": v for n, v in model.weights.items()}, **{f"c.{n}": v for n, v in model.comps.items()}}
    if lap == 0 or not saved(spark, path):
        prior = {n: np.atleast_1d(v) for n, v in model.prior.items()}
        spark.createDataFrame(long_rows(prior), ST.SCHEMA).write.mode("overwrite").parquet(f"{path}/prior")
    spark.createDataFrame(long_rows(arrays), ST.SCHEMA).write.mode("overwrite").parquet(f"{path}/model/lap={float(lap)}")
    info = {"alloc": model.alloc, "obs": model.obs, "k": model.k, "dim": model.dim, "alpha0": model.alpha0,
            "shapes": {n: list(np.shape(v)) for n, v in arrays.items()}}
    _append(spark, path, lap, {**info, "prior": {n: list(np.shape(v)) for n, v in model.prior.items()}})


def saved(spark: SparkSession, path: str) -> bool:
    """Whether a model has been saved under path."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/laps")
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def nearest_lap(laps: DataFrame, lap: float) -> DataFrame:
    """The saved lap closest to the one asked for; the earlier one on a tie."""
    return laps.orderBy(F.abs(F.col("lap") - lap), "lap").limit(1)


def load_mixture(spark: SparkSession, path: str, lap: float | None = None) -> tuple[Mixture, float]:
    laps = spark.read.schema("lap double, info string").parquet(f"{path}/laps")
    lap = spark.read.parquet(f"{path}/best").first()["lap"] if lap is None else lap
    at = nearest_lap(laps, lap).first()
    info = json.loads(at["info"])
    arrays = ST.to_numpy(spark.read.schema(ST.SCHEMA).parquet(f"{path}/model/lap={at['lap']}"), {n: tuple(s) for n, s in info["shapes"].items()})
    shapes = {n: tuple(s) or (1,) for n, s in info["prior"].items()}
    prior = ST.to_numpy(spark.read.schema(ST.SCHEMA).parquet(f"{path}/prior"), shapes)
    prior = {n: float(v[0]) if not info["prior"][n] else v for n, v in prior.items()}
    model = Mixture(info["alloc"], info["obs"], info["k"], info["dim"], prior, info["alpha0"])
    model.weights = {n[2:]: v for n, v in arrays.items() if n.startswith("w.")}
    model.comps = {n[2:]: v for n, v in arrays.items() if n.startswith("c.")}
    return model, at["lap"]


FIELDS = ("k", "vocab_size", "kind", "lam0", "alpha0", "gamma", "sticks", "assign", "limit_bytes")


def save_topics(spark: SparkSession, model: TopicModel, path: str, lap: float) -> None:
    """The topic table goes from the executors to parquet; the sticks are a few numbers."""
    model.topics.write.mode("overwrite").parquet(f"{path}/model/lap={float(lap)}")
    info = {f: getattr(model, f) for f in FIELDS}
    if model.kind == "hdp":
        info |= {"u1": model.u1.tolist(), "u0": model.u0.tolist()}
    _append(spark, path, lap, info)


def load_topics(spark: SparkSession, path: str, lap: float | None = None) -> tuple[TopicModel, float]:
    laps = spark.read.schema("lap double, info string").parquet(f"{path}/laps")
    lap = spark.read.parquet(f"{path}/best").first()["lap"] if lap is None else lap
    at = nearest_lap(laps, lap).first()
    info = json.loads(at["info"])
    model = TopicModel(**{f: info[f] for f in FIELDS})
    if model.kind == "hdp":
        model.u1, model.u0 = np.array(info["u1"]), np.array(info["u0"])
    schema = "word_id int, lam array<double>"
    model.topics = spark.read.schema(schema).parquet(f"{path}/model/lap={at['lap']}")
    return model, at["lap"]
