"""Trained models as files that Spark writes: weights, features, metrics and a hash of the feature list."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import SparkSession

from .training import DeepModel, GatedModel, RankModel


def feature_hash(features: list[str]) -> str:
    return hashlib.sha1("\n".join(features).encode()).hexdigest()


def _shape(model: RankModel) -> dict[str, object]:
    return {"layers": list(model.layers), "dropout": model.dropout} if isinstance(model, DeepModel) else {}


def save(spark: SparkSession, model: RankModel, path: str, metrics: dict[str, float] | None = None, scaler: list[dict] | None = None) -> None:
    """metrics: those of the validation; scaler: rows of feature, mean, std."""
    text = json.dumps({"features": model.features, "sha1": feature_hash(model.features), "kind": type(model).__name__, "hidden": model.hidden, "seed": model.seed, "shape": _shape(model), "scaler": scaler or [], "metrics": metrics or {}, "weights": {k: v.tolist() for k, v in model.weights.items()}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> RankModel:
    """The model; a ValueError if its feature list was changed or the columns at hand lack one."""
    data = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if feature_hash(data["features"]) != data["sha1"]:
        raise ValueError("the feature list doesn't fit its hash")
    if columns is not None and (missing := [f for f in data["features"] if f not in columns]):
        raise ValueError(f"missing features: {', '.join(missing)}")
    kind = {c.__name__: c for c in (RankModel, GatedModel, DeepModel)}[data.get("kind", "RankModel")]
    return kind(data["features"], data["hidden"], data["seed"], {k: np.array(v) for k, v in data["weights"].items()}, **data.get("shape", {}))


def told(spark: SparkSession, path: str) -> dict[str, object]:
    """What a stored model says of itself: kind, features, their hash, metrics and scaler."""
    data = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    return {k: data.get(k) for k in ("kind", "features", "sha1", "metrics", "scaler")}


def first_usable(spark: SparkSession, paths: list[str], columns: list[str]) -> RankModel:
    """The first model of the list that the columns at hand can feed."""
    for path in paths:
        try:
            return load(spark, path, columns)
        except ValueError:
            continue
    raise ValueError("none of the models fits the columns")
