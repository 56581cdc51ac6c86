"""Trained models on shared storage, saved and loaded whole.

A model is a folder: its Spark parts in Spark's own format, the bases of a
stack as models of their own, and a line of JSON with the class, its parameters
and the classes of the parts.
"""

from __future__ import annotations

import json
from dataclasses import fields
from importlib import import_module

from pyspark.sql import SparkSession

from ..operators import models as kinds

_TRAINED = {"models", "model", "fitted", "meta", "bases"}


def save_trained(spark: SparkSession, model, path: str) -> None:
    """Write a model of :mod:`tidemark.operators.models`; an older one at ``path`` is replaced."""
    parts = getattr(model, "models", None) or [p for p in (getattr(model, "model", None), getattr(model, "meta", None)) if p]
    bases = getattr(model, "fitted", [])
    for i, part in enumerate(parts):
        part.write().overwrite().save(f"{path}/part{i}")
    for i, base in enumerate(bases):
        save_trained(spark, base, f"{path}/base{i}")
    about = {
        "kind": type(model).__name__,
        "params": {f.name: getattr(model, f.name) for f in fields(model) if f.name not in _TRAINED},
        "parts": [f"{type(p).__module__}.{type(p).__name__}" for p in parts],
        "bases": len(bases),
    }
    line = spark.createDataFrame([(json.dumps(about),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_trained(spark: SparkSession, path: str):
    """The model that :func:`save_trained` wrote, ready to predict."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    parts = []
    for i, name in enumerate(about["parts"]):
        module, _, kind = name.rpartition(".")
        parts.append(getattr(import_module(module), kind).load(f"{path}/part{i}"))
    kind, params = getattr(kinds, about["kind"]), about["params"]
    bases = [load_trained(spark, f"{path}/base{i}") for i in range(about["bases"])]
    if bases:
        made = [lambda b=b: type(b)(**{f.name: getattr(b, f.name) for f in fields(b) if f.name not in _TRAINED}) for b in bases]
        return kind(bases=made, fitted=bases, meta=parts[0], **params)
    return kind(models=parts, **params) if "models" in {f.name for f in fields(kind)} else kind(model=parts[0], **params)
