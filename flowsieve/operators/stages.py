"""Shared base of the Spark ML stages: fitted state lives in JSON-serialisable params."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable


class PersistedParams(DefaultParamsReadable, DefaultParamsWritable):
    """Save and load by params alone; medians, categories and scales are small."""

    def _read(self, name: str):
        return self.getOrDefault(name)


class FlowEstimator(Estimator, PersistedParams):
    pass


class FlowModel(Model, PersistedParams):
    pass


class FlowTransformer(Transformer, PersistedParams):
    pass


def strings(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toListString)


def text(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toString)


def number(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toInt)


def flag(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toBoolean)


def state(name: str, doc: str) -> Param:
    """Fitted values: nested lists and dicts of strings and numbers."""
    return Param(Params._dummy(), name, doc, TypeConverters.identity)
