"""Training and applying ``pyspark.ml`` models on feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from importlib import import_module

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import named_col

_FEATURES = "__features"


class ModelWrapper:
    """An estimator, and after ``fit`` its model, applied to named feature columns.

    :param model_class: an estimator class, or its dotted path
    :param model_instance: a ready estimator or model, used instead of ``model_class(**kwargs)``

    ``predict`` and ``predict_proba`` return the table with one more column. Other
    attributes are those of the wrapped object.
    """

    def __init__(self, model_class=None, model_instance=None, **kwargs):
        if isinstance(model_class, str):
            module, _, name = model_class.rpartition(".")
            if not module:
                raise ImportError(f"{model_class!r} is not a dotted path")
            model_class = getattr(import_module(module), name)
        self.model_class = model_class
        self.model = model_class(**kwargs) if model_instance is None else model_instance
        self.features: list[str] = []

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> "ModelWrapper":
        """Train on ``features`` and ``label``; rows with a missing value fail the job."""
        self.features = list(features)
        data = self._assembled(df).select(_FEATURES, named_col(label).cast("double").alias("__label"))
        columns = {self.model.featuresCol: _FEATURES, self.model.labelCol: "__label"}
        self.model = self.model.fit(data, columns)
        return self

    def predict(self, df: DataFrame, result: str = "prediction") -> DataFrame:
        return self._applied(df, F.col(self.model.getPredictionCol()), result)

    def predict_proba(self, df: DataFrame, result: str = "score") -> DataFrame:
        """One column per row of class probabilities."""
        return self._applied(df, vector_to_array(self.model.getProbabilityCol()), result)

    def get_params(self) -> dict:
        """The parameters of the wrapped object, and its class."""
        params = {p.name: self.model.getOrDefault(p) for p in self.model.params if self.model.isDefined(p)}
        return {**params, "model_class": self.model_class}

    def __getattr__(self, name):
        if name == "model":
            raise AttributeError(name)
        return getattr(self.model, name)

    def __repr__(self):
        return f"{type(self).__name__}({self.model!r})"

    def _assembled(self, df: DataFrame) -> DataFrame:
        # plain names: the assembler cannot take dots
        inputs = [f"__x{i}" for i in range(len(self.features))]
        plain = df.select("*", *(named_col(c).cast("double").alias(x) for c, x in zip(self.features, inputs)))
        return VectorAssembler(inputCols=inputs, outputCol=_FEATURES).transform(plain).drop(*inputs)

    def _applied(self, df: DataFrame, column: Column, result: str) -> DataFrame:
        scored = self.model.transform(self._assembled(df), {self.model.featuresCol: _FEATURES})
        return scored.select(*map(named_col, df.columns), column.alias(result))


class BinaryClassifier(ModelWrapper):
    """Both ``predict`` and ``predict_proba`` give the probability of the positive class."""

    def predict(self, df: DataFrame, result: str = "prediction") -> DataFrame:
        return self.predict_proba(df, result)

    def predict_proba(self, df: DataFrame, result: str = "score") -> DataFrame:
        # classes are 0..k-1, so exactly one of them is truthy if there are two
        if self.model.numClasses != 2:
            raise ValueError(f"a binary classifier has 2 classes, this one {self.model.numClasses}")
        return self._applied(df, vector_to_array(self.model.getProbabilityCol())[1], result)


class ZscoreRegressor(ModelWrapper):
    """The score is minus the prediction: low predicted values are the outliers."""

    def predict_proba(self, df: DataFrame, result: str = "score") -> DataFrame:
        return self._applied(df, -F.col(self.model.getPredictionCol()), result)


class NullRegressor:
    """Predicts the mean of a row's features; a missing feature gives a missing mean."""

    def __init__(self, features: Sequence[str] = ()):
        self.features = list(features)

    def fit(self, df: DataFrame | None = None, features: Sequence[str] | None = None, label: str | None = None):
        self.features = list(features) if features is not None else self.features
        return self

    def predict(self, df: DataFrame, result: str = "prediction") -> DataFrame:
        return df.withColumn(result, row_mean(self.features))

    def predict_proba(self, df: DataFrame, result: str = "score") -> DataFrame:
        return self.predict(df, result)

    def get_params(self, deep: bool = False) -> dict:
        return {}


def row_mean(features: Sequence[str]) -> Column:
    if not features:
        raise ValueError("no feature columns given")
    return reduce(lambda a, b: a + b, (named_col(c).cast("double") for c in features)) / len(features)


def fit_model(df: DataFrame, estimator, features: Sequence[str], label: str,
              wrapper: type[ModelWrapper] = ModelWrapper) -> ModelWrapper:
    """Train ``estimator`` and wrap the result."""
    return wrapper(type(estimator), estimator).fit(df, features, label)


def score_model(df: DataFrame, model: ModelWrapper, result: str = "score") -> DataFrame:
    """The table with the model's score."""
    return model.predict_proba(df, result)
