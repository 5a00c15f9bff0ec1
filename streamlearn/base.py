"""Estimators, transformers, predictors and pipelines.

An estimator's fit() returns a model and changes nothing; parameters are set when an operator is made and can be
overridden in a call. Operators that fit nothing return themselves.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame


class Operator:
    """Named parameters with defaults; values given later win over earlier ones."""

    defaults: dict[str, Any] = {}

    def __init__(self, **params: Any):
        self.params = self._merged(self.defaults, params)

    def _merged(self, base: dict[str, Any], more: dict[str, Any]) -> dict[str, Any]:
        unknown = set(more) - set(self.defaults)
        if unknown:
            raise ValueError(f"{type(self).__name__} has no parameter {', '.join(sorted(unknown))}; it has {', '.join(sorted(self.defaults))}")
        return base | more

    def with_params(self, **params: Any):
        """A copy with other parameters."""
        out = object.__new__(type(self))
        out.__dict__ |= self.__dict__
        out.params = self._merged(self.params, params)
        return out

    def fit(self, df: DataFrame, **params: Any):
        """Fits nothing unless a subclass does."""
        return self

    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} does not transform {df.schema.simpleString()}")

    def predict(self, df: DataFrame, **params: Any) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} does not predict on {df.schema.simpleString()}")

    def then(self, other: Operator) -> Pipeline:
        return Pipeline([self, other])


class Transformer(Operator):
    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        return self._transform(df, self._merged(self.params, params))

    def _transform(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        return super().transform(df)


class Predictor(Operator):
    def predict(self, df: DataFrame, **params: Any) -> DataFrame:
        return self._predict(df, self._merged(self.params, params))

    def _predict(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        return super().predict(df)


class Pipeline(Operator):
    """Stages in order: all but the last transform, the last transforms or predicts. fit() fits every stage on what
    the stages before it return."""

    def __init__(self, stages: list[Operator]):
        super().__init__()
        self.stages = [x for s in stages for x in (s.stages if isinstance(s, Pipeline) else [s])]

    def fit(self, df: DataFrame, **params: Any) -> Pipeline:
        fitted = []
        for n, stage in enumerate(self.stages):
            fitted.append(stage.fit(df))
            if n + 1 < len(self.stages):
                df = fitted[-1].transform(df)
        return Pipeline(fitted)

    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df

    def predict(self, df: DataFrame, **params: Any) -> DataFrame:
        for stage in self.stages[:-1]:
            df = stage.transform(df)
        return self.stages[-1].predict(df)


class Mapped(Predictor):
    """Any column expression as a predictor: adds it to each row under the name `prediction`."""

    def __init__(self, expression):
        super().__init__()
        self.expression = expression

    def _predict(self, df: DataFrame, p: dict[str, Any]) -> DataFrame:
        return df.withColumn("prediction", self.expression(df))
