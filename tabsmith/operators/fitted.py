"""Bases of fit/transform stages.  All are ``pyspark.ml`` stages, so they save and load
inside a ``PipelineModel``."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame


class ColumnEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns something about ``inputCols``; options travel as one JSON parameter."""

    inputCols = Param(Params._dummy(), "inputCols", "columns to fit", TypeConverters.toListString)
    options = Param(Params._dummy(), "options", "settings as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, options="{}"):
        super().__init__()
        self._setDefault(inputCols=[], options="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, cols, **options):
        return cls(inputCols=list(cols), options=json.dumps(options))

    @property
    def cols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)

    def option(self, name, default=None):
        return json.loads(self.getOrDefault(self.options)).get(name, default)


class FittedColumns(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted stage that is column expressions over a small JSON ``spec``."""

    spec = Param(Params._dummy(), "spec", "fitted values as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spec="{}"):
        super().__init__()
        self._setDefault(spec="{}")
        self._set(spec=spec)

    @classmethod
    def of(cls, values):
        return cls(spec=json.dumps(values))

    @property
    def fitted(self):
        return json.loads(self.getOrDefault(self.spec))

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        new = self.expressions(df)
        return df.withColumns(new) if new else df


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.mode("overwrite").parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        instance.table = spark.read.parquet(f"{path}/table")
        return instance


class TableModel(Model, MLReadable, MLWritable):
    """A fitted stage whose state is a table of unknown size, kept as a DataFrame and
    saved as parquet next to the parameters."""

    spec = Param(Params._dummy(), "spec", "fitted values as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spec="{}"):
        super().__init__()
        self._setDefault(spec="{}")
        self._set(spec=spec)
        self.table: DataFrame | None = None

    @classmethod
    def of(cls, values, table: DataFrame):
        model = cls(spec=json.dumps(values))
        model.table = table
        return model

    @property
    def fitted(self):
        return json.loads(self.getOrDefault(self.spec))

    def write(self):
        return _TableWriter(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls):
        return _TableReader(cls)

    @classmethod
    def load(cls, path: str):
        return cls.read().load(path)

    def copy(self, extra=None):
        other = super().copy(extra)
        other.table = self.table
        return other
