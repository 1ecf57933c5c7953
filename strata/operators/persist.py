"""Saving stages that are written in Python (feature steps, boosting, k-NN).

A stage names its plain state, its tables and its fitted MLlib models; the
writer stores them below the stage's folder (a one-row table for the state,
Parquet for tables, MLlib's own format for models), so that a PipelineModel
with such stages saves and loads as any other.
"""

from __future__ import annotations

import base64

from pyspark import cloudpickle
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import SparkSession


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.stage, path, spark.sparkContext)
        state, tables, models = self.stage.parts()
        text = base64.b64encode(cloudpickle.dumps((state, sorted(tables), len(models)))).decode()
        spark.createDataFrame([(text,)], "state string").coalesce(1).write.parquet(f"{path}/state")
        for name, df in tables.items():
            df.write.parquet(f"{path}/tables/{name}")
        for i, m in enumerate(models):
            m.write().save(f"{path}/models/{i}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        text = spark.read.parquet(f"{path}/state").first()["state"]
        state, tables, n = cloudpickle.loads(base64.b64decode(text))
        models = [DefaultParamsReader.loadParamsInstance(f"{path}/models/{i}", spark.sparkContext) for i in range(n)]
        return self.cls.from_parts(state, {t: spark.read.parquet(f"{path}/tables/{t}") for t in tables}, models)


class Saved(MLWritable, MLReadable):
    """Mix-in: ``parts()`` -> (state, {name: DataFrame}, [models]); ``from_parts`` builds the stage again."""

    def parts(self):
        raise NotImplementedError

    @classmethod
    def from_parts(cls, state, tables, models):
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)
