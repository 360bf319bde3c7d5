"""A store of fitted models with their out-of-fold rows, in the shared storage.

A run has a key and, under a folder of its own that is never written twice, a Spark ML model, as its writer saves it, and the
out-of-fold rows as Parquet. A run counts once it is in the store's list, to which one row is appended last: what a lost driver left
half written is never read. Of several runs of one key the latest counts, by time and then by folder. The list has a row for each run;
rows of data never reach the driver.
"""

from __future__ import annotations

import datetime
import uuid
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.shared import has_path
from tallyforge.sources.tables import append


def out_of_fold(rows: DataFrame, model: Estimator, fold: str, folds: int, prediction: str, name: str) -> DataFrame:
    """rows with `name`: what the model says of a row when it is fitted to the other folds (0 to folds - 1). A row without a fold is
    left out. Each fold is fitted by a job of its own over all rows of the others."""
    parts = []
    for k in range(folds):
        fitted = model.fit(rows.where(F.col(fold).between(0, folds - 1) & (F.col(fold) != k)))
        parts.append(fitted.transform(rows.where(F.col(fold) == k)).withColumnRenamed(prediction, name))
    return reduce(lambda a, b: a.unionByName(b), parts)


def save(root: str, key: str, model: Model, oof: DataFrame) -> None:
    """Save a fitted pipeline and its out-of-fold rows as the latest run of a key."""
    spark = oof.sparkSession
    part = uuid.uuid4().hex
    PipelineModel([model]).write().save(f"{root}/runs/{part}/model")
    oof.write.parquet(f"{root}/runs/{part}/oof")
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="microseconds")
    append(spark.createDataFrame([(key, part, now)], "key string, part string, saved string").coalesce(1), f"{root}/list")


def keys(spark: SparkSession, root: str) -> DataFrame:
    """key, part and saved of each key's latest run."""
    kind = "key string, part string, saved string"
    runs = spark.read.schema(kind).parquet(f"{root}/list") if has_path(spark, f"{root}/list") else spark.createDataFrame([], kind)
    return runs.groupBy("key").agg(F.max(F.struct("saved", "part")).alias("x")).select("key", "x.part", "x.saved")


def load(spark: SparkSession, root: str, key: str) -> tuple[Model, DataFrame]:
    """The model and the out-of-fold rows of a key's latest run; KeyError without one."""
    found = keys(spark, root).where(F.col("key") == key).first()
    if found is None:
        raise KeyError(key)
    path = f"{root}/runs/{found['part']}"
    return PipelineModel.load(f"{path}/model").stages[0], spark.read.parquet(f"{path}/oof")
