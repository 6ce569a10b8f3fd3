"""Readers and writers.

Nested data (token lists, utterance lists, vectors) is stored as Parquet: the
CSV sink has no array type.  A CSV export renders arrays with ``to_json``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.schemas import RAW_TURNS, VOCABULARY


def read_conversations(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = RAW_TURNS) -> DataFrame:
    """Read a stored turn dataset with a fixed schema (no inference pass)."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return reader.format(fmt).load(path)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Overwrite (or append) a dataset.  CSV output renders arrays as JSON text."""
    out = df
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        out = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_conversations(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append new conversation rows; concurrent writers never rewrite old files."""
    write_dataset(df, path, fmt=fmt, mode="append")


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("token", "cnt", "idx").write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCABULARY).parquet(path)


def save_model(model, path: str) -> None:
    """Persist an MLlib model or pipeline, replacing what is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A fitted pipeline saved with :func:`save_model`; single classifiers load
    through ``operators.train.ModelRegistry``."""
    return PipelineModel.load(path)
