"""Repeatable append: a dataset as committed batches.

A batch is written to a folder of its own, and becomes visible by one small
file: ``_commits/<key>.json``, named after the batch's content and published by
a rename that does not replace.  So

* the same rows appended twice are one batch, however they were partitioned;
* a writer that dies before the rename leaves nothing that a reader sees;
* writers of different batches never touch each other's files, and of two
  writers of one batch exactly one lands.

Readers list the commit files and read the folders these name.  A reader's
table is the set of batches committed when it was opened.  The folder may be on
any Hadoop file system whose rename of a file is atomic (HDFS, local disks); on
an object store without one, two writers of *one* batch may both land in the
same commit file, which still names a single folder.

The log has one row per batch; rows are never collected.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = "key string, folder string, n_rows long, fields string"
SLICES = 4  # 56-bit slices of a row's digest


def batch_key(df: DataFrame) -> tuple[str, int]:
    """A key of the batch's content and its row count: equal for equal rows in
    any order and partitioning, also in the number of copies.

    Per-row digests are cut in slices that are summed map-side; only the sums
    reach the driver.
    """
    def field(f: T.StructField) -> Column:
        # Null and "null", "" and an absent value all differ; nested values as JSON.
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        value = F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if nested else F.col(f"`{f.name}`").cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    fields = sorted(df.schema.fields, key=lambda f: f.name)
    digest = F.sha2(F.concat_ws(",", *[field(f) for f in fields]), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)).alias("n"), *[part(i).alias(f"s{i}") for i in range(SLICES)]).first()
    names = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    sums = ":".join(str(row[f"s{i}"]) for i in range(SLICES))
    import hashlib

    return hashlib.sha256(f"{names}|{row['n']}|{sums}".encode()).hexdigest()[:32], row["n"]


class _Folder:
    """The few file operations that a commit needs, on the table's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def inside(self, *parts: str):
        return self._path("/".join([self.root.toString(), *parts]))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.inside(*parts))

    def publish(self, name: str, content: str) -> bool:
        """Write a file under a temporary name and rename it into place;
        false if the name is taken."""
        target, waiting = self.inside("_commits", name), self.inside("_commits", f".{name}.{uuid.uuid4().hex}")
        out = self.fs.create(waiting, False)
        out.write(bytearray(content.encode()))
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        no_options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(waiting, target, no_options)
        except Exception:
            self.fs.delete(waiting, False)
            if self.exists("_commits", name):
                return False
            raise
        return True


def append_batch(df: DataFrame, path: str) -> str | None:
    """Append the rows of ``df`` as one batch; its key, or null if a batch of
    the same content is there already.  An empty batch is committed as well."""
    spark = df.sparkSession
    key, n = batch_key(df)
    table = _Folder(spark, path)
    if table.exists("_commits", f"{key}.json"):
        return None
    folder = f"batch-{key}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path.rstrip('/')}/{folder}")
    # What was written counts, not what was hashed: a source that changed in between is no batch.
    written = batch_key(spark.read.schema(df.schema).parquet(f"{path.rstrip('/')}/{folder}"))
    if written != (key, n):
        raise RuntimeError("the rows changed while they were written")
    commit = {"key": key, "folder": folder, "n_rows": n, "fields": df.schema.simpleString()}
    return key if table.publish(f"{key}.json", json.dumps(commit)) else None


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``key, folder, n_rows, fields`` of the committed batches."""
    root = _Folder(spark, path)
    if not root.exists("_commits"):
        return spark.createDataFrame([], LOG_SCHEMA)
    try:
        # Names that begin with a dot, those of unfinished commits, are no data to Spark.
        return spark.read.schema(LOG_SCHEMA).json(f"{path.rstrip('/')}/_commits/*.json")
    except AnalysisException:
        return spark.createDataFrame([], LOG_SCHEMA)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed batches."""
    folders = sorted(r.folder for r in commits(spark, path).select("folder").collect())
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in folders])
