"""Vectors by the hash of their text: what is known is looked up, the rest goes through an encoder once and is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text as tx
from fieldloom.runtime import stage

SCHEMA = "content_hash string, vec array<float>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; an empty one where nothing was written yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def embedded(rows: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], path: str) -> DataFrame:
    """``rows`` with ``content_hash`` and ``vec``: the encoder runs over each distinct text that the cache lacks, in Arrow batches.

    New vectors are appended to the cache. Rows without a text have null for both.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("content_hash", F.when(F.col(text).isNotNull(), tx.short_hash(F.col(text))))
    wanted = hashed.where("content_hash is not null").select("content_hash", F.col(text).alias("_t")).dropDuplicates(["content_hash"])
    missing = wanted.join(read(spark, path).select("content_hash"), "content_hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder(b.column(1).to_pylist()), pa.list_(pa.float32()))], names=["content_hash", "vec"])

    made = stage(missing.mapInArrow(run, SCHEMA), "vectors")
    made.write.mode("append").parquet(path)
    return hashed.join(read(spark, path).dropDuplicates(["content_hash"]), "content_hash", "left")


def lookup(rows: DataFrame, text: str, path: str) -> DataFrame:
    """``rows`` with the vector of each text, null where the cache has none."""
    known = read(rows.sparkSession, path).dropDuplicates(["content_hash"])
    return rows.withColumn("content_hash", tx.short_hash(F.col(text))).join(known, "content_hash", "left")
