"""Writers: guarded CSV, review queues, JSON lines, nested element documents, vector cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.values import parse_options


def write_review_csv(rows: DataFrame, path: str) -> None:
    """Every cell quoted. A cell with a line break would split a row for spreadsheet users, so it is refused."""
    texts = [c for c, t in rows.dtypes if t == "string"]
    if texts and not rows.where(" or ".join(f"`{c}` rlike '[\\r\\n]'" for c in texts)).isEmpty():
        raise ValueError("a cell holds a line break")
    rows.write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def review_order(rows: DataFrame, verdict: str = "verdict", cos: str = "cos") -> DataFrame:
    """refine, novel, adopt, others; the least similar first."""
    rank = F.when(F.col(verdict) == "refine", 0).when(F.col(verdict) == "novel", 1).when(F.col(verdict) == "adopt", 2).otherwise(3)
    return rows.orderBy(rank, F.asc_nulls_first(cos))


def write_queue_tsv(rows: DataFrame, path: str, verdict: str = "verdict", cos: str = "cos") -> None:
    review_order(rows, verdict, cos).write.mode("overwrite").options(header=True, sep="\t").csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line; keys without a value are left out."""
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_buckets(rows: DataFrame, path: str, bucket: str) -> None:
    rows.write.mode("overwrite").partitionBy(bucket).json(path)


def element_documents(elements: DataFrame) -> DataFrame:
    """(tinyid, document): flat catalog elements as nested JSON documents."""
    pv = F.transform(parse_options(F.coalesce("permissible_values", F.lit(""))), lambda o: F.struct(o["code"].alias("permissibleValue"), o["label"].alias("valueMeaningName")))
    doc = F.struct(
        F.col("tinyid").alias("tinyId"),
        F.array(F.struct(F.col("designation"))).alias("designations"),
        F.array(F.struct(F.col("definition"))).alias("definitions"),
        F.struct(F.when(F.size(pv) > 0, F.lit("Value List")).otherwise(F.coalesce("datatype", F.lit("Text"))).alias("datatype"), F.col("uom"), pv.alias("permissibleValues")).alias("valueDomain"),
    )
    return elements.select("tinyid", F.to_json(doc).alias("document"))


def put_vectors(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (model, content_hash, vector_type, vec) that the cache lacks, to append to it."""
    return new.dropDuplicates(["model", "content_hash", "vector_type"]).join(cache, ["model", "content_hash", "vector_type"], "left_anti")
