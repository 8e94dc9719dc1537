"""Readers and writers of catalogues, folds, predictions, journals and results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.operators.components import checkpointed
from pairlab.operators.contracts import item_ids, strict
from pairlab.operators.joins import once, semi_join

ITEMS = "id long, name string, attributes string, category string"
JOURNAL = "id1 long, id2 long, audited_label int, original_target int, mode string, judged_at long"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Only a local session may have none; it then gets one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan_items(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    return spark.read.schema(ITEMS).parquet(path).select(*cols)


def scan_needed_items(items: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that pairs name, ids that no item has); a named id of several items fails.

    The catalogue is read once for its needed rows and once for their ids; rows that no pair names are not shuffled.
    """
    ids = checkpointed(item_ids(pairs))
    known = semi_join(items.select("id"), ids)
    return once(semi_join(items, ids)), ids.join(known, "id", "left_anti")


def write_folds(df: DataFrame, path: str) -> str:
    """CSV with header, a folder fold=<n> for each fold."""
    df.write.partitionBy("fold").option("header", True).csv(path)
    return path


def read_fold_files(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(fold, id1, id2, value, category): fold is fold_<n> from the folder's name; a malformed row fails."""
    got = spark.read.schema(f"id1 long, id2 long, {value}, category string").option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path)
    fold = F.concat(F.lit("fold_"), F.regexp_extract(F.col("_metadata.file_path"), r"fold=([^/]+)/", 1))
    return got.withColumn("fold", fold)


def read_strict(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """CSV whose header must name exactly these columns and whose values must have their types, else the read fails.

    With keys it also fails if there is no row, a key repeats, or a number is missing or not finite.
    """
    got = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return strict(got, keys, [c for c, kind in got.dtypes if c not in keys and kind != "string"]) if keys else got


def scan_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL).json(path)


def scan_results(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Result documents of one fold specification."""
    schema = "experiment string, fold_spec_version int, folds array<struct<id:long,rows:long,positives:long,prauc:double>>"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).where(F.col("fold_spec_version") == version)


def explode_metrics(results: DataFrame) -> DataFrame:
    """(experiment, fold, n_rows, positives, prauc): a row for each nested fold."""
    return results.select("experiment", F.explode("folds").alias("f")).select("experiment", F.col("f.id").alias("fold"), F.col("f.rows").alias("n_rows"), "f.positives", "f.prauc")


def oof_matrix(scores: DataFrame, k: int | None, models: list[str]) -> DataFrame:
    """(id1, id2, a column for each model): models that have all k folds; others' columns are null. Without k every model has its scores."""
    if k is None:
        return scores.groupBy("id1", "id2").pivot("model", models).agg(F.first("predict"))
    whole = scores.groupBy("model").agg(F.count_distinct("fold").alias("folds")).where(F.col("folds") == k).select("model")
    return scores.join(F.broadcast(whole), "model", "left_semi").groupBy("id1", "id2").pivot("model", models).agg(F.first("predict"))


def write_predictions(df: DataFrame, path: str) -> str:
    """CSV id1, id2, predict with eight decimals, a folder for each fold."""
    df.select("fold", "id1", "id2", F.format_string("%.8f", "predict").alias("predict")).write.partitionBy("fold").option("header", True).csv(path)
    return path


def write_texts(df: DataFrame, path: str) -> str:
    df.write.option("compression", "zstd").parquet(path)
    return path


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, fingerprint): whatever the partitions and their order; values are hashed as comma-joined text."""
    row = F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns if c not in by])
    part = F.conv(F.substring(F.sha2(row, 256), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(part).alias("fingerprint"))


def require_fingerprint(df: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """df as it is; raises if a group's row count or fingerprint is not the one in expected, or a group is in one of them only."""
    found = fingerprint(df, by)
    wrong = found.exceptAll(expected.select(found.columns)).union(expected.select(found.columns).exceptAll(found)).select(*by).distinct().limit(5).collect()
    if wrong:
        raise ValueError(f"data differ from their fingerprint in {', '.join(str(tuple(x)) for x in wrong)}")
    return df
