"""Targets and weights of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def binarize(t: Column, threshold: float = 0.5) -> Column:
    return (t >= threshold).cast("int")


def soft_target(teacher: Column, hard: Column, alpha: float = 0.7) -> Column:
    return alpha * teacher + (1 - alpha) * hard


def remix_target(t: Column, hard: Column, new: Column, share: float = 0.3, mix: tuple[float, float, float] = (0.3, 0.6, 0.1)) -> Column:
    """Takes the hard share out of a soft target and mixes hard, old and new teacher anew."""
    old = (t - share * hard) / (1 - share)
    return mix[0] * hard + mix[1] * old + mix[2] * new


def clip_confidence(p: Column, low: float = 0.05, high: float = 0.95) -> Column:
    return F.when(p < low, F.lit(0.0)).when(p > high, F.lit(1.0)).otherwise(p)


def error_weight(pairs: DataFrame, oof: DataFrame, a: float = 1.0) -> DataFrame:
    """pairs plus weight = 1 + a * |target - oof|; a pair without a score weighs 1."""
    joined = pairs.join(oof.select("id1", "id2", "predict"), ["id1", "id2"], "left")
    return joined.withColumn("weight", 1 + a * F.coalesce(F.abs(F.col("target") - F.col("predict")), F.lit(0.0))).drop("predict")


def category_weight(pairs: DataFrame, train: Column) -> DataFrame:
    """pairs plus weight = N / (C * n_c) over the rows of train, scaled to mean 1 there; null for unseen categories."""
    counts = pairs.where(train).groupBy("category").agg(F.count("*").alias("n_c"))
    sums = counts.agg(F.sum("n_c").alias("n"), F.count("*").alias("c"))
    weights = counts.crossJoin(F.broadcast(sums)).select("category", (F.col("n") / (F.col("c") * F.col("n_c"))).alias("weight"))
    return pairs.join(weights, "category", "left")


def prior_weight(pairs: DataFrame, priors: DataFrame) -> DataFrame:
    """pairs plus weight: p'/p for positives, (1-p')/(1-p) for negatives, p the category's rate, p' its wanted prior."""
    rate = F.avg("target").over(W.partitionBy("category"))
    joined = pairs.withColumn("rate", rate).join(priors, "category", "left")
    weight = F.when(F.col("target") == 1, F.col("prior") / F.col("rate")).otherwise((1 - F.col("prior")) / (1 - F.col("rate")))
    return joined.withColumn("weight", F.when(F.col("prior").isNull() | F.col("rate").isin(0.0, 1.0), F.lit(1.0)).otherwise(weight)).drop("rate", "prior")


def symmetrize(pairs: DataFrame) -> DataFrame:
    """Each pair in both orders."""
    return pairs.unionByName(pairs.withColumns({"id1": F.col("id2"), "id2": F.col("id1")}))
