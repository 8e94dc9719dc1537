"""Permutation controls and bootstraps; draws come from hashes, so every run makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.draws import draw, uniform
from pairlab.operators import blend, metrics, ranks


def degree_bin(degree: Column) -> Column:
    return F.least(F.lit(5), F.floor(F.log2(F.greatest(degree, F.lit(1))))).cast("int")


def permute_within(df: DataFrame, by: list[str], col: str, seed: int, order: Column | None = None) -> DataFrame:
    """df with col's values dealt anew within each group: the i-th row by key takes the value of the i-th by hash (or order)."""
    rows = ranks.place_in_group(df, by, ["id1", "id2"], "_k").drop("_size")
    dealt = df.select(*by, "id1", "id2", F.col(col).alias("_v"), (order if order is not None else draw(seed, "id1", "id2")).alias("_o"))
    dealt = ranks.place_in_group(dealt, by, ["_o", "id1", "id2"], "_k").select(*by, "_k", "_v")
    return rows.join(dealt, [*by, "_k"]).withColumn(col, F.col("_v")).drop("_k", "_v")


def with_degree_bin(df: DataFrame) -> DataFrame:
    """df plus degree_bin: that of the pair's end of more pairs, in doublings up to 5; a stratum beside fold and category."""
    degree = df.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg(F.count("*").alias("_d"))
    for side in ("1", "2"):
        df = df.join(degree.select(F.col("id").alias(f"id{side}"), F.col("_d").alias(f"_d{side}")), f"id{side}")
    return df.withColumn("degree_bin", degree_bin(F.greatest("_d1", "_d2"))).drop("_d1", "_d2")


def permutation_controls(df: DataFrame, base: str, candidate: str, n: int = 20, seed: int = 0) -> DataFrame:
    """(control, mean_delta, std_delta): AP over base when candidate is averaged in; target: with the label itself; permuted: n shuffles.

    Rows multiply by n and reduce to score blocks at once.
    """
    def scored(rows: DataFrame, x: Column) -> DataFrame:
        return metrics.average_precision(rows.withColumn("predict", F.round((F.col(base) + x) / 2, 8)), ["rep"]).select("rep", "ap")

    plain = df.withColumn("rep", F.lit(-1))
    start = metrics.average_precision(df.withColumn("rep", F.lit(0)).withColumn("predict", F.col(base)), ["rep"]).select(F.col("ap").alias("start"))
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    shuffled = permute_within(reps, ["rep", "fold", "category"], candidate, seed, draw(seed, "rep", "id1", "id2"))
    parts = {"real": scored(plain, F.col(candidate)), "target": scored(plain, F.col("target").cast("double")), "permuted": scored(shuffled, F.col(candidate))}
    out = None
    for name, ap in parts.items():
        row = ap.crossJoin(F.broadcast(start)).agg(F.avg(F.col("ap") - F.col("start")).alias("mean_delta"), F.stddev_pop(F.col("ap") - F.col("start")).alias("std_delta")).select(F.lit(name).alias("control"), "mean_delta", "std_delta")
        out = row if out is None else out.union(row)
    return out


def category_bootstrap(deltas: DataFrame, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """(mean, low, high): 95 % interval of the mean of (category, delta) over resampled categories, drawn by hash.

    Categories are few, so the table of deltas is broadcast as one array of its values. Categories without a delta stay out.
    """
    values = deltas.where("delta is not null").agg(F.sort_array(F.collect_list(F.struct("category", "delta"))).alias("v"))
    spark = deltas.sparkSession
    drawn = spark.range(reps).crossJoin(F.broadcast(values)).select(F.aggregate(F.sequence(F.lit(1), F.size("v")), F.lit(0.0), lambda a, i: a + F.get(F.col("v"), (draw(seed, "id", i) % F.size("v")).cast("int"))["delta"]).alias("s"), F.size("v").alias("n"))
    means = drawn.select((F.col("s") / F.col("n")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", [0.025, 0.975]).alias("q")).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def cluster_bootstrap(df: DataFrame, a: str, b: str, cluster: str, reps: int = 200, seed: int = 0, chunk: int = 25) -> DataFrame:
    """(reps, mean_delta, low, high, p_above): AP(b) - AP(a) when as many whole clusters as there are, are drawn with replacement, again and again.

    How often a replicate draws a cluster is one array for each cluster and `chunk` replicates. Rows collapse to
    (cluster, score) blocks, meet those arrays, and are summed by score, a column for each replicate of the chunk;
    only the sums become a row for each replicate.
    """
    long = df.select(F.col(cluster).alias("cluster"), "target", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predict")) for m in (a, b)])).alias("s")).select("cluster", "target", "s.*").where("cluster is not null")
    blocks = long.groupBy("cluster", "model", "predict").agg(F.sum("target").alias("tp"), F.count("*").alias("n"))
    index = ranks.global_position(df.select(F.col(cluster).alias("cluster")).where("cluster is not null").distinct(), ["cluster"])
    total = index.agg(F.count("*").alias("total"))
    slots = index.crossJoin(F.broadcast(total)).select(F.col("position").alias("slot"), "total", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = slots.select((draw(seed, "rep", "slot") % F.col("total")).alias("position"), F.floor(F.col("rep") / chunk).alias("part"), (F.col("rep") % chunk).alias("place"))
    counts = drawn.groupBy("position", "part").agg(F.array(*[F.count_if(F.col("place") == i) for i in range(chunk)]).alias("w"))
    met = blocks.join(index, "cluster").join(counts, "position")
    sums = met.groupBy("part", "model", "predict").agg(*[F.sum(F.col("w")[i] * F.col(c)).alias(f"{c}{i}") for i in range(chunk) for c in ("tp", "n")])
    each = sums.select("model", "predict", "part", F.posexplode(F.array(*[F.struct(F.col(f"tp{i}").alias("tp"), F.col(f"n{i}").alias("n")) for i in range(chunk)])).alias("place", "s"))
    each = each.select((F.col("part") * chunk + F.col("place")).alias("rep"), "model", "predict", "s.tp", "s.n").where("n > 0")
    ap = metrics.ap_of_blocks(each, ["rep", "model"])
    delta = ap.groupBy("rep").agg((F.max(F.when(F.col("model") == b, F.col("ap"))) - F.max(F.when(F.col("model") == a, F.col("ap")))).alias("d"))
    return delta.agg(F.count("d").alias("reps"), F.avg("d").alias("mean_delta"), F.percentile("d", [0.025, 0.975]).alias("q"), F.avg((F.col("d") > 0).cast("double")).alias("p_above")).select("reps", "mean_delta", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_above")


def residual_control(wide: DataFrame, base: str, candidates: list[str], folds: list[int], seed: int = 0) -> DataFrame:
    """(candidate, control, mean_weight, delta, folds) of blend.residual_screen, for each candidate (real) and its values shuffled within (fold, category)."""
    rows = wide
    for c in candidates:
        rows = permute_within(rows.withColumn(f"{c}_shuffled", F.col(c)), ["fold", "category"], f"{c}_shuffled", seed, draw(seed, F.lit(c), "id1", "id2"))
    out = blend.residual_screen(rows, base, [*candidates, *[f"{c}_shuffled" for c in candidates]], folds)
    shuffled = F.col("candidate").endswith("_shuffled")
    return out.withColumn("control", F.when(shuffled, "shuffled").otherwise("real")).withColumn("candidate", F.regexp_replace("candidate", "_shuffled$", ""))


def graph_model(rows: DataFrame, base: list[str], graph: list[str], folds: list[int], seed: int = 0, rounds: int = 8, depth: int = 3) -> DataFrame:
    """(control, id1, id2, fold, target, predict): boosted trees over base and graph columns, and the same with the graph columns shuffled.

    Shuffled: whole rows of graph columns change places within (fold, category), so only their tie to the pair is lost.
    """
    out = None
    moved = permute_within(rows.withColumn("_g", F.struct(*graph)).drop(*graph), ["fold", "category"], "_g", seed).select("*", "_g.*").drop("_g")
    for name, df in (("graph", rows), ("shuffled", moved)):
        part = blend.train_oof(df, [*base, *graph], folds, rounds=rounds, depth=depth)[0].withColumn("control", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def random_weights(wide: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(held, category, weights): weights of n models, uniform over all that sum to 1, for each fold and category."""
    rows = wide.select(F.col("fold").alias("held"), "category").distinct().withColumn("e", F.array(*[-F.ln(uniform(seed, "held", "category", i)) for i in range(n)]))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select("held", "category", F.transform("e", lambda x: x / total).alias("weights"))


def selection_control(wide: DataFrame, models: list[str], folds: list[int], seed: int = 0, parts: int = 4) -> DataFrame:
    """(labels, ap): held-out AP of nested weight selection with real labels, with labels permuted within (fold, category), and of random weights.

    The AP is that of the real labels in the first and last case, of the permuted ones in the other.
    """
    grid = blend.simplex(len(models), parts)
    table = blend.grid_table(wide.sparkSession, grid)
    cases = {"random": (wide, random_weights(wide, len(models), seed))}
    for name, rows in (("real", wide), ("permuted", permute_within(wide, ["fold", "category"], "target", seed))):
        cases[name] = (rows, blend.choose_weights(blend.grid_ap(rows, models, grid), table, folds).select("held", "category", "weights"))
    out = None
    for name, (rows, chosen) in cases.items():
        scored = blend.nested_blend(rows, models, chosen).withColumn("predict", F.round("predict", 8)).withColumn("labels", F.lit(name))
        ap = metrics.average_precision(scored, ["labels"]).select("labels", "ap")
        out = ap if out is None else out.union(ap)
    return out
