"""Folds by component and samples by hash: the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions.draws import draw
from pairlab.operators import ranks
from pairlab.operators.graph import connected_components


def hash_fold(key: Column, seed: str, k: int) -> Column:
    """The first eight bytes of sha256(seed:key), big-endian, modulo k."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % k).cast("int")


def component_loads(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(category, component, pairs, positives): each component once, under the category of most of its pairs (ties: the least)."""
    joined = pairs.join(comp.withColumnRenamed("id", "id1"), "id1")
    each = joined.groupBy("component", "category").agg(F.count("*").alias("n"), F.sum("target").alias("t"))
    one = each.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("less"), "category")).alias("first"), F.sum("n").alias("pairs"), F.sum("t").alias("positives"))
    return one.select("first.category", "component", "pairs", "positives")


def stratified_fold(components: DataFrame, seed: str, k: int) -> DataFrame:
    """(category, component, fold): greedy in each category, largest components first, to the least loaded fold.

    The load of a fold is the worse of its pairs and positives against their shares of the category (positives'
    share at least 1); ties go to the lowest fold. A category is one sequence by definition: Spark sorts its rows
    on disk, and they stream through one task whose state is 2k numbers. Categories run apart. They are dealt by a hash
    of the category: a repartition by the join's own key is left out as already done, and adaptive execution is then
    free to read the join's rows in parts, each of which would start with empty folds.
    """
    shares = components.groupBy("category").agg((F.sum("pairs") / k).alias("share_p"), F.greatest(F.sum("positives") / k, F.lit(1.0)).alias("share_t"))
    rows = components.join(shares, "category").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")), 256))
    ordered = rows.repartition(F.xxhash64("category")).sortWithinPartitions("category", F.desc("pairs"), "h")

    def run(batches):
        category, p, q = None, [], []
        for t in batches:
            out = []
            for name, n, m, share_p, share_t in zip(t.category, t.pairs, t.positives, t.share_p, t.share_t):
                if name != category:
                    category, p, q = name, [0.0] * k, [0.0] * k
                f = min(range(k), key=lambda i: (max((p[i] + n) / share_p, (q[i] + m) / share_t), i))
                p[f], q[f] = p[f] + n, q[f] + m
                out.append(f)
            yield t[["category", "component"]].assign(fold=out)

    return ordered.mapInPandas(run, "category string, component long, fold int")


def build_folds(pairs: DataFrame, seed: str, k: int, stratified: bool) -> DataFrame:
    """pairs plus component and fold: no item, and so no component, is in two folds."""
    comp = connected_components(pairs)
    joined = pairs.join(comp.withColumnRenamed("id", "id1"), "id1")
    if not stratified:
        return joined.withColumn("fold", hash_fold(F.col("component"), seed, k))
    folds = stratified_fold(component_loads(pairs, comp), seed, k).drop("category")
    return joined.join(folds, "component")


def fold_balance(pairs: DataFrame) -> DataFrame:
    """(category, pair_spread, rate_spread): largest minus smallest over folds."""
    each = pairs.groupBy("category", "fold").agg(F.count("*").alias("n"), F.avg("target").alias("rate"))
    return each.groupBy("category").agg((F.max("n") - F.min("n")).alias("pair_spread"), (F.max("rate") - F.min("rate")).alias("rate_spread"))


def inner_split(pairs: DataFrame, held_out: int, n: int = 10) -> DataFrame:
    """Training pairs plus validation: one bucket of n of their components, salted by the held-out fold."""
    train = pairs.where(F.col("fold") != held_out)
    comp = connected_components(train)
    return train.join(comp.withColumnRenamed("id", "id1"), "id1").withColumn("validation", hash_fold(F.col("component"), f"inner-{held_out}", n) == 0)


def seeded(seed: int, *cols: str) -> Column:
    return draw(seed, *cols)


def stratified_sample(df: DataFrame, n: int, seed: int, order: Column | None = None) -> DataFrame:
    """round(n * n_t / n_all) rows of each (fold, target), exactly, by hash order (or the order given)."""
    total = df.groupBy("fold").agg(F.count("*").alias("_all"))
    size = df.groupBy("fold", "target").agg(F.count("*").alias("_n"))
    quota = size.join(total, "fold").select("fold", "target", F.round(n * F.col("_n") / F.col("_all")).alias("_quota"))
    ranked = ranks.place_in_group(df, ["fold", "target"], [order if order is not None else seeded(seed, "id1", "id2"), "id1", "id2"], "_k")
    return ranked.join(F.broadcast(quota), ["fold", "target"]).where("_k <= _quota").drop("_k", "_size", "_quota")


def uniform_sample(df: DataFrame, n: int, seed: int, order: Column | None = None) -> DataFrame:
    return df.orderBy(order if order is not None else seeded(seed, "id1", "id2"), "id1", "id2").limit(n)


def hard_negatives(df: DataFrame, held: int, share: float) -> DataFrame:
    """Training negatives of the top share of each category by pct_rank(score) + pct_rank(similarity) + conflict / 2.

    df: id1, id2, category, fold, target, predict, similarity, conflict (0/1). The count is max(1, round(n * share)).
    """
    neg = df.where((F.col("fold") != held) & (F.col("target") == 0))
    for c in ("predict", "similarity"):
        neg = ranks.rank_average_pct(neg, ["category"], c).withColumnRenamed("rank", f"_{c}")
    hard = neg.withColumn("hardness", F.col("_predict") + F.col("_similarity") + 0.5 * F.col("conflict")).drop("_predict", "_similarity")
    ranked = ranks.place_in_group(hard, ["category"], [F.desc(F.round("hardness", 9)), "id1", "id2"])
    return ranked.where(F.col("_place") <= F.greatest(F.lit(1), F.round(F.col("_size") * share))).drop("_place", "_size")


def soft_negatives(df: DataFrame, held: int, share: float, seed: int = 0) -> DataFrame:
    """(id1, id2, category, predict, arm): the top share of training negatives of each category by score (soft), and as many by hash (control).

    A pair can be in both arms.
    """
    neg = df.where((F.col("fold") != held) & (F.col("target") == 0)).select("id1", "id2", "category", "predict")
    ranked = ranks.place_in_group(neg, ["category"], [F.desc("predict"), "id1", "id2"], "k", "n")
    ranked = ranks.place_in_group(ranked, ["category"], [seeded(seed, "id1", "id2"), "id1", "id2"], "c", "n")
    quota = F.greatest(F.lit(1), F.round(F.col("n") * share))
    arms = F.array_compact(F.array(F.when(F.col("k") <= quota, F.lit("soft")), F.when(F.col("c") <= quota, F.lit("control"))))
    return ranked.select("id1", "id2", "category", "predict", F.explode(arms).alias("arm"))


def arm_statistics(arms: DataFrame) -> DataFrame:
    """(category, n, soft_mean, soft_least, control_mean, control_least, lift, shared): what sets the soft arm of a category apart from its control.

    lift is soft_mean - control_mean; shared counts pairs in both arms.
    """
    each = arms.groupBy("category", "id1", "id2").agg(F.max("predict").alias("predict"), F.count_if(F.col("arm") == "soft").alias("s"), F.count_if(F.col("arm") == "control").alias("c"))
    soft, control = F.when(F.col("s") > 0, F.col("predict")), F.when(F.col("c") > 0, F.col("predict"))
    out = each.groupBy("category").agg(
        F.count_if(F.col("s") > 0).alias("n"), F.avg(soft).alias("soft_mean"), F.min(soft).alias("soft_least"), F.avg(control).alias("control_mean"), F.min(control).alias("control_least"),
        F.count_if((F.col("s") > 0) & (F.col("c") > 0)).alias("shared"),
    )
    return out.withColumn("lift", F.col("soft_mean") - F.col("control_mean"))


def batch_audit(df: DataFrame, size: int, order: list[str | Column]) -> DataFrame:
    """(category, batches, usable): batches of `size` rows in the order within each fold; usable sums least(positives, negatives)."""
    placed = ranks.place_in_group(df, ["fold"], order)
    each = placed.withColumn("batch", F.floor((F.col("_place") - 1) / size)).groupBy("fold", "batch", "category").agg(F.sum("target").alias("p"), F.count("*").alias("n"))
    return each.groupBy("category").agg(F.count("*").alias("batches"), F.sum(F.least("p", F.col("n") - F.col("p"))).alias("usable"))


def hash_route(df: DataFrame, n: int) -> DataFrame:
    """df plus route: a part of n by a hash of the pair."""
    return df.withColumn("route", draw("id1", "id2") % n)
