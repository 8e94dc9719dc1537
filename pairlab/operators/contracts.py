"""Checks of pair, score and fold tables: each returns a small report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unordered(df: DataFrame) -> DataFrame:
    return df.withColumns({"lo": F.least("id1", "id2"), "hi": F.greatest("id1", "id2")})


def check_pairs(pairs: DataFrame) -> DataFrame:
    """One row of counts: rows, self pairs, bad targets, repeated ordered and unordered pairs, conflicting labels."""
    both = unordered(pairs).groupBy("lo", "hi").agg(
        F.count("*").alias("n"), F.count_if(F.col("id1") == F.col("id2")).alias("selves"),
        F.count_if(F.col("target").isNull() | ~F.col("target").isin(0, 1)).alias("bad"),
        F.count_if(F.col("id1") < F.col("id2")).alias("forward"), F.count_if(F.col("id1") > F.col("id2")).alias("backward"),
        (F.min("target") < F.max("target")).alias("conflict"),
    )
    # Of one unordered pair: copies beyond the first of either direction.
    extra = F.greatest(F.col("forward") - 1, F.lit(0)) + F.greatest(F.col("backward") - 1, F.lit(0)) + F.greatest(F.col("selves") - 1, F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return both.agg(
        total("n").alias("n_rows"), total("selves").alias("self_pairs"), total("bad").alias("bad_targets"), total(extra).alias("repeated_ordered"),
        total(F.col("n") - 1).alias("repeated_unordered"), F.count_if("conflict").alias("conflicting"),
    )


def check_coverage(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """One row: pairs, sides without an item, pairs across categories."""
    known = items.select("id", F.col("category").alias("c"))
    one, two = known.select(F.col("id").alias("id1"), F.col("c").alias("c1")), known.select(F.col("id").alias("id2"), F.col("c").alias("c2"))
    joined = pairs.select("id1", "id2").join(one, "id1", "left").join(two, "id2", "left")
    return joined.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("c1").isNull()).alias("missing1"), F.count_if(F.col("c2").isNull()).alias("missing2"), F.count_if(F.col("c1") != F.col("c2")).alias("across"))


def item_ids(pairs: DataFrame) -> DataFrame:
    """Distinct item ids of both sides."""
    return pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()


def check_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: item ids of either set, and how many both have."""
    marked = item_ids(a).withColumn("in_a", F.lit(1)).join(item_ids(b).withColumn("in_b", F.lit(1)), "id", "full_outer")
    return marked.agg(F.count("in_a").alias("items_a"), F.count("in_b").alias("items_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"))


def check_folds(pairs: DataFrame) -> DataFrame:
    """One row: items, items in several folds, pairs in several folds."""
    items = pairs.select(F.explode(F.array("id1", "id2")).alias("id"), "fold").groupBy("id").agg((F.min("fold") < F.max("fold")).alias("split"))
    repeated = unordered(pairs).groupBy("lo", "hi").agg((F.min("fold") < F.max("fold")).alias("split"))
    return items.agg(F.count("*").alias("n_items"), F.count_if("split").alias("split_items")).crossJoin(repeated.agg(F.count("*").alias("n_pairs"), F.count_if("split").alias("split_pairs")))


def check_alignment(pred: DataFrame, target: DataFrame) -> DataFrame:
    """One row: keys of both, of predictions only, of targets only, and repeated keys of either."""
    p = pred.groupBy("id1", "id2").agg(F.count("*").alias("n_p"))
    t = target.groupBy("id1", "id2").agg(F.count("*").alias("n_t"))
    both = p.join(t, ["id1", "id2"], "full_outer")
    return both.agg(
        F.count_if(F.col("n_p").isNotNull() & F.col("n_t").isNotNull()).alias("matched"), F.count_if(F.col("n_t").isNull()).alias("only_pred"),
        F.count_if(F.col("n_p").isNull()).alias("only_target"), F.count_if(F.col("n_p") > 1).alias("repeated_pred"), F.count_if(F.col("n_t") > 1).alias("repeated_target"),
    )


def check_submission(pred: DataFrame) -> DataFrame:
    """One row: rows, nulls, scores that are not finite or not within 0 and 1, repeated keys."""
    p = F.col("predict")
    keys = pred.groupBy("id1", "id2").agg(F.count("*").alias("n"), F.count_if(p.isNull()).alias("nulls"), F.count_if(F.isnan(p) | (F.abs(p) == float("inf"))).alias("odd"), F.count_if((p < 0) | ((p > 1) & ~F.isnan(p))).alias("outside"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return keys.agg(total("n").alias("n_rows"), total("nulls").alias("nulls"), total("odd").alias("not_finite"), total("outside").alias("out_of_range"), total(F.col("n") - 1).alias("repeated"))


def compare_tables(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(column, mismatches): rows of either table whose values differ, column by column; `(key)` counts unmatched rows."""
    columns = [c for c in a.columns if c not in key]
    left = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("in_a"))
    right = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("in_b"))
    both = left.join(right, key, "full_outer")
    alone = F.col("in_a").isNull() | F.col("in_b").isNull()
    counts = both.agg(F.count_if(alone).alias("(key)"), *[F.count_if(~alone & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns])
    return counts.unpivot([], ["(key)", *columns], "column", "mismatches")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df as it is; the job fails if two rows have equal keys. The check shuffles by the keys, as a join on them does."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("rows of a key"), F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    message = F.concat(F.lit(f"repeated {', '.join(keys)}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    once = F.when(F.col("rows of a key") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return rows.where(once).select("row.*")


def strict(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """df as it is; raises if it has no row, a repeated or null key, or a value that is null, NaN or infinite."""
    bad = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in values] + [F.col(k).isNull() for k in keys]
    each = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(reduce(lambda a, b: a | b, bad)).alias("bad"))
    n, repeated, wrong = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n or repeated or wrong:
        raise ValueError(f"{n} rows, {repeated} with a repeated key, {wrong} with a key or value that is missing or not finite")
    return df
