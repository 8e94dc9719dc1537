"""Ranks, orders, top lists and set operations. The four rank rules differ in ties and denominators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlab.operators.components import checkpointed

KEY = ("id1", "id2")


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df plus a dense 0-based position in the given order, without one task that sees all rows.

    Rows are dealt by ranges of the order; a small table of range sizes gives each range its offset.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    ordered = checkpointed(ordered)  # both passes must see one partitioning
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def meet(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows plus the other columns of table by keys, null meeting null."""
    other = table.withColumnsRenamed({k: f"{k} of the table" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"`{k} of the table`")) for k in keys])
    return rows.join(other, on).drop(*[f"{k} of the table" for k in keys])


def _cells(ranged: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """(_part, by, <sum>_above, <sum>_all): what the group has in the ranges before, and in all; a row for each range and group.

    The window runs over one row a range.
    """
    group = W.partitionBy(*by)
    above = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    cells = ranged.groupBy("_part", *by).agg(*[x.alias(k) for k, x in sums.items()])
    return cells.select("_part", *by, *[F.coalesce(F.sum(k).over(above), F.lit(0)).alias(f"{k}_above") for k in sums], *[F.sum(k).over(group).alias(f"{k}_all") for k in sums])


def place_in_group(df: DataFrame, by: list[str], order: list[str | Column], place: str = "_place", size: str = "_size") -> DataFrame:
    """df plus place (from 1, in the given order within by) and size (rows of the group); nulls of by are a group.

    Rows are dealt by ranges of (by, order), so a group of any size is many tasks' work, each of which numbers its
    own range; a table of one row for each range and group says how many rows of the group lie in the ranges before.
    order should leave no ties, or equal rows change places.
    """
    keys, spare = _columns([*by]), "_at"
    ranged = df.repartitionByRange(*keys, *_columns(order)).sortWithinPartitions(*keys, *_columns(order)).withColumn("_part", F.spark_partition_id())
    ranged = checkpointed(ranged.withColumn(spare, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))  # both passes must see one partitioning
    first = ranged.groupBy("_part", *by).agg(F.min(spare).alias("_first"))
    cells = meet(_cells(ranged, by, {"_n": F.count("*")}), first, ["_part", *by])
    out = meet(ranged, cells, ["_part", *by])
    return out.withColumns({place: F.col("_n_above") + F.col(spare) - F.col("_first") + 1, size: F.col("_n_all")}).drop("_part", spare, "_first", "_n_above", "_n_all")


def running_sums(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df plus, for each of sums, <name>_before (over the group's rows that come earlier) and <name>_all.

    As place_in_group: windows run within one range of the group, totals of the ranges before come from a small table.
    """
    keys = _columns([*by])
    ranged = checkpointed(df.withColumns({f"_{k}": x for k, x in sums.items()}).repartitionByRange(*keys, *_columns(order)).withColumn("_part", F.spark_partition_id()))
    cells = _cells(ranged, by, {k: F.sum(f"_{k}") for k in sums})
    earlier = W.partitionBy("_part", *by).orderBy(*_columns(order)).rowsBetween(W.unboundedPreceding, -1)
    out = meet(ranged.withColumns({f"{k}_here": F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)) for k in sums}), cells, ["_part", *by])
    return out.withColumns({f"{k}_before": F.col(f"{k}_here") + F.col(f"{k}_above") for k in sums}).drop("_part", *[x for k in sums for x in (f"_{k}", f"{k}_here", f"{k}_above")])


def rank_ordinal(df: DataFrame, by: list[str], col: str = "predict", key=KEY) -> DataFrame:
    """(row_number - 1) / (n - 1) within by, ties by key; 0 for a single row."""
    return place_in_group(df, by, [col, *key]).withColumn("rank", (F.col("_place") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))).drop("_place", "_size")


def rank_average_pct(df: DataFrame, by: list[str], col: str = "predict") -> DataFrame:
    """Average rank of equal values over n within by. Equal values are one row while ranks are summed."""
    blocks = running_sums(df.groupBy(*by, col).agg(F.count("*").alias("_many")), by, [col], {"_n": F.col("_many")})
    blocks = blocks.select(*by, col, ((F.col("_n_before") + (F.col("_many") + 1) / 2) / F.col("_n_all")).alias("rank"))
    return meet(df.drop("rank"), blocks, [*by, col])


def rank_midpoint(df: DataFrame, by: list[str], col: str = "predict", key=KEY) -> DataFrame:
    """(row_number - 0.5) / n within by, ties by key."""
    return place_in_group(df, by, [col, *key]).withColumn("rank", (F.col("_place") - 0.5) / F.col("_size")).drop("_place", "_size")


def rank_in_route(df: DataFrame, by: list[str], col: str = "predict", key=KEY) -> DataFrame:
    """row_number / n within by, ties by key."""
    return place_in_group(df, by, [col, *key]).withColumn("rank", F.col("_place") / F.col("_size")).drop("_place", "_size")


def quantiles_of_counts(counts: DataFrame, by: list[str], value: str, many: str, wanted: dict[str, float]) -> DataFrame:
    """(by, a column for each of wanted): exact quantiles, interpolated between neighbours, of values that stand `many` times each.

    Running counts tell at which value a place lies, so no group's values come together anywhere.
    """
    placed = running_sums(counts, by, [value], {"_n": F.col(many)})

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("_n_before") <= k) & (k < F.col("_n_before") + F.col(many)), F.col(value)))

    found = []
    for name, q in wanted.items():
        place = (F.col("_n_all") - 1) * q
        low = F.floor(F.round(place, 9))
        found += [at(low).alias(f"{name} low"), at(F.least(low + 1, F.col("_n_all") - 1)).alias(f"{name} high"), F.max(F.greatest(place - low, F.lit(0.0))).alias(f"{name} part")]
    each = placed.groupBy(*by).agg(*found)
    return each.select(*by, *[(F.col(f"{k} low") + (F.col(f"{k} high") - F.col(f"{k} low")) * F.col(f"{k} part")).alias(k) for k in wanted])


def latest_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; an aggregate, so no window holds a key's history."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def canonical_order(df: DataFrame, key=KEY) -> DataFrame:
    return df.orderBy(*key)


def top_errors(df: DataFrame, n: int, positives: bool) -> DataFrame:
    """The n positives of least score, or the negatives of greatest."""
    side = df.where(F.col("target") == int(positives))
    return side.orderBy(F.col("predict").asc() if positives else F.col("predict").desc(), *KEY).limit(n)


def top_disagreement(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """The n widest gaps between two score columns in either direction; direction says which is above."""
    gap = df.withColumn("gap", F.col(a) - F.col(b))
    up = gap.orderBy(F.desc("gap"), *KEY).limit(n).withColumn("direction", F.lit("first"))
    return up.unionByName(gap.orderBy("gap", *KEY).limit(n).withColumn("direction", F.lit("second")))


def union_pairs(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts under another, with the name of each as source."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def id_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(part, n): ids of both sets, of a only and of b only."""
    a, b = a.select("id").distinct(), b.select("id").distinct()
    parts = {"both": a.intersect(b), "only_a": a.exceptAll(b), "only_b": b.exceptAll(a)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.union(row)
    return out


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, spearman): correlation of average ranks within by."""
    ranked = rank_average_pct(df, by, a).withColumnRenamed("rank", "_a")
    ranked = rank_average_pct(ranked, by, b).withColumnRenamed("rank", "_b")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("spearman"))


