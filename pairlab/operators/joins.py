"""Joins of pairs with items, scores, verdicts and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators import ranks
from pairlab.operators.components import checkpointed
from pairlab.operators.contracts import item_ids, unique


#: Ids of items that are sent to all tasks at most; more of them meet the items by a shuffle. The driver builds what is
#: sent, some 200 bytes for each id at its peak.
SENT_IDS = 250_000


def shuffled(table: DataFrame) -> DataFrame:
    """table, which joins by a shuffle. It is for tables that grow with the input where Spark cannot tell: it sizes
    arrays, maps and what an explode makes by their types alone, and files as they are compressed, so that it may take
    a table of any size for one that the driver can send to all tasks."""
    return table.hint("merge")


def by_size(table: DataFrame, sent: int = SENT_IDS) -> DataFrame:
    """table, which is sent to all tasks if it has `sent` rows at most, and otherwise joins by a shuffle. It is counted first."""
    return F.broadcast(table) if table.count() <= sent else shuffled(table)


def attach_items(pairs: DataFrame, items: DataFrame, cols: list[str], drop_missing: bool = False, known_unique: bool = False) -> DataFrame:
    """pairs plus each of cols with suffix 1 and 2; a missing item gives nulls. A named id of several items fails, as pairs would multiply.

    Only items that pairs name go on, and where columns are computed from an item they are computed for those alone.
    known_unique leaves the check out, for items that are grouped by id already.
    """
    items = needed_items(items.select("id", *cols), pairs)
    items = items if known_unique else once(items)
    out, how = pairs, "inner" if drop_missing else "left"
    for side in ("1", "2"):
        out = out.join(shuffled(items.select(F.col("id").alias(f"id{side}"), *[F.col(c).alias(f"{c}{side}") for c in cols])), f"id{side}", how)
    return out


def needed_items(items: DataFrame, pairs: DataFrame, sent: int = SENT_IDS) -> DataFrame:
    """The items that some pair names. Up to `sent` ids go to the items, which then stay where they are."""
    return semi_join(items, checkpointed(item_ids(pairs)), sent)


def semi_join(items: DataFrame, ids: DataFrame, sent: int = SENT_IDS) -> DataFrame:
    """The items of the given ids, a table that is counted first."""
    return items.join(by_size(ids, sent), "id", "left_semi")


def once(items: DataFrame) -> DataFrame:
    """items as they are; the job fails if two have one id. The count is of ids alone; rows are not grouped."""
    counts = items.groupBy("id").agg(F.count("*").alias("rows of an id"))
    message = F.concat(F.lit("repeated id: "), F.col("id").cast("string"))
    ok = F.when(F.col("rows of an id") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return items.join(shuffled(counts), "id").where(ok).drop("rows of an id")


def join_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """df plus predict by pair, null where there is none; a pair that is scored twice fails, as rows would multiply."""
    return df.join(unique(scores.select("id1", "id2", "predict"), ["id1", "id2"]), ["id1", "id2"], "left")


def apply_corrections(pairs: DataFrame, journal: DataFrame) -> DataFrame:
    """pairs with the latest verdict of 0 or 1 as target; original_target keeps the old one."""
    last = ranks.latest_per_key(journal.select("id1", "id2", "audited_label", "judged_at"), ["id1", "id2"], "judged_at").where("audited_label >= 0")
    joined = pairs.join(last.select("id1", "id2", "audited_label"), ["id1", "id2"], "left")
    return joined.withColumn("original_target", F.col("target")).withColumn("target", F.coalesce("audited_label", "target").cast("int")).drop("audited_label")


def unordered_anti(derived: DataFrame, labelled: DataFrame) -> DataFrame:
    """Derived pairs that are not labelled in either order."""
    known = labelled.select(F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")).distinct()
    keyed = derived.withColumns({"lo": F.least("id1", "id2"), "hi": F.greatest("id1", "id2")})
    return keyed.join(known, ["lo", "hi"], "left_anti").drop("lo", "hi")


def lookup_tokens(tokens: DataFrame, vocab: DataFrame, unknown: int = 0) -> DataFrame:
    """tokens plus code from vocab (token, code); unknown ones get `unknown`."""
    return tokens.join(vocab, "token", "left").withColumn("code", F.coalesce("code", F.lit(unknown)))


def intersect_scores(scores: DataFrame, n: int) -> DataFrame:
    """Long scores of the pairs that all n models have."""
    full = scores.groupBy("id1", "id2").agg(F.count_distinct("model").alias("n")).where(F.col("n") == n)
    return scores.join(full.select("id1", "id2"), ["id1", "id2"], "left_semi")
