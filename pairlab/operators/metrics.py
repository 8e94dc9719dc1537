"""Ranking metrics: average precision over blocks of equal scores, and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlab.operators import ranks
from pairlab.operators.components import checkpointed


def score_blocks(df: DataFrame, by: list[str], score: str = "predict", weight: str | None = None) -> DataFrame:
    """(by, score, tp, n): one row for each distinct score, weighted if a weight is named."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*by, score).agg(F.sum(w * F.col("target")).alias("tp"), F.sum(w).alias("n"))


def average_precision(df: DataFrame, by: list[str], score: str = "predict", weight: str | None = None) -> DataFrame:
    """(by, n_rows, positives, ap): equal scores are one block; ap is null without positives.

    Scores collapse to blocks before any window, so a group's window holds its distinct scores.
    """
    return ap_of_blocks(score_blocks(df, by, score, weight), by, score)


def score_range(x: Column) -> Column:
    """A whole number that grows with x over all doubles, so that scores of any scale spread over many ranges.

    Probabilities get 254 equal ranges, with ever finer ones toward 0 and 1; outside of 0 to 1 there are 16 ranges
    to each doubling. Null is below all numbers, NaN above them, as in Spark's order.
    """

    def doublings(y: Column) -> Column:
        return F.floor(16 * F.least(F.greatest(F.log2(y), F.lit(-1100.0)), F.lit(1100.0)))

    out = F.when(x.isNull(), -100_000).when(F.isnan(x), 100_000).when(x < 0, -40_000 - doublings(-x)).when(x == 0, -20_000)
    out = out.when(x < 1 / 256, 128 + doublings(x)).when(x < 255 / 256, F.floor(x * 256)).when(x < 1, 128 - doublings(1 - x)).when(x == 1, 2_000)
    return out.otherwise(40_000 + doublings(x)).cast("int")


def ap_of_blocks(blocks: DataFrame, by: list[str], score: str = "predict") -> DataFrame:
    """The same from blocks.

    Running sums go in two steps, so that no task holds a whole group: within one range of the score
    (`score_range`), and over the totals of the ranges above, a small table.
    """
    cut = blocks.withColumn("_part", score_range(F.col(score).cast("double")))
    totals = cut.groupBy(*by, "_part").agg(F.sum("tp").alias("_tp"), F.sum("n").alias("_n"))
    group = W.partitionBy(*by)
    above = group.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_{c}") for c in by]
    totals = totals.select(*keys, F.col("_part").alias("_range"), F.coalesce(F.sum("_tp").over(above), F.lit(0)).alias("_ctp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_cn"), F.sum("_tp").over(group).alias("pos"))
    on = F.col("_part") == F.col("_range")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    down = W.partitionBy(*by, "_part").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = cut.join(totals, on).select(*by, "tp", "n", (F.sum("tp").over(down) + F.col("_ctp")).alias("ctp"), (F.sum("n").over(down) + F.col("_cn")).alias("cn"), "pos")
    term = F.col("tp").cast("double") / F.nullif(F.col("pos").cast("double"), F.lit(0.0)) * F.col("ctp") / F.col("cn")
    return cum.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.max("pos").alias("positives"), F.sum(term).alias("ap"))


def macro_ap(df: DataFrame, by: list[str], score: str = "predict", category: str = "category") -> DataFrame:
    """(by, macro_ap, categories, skipped, worst): mean over categories with both classes."""
    each = average_precision(df, [*by, category], score)
    two = (F.col("positives") > 0) & (F.col("positives") < F.col("n_rows"))
    return each.groupBy(*by).agg(
        F.avg(F.when(two, F.col("ap"))).alias("macro_ap"), F.count_if(two).alias("categories"), F.count_if(~two).alias("skipped"),
        F.min_by(category, F.when(two, F.struct("ap", category))).alias("worst"),
    )


def score_report(scored: DataFrame) -> DataFrame:
    """AP at (model), (model, fold), (model, category) and (model, fold, category), by one pass of grouping sets over score blocks.

    level: pooled, fold, category or cell; the columns a level lacks are null.
    """
    cells = scored.groupBy("model", "fold", "category", "predict").agg(F.sum("target").alias("tp"), F.count("*").alias("n"))
    sets = [["model", "predict"], ["model", "fold", "predict"], ["model", "category", "predict"], ["model", "fold", "category", "predict"]]
    names = ["model", "fold", "category", "predict"]
    blocks = cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"), F.grouping("fold").alias("gf"), F.grouping("category").alias("gc"))
    level = F.when(F.col("gf") + F.col("gc") == 2, "pooled").when(F.col("gc") == 1, "fold").when(F.col("gf") == 1, "category").otherwise("cell")
    return ap_of_blocks(blocks.withColumn("level", level).drop("gf", "gc"), ["model", "level", "fold", "category"])


def fold_report(report: DataFrame) -> DataFrame:
    """(model, fold, n_rows, positives, ap, macro_ap, skipped) from score_report's rows: AP of each fold and its mean over categories with both classes."""
    cells = report.where("level = 'cell'").withColumn("two", (F.col("positives") > 0) & (F.col("positives") < F.col("n_rows")))
    macro = cells.groupBy("model", "fold").agg(F.avg(F.when(F.col("two"), F.col("ap"))).alias("macro_ap"), F.count_if(~F.col("two")).alias("skipped"))
    return report.where("level = 'fold'").join(macro, ["model", "fold"]).select("model", "fold", "n_rows", "positives", "ap", "macro_ap", "skipped")


def report_summary(report: DataFrame) -> DataFrame:
    """(model, mean_fold, min_fold, pooled, pooled_macro, skipped, worst_category, worst_ap) from score_report's rows.

    The pooled macro is the mean over categories of both classes, all folds together; the worst category is the
    least of those, of equal ones the first by name.
    """
    two = (F.col("level") == "category") & (F.col("positives") > 0) & (F.col("positives") < F.col("n_rows"))
    fold, kept = F.when(F.col("level") == "fold", F.col("ap")), F.when(two, F.col("ap"))
    worst = F.min(F.when(two, F.struct("ap", "category")))
    out = report.groupBy("model").agg(
        F.avg(fold).alias("mean_fold"), F.min(fold).alias("min_fold"), F.max(F.when(F.col("level") == "pooled", F.col("ap"))).alias("pooled"), F.avg(kept).alias("pooled_macro"),
        F.count_if((F.col("level") == "category") & ~two).alias("skipped"), worst.alias("worst"),
    )
    return out.select("model", "mean_fold", "min_fold", "pooled", "pooled_macro", "skipped", F.col("worst.category").alias("worst_category"), F.col("worst.ap").alias("worst_ap"))


def leaderboard(reports: DataFrame) -> DataFrame:
    """reports (model, mean_ap, macro_ap, public): rank by mean_ap, public rank among those with a public score, and the difference."""
    by = W.orderBy(F.desc("mean_ap"), "model")
    ranked = reports.withColumn("rank", F.row_number().over(by))
    public = reports.where("public is not null").select("model", F.row_number().over(W.orderBy(F.desc("public"), "model")).alias("public_rank"))
    return ranked.join(public, "model", "left").withColumn("delta", F.col("public_rank") - F.col("rank"))


def top_n(board: DataFrame, n: int = 5, metric: str = "mean_ap") -> DataFrame:
    return board.orderBy(F.desc(metric), "model").limit(n)


def fold_summary(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(fold, n_pairs, positives, rate, items, components): exact distinct items of each fold, and components of those; comp (id, component)."""
    base = pairs.groupBy("fold").agg(F.count("*").alias("n_pairs"), F.sum("target").alias("positives"), F.avg("target").alias("rate"))
    items = pairs.select("fold", F.explode(F.array("id1", "id2")).alias("id")).distinct().join(comp, "id", "left")
    each = items.groupBy("fold", "component").agg(F.count("*").alias("n")).groupBy("fold").agg(F.sum("n").alias("items"), F.count("component").alias("components"))
    return base.join(each, "fold")


def confusion_at(df: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, tn, f1)."""
    said, true = F.col("predict") >= threshold, F.col("target") == 1
    out = df.groupBy(*by).agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    return out.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)))


def bce(p: Column, t: Column, eps: float = 1e-6) -> Column:
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(t * F.ln(c) + (1 - t) * F.ln(1 - c))


def calibration(df: DataFrame, by: list[str], bins: int = 20) -> DataFrame:
    """(by, brier, log_loss, ece): equal-width bins, right-open, the last closed."""
    p, t = F.col("predict"), F.col("target")
    each = df.groupBy(*by, F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(t).alias("st"), F.sum((p - t) * (p - t)).alias("sq"), F.sum(bce(p, t)).alias("ll"))
    n = F.sum("n")
    return each.groupBy(*by).agg((F.sum("sq") / n).alias("brier"), (F.sum("ll") / n).alias("log_loss"), (F.sum(F.abs(F.col("sp") - F.col("st"))) / n).alias("ece"))


def slice_metrics(df: DataFrame, slices: dict[str, Column], by: list[str]) -> DataFrame:
    """(by, slice, n_rows, positives, ap, coverage, delta): overlapping slices against the whole, named all."""
    names = F.array_compact(F.array(F.lit("all"), *[F.when(c, F.lit(k)) for k, c in slices.items()]))
    each = average_precision(df.withColumn("slice", F.explode(names)), [*by, "slice"])
    whole = each.where("slice = 'all'").select(*by, F.col("n_rows").alias("n_all"), F.col("ap").alias("ap_all"))
    return each.join(whole, by).select(*by, "slice", "n_rows", "positives", "ap", (F.col("n_rows") / F.col("n_all")).alias("coverage"), (F.col("ap") - F.col("ap_all")).alias("delta"))


def distribution(df: DataFrame, by: list[str], col: str = "predict") -> DataFrame:
    """(by, mean, mean0, mean1, std, q01, q50, q99). Quantiles are exact and come from counts of equal values."""
    c, t = F.col(col), F.col("target")
    out = df.groupBy(*by).agg(F.avg(c).alias("mean"), F.avg(F.when(t == 0, c)).alias("mean0"), F.avg(F.when(t == 1, c)).alias("mean1"), F.stddev_pop(c).alias("std"))
    counts = df.where(c.isNotNull()).groupBy(*by, col).agg(F.count("*").alias("many"))
    q = ranks.quantiles_of_counts(counts, by, col, "many", {"q01": 0.01, "q50": 0.5, "q99": 0.99})
    return ranks.meet(out, q, by).select(*by, "mean", "mean0", "mean1", "std", "q01", "q50", "q99")


def ranking_change(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, spearman, mean_move, median_move, moved_share, top_jaccard): how a ranking changes from a to b."""
    both = ranks.rank_average_pct(ranks.rank_average_pct(df, by, a).withColumnRenamed("rank", "ra"), by, b).withColumnRenamed("rank", "rb")
    move = F.abs(F.col("ra") - F.col("rb"))
    ta, tb = F.col("ra") > 0.9, F.col("rb") > 0.9
    return both.groupBy(*by).agg(F.corr("ra", "rb").alias("spearman"), F.avg(move).alias("mean_move"), F.median(move).alias("median_move"), F.avg((move >= 0.01).cast("int")).alias("moved_share"), (F.count_if(ta & tb) / F.count_if(ta | tb)).alias("top_jaccard"))


def pivot_deltas(each: DataFrame, base: str, variants: list[str]) -> DataFrame:
    """(category, variant, mean_delta, min_delta, max_delta, same_sign) over folds of (variant, fold, category, ap)."""
    wide = each.groupBy("category", "fold").pivot("variant", [base, *variants]).agg(F.first("ap"))
    out = None
    for v in variants:
        d = F.col(v) - F.col(base)
        row = wide.groupBy("category").agg(F.lit(v).alias("variant"), F.avg(d).alias("mean_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"), ((F.min(d) > 0) | (F.max(d) < 0)).alias("same_sign"))
        out = row if out is None else out.unionByName(row)
    return out


def gate_decision(deltas: DataFrame, pooled: DataFrame, least: float = 0.001) -> DataFrame:
    """(variant, min_fold_delta, pooled_delta, go, go_every_fold): go asks every fold above 0 and the pooled delta above least; the variant every fold above least."""
    folds = deltas.groupBy("variant").agg(F.min("delta").alias("min_fold_delta"))
    gate = folds.join(pooled.select("variant", F.col("delta").alias("pooled_delta")), "variant")
    return gate.withColumns({"go": (F.col("min_fold_delta") > 0) & (F.col("pooled_delta") > least), "go_every_fold": F.col("min_fold_delta") > least})


def split_compare(long: DataFrame) -> DataFrame:
    """(model, validation, board, difference, ratio) from (model, split, value): full outer, so a one-sided model stays."""
    a = long.where("split = 'validation'").groupBy("model").agg(F.max("value").alias("validation"))
    b = long.where("split = 'board'").groupBy("model").agg(F.max("value").alias("board"))
    return a.join(b, "model", "full_outer").select("model", "validation", "board", (F.col("board") - F.col("validation")).alias("difference"), (F.col("board") / F.nullif("validation", F.lit(0.0))).alias("ratio"))


def model_gaps(wide: DataFrame, a: str, b: str) -> DataFrame:
    """(model_a, model_b, gap_a, gap_b, sign_kept, shrink): all model pairs; models are few, rows are not involved."""
    x, y = wide.select(F.col("model").alias("model_a"), F.col(a).alias("a1"), F.col(b).alias("b1")), wide.select(F.col("model").alias("model_b"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    gaps = x.join(y, F.col("model_a") < F.col("model_b")).select("model_a", "model_b", (F.col("a1") - F.col("a2")).alias("gap_a"), (F.col("b1") - F.col("b2")).alias("gap_b"))
    return gaps.withColumn("sign_kept", F.signum("gap_a") == F.signum("gap_b")).withColumn("shrink", F.col("gap_b") / F.nullif("gap_a", F.lit(0.0)))


def rank_corr(df: DataFrame, a: str, b: str, by: str = "category", least: int = 3) -> DataFrame:
    return ranks.spearman(df, [by], a, b).where(F.col("n") >= least)


def compare_arms(each: DataFrame) -> DataFrame:
    """(arm, mean_ap, delta_to_best, wins) from (arm, fold, ap): wins counts folds in which the arm is first."""
    first = F.row_number().over(W.partitionBy("fold").orderBy(F.desc("ap"), "arm")) == 1
    arms = each.withColumn("won", first).groupBy("arm").agg(F.avg("ap").alias("mean_ap"), F.count_if("won").alias("wins"))
    return arms.crossJoin(F.broadcast(arms.agg(F.max("mean_ap").alias("best")))).select("arm", "mean_ap", (F.col("mean_ap") - F.col("best")).alias("delta_to_best"), "wins")


def label_histogram(df: DataFrame, col: str = "target") -> DataFrame:
    """(value, n, share)."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def signal_price(df: DataFrame, signal: Column) -> DataFrame:
    """(coverage, precision, fp_share): what a yes/no signal alone is worth."""
    t = F.col("target") == 1
    return df.agg((F.count_if(signal) / F.count("*")).alias("coverage"), (F.count_if(signal & t) / F.nullif(F.count_if(signal), F.lit(0))).alias("precision"), (F.count_if(signal & ~t) / F.nullif(F.count_if(~t), F.lit(0))).alias("fp_share"))


def model_correlation(scores: DataFrame, by: list[str]) -> DataFrame:
    """(model_a, model_b, pearson, spearman): all pairs of models over their common rows; by: groups within which ranks are taken."""
    ranked = ranks.rank_average_pct(scores, ["model", *by])
    a = ranked.select("id1", "id2", F.col("model").alias("model_a"), F.col("predict").alias("pa"), F.col("rank").alias("ra"))
    b = ranked.select("id1", "id2", F.col("model").alias("model_b"), F.col("predict").alias("pb"), F.col("rank").alias("rb"))
    return a.join(b, ["id1", "id2"]).where("model_a < model_b").groupBy("model_a", "model_b").agg(F.corr("pa", "pb").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def seed_noise(scores: DataFrame) -> DataFrame:
    """(n_pairs, mean_std, max_std): spread of several predictions of the same pair."""
    each = scores.groupBy("id1", "id2").agg(F.stddev_pop("predict").alias("s"))
    return each.agg(F.count("*").alias("n_pairs"), F.avg("s").alias("mean_std"), F.max("s").alias("max_std"))


def submission_board(subs: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, latest, best, runner_up, delta, top_gain): per-category scores of the latest, the best and the second submission.

    subs (submission, status, created_at, public), categories (submission, category, ap). Only submissions that
    succeeded and have a score count. top_gain: among the four largest deltas of best over runner-up.
    """
    scored = subs.where((F.col("status") == "success") & F.col("public").isNotNull())
    newest = scored.agg(F.max_by("submission", F.struct("created_at", "submission")).alias("submission")).withColumn("is_latest", F.lit(True))  # one row
    best = scored.orderBy(F.desc("public"), "submission").limit(2)
    place = best.select("submission", F.row_number().over(W.orderBy(F.desc("public"), "submission")).alias("place"))  # two rows
    named = place.join(newest, "submission", "full_outer")
    both = categories.join(F.broadcast(named), "submission").groupBy("category").agg(F.max(F.when(F.col("is_latest"), F.col("ap"))).alias("latest"), F.max(F.when(F.col("place") == 1, F.col("ap"))).alias("best"), F.max(F.when(F.col("place") == 2, F.col("ap"))).alias("runner_up"))
    both = both.withColumn("delta", F.col("best") - F.col("runner_up"))
    return both.withColumn("top_gain", F.row_number().over(W.orderBy(F.desc_nulls_last("delta"), "category")) <= 4)


def prior_from_constant(df: DataFrame, by: list[str]) -> DataFrame:
    """AP of a constant score: the prevalence of each group."""
    return average_precision(df.withColumn("predict", F.lit(0.5)), by)


def variant_report(scored: DataFrame, base: str, least: float = 0.001) -> DataFrame:
    """(variant, mean_ap, mean_macro, mean_delta, std_delta, same_sign, worst_category, worst_delta, pooled_delta, go) against a named variant.

    scored: model, fold, category, target, predict. All of it comes from one score_report; go is gate_decision's.
    """
    report = checkpointed(score_report(scored))
    folds = fold_report(report)
    mine = folds.where(F.col("model") == base).select("fold", F.col("ap").alias("base_ap"))
    d = F.col("ap") - F.col("base_ap")
    each = folds.join(mine, "fold").select(F.col("model").alias("variant"), "ap", "macro_ap", d.alias("delta"))
    out = each.groupBy("variant").agg(F.avg("ap").alias("mean_ap"), F.avg("macro_ap").alias("mean_macro"), F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("std_delta"), ((F.min("delta") > 0) | (F.max("delta") < 0)).alias("same_sign"))
    cat = report.where("level = 'category'").select("model", "category", "ap")
    base_cat = cat.where(F.col("model") == base).select("category", F.col("ap").alias("base_ap"))
    worst = cat.join(base_cat, "category").groupBy(F.col("model").alias("variant")).agg(F.min_by("category", F.struct(d, "category")).alias("worst_category"), F.min(d).alias("worst_delta"))
    pooled = report.where("level = 'pooled'").select(F.col("model").alias("variant"), "ap")
    pooled = pooled.join(F.broadcast(pooled.where(F.col("variant") == base).select(F.col("ap").alias("base_ap"))), F.lit(True)).select("variant", d.alias("delta"))  # one row
    gate = gate_decision(each, pooled, least).select("variant", "pooled_delta", "go")
    return out.join(worst, "variant").join(gate, "variant")


def variant_category_deltas(scored: DataFrame, base: str) -> DataFrame:
    """(variant, fold, category, ap, delta): AP of each variant in each fold and category, and how far it is from the named one's; null without positives."""
    cells = score_report(scored).where("level = 'cell'").select("model", "fold", "category", "ap")
    mine = cells.where(F.col("model") == base).select("fold", "category", F.col("ap").alias("base_ap"))
    return cells.where(F.col("model") != base).join(mine, ["fold", "category"]).select(F.col("model").alias("variant"), "fold", "category", "ap", (F.col("ap") - F.col("base_ap")).alias("delta"))


def factorial_effects(each: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """(fold, effect_a, effect_b, simple_a, simple_b, interaction) from (variant, fold, ap); names: none, a, b, both."""
    wide = each.groupBy("fold").pivot("variant", list(names)).agg(F.first("ap"))
    n, a, b, ab = (F.col(x) for x in names)
    return wide.select("fold", ((a - n + ab - b) / 2).alias("effect_a"), ((b - n + ab - a) / 2).alias("effect_b"), (a - n).alias("simple_a"), (b - n).alias("simple_b"), (ab - a - b + n).alias("interaction"))
