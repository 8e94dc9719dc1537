"""Label audit on an append-only journal: the last verdict of a pair wins.

oof: long scores with model, fold, category, id1, id2, target, predict. infold: scores of models that saw the
fold, with held (the fold a model left out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.draws import draw
from pairlab.operators import metrics, ranks
from pairlab.operators.joins import apply_corrections


def latest(journal: DataFrame) -> DataFrame:
    return ranks.latest_per_key(journal, ["id1", "id2"], "judged_at")


def votes_against_label(oof: DataFrame) -> DataFrame:
    """(id1, id2, target, voters, against): models whose side of 0.5 differs from the label."""
    return oof.groupBy("id1", "id2").agg(F.max("target").alias("target"), F.count("*").alias("voters"), F.count_if((F.col("predict") >= 0.5).cast("int") != F.col("target")).alias("against"))


def infold_average(infold: DataFrame) -> DataFrame:
    """(fold, id1, id2, target, predict, loss): mean over the models that saw the pair's fold, and its cross-entropy."""
    mean = infold.where(F.col("held") != F.col("fold")).groupBy("fold", "id1", "id2").agg(F.max("target").alias("target"), F.avg("predict").alias("predict"))
    return mean.withColumn("loss", metrics.bce(F.col("predict"), F.col("target")))


def infold_gap(oof: DataFrame, infold: DataFrame) -> DataFrame:
    """(model, infold_ap, oof_ap, gap)."""
    seen = infold.where(F.col("held") != F.col("fold")).groupBy("model", "id1", "id2").agg(F.max("target").alias("target"), F.avg("predict").alias("predict"))
    a = metrics.average_precision(seen, ["model"]).select("model", F.col("ap").alias("infold_ap"))
    b = metrics.average_precision(oof, ["model"]).select("model", F.col("ap").alias("oof_ap"))
    return a.join(b, "model").withColumn("gap", F.col("infold_ap") - F.col("oof_ap"))


def audit_queue(mode: str, oof: DataFrame, n: int, model: str | None = None, infold: DataFrame | None = None, journal: DataFrame | None = None, judge: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """The n pairs that most deserve a look: (id1, id2, target, priority), pairs with a verdict left out.

    fn, fp: positives of least, negatives of greatest score of the model. consensus: |target - mean score of all
    models|. random: by hash. infold, infold_fn, infold_fp: loss of the in-fold mean, of all, positives, negatives.
    infold_gap: in-fold minus out-of-fold score on the label's side. judge, judge_fn, judge_fp: distance of a
    judge's score (id1, id2, predict) from the label. Priorities are rounded to nine decimals, so that equal ones tie.
    """
    one = oof.where(F.col("model") == model) if model else oof
    target = F.col("target")
    if mode in ("fn", "fp"):
        rows = one.where(target == int(mode == "fn")).select("id1", "id2", "target", (F.abs(target - F.col("predict"))).alias("priority"))
    elif mode == "consensus":
        rows = oof.groupBy("id1", "id2").agg(F.max("target").alias("target"), F.avg("predict").alias("p")).select("id1", "id2", "target", F.abs(target - F.col("p")).alias("priority"))
    elif mode == "random":
        rows = oof.select("id1", "id2", "target").distinct().withColumn("priority", draw(seed, "id1", "id2") % 1_000_000 / 1e6)
    elif mode in ("infold", "infold_fn", "infold_fp"):
        rows = infold_average(infold).select("id1", "id2", "target", F.col("loss").alias("priority"))
        rows = rows if mode == "infold" else rows.where(target == int(mode == "infold_fn"))
    elif mode == "infold_gap":
        seen = infold_average(infold).select("id1", "id2", F.col("predict").alias("seen"))
        rows = one.join(seen, ["id1", "id2"]).select("id1", "id2", "target", F.when(target == 1, F.col("seen") - F.col("predict")).otherwise(F.col("predict") - F.col("seen")).alias("priority"))
    elif mode in ("judge", "judge_fn", "judge_fp"):
        labels = oof.select("id1", "id2", "target").distinct()
        rows = labels.join(judge.select("id1", "id2", "predict"), ["id1", "id2"]).select("id1", "id2", "target", F.abs(target - F.col("predict")).alias("priority"))
        rows = rows if mode == "judge" else rows.where(target == int(mode == "judge_fn"))
    else:
        raise ValueError(f"no audit mode {mode}")
    if journal is not None:
        rows = rows.join(journal.select("id1", "id2").distinct(), ["id1", "id2"], "left_anti")
    return rows.withColumn("priority", F.round("priority", 9)).orderBy(F.desc("priority"), "id1", "id2").limit(n)


def audit_summary(journal: DataFrame, least: int = 30) -> DataFrame:
    """(mode, n, changed, unsure, rate, low, high): verdicts by mode; the noise rate and its interval only from random ones."""
    last = latest(journal)
    sure = F.col("audited_label") >= 0
    out = last.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(sure & (F.col("audited_label") != F.col("original_target"))).alias("changed"), F.count_if(~sure).alias("unsure"), F.count_if(sure).alias("sure"))
    ok = (F.col("mode") == "random") & (F.col("sure") >= least)
    rate = F.when(ok, F.col("changed") / F.col("sure"))
    half = 1.96 * F.sqrt(rate * (1 - rate) / F.col("sure"))
    return out.select("mode", "n", "changed", "unsure", rate.alias("rate"), (rate - half).alias("low"), (rate + half).alias("high"))


def audit_impact(oof: DataFrame, journal: DataFrame) -> DataFrame:
    """(model, before, after): mean fold AP with the original and the corrected labels."""
    before = metrics.average_precision(oof, ["model", "fold"]).groupBy("model").agg(F.avg("ap").alias("before"))
    fixed = apply_corrections(oof, journal)
    after = metrics.average_precision(fixed, ["model", "fold"]).groupBy("model").agg(F.avg("ap").alias("after"))
    return before.join(after, "model")


def judge_agreement(judge: DataFrame, journal: DataFrame) -> DataFrame:
    """(changed, n, with_original, with_audited): a judge's side of 0.5 against both labels, by whether the verdict changed the label."""
    last = latest(journal).where("audited_label >= 0")
    said = (F.col("predict") >= 0.5).cast("int")
    rows = last.join(judge.select("id1", "id2", "predict"), ["id1", "id2"]).withColumn("changed", F.col("audited_label") != F.col("original_target"))
    return rows.groupBy("changed").agg(F.count("*").alias("n"), F.avg((said == F.col("original_target")).cast("double")).alias("with_original"), F.avg((said == F.col("audited_label")).cast("double")).alias("with_audited"))


def verdict_table(judge: DataFrame, journal: DataFrame) -> DataFrame:
    """(human, model, n)."""
    return latest(journal).join(judge.select("id1", "id2", "predict"), ["id1", "id2"]).groupBy(F.col("audited_label").alias("human"), (F.col("predict") >= 0.5).cast("int").alias("model")).agg(F.count("*").alias("n"))


def model_freshness(journal: DataFrame, models: DataFrame) -> DataFrame:
    """(model, newer): corrections later than the model's trained_at; models are a small configuration table."""
    last = latest(journal).where("audited_label >= 0 and audited_label <> original_target").select("judged_at")
    joined = last.join(F.broadcast(models), F.col("judged_at") > F.col("trained_at"))
    return models.select("model").join(joined.groupBy("model").agg(F.count("*").alias("newer")), "model", "left").select("model", F.coalesce("newer", F.lit(0)).alias("newer"))


def audited_slice_metrics(oof: DataFrame, journal: DataFrame) -> DataFrame:
    """(model, n_rows, ap_original, ap_audited, flips, unsure) over pairs with a verdict."""
    last = latest(journal).select("id1", "id2", "audited_label")
    rows = oof.join(last, ["id1", "id2"])
    counts = rows.groupBy("model").agg(F.count_if((F.col("audited_label") >= 0) & (F.col("audited_label") != F.col("target"))).alias("flips"), F.count_if(F.col("audited_label") < 0).alias("unsure"))
    a = metrics.average_precision(rows, ["model"]).select("model", "n_rows", F.col("ap").alias("ap_original"))
    fixed = rows.withColumn("target", F.when(F.col("audited_label") >= 0, F.col("audited_label")).otherwise(F.col("target")))
    b = metrics.average_precision(fixed, ["model"]).select("model", F.col("ap").alias("ap_audited"))
    return a.join(b, "model").join(counts, "model")
