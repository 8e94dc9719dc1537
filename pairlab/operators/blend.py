"""Combining score columns: blends, weight search, stacking, routing and penalties.

Long scores have model, id1, id2, predict; keyed scores also fold, category, target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.operators import metrics, ranks
from pairlab.operators.components import checkpointed


def logit(p: Column, eps: float) -> Column:
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def blend(scores: DataFrame, weights: dict[str, float], mode: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """(id1, id2, predict) of pairs that every weighted model has. mode: mean, rank (ordinal within by) or logit."""
    rows = scores.where(F.col("model").isin(*weights))
    if mode == "rank":
        rows = ranks.rank_ordinal(rows, ["model", *by]).withColumn("predict", F.col("rank"))
    elif mode == "logit":
        rows = rows.withColumn("predict", logit(F.col("predict"), 1e-7))
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    w = table[F.col("model")]
    out = rows.groupBy("id1", "id2").agg((F.sum(w * F.col("predict")) / F.sum(w)).alias("predict"), F.count_distinct("model").alias("n")).where(F.col("n") == len(weights)).drop("n")
    return out.withColumn("predict", sigmoid(F.col("predict"))) if mode == "logit" else out


def symmetric_mean(scores: DataFrame) -> DataFrame:
    """(id1, id2, predict): the mean over both directions of a pair, ids in order."""
    return scores.groupBy(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).agg(F.avg("predict").alias("predict"))


def simplex(n: int, parts: int = 4) -> list[tuple[float, ...]]:
    """All weights of n models in steps of 1/parts that sum to 1."""
    return [tuple(x / parts for x in p) for p in product(range(parts + 1), repeat=n) if sum(p) == parts]


def grid_ap(wide: DataFrame, models: list[str], grid: list[tuple[float, ...]]) -> DataFrame:
    """(fold, category, point, ap): every grid point's blend, exploded in the row and reduced to score blocks at once.

    wide: fold, category, target and a column for each model.
    """
    points = F.array(*[F.struct(F.lit(i).alias("point"), sum((F.col(m) * w for m, w in zip(models, ws) if w), F.lit(0.0)).alias("predict")) for i, ws in enumerate(grid)])
    rows = wide.select("fold", "category", "target", F.explode(points).alias("p")).select("fold", "category", "target", "p.point", "p.predict")
    return metrics.average_precision(rows, ["fold", "category", "point"]).select("fold", "category", "point", "ap", "n_rows", "positives")


def grid_table(spark: SparkSession, grid: list[tuple[float, ...]]) -> DataFrame:
    """(point, weights, spread): spread is the squared distance to equal weights."""
    n = len(grid[0])
    return spark.createDataFrame([(i, list(w), sum((x - 1 / n) ** 2 for x in w)) for i, w in enumerate(grid)], "point int, weights array<double>, spread double")


#: Mean APs that are no further apart are equal.
TIE = 1e-12


def choose_weights(ap: DataFrame, grid: DataFrame, folds: list[int], by: tuple[str, ...] = ("category",)) -> DataFrame:
    """(held, by, point, weights): the best mean AP over the other folds; ties within 1e-12 go to the weights nearest equal ones."""
    held = F.explode(F.array(*[F.lit(f) for f in folds])).alias("held")
    rows = ap.where("ap is not null").select("*", held).where("fold <> held")
    mean = rows.groupBy("held", *by, "point").agg(F.avg("ap").alias("ap")).join(F.broadcast(grid), "point")
    points = F.collect_list(F.struct("ap", "spread", "point", "weights"))  # as many as the grid has
    best = mean.groupBy("held", *by).agg(F.max("ap").alias("most"), points.alias("points"))
    near = F.filter("points", lambda x: x["ap"] >= F.col("most") - TIE)
    first = F.array_min(F.transform(near, lambda x: F.struct(x["spread"].alias("spread"), x["point"].alias("point"), x["weights"].alias("weights"))))
    return best.select("held", *by, first.alias("b")).select("held", *by, "b.point", "b.weights")


def nested_blend(wide: DataFrame, models: list[str], chosen: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(id1, id2, fold, category, target, predict): weights of the held-out fold, shrunk toward equal ones by 1 - alpha."""
    equal = 1 / len(models)
    joined = wide.join(F.broadcast(chosen.withColumnRenamed("held", "fold")), ["fold", "category"])
    w = [alpha * F.col("weights")[i] + (1 - alpha) * equal for i in range(len(models))]
    return joined.select("id1", "id2", "fold", "category", "target", sum((F.col(m) * x for m, x in zip(models, w)), F.lit(0.0)).alias("predict"))


def nested_variants(wide: DataFrame, models: list[str], ap: DataFrame, grid: DataFrame, folds: list[int], alphas: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(variant, id1, id2, fold, category, target, predict): held-out scores of every way to choose weights.

    ap from grid_ap over grid. equal; global: one choice for all categories; best_single: the category's best model;
    raw: its best weights; shrunk_<alpha>: those, drawn toward equal ones. The choices of a (fold, category) are one
    row of arrays, so the scores are joined once.
    """
    n, ap = len(models), checkpointed(ap)
    equal = F.array_repeat(F.lit(1 / n), n)
    singles = ap.join(F.broadcast(grid.where(F.array_max("weights") == 1).select("point")), "point")
    raw = choose_weights(ap, grid, folds).select("held", "category", F.col("weights").alias("raw"))
    single = choose_weights(singles, grid, folds).select("held", "category", F.col("weights").alias("single"))
    overall = choose_weights(ap, grid, folds, ()).select("held", F.col("weights").alias("overall"))
    ways = {"equal": equal, "global": F.col("overall"), "best_single": F.col("single"), "raw": F.col("raw")}
    ways |= {f"shrunk_{a}": F.zip_with("raw", equal, _toward(a)) for a in alphas}
    chosen = raw.join(single, ["held", "category"]).join(overall, "held").select(F.col("held").alias("fold"), "category", F.array(*[F.struct(F.lit(k).alias("variant"), w.alias("w")) for k, w in ways.items()]).alias("ways"))
    rows = wide.join(F.broadcast(chosen), ["fold", "category"]).withColumn("way", F.explode("ways"))
    return rows.select("way.variant", "id1", "id2", "fold", "category", "target", sum((F.col(m) * F.col("way.w")[i] for i, m in enumerate(models)), F.lit(0.0)).alias("predict"))


def _toward(alpha: float):
    return lambda w, e: alpha * w + (1 - alpha) * e


def two_level_weights(by_category: DataFrame, overall: DataFrame, share: float = 0.75) -> DataFrame:
    """(held, category, weights): share of the category's weights, the rest of the global ones."""
    both = by_category.join(overall.select("held", F.col("weights").alias("g")), "held")
    return both.select("held", "category", F.zip_with("weights", "g", lambda a, b: share * a + (1 - share) * b).alias("weights"))


def residual_screen(wide: DataFrame, base: str, candidates: list[str], folds: list[int], steps=(0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35)) -> DataFrame:
    """(candidate, mean_weight, delta, folds): nested weight of each candidate on top of the base, and the AP it adds over held-out folds.

    folds has a struct (fold, weight, delta) for each held-out fold.
    """
    rows = wide.select("fold", "target", F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(i).alias("point"), F.round((1 - w) * F.col(base) + w * F.col(c), 8).alias("predict")) for c in candidates for i, w in enumerate(steps)])).alias("p"))
    ap = checkpointed(metrics.average_precision(rows.select("fold", "target", "p.*"), ["candidate", "fold", "point"]).where("ap is not null"))
    held = ap.select("*", F.explode(F.array(*[F.lit(f) for f in folds])).alias("held")).where("fold <> held")
    mean = held.groupBy("candidate", "held", "point").agg(F.round(F.avg("ap"), 9).alias("m"))
    best = mean.groupBy("candidate", "held").agg(F.max_by("point", F.struct("m", -F.col("point"))).alias("point"))
    zero = ap.where("point = 0").select("candidate", F.col("fold").alias("held"), F.col("ap").alias("base_ap"))
    gain = best.join(ap.withColumnRenamed("fold", "held"), ["candidate", "held", "point"]).join(zero, ["candidate", "held"])
    weight = F.element_at(F.array(*[F.lit(float(s)) for s in steps]), F.col("point") + 1)
    each = gain.select("candidate", F.col("held").alias("fold"), weight.alias("weight"), (F.col("ap") - F.col("base_ap")).alias("delta"))
    return each.groupBy("candidate").agg(F.avg("weight").alias("mean_weight"), F.avg("delta").alias("delta"), F.sort_array(F.collect_list(F.struct("fold", "weight", "delta"))).alias("folds"))


def stack_inputs(wide: DataFrame, models: list[str], transform: str, eps: float = 1e-6) -> DataFrame:
    """wide plus x_<model>: the score itself (prob), its logit, or its ordinal rank within the fold (rank)."""
    if transform == "prob":
        return wide.withColumns({f"x_{m}": F.col(m) for m in models})
    if transform == "logit":
        return wide.withColumns({f"x_{m}": logit(F.col(m), eps) for m in models})
    if transform != "rank":
        raise ValueError(f"no transform {transform}")
    for m in models:
        wide = ranks.rank_ordinal(wide, ["fold"], m).withColumnRenamed("rank", f"x_{m}")
    return wide


def fit_stack(wide: DataFrame, models: list[str], folds: list[int], c: float = 1.0, eps: float = 1e-6, transform: str = "logit") -> tuple[DataFrame, list[tuple]]:
    """Leave-one-fold-out logistic stack: (rows with predict, [(held, intercept, coefficients)]); the last fit, of held None, saw all folds.

    Penalty 1/C on half the squared coefficients, none on the intercept. All fits take their Newton steps together:
    a pass over the rows gives the loss, slopes and curvatures of each as sums over the folds it may see. A fit
    without both labels is left out.
    """
    base = ["id1", "id2", "fold", "category", "target"]
    x = [f"x_{m}" for m in models]
    rows = stack_inputs(wide, models, transform, eps).select(*base, *x).persist()
    counts = {r.fold: (r.n, r.t) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("target").alias("t")).collect()}
    seen = {f: [sum(v[i] for k, v in counts.items() if k != f or f is None) for i in (0, 1)] for f in [*folds, None]}
    fits = {f: np.zeros(len(x) + 1) for f, (n, t) in seen.items() if 0 < t < n}
    fits = newton_fits(rows, x, fits, {f: seen[f][0] for f in fits}, 1 / c) if fits else {}
    rows.unpersist()
    coefficients = [(f, float(w[0]), [float(v) for v in w[1:]]) for f, w in fits.items()]
    out = None
    for f, intercept, cs in coefficients:
        if f is not None:
            part = rows.where(F.col("fold") == f).select(*base, sigmoid(sum((k * F.col(v) for k, v in zip(cs, x)), F.lit(intercept))).alias("predict"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select(*base, F.lit(None).cast("double").alias("predict")).limit(0), coefficients


def newton_fits(rows: DataFrame, x: list[str], fits: dict, n: dict, penalty: float, steps: int = 100, tolerance: float = 1e-11) -> dict:
    """Coefficients (intercept first) of each fit, from rows of other folds than its own; n: rows of each. Steps that raise the loss are halved."""
    terms, pairs = [F.lit(1.0), *[F.col(c) for c in x]], [(i, j) for i in range(len(x) + 1) for j in range(i, len(x) + 1)]
    weight = np.array([0.0] + [penalty] * len(x))
    now, best, going = dict(fits), {f: (np.inf, w) for f, w in fits.items()}, list(fits)
    for _ in range(steps):
        sums, y = [], F.col("target")
        scored = rows.select("fold", "target", *x, *[sum((float(w) * t for w, t in zip(now[f][1:], terms[1:])), F.lit(float(now[f][0]))).alias(f"z{k}") for k, f in enumerate(going)])
        # What a fit may not see weighs nothing: its chance, spread and loss are 0 there.
        mine = {k: F.lit(True) if f is None else F.col("fold") != f for k, f in enumerate(going)}
        parts = {k: (sigmoid(z) - y, sigmoid(z) * (1 - sigmoid(z)), F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z) for k in mine for z in [F.col(f"z{k}")]}
        scored = scored.select(*x, *[F.when(mine[k], v).otherwise(0.0).alias(f"{name}{k}") for k, vs in parts.items() for name, v in zip("rvl", vs)])
        for k in mine:
            each = [F.col(f"l{k}"), *[F.col(f"r{k}") * t for t in terms], *[F.col(f"v{k}") * terms[i] * terms[j] for i, j in pairs]]
            sums += [F.sum(v).alias(f"s{k}_{i}") for i, v in enumerate(each)]
        got, left = scored.agg(*sums).first(), []
        for k, f in enumerate(going):
            w = now[f]
            loss = got[f"s{k}_0"] + 0.5 * float(weight @ w**2)
            if loss > best[f][0] * (1 + 1e-13):
                now[f] = (w + best[f][1]) / 2
                left.append(f)
                continue
            best[f] = (loss, w)
            slope = np.array([got[f"s{k}_{1 + i}"] for i in range(len(terms))]) + weight * w
            curve = np.diag(weight)
            for m, (i, j) in enumerate(pairs):
                v = got[f"s{k}_{1 + len(terms) + m}"]
                curve[i, j] += v
                curve[j, i] += v if i != j else 0
            if np.abs(slope).max() > tolerance * n[f]:
                now[f] = w - np.linalg.solve(curve + 1e-12 * np.eye(len(terms)), slope)
                left.append(f)
        going = left
        if not going:
            break
    return {f: w for f, (_, w) in best.items()}


def stack_slopes(wide: DataFrame, models: list[str], coefficients: list[tuple], c: float = 1.0, eps: float = 1e-6, transform: str = "logit") -> DataFrame:
    """(held, steepest): the largest slope, for each row seen, of the penalised loss at a fit's coefficients; 0 at its minimum. held is null for the fit of all folds."""
    out = None
    for f, intercept, cs in coefficients:
        rows = apply_stack(wide, models, intercept, cs, eps, transform).drop("target").join(stack_inputs(wide, models, transform, eps).select("id1", "id2", "target", *[f"x_{m}" for m in models]), ["id1", "id2"])
        rows = rows if f is None else rows.where(F.col("fold") != f)
        off = F.col("predict") - F.col("target")
        slopes = [F.sum(off), *[F.sum(off * F.col(f"x_{m}")) + k / c for m, k in zip(models, cs)]]
        part = rows.agg((F.greatest(*[F.abs(v) for v in slopes]) / F.count("*")).alias("steepest")).select(F.lit(f).cast("int").alias("held"), "steepest")
        out = part if out is None else out.unionByName(part)
    return out


def weight_stability(spark: SparkSession, models: list[str], coefficients: list[tuple]) -> DataFrame:
    """(model, mean, std, share, final): a model's coefficient over the held-out fits, its part of their sum, and that of the fit on all folds."""
    held = [c for f, _, c in coefficients if f is not None]
    final = next((c for f, _, c in coefficients if f is None), [None] * len(models))
    means = [sum(c[i] for c in held) / len(held) for i in range(len(models))] if held else []
    stds = [(sum((c[i] - m) ** 2 for c in held) / len(held)) ** 0.5 for i, m in enumerate(means)]
    total = sum(means)
    return spark.createDataFrame([(m, x, y, x / total if total else None, z) for m, x, y, z in zip(models, means, stds, final)], "model string, mean double, std double, share double, final double")


def apply_stack(wide: DataFrame, models: list[str], intercept: float, coefficients: list[float], eps: float = 1e-6, transform: str = "logit") -> DataFrame:
    """wide plus predict = sigmoid(intercept + sum of c * input); ranks are those within the folds of wide."""
    rows = stack_inputs(wide, models, transform, eps)
    return rows.withColumn("predict", sigmoid(sum((c * F.col(f"x_{m}") for m, c in zip(models, coefficients)), F.lit(float(intercept))))).drop(*[f"x_{m}" for m in models])


def stack_features(features: DataFrame, nested: DataFrame, folds: list[int]) -> DataFrame:
    """features once for each held-out fold, plus the score column that did not see it: nested (held, id1, id2, predict)."""
    rows = features.select("*", F.explode(F.array(*[F.lit(f) for f in folds])).alias("held"))
    return rows.join(nested.select("held", "id1", "id2", F.col("predict").alias("nested_score")), ["held", "id1", "id2"], "left")


def route(scores: DataFrame, pairs: DataFrame, routes: DataFrame, default: float = 0.5) -> DataFrame:
    """(id1, id2, predict): routed categories mix their models' ranks, others all models' ranks; a missing model leaves the rest.

    routes (category, model, weight), a small configuration table.
    """
    ranked = ranks.rank_in_route(scores.join(pairs.select("id1", "id2", "category"), ["id1", "id2"]), ["model", "category"])
    routed = routes.select("category").distinct().withColumn("routed", F.lit(True))
    both = ranked.join(F.broadcast(routes), ["category", "model"], "left").join(F.broadcast(routed), "category", "left")
    w = F.when(F.col("routed"), F.col("weight")).otherwise(F.lit(1.0))
    mixed = both.where(w.isNotNull()).groupBy("id1", "id2").agg((F.sum(w * F.col("rank")) / F.sum(w)).alias("predict"))
    return pairs.select("id1", "id2").join(mixed, ["id1", "id2"], "left").select("id1", "id2", F.coalesce("predict", F.lit(default)).alias("predict"))


def work_plan(pairs: DataFrame, routes: DataFrame, models: list[str]) -> DataFrame:
    """(model, n_pairs, share): the pairs whose answer can depend on each model."""
    all_models = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    need = pairs.join(F.broadcast(routes.select("category").distinct().withColumn("routed", F.lit(True))), "category", "left").select("category", "routed", all_models)
    need = need.join(F.broadcast(routes.select("category", "model").distinct().withColumn("named", F.lit(True))), ["category", "model"], "left").where("named or routed is null")
    total = pairs.agg(F.count("*").alias("total"))
    return need.groupBy("model").agg(F.count("*").alias("n_pairs")).crossJoin(F.broadcast(total)).select("model", "n_pairs", (F.col("n_pairs") / F.col("total")).alias("share"))


def apply_penalty(scores: DataFrame, flags: DataFrame, factor: float = 0.25) -> DataFrame:
    """scores with predict times factor where flags (id1, id2, mismatch) hold."""
    joined = scores.join(flags.select("id1", "id2", "mismatch"), ["id1", "id2"], "left")
    return joined.withColumn("predict", F.when(F.coalesce("mismatch", F.lit(False)), F.col("predict") * factor).otherwise(F.col("predict"))).drop("mismatch")


def fill_default(scores: DataFrame, pairs: DataFrame, value: float = 0.5) -> DataFrame:
    """A score for every pair: value where there is none."""
    return pairs.select("id1", "id2").join(scores.select("id1", "id2", "predict"), ["id1", "id2"], "left").select("id1", "id2", F.coalesce("predict", F.lit(value)).alias("predict"))


def pooled(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The block of each of a row of (sum, count): adjacent blocks whose means do not rise are pooled."""
    heads, sums, counts = [], [], []
    for i, (t, n) in enumerate(zip(total.tolist(), count.tolist())):
        heads.append(i)
        sums.append(t)
        counts.append(n)
        while len(sums) > 1 and sums[-2] * counts[-1] >= sums[-1] * counts[-2]:
            t, n, _ = sums.pop(), counts.pop(), heads.pop()
            sums[-1] += t
            counts[-1] += n
    return np.repeat(np.arange(len(heads)), np.diff([*heads, len(total)]))


def isotonic_by_fold(df: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """df plus calibrated: the isotonic map of the fold's own scores to labels, clipped to low and high.

    Equal scores are one block from the start. Adjacent violators are pooled within each range of the score
    (metrics.score_range), all folds at once; a second pass pools the blocks that ranges have left, one row each. A
    pooled block stays pooled whatever comes beside it, so the result is that of one pass over all scores. A null or
    NaN score has no place in the order and gives null.
    """
    known = F.col("predict").isNotNull() & ~F.isnan("predict")
    blocks = df.where(known).groupBy("fold", "predict").agg(F.sum("target").cast("double").alias("t"), F.count("*").alias("n"))
    ranged = blocks.withColumn("part", metrics.score_range(F.col("predict")))

    def within(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("predict", kind="stable")
        return t.assign(block=pooled(t.t.to_numpy(), t.n.to_numpy()))

    def across(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["part", "block"], kind="stable")
        t["into"] = pooled(t.t.to_numpy(), t.n.to_numpy())
        sums = t.groupby("into")[["t", "n"]].transform("sum")
        return t[["fold", "part", "block"]].assign(calibrated=sums.t / sums.n)

    kind = df.schema["fold"].dataType.simpleString()
    placed = checkpointed(ranged.groupBy("fold", "part").applyInPandas(within, f"fold {kind}, predict double, t double, n long, part int, block long"))
    left = placed.groupBy("fold", "part", "block").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    value = left.groupBy("fold").applyInPandas(across, f"fold {kind}, part int, block long, calibrated double")
    mapped = placed.join(value, ["fold", "part", "block"]).select("fold", "predict", F.least(F.greatest("calibrated", F.lit(low)), F.lit(high)).alias("calibrated"))
    return df.join(mapped, ["fold", "predict"], "left").select(*df.columns, "calibrated")


#: Rows of a partition that trees are fitted on, at least.
TREE_ROWS = 25_000


def train_oof(features: DataFrame, columns: list[str], folds: list[int], weight: str | None = None, rounds: int = 15, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """Boosted trees, leave one fold out: (id1, id2, fold, target, predict) and (fold, feature, importance).

    Rows with train_only true are never scored. Importances of a fit sum to 1. A fit is a hundred short passes over the
    rows, so they are written once and read in partitions of TREE_ROWS rows or more, and the fits run side by side.
    """
    kept = ["id1", "id2", "fold", "target", *[c for c in (weight, "train_only") if c in features.columns]]
    rows = VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="keep").transform(features).select(*kept, "x", F.col("target").cast("double").alias("label"))
    rows = checkpointed(rows)
    rows = rows.coalesce(max(1, features.sparkSession.sparkContext.defaultParallelism // 2, rows.count() // TREE_ROWS)).persist()
    scored = ~F.coalesce(F.col("train_only"), F.lit(False)) if "train_only" in features.columns else F.lit(True)
    out, importances = None, []

    def fit(f: int):
        gbt = GBTClassifier(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7, **({"weightCol": weight} if weight else {}))
        return gbt.fit(rows.where(F.col("fold") != f))

    with ThreadPoolExecutor(max(1, len(folds))) as pool:
        models = list(pool.map(inheritable_thread_target(features.sparkSession)(fit), folds))
    for f, model in zip(folds, models):
        importances += [(f, c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
        part = model.transform(rows.where((F.col("fold") == f) & scored)).select("id1", "id2", "fold", "target", vector_to_array("probability")[1].alias("predict"))
        out = part if out is None else out.unionByName(part)
    rows.unpersist()
    return out, features.sparkSession.createDataFrame(importances, "fold int, feature string, importance double")


def score_batches(texts: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], partitions: int = 8) -> DataFrame:
    """(id1, id2, predict): batch inference over (id1, id2, text1, text2); pairs of like length share batches."""
    ordered = texts.withColumn("_len", F.length("text1") + F.length("text2")).repartitionByRange(partitions, "_len", "id1", "id2").sortWithinPartitions("_len", "id1", "id2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t[["id1", "id2"]].assign(predict=scorer(t.text1, t.text2).astype(float))

    return ordered.select("id1", "id2", "text1", "text2").mapInPandas(run, "id1 long, id2 long, predict double")


def step_table(scored: DataFrame, base: str, weight: float = 0.1) -> DataFrame:
    """(step, delta, spearman) of every model: what its rank adds to the base's macro AP at `weight`, and its mean rank correlation with the base by category.

    scored: model, category, id1, id2, target, predict; ranks are within a category.
    """
    ranked = ranks.rank_ordinal(scored.select("model", "category", "id1", "id2", "target", "predict"), ["model", "category"])
    first = ranked.where(F.col("model") == base).select("id1", "id2", F.col("rank").alias("base_rank"), F.col("predict").alias("base_predict"))
    both = ranked.join(first, ["id1", "id2"])
    mixed = both.withColumn("predict", F.round((1 - weight) * F.col("base_rank") + weight * F.col("rank"), 8))
    start = metrics.macro_ap(scored.where(F.col("model") == base), ["model"]).select(F.col("macro_ap").alias("start"))
    gain = metrics.macro_ap(mixed, ["model"]).crossJoin(F.broadcast(start)).select("model", (F.col("macro_ap") - F.col("start")).alias("delta"))
    near = ranks.spearman(both, ["model", "category"], "base_predict", "predict").groupBy("model").agg(F.avg("spearman").alias("spearman"))
    return gain.join(near, "model").withColumnRenamed("model", "step")


def select_step(df: DataFrame) -> DataFrame:
    """The row of the largest delta, ties to the earliest, from (step, position, delta, ...)."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct("delta", -F.col("position"))).alias("b")).select("b.*")
