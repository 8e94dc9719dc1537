"""Queries: sources and sinks, contracts, targets and weights, joins, sets and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import weights
from pairlab.operators import contracts, joins, metrics, ranks
from pairlab.plans.registry import ap_sql, big, query, r, rounded
from pairlab.sources import files

KEYED = "(SELECT id1, id2, predict FROM scores WHERE model = 'm1')"


def m1(t):
    return t.scores.where("model = 'm1'").select("id1", "id2", "predict")


@query("s1_scan_items", "SELECT category, COUNT(*) AS n_items FROM items GROUP BY category")
def _(t):
    path = files.write_texts(t.items.select("id", "name", "attributes", "category"), files.scratch(t.spark, "items"))
    return files.scan_items(t.spark, path, ["id", "category"]).groupBy("category").agg(F.count("*").alias("n_items"))


@query("s2_scan_needed_items", """SELECT i.id, i.name, i.category, m.n_missing FROM items i, (SELECT COUNT(*) AS n_missing FROM (SELECT id1 AS id FROM journal UNION SELECT id2 FROM journal) WHERE id NOT IN (SELECT id FROM items)) m
WHERE i.id IN (SELECT id1 FROM journal UNION SELECT id2 FROM journal)""")
def _(t):
    needed, missing = files.scan_needed_items(t.items.select("id", "name", "category"), t.journal)
    return needed.crossJoin(F.broadcast(missing.agg(F.count("*").alias("n_missing"))))  # one row


@query("s3_read_fold_targets", "SELECT concat('fold_', CAST(fold AS STRING)) AS fold, COUNT(*) AS n_pairs, CAST(SUM(target) AS BIGINT) AS positives FROM folded GROUP BY fold")
def _(t):
    path = files.write_folds(t.folded.select("fold", "id1", "id2", "target", "category"), files.scratch(t.spark, "folds"))
    return files.read_fold_files(t.spark, path, "target int").groupBy("fold").agg(F.count("*").alias("n_pairs"), F.sum("target").alias("positives"))


@query("s4_read_pairs_strict", "SELECT COUNT(*) AS n_rows, CAST(COUNT(DISTINCT id1) AS BIGINT) AS left_items FROM pairs")
def _(t):
    path = files.scratch(t.spark, "strict")
    t.pairs.select("id1", "id2", "target").write.option("header", True).csv(path)
    return files.read_strict(t.spark, path, "id1 long, id2 long, target int", ["id1", "id2"]).agg(F.count("*").alias("n_rows"), F.count_distinct("id1").alias("left_items"))


@query("s5_scan_journal", "SELECT mode, audited_label, COUNT(*) AS n FROM journal GROUP BY mode, audited_label")
def _(t):
    path = files.scratch(t.spark, "journal")
    t.journal.write.json(path)
    return files.scan_journal(t.spark, path).groupBy("mode", "audited_label").agg(F.count("*").alias("n"))


RESULTS = f"SELECT model AS experiment, fold, {big('n_rows', 'n_rows')}, {big('positives', 'positives')}, {r('ap', 'prauc')} FROM {ap_sql('scored', 'model, fold')}"


def results(t):
    each = metrics.average_precision(t.scored, ["model", "fold"])
    folds = F.collect_list(F.struct(F.col("fold").alias("id"), F.col("n_rows").alias("rows"), "positives", F.col("ap").alias("prauc")))
    return each.groupBy(F.col("model").alias("experiment")).agg(folds.alias("folds"), F.lit(2).alias("fold_spec_version"))


@query("s6_scan_results", f"SELECT experiment, COUNT(*) AS folds, {r('AVG(ap)', 'mean_prauc')} FROM (SELECT model AS experiment, ap FROM {ap_sql('scored', 'model, fold')}) GROUP BY experiment")
def _(t):
    path = files.scratch(t.spark, "results")
    results(t).write.json(path)
    found = files.explode_metrics(files.scan_results(t.spark, path, 2))
    return rounded(found.groupBy("experiment").agg(F.count("*").alias("folds"), F.avg("prauc").alias("mean_prauc")))


@query("s7_assemble_oof_matrix", """SELECT id1, id2, MAX(CASE WHEN model = 'm1' THEN predict END) AS m1, MAX(CASE WHEN model = 'm2' THEN predict END) AS m2,
MAX(CASE WHEN model = 'm3' THEN predict END) AS m3 FROM scored GROUP BY id1, id2""")
def _(t):
    return files.oof_matrix(t.scored, 4, ["m1", "m2", "m3"])


@query("s8_write_predictions", f"SELECT fold, id1, id2, {r('predict', 'predict')} FROM scored WHERE model = 'm1'")
def _(t):
    path = files.write_predictions(t.scored.where("model = 'm1'").select("fold", "id1", "id2", "predict"), files.scratch(t.spark, "predictions"))
    return rounded(t.spark.read.schema("id1 long, id2 long, predict double, fold long").option("header", True).csv(path)).select("fold", "id1", "id2", "predict")


@query("s9_write_pair_texts", "SELECT id, name, category FROM items")
def _(t):
    path = files.write_texts(t.items.select("id", "name", "category"), files.scratch(t.spark, "texts"))
    return t.spark.read.schema("id long, name string, category string").parquet(path)


@query("s10_explode_result_metrics", RESULTS)
def _(t):
    return rounded(files.explode_metrics(results(t)))


@query("s11_dataset_fingerprint", """SELECT fold, COUNT(*) AS n_rows,
CAST(SUM(('0x' || substr(sha256(concat(CAST(id1 AS STRING), ',', CAST(id2 AS STRING), ',', CAST(target AS STRING), ',', category)), 1, 8))::UBIGINT) AS BIGINT) AS fingerprint FROM folded GROUP BY fold""")
def _(t):
    rows = t.folded.select("fold", "id1", "id2", "target", "category")
    found = files.fingerprint(rows, ["fold"])
    files.require_fingerprint(rows.repartition(3), ["fold"], found)
    return found


@query("oc1_check_pairs", """SELECT COUNT(*) AS n_rows, CAST(COUNT_IF(id1 = id2) AS BIGINT) AS self_pairs, CAST(COUNT_IF(target NOT IN (0, 1)) AS BIGINT) AS bad_targets,
(SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) n FROM pairs GROUP BY id1, id2)) AS repeated_ordered,
(SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) n FROM pairs GROUP BY least(id1, id2), greatest(id1, id2))) AS repeated_unordered,
(SELECT COUNT(*) FROM (SELECT 1 FROM pairs GROUP BY least(id1, id2), greatest(id1, id2) HAVING COUNT(DISTINCT target) > 1)) AS conflicting FROM pairs""")
def _(t):
    return contracts.check_pairs(t.pairs)


@query("oc2_check_item_coverage", """SELECT COUNT(*) AS n_pairs, CAST(COUNT_IF(a.id IS NULL) AS BIGINT) AS missing1, CAST(COUNT_IF(b.id IS NULL) AS BIGINT) AS missing2,
CAST(COUNT_IF(a.category <> b.category) AS BIGINT) AS across FROM journal p LEFT JOIN items a ON p.id1 = a.id LEFT JOIN items b ON p.id2 = b.id""")
def _(t):
    return contracts.check_coverage(t.journal, t.items)


@query("oc3_check_universe_disjoint", """SELECT (SELECT COUNT(*) FROM (SELECT id1 FROM pairs UNION SELECT id2 FROM pairs)) AS items_a, (SELECT COUNT(*) FROM (SELECT id1 FROM journal UNION SELECT id2 FROM journal)) AS items_b,
(SELECT COUNT(*) FROM ((SELECT id1 FROM pairs UNION SELECT id2 FROM pairs) INTERSECT (SELECT id1 FROM journal UNION SELECT id2 FROM journal))) AS shared""")
def _(t):
    return contracts.check_disjoint(t.pairs, t.journal)


@query("oc4_check_fold_partition", """SELECT (SELECT COUNT(*) FROM (SELECT id FROM u GROUP BY id)) AS n_items, (SELECT COUNT(*) FROM (SELECT id FROM u GROUP BY id HAVING COUNT(DISTINCT fold) > 1)) AS split_items,
COUNT(*) AS n_pairs, CAST(0 AS BIGINT) AS split_pairs FROM folded""".replace("FROM u", "FROM (SELECT id1 AS id, fold FROM folded UNION ALL SELECT id2, fold FROM folded) u"))
def _(t):
    return contracts.check_folds(t.folded)


@query("oc5_check_key_alignment", f"""SELECT CAST(COUNT_IF(p.id1 IS NOT NULL AND q.id1 IS NOT NULL) AS BIGINT) AS matched, CAST(COUNT_IF(q.id1 IS NULL) AS BIGINT) AS only_pred,
CAST(COUNT_IF(p.id1 IS NULL) AS BIGINT) AS only_target, CAST(0 AS BIGINT) AS repeated_pred, CAST(0 AS BIGINT) AS repeated_target
FROM (SELECT * FROM {KEYED} WHERE predict < 0.9) p FULL OUTER JOIN (SELECT * FROM pairs WHERE id1 % 7 <> 0) q ON p.id1 = q.id1 AND p.id2 = q.id2""")
def _(t):
    return contracts.check_alignment(m1(t).where("predict < 0.9"), t.pairs.where("id1 % 7 <> 0"))


@query("oc6_check_submission", """SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS not_finite, CAST(COUNT_IF(2 * predict - 0.5 < 0 OR 2 * predict - 0.5 > 1) AS BIGINT) AS out_of_range,
(SELECT CAST(SUM(n - 1) AS BIGINT) FROM (SELECT COUNT(*) n FROM scores GROUP BY id1, id2)) AS repeated FROM scores""")
def _(t):
    return contracts.check_submission(t.scores.withColumn("predict", 2 * F.col("predict") - 0.5))


@query("oc7_compare_tables", """SELECT * FROM (SELECT '(key)' AS "column", CAST(COUNT_IF(b.id IS NULL OR a.id IS NULL) AS BIGINT) AS mismatches FROM items a FULL OUTER JOIN (SELECT * FROM items WHERE id % 9 <> 0) b ON a.id = b.id
UNION ALL SELECT 'name', CAST(COUNT_IF(a.id % 5 = 0) AS BIGINT) FROM items a WHERE a.id % 9 <> 0 UNION ALL SELECT 'category', CAST(0 AS BIGINT))""")
def _(t):
    a = t.items.select("id", "name", "category")
    b = a.where("id % 9 <> 0").withColumn("name", F.when(F.col("id") % 5 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return contracts.compare_tables(a, b, ["id"])


SIDE = "SELECT model, id1, id2, target, predict FROM scored"


@query("op_p1_binarize_weak_label", "SELECT id1, id2, model, CAST(predict >= 0.5 AS INT) AS label FROM scored")
def _(t):
    return t.scored.select("id1", "id2", "model", weights.binarize(F.col("predict")).alias("label"))


@query("op_p2_soft_target", f"SELECT id1, id2, model, {r('0.7 * predict + 0.3 * target', 'soft')} FROM scored")
def _(t):
    return rounded(t.scored.select("id1", "id2", "model", weights.soft_target(F.col("predict"), F.col("target")).alias("soft")))


@query("op_p3_remix_soft_target", f"SELECT id1, id2, model, {r('0.3 * target + 0.6 * predict + 0.1 * (1 - predict)', 'remixed')} FROM scored")
def _(t):
    soft = 0.3 * F.col("target") + 0.7 * F.col("predict")
    return rounded(t.scored.select("id1", "id2", "model", weights.remix_target(soft, F.col("target"), 1 - F.col("predict")).alias("remixed")))


@query("op_p4_clip_confidence", f"SELECT id1, id2, model, {r('CASE WHEN predict < 0.05 THEN 0 WHEN predict > 0.95 THEN 1 ELSE predict END', 'clipped')} FROM scored")
def _(t):
    return rounded(t.scored.select("id1", "id2", "model", weights.clip_confidence(F.col("predict")).alias("clipped")))


@query("op_p5_error_weight", f"SELECT p.id1, p.id2, {r('1 + 2 * COALESCE(ABS(p.target - s.predict), 0)', 'weight')} FROM pairs p LEFT JOIN (SELECT * FROM {KEYED} WHERE predict < 0.7) s ON p.id1 = s.id1 AND p.id2 = s.id2")
def _(t):
    return rounded(weights.error_weight(t.pairs, m1(t).where("predict < 0.7"), 2.0).select("id1", "id2", "weight"))


@query("op_p6_category_balance_weight", f"""SELECT p.id1, p.id2, {r('w.weight', 'weight')} FROM folded p LEFT JOIN (SELECT category, SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)) AS weight FROM folded WHERE fold <> 1 GROUP BY category) w ON p.category = w.category""")
def _(t):
    return rounded(weights.category_weight(t.folded, F.col("fold") != 1).select("id1", "id2", "weight"))


PRIORS = "(SELECT DISTINCT category, 0.1 + 0.05 * (length(category) % 5) AS prior FROM pairs)"


@query("op_p7_prior_shift_weight", f"""SELECT category, {r('SUM(weight)', 'total')}, {r('MAX(weight)', 'most')} FROM (SELECT p.category, CASE WHEN target = 1 THEN prior / rate ELSE (1 - prior) / (1 - rate) END AS weight
FROM (SELECT *, AVG(target) OVER (PARTITION BY category) AS rate FROM pairs) p JOIN {PRIORS} q ON p.category = q.category) GROUP BY category""")
def _(t):
    priors = t.pairs.select("category").distinct().withColumn("prior", 0.1 + 0.05 * (F.length("category") % 5))
    return rounded(weights.prior_weight(t.pairs, priors).groupBy("category").agg(F.sum("weight").alias("total"), F.max("weight").alias("most")))


@query("op_p8_symmetrize_pairs", "SELECT id1, id2, target FROM pairs UNION ALL SELECT id2, id1, target FROM pairs")
def _(t):
    return weights.symmetrize(t.pairs).select("id1", "id2", "target")


@query("j1_attach_items", "SELECT p.id1, p.id2, p.target, a.name AS name1, b.name AS name2, a.category AS category1 FROM pairs p LEFT JOIN items a ON p.id1 = a.id LEFT JOIN items b ON p.id2 = b.id")
def _(t):
    return joins.attach_items(t.pairs, t.items, ["name", "category"]).select("id1", "id2", "target", "name1", "name2", "category1")


@query("j2_filter_items_semi", "SELECT id FROM items WHERE id IN (SELECT id1 FROM journal UNION SELECT id2 FROM journal)")
def _(t):
    return joins.needed_items(t.items, t.journal).select("id")


@query("j3_drop_missing_sides", "SELECT p.id1, p.id2, a.name AS name1, b.name AS name2, COUNT(*) AS n FROM journal p JOIN items a ON p.id1 = a.id JOIN items b ON p.id2 = b.id GROUP BY ALL")
def _(t):
    return joins.attach_items(t.journal, t.items, ["name"], drop_missing=True).groupBy("id1", "id2", "name1", "name2").agg(F.count("*").alias("n"))


@query("j4_join_oof_1to1", f"SELECT p.id1, p.id2, p.target, s.predict FROM pairs p LEFT JOIN {KEYED} s ON p.id1 = s.id1 AND p.id2 = s.id2")
def _(t):
    return joins.join_scores(t.pairs, m1(t)).select("id1", "id2", "target", "predict")


LATEST = "(SELECT id1, id2, arg_max(audited_label, judged_at) AS audited_label, arg_max(mode, judged_at) AS mode, MAX(judged_at) AS judged_at FROM verdicts GROUP BY id1, id2)"


@query("j5_join_corrections", f"SELECT p.id1, p.id2, CAST(COALESCE(CASE WHEN v.audited_label >= 0 THEN v.audited_label END, p.target) AS INT) AS target FROM pairs p LEFT JOIN {LATEST} v ON p.id1 = v.id1 AND p.id2 = v.id2")
def _(t):
    return joins.apply_corrections(t.pairs, t.verdicts).select("id1", "id2", "target")


@query("j9_vocabulary_lookup", """SELECT w.token, COALESCE(v.code, 0) AS code, COUNT(*) AS n FROM (SELECT unnest(string_split(name, ' ')) AS token FROM items) w
LEFT JOIN (SELECT token, row_number() OVER (ORDER BY token) AS code FROM (SELECT DISTINCT unnest(string_split(name, ' ')) AS token FROM items WHERE id % 3 = 0)) v ON w.token = v.token GROUP BY w.token, v.code""")
def _(t):
    tokens = t.items.select("id", F.explode(F.split("name", " ")).alias("token"))
    vocab = ranks.global_position(tokens.where("id % 3 = 0").select("token").distinct(), ["token"]).select("token", (F.col("position") + 1).alias("code"))
    return joins.lookup_tokens(tokens, vocab).groupBy("token", "code").agg(F.count("*").alias("n"))


@query("j10_multi_rank_inner", f"SELECT id1, id2, {r('AVG(predict)', 'mean')} FROM scores WHERE (id1 + length(model)) % 5 <> 0 AND NOT (model = 'm2' AND id2 % 4 = 0) GROUP BY id1, id2 HAVING COUNT(*) = 3")
def _(t):
    part = t.scores.where("(id1 + length(model)) % 5 <> 0 and not (model = 'm2' and id2 % 4 = 0)")
    return rounded(joins.intersect_scores(part, 3).groupBy("id1", "id2").agg(F.avg("predict").alias("mean")))


@query("w1_rank_ordinal", f"SELECT model, id1, id2, {r('(row_number() OVER (PARTITION BY model, category ORDER BY predict, id1, id2) - 1) / greatest(COUNT(*) OVER (PARTITION BY model, category) - 1, 1)', 'rank')} FROM scored")
def _(t):
    return rounded(ranks.rank_ordinal(t.scored, ["model", "category"]).select("model", "id1", "id2", "rank"))


@query("w2_rank_average_pct", f"SELECT model, id1, id2, {r('(rank() OVER (PARTITION BY model, category ORDER BY predict) + (COUNT(*) OVER (PARTITION BY model, category, predict) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY model, category)', 'rank')} FROM scored")
def _(t):
    return rounded(ranks.rank_average_pct(t.scored, ["model", "category"]).select("model", "id1", "id2", "rank"))


@query("w3_rank_midpoint", f"SELECT model, id1, id2, {r('(row_number() OVER (PARTITION BY model, category ORDER BY predict, id1, id2) - 0.5) / COUNT(*) OVER (PARTITION BY model, category)', 'rank')} FROM scored")
def _(t):
    return rounded(ranks.rank_midpoint(t.scored, ["model", "category"]).select("model", "id1", "id2", "rank"))


@query("w4_rank_in_route", f"SELECT model, id1, id2, {r('row_number() OVER (PARTITION BY model, category ORDER BY predict, id1, id2) / COUNT(*) OVER (PARTITION BY model, category)', 'rank')} FROM scored")
def _(t):
    return rounded(ranks.rank_in_route(t.scored, ["model", "category"]).select("model", "id1", "id2", "rank"))


@query("w5_latest_per_key", "SELECT id1, id2, arg_max(audited_label, judged_at) AS audited_label, MAX(judged_at) AS judged_at FROM journal GROUP BY id1, id2")
def _(t):
    return ranks.latest_per_key(t.journal, ["id1", "id2"], "judged_at").select("id1", "id2", "audited_label", "judged_at")


@query("w6_block_cumulative", f"SELECT model, predict, {big('SUM(tp) OVER w', 'ctp')}, {big('SUM(n) OVER w', 'cn')} FROM (SELECT model, predict, SUM(target) AS tp, COUNT(*) AS n FROM scored GROUP BY model, predict) WINDOW w AS (PARTITION BY model ORDER BY predict DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("model").orderBy(F.desc("predict")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return metrics.score_blocks(t.scored, ["model"]).select("model", "predict", F.sum("tp").over(w).alias("ctp"), F.sum("n").over(w).alias("cn"))


@query("w8_row_index", "SELECT id1, id2, CAST(row_number() OVER (ORDER BY id1, id2) - 1 AS BIGINT) AS position FROM pairs")
def _(t):
    return ranks.global_position(t.pairs.select("id1", "id2"), ["id1", "id2"])


@query("k1_canonical_order", "SELECT id1, id2, target, category FROM pairs ORDER BY id1, id2")
def _(t):
    return ranks.canonical_order(t.pairs.select("id1", "id2", "target", "category"))


@query("k2_top_k_errors", "(SELECT id1, id2, target, predict FROM scored WHERE model = 'm1' AND target = 1 ORDER BY predict, id1, id2 LIMIT 20) UNION ALL (SELECT id1, id2, target, predict FROM scored WHERE model = 'm1' AND target = 0 ORDER BY predict DESC, id1, id2 LIMIT 20)".join(("SELECT * FROM (", ")")))
def _(t):
    one = t.scored.where("model = 'm1'").select("id1", "id2", "target", "predict")
    return ranks.top_errors(one, 20, True).unionByName(ranks.top_errors(one, 20, False))


WIDE = "(SELECT id1, id2, MAX(CASE WHEN model = 'm1' THEN predict END) AS m1, MAX(CASE WHEN model = 'm2' THEN predict END) AS m2, MAX(CASE WHEN model = 'm3' THEN predict END) AS m3 FROM scored GROUP BY id1, id2)"


@query("k3_top_disagreement", f"SELECT * FROM ((SELECT id1, id2, {r('m1 - m2', 'gap')}, 'first' AS direction FROM {WIDE} ORDER BY m1 - m2 DESC, id1, id2 LIMIT 15) UNION ALL (SELECT id1, id2, {r('m1 - m2', 'gap')}, 'second' FROM {WIDE} ORDER BY m1 - m2, id1, id2 LIMIT 15))")
def _(t):
    wide = files.oof_matrix(t.scored, 4, ["m1", "m2", "m3"])
    return rounded(ranks.top_disagreement(wide, "m1", "m2", 15).select("id1", "id2", "gap", "direction"))


@query("u1_union_pairs", "SELECT source, COUNT(*) AS n FROM (SELECT 'hand' AS source FROM pairs UNION ALL SELECT 'journal' FROM journal) GROUP BY source")
def _(t):
    keys = ["id1", "id2"]
    return ranks.union_pairs({"hand": t.pairs.select(keys), "journal": t.journal.select(keys)}).groupBy("source").agg(F.count("*").alias("n"))


@query("u2_distinct_items", "SELECT id1 AS id FROM pairs UNION SELECT id2 FROM pairs")
def _(t):
    return contracts.item_ids(t.pairs)


@query("u3_id_overlap", """SELECT 'both' AS part, COUNT(*) AS n FROM (SELECT id FROM items INTERSECT SELECT id1 FROM journal) UNION ALL SELECT 'only_a', COUNT(*) FROM (SELECT id FROM items EXCEPT SELECT id1 FROM journal)
UNION ALL SELECT 'only_b', COUNT(*) FROM (SELECT id1 FROM journal EXCEPT SELECT id FROM items)""")
def _(t):
    return ranks.id_overlap(t.items.select("id"), t.journal.select(F.col("id1").alias("id")))
