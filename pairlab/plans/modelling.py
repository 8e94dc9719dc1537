"""Queries: graph, splits, blends, models, audit, resampling and the journal stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.operators import audit, blend, features, graph, metrics, resample, splits
from pairlab.operators.components import checkpointed, connected_components
from pairlab.plans.basics import LATEST, WIDE
from pairlab.plans.registry import ap_sql, big, query, r, rounded
from pairlab.sources import files
from pairlab.streaming import journal as stream

MODELS, FOLDS = ["m1", "m2", "m3"], [0, 1, 2, 3]


def components_sql(where: str = "TRUE", pairs: str = "pairs") -> str:
    """Recursive parts e and r of the components over pairs that hold `where`."""
    return f"""WITH RECURSIVE e AS (SELECT id1 s, id2 d FROM {pairs} WHERE {where} UNION SELECT id2, id1 FROM {pairs} WHERE {where}),
r(node, lab) AS (SELECT s, s FROM e UNION SELECT e.d, r.lab FROM r JOIN e ON r.node = e.s WHERE r.lab < e.d), comp AS (SELECT node AS id, MIN(lab) AS component FROM r GROUP BY node)"""


POS = components_sql("target = 1").replace("comp AS (", "c0 AS (") + ", comp AS (SELECT u.id, COALESCE(c0.component, u.id) AS component FROM (SELECT id1 AS id FROM pairs UNION SELECT id2 FROM pairs) u LEFT JOIN c0 ON u.id = c0.id)"
EDGES = "(SELECT p.*, a.component AS c1, b.component AS c2 FROM folded p JOIN comp a ON p.id1 = a.id JOIN comp b ON p.id2 = b.id)"


def wide(t, k=4):
    return t.folded.join(files.oof_matrix(t.scored, k, MODELS), ["id1", "id2"])


WIDEF = f"(SELECT f.*, w.m1, w.m2, w.m3 FROM folded f JOIN {WIDE} w ON f.id1 = w.id1 AND f.id2 = w.id2)"


@query("g1_connected_components", components_sql() + " SELECT id, component FROM comp")
def _(t):
    return connected_components(t.pairs)


@query("g2_positive_components", POS + " SELECT id, component FROM comp")
def _(t):
    return graph.positive_components(t.pairs)


@query("g3_component_stats", components_sql() + f""" SELECT n.component, n.nodes, COALESCE(e.edges, 0) AS edges, CAST(COALESCE(e.edges, 0) - n.nodes + 1 AS BIGINT) AS cyclomatic, {r('e.rate', 'positive_rate')} FROM (SELECT component, COUNT(*) AS nodes FROM comp GROUP BY component) n
LEFT JOIN (SELECT c1, COUNT(*) AS edges, AVG(target) AS rate FROM {EDGES} WHERE c1 = c2 GROUP BY c1) e ON n.component = e.c1""")
def _(t):
    return rounded(graph.component_stats(t.pairs, connected_components(t.pairs)))


@query("g3_component_sizes", components_sql() + f""" SELECT nodes, COUNT(*) AS components, {r('AVG(rate)', 'positive_rate')} FROM (SELECT component, COUNT(*) AS nodes FROM comp GROUP BY component) n LEFT JOIN (SELECT c1, AVG(target) AS rate FROM {EDGES} WHERE c1 = c2 GROUP BY c1) e ON n.component = e.c1 GROUP BY nodes""")
def _(t):
    return rounded(graph.size_histogram(graph.component_stats(t.pairs, connected_components(t.pairs))))


@query("g4_contradictions", POS + f" SELECT id1, id2, c1 AS component FROM {EDGES} WHERE target = 0 AND c1 = c2")
def _(t):
    return graph.contradictions(t.pairs, graph.positive_components(t.pairs))


CLOSURE = POS + f""", ed AS (SELECT * FROM {EDGES}), clean AS (SELECT component, COUNT(*) AS size FROM comp WHERE component NOT IN (SELECT c1 FROM ed WHERE target = 0 AND c1 = c2) GROUP BY component),
fo AS (SELECT id, MIN(fold) AS fold FROM (SELECT id1 AS id, fold FROM folded UNION ALL SELECT id2, fold FROM folded) GROUP BY id), mem AS (SELECT c.id, c.component, k.size, f.fold FROM comp c JOIN clean k ON c.component = k.component JOIN fo f ON c.id = f.id),
cand AS (SELECT a.id AS id1, b.id AS id2, 1 AS target, a.fold FROM mem a JOIN mem b ON a.component = b.component AND a.id < b.id AND a.fold = b.fold WHERE a.size >= 3
UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id), 0, a.fold FROM (SELECT DISTINCT least(c1, c2) AS c1, greatest(c1, c2) AS c2 FROM ed WHERE target = 0 AND c1 <> c2) x JOIN mem a ON a.component = x.c1 JOIN mem b ON b.component = x.c2 AND a.fold = b.fold),
derived AS (SELECT id1, id2, MAX(target) AS target, MIN(fold) AS fold FROM cand c WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE least(p.id1, p.id2) = c.id1 AND greatest(p.id1, p.id2) = c.id2) GROUP BY id1, id2)"""


@query("g5_transitive_closure_pairs", CLOSURE + " SELECT id1, id2, CAST(target AS INT) AS target, fold FROM derived")
def _(t):
    return graph.closure_pairs(t.folded)


LABELLED = ", lab AS (SELECT least(c1, c2) AS c1, greatest(c1, c2) AS c2, COUNT(*) AS labelled, COUNT_IF(neg > 0) AS negative FROM (SELECT least(id1, id2) AS a, greatest(id1, id2) AS b, MIN(c1) AS c1, MIN(c2) AS c2, COUNT_IF(target = 0) AS neg FROM ed WHERE id1 <> id2 GROUP BY a, b) GROUP BY 1, 2), cf AS (SELECT DISTINCT component, fold FROM mem)"


@query("g5_closure_classes", CLOSURE + LABELLED + f""" SELECT k.component, cf.fold, k.size, {big('COALESCE(l.labelled, 0)', 'labelled')}, {big('(SELECT COUNT(*) FROM derived d JOIN comp c ON d.id1 = c.id JOIN comp e ON d.id2 = e.id WHERE d.target = 1 AND c.component = k.component AND e.component = k.component)', 'derived')}
FROM clean k JOIN cf ON k.component = cf.component LEFT JOIN lab l ON l.c1 = k.component AND l.c2 = k.component""")
def _(t):
    return graph.closure_classes(t.folded)[1]


@query("g5_closure_links", CLOSURE + LABELLED + f""", found AS (SELECT least(c.component, e.component) AS c1, greatest(c.component, e.component) AS c2, COUNT(*) AS derived FROM derived d JOIN comp c ON d.id1 = c.id JOIN comp e ON d.id2 = e.id WHERE d.target = 0 GROUP BY 1, 2)
SELECT l.c1, l.c2, f.fold, {big('l.labelled', 'labelled')}, {big('COALESCE(x.derived, 0)', 'derived')} FROM lab l JOIN cf f ON f.component = l.c1 JOIN cf g ON g.component = l.c2 LEFT JOIN found x ON x.c1 = l.c1 AND x.c2 = l.c2 WHERE l.c1 <> l.c2 AND l.negative > 0""")
def _(t):
    return graph.closure_classes(t.folded)[2]


CHAINS = CLOSURE + """, walk(src, node, path, n) AS (SELECT DISTINCT id1, id1, [id1], 0 FROM derived WHERE target = 1 UNION ALL SELECT w.src, q.d, list_append(w.path, q.d), w.n + 1 FROM walk w JOIN (SELECT id1 AS s, id2 AS d FROM pairs WHERE target = 1 UNION SELECT id2, id1 FROM pairs WHERE target = 1) q ON w.node = q.s WHERE NOT list_contains(w.path, q.d) AND w.n < 8),
best AS (SELECT d.id1, d.id2, MIN({'n': w.n, 'path': w.path}) AS b FROM derived d JOIN walk w ON d.id1 = w.src AND d.id2 = w.node WHERE d.target = 1 GROUP BY d.id1, d.id2)"""


def chains(t):
    return graph.shortest_chains(t.pairs, graph.closure_pairs(t.folded).where("target = 1"))


@query("g6_shortest_chain", CHAINS + f" SELECT id1, id2, array_to_string(b.path, '>') AS path, {big('b.n', 'steps')} FROM best")
def _(t):
    return chains(t).select("id1", "id2", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "steps")


@query("g7_closure_queue", CHAINS + f" SELECT d.id1, d.id2, {r('((d.id1 * 13 + d.id2 * 7) % 100) / 100.0', 'predict')}, CAST(k.size AS BIGINT) AS size, {big('best.b.n', 'steps')} FROM derived d LEFT JOIN best ON d.id1 = best.id1 AND d.id2 = best.id2 JOIN comp c ON d.id1 = c.id JOIN clean k ON c.component = k.component WHERE d.target = 1 AND (d.id1 + d.id2) % 11 <> 0")
def _(t):
    derived = graph.closure_pairs(t.folded)
    scores = derived.select("id1", "id2", (((F.col("id1") * 13 + F.col("id2") * 7) % 100) / 100).alias("predict"))
    judged = derived.where("(id1 + id2) % 11 = 0").select("id1", "id2")
    return rounded(graph.closure_queue(derived, chains(t), scores, judged, graph.positive_components(t.pairs)))


@query("g8_weakest_link", CHAINS + f""", link AS (SELECT id1, id2, unnest(range(1, len(b.path))) AS i, b.path AS path FROM best), sc AS (SELECT l.id1, l.id2, least(l.path[i], l.path[i + 1]) AS a, greatest(l.path[i], l.path[i + 1]) AS b FROM link l)
SELECT id1, id2, m.a AS a, m.b AS b, {r('m.p', 'predict')}, m.p < 0.5 AS weak FROM (SELECT sc.id1, sc.id2, MIN({{'p': s.predict, 'a': sc.a, 'b': sc.b}}) AS m FROM sc JOIN scores s ON s.model = 'm1' AND s.id1 = sc.a AND s.id2 = sc.b GROUP BY sc.id1, sc.id2)""")
def _(t):
    return rounded(graph.weakest_link(chains(t), t.scores.where("model = 'm1'")))


NB = "(SELECT id1 AS a, id2 AS b FROM pairs UNION SELECT id2, id1 FROM pairs)"
DEG = f"(SELECT a, COUNT(*) AS d FROM {NB} GROUP BY a)"


@query("g9_link_features", f"""SELECT p.id1, p.id2, {big('least(x.d, y.d)', 'deg_min')}, {big('greatest(x.d, y.d)', 'deg_max')}, {r('ln(1 + x.d * y.d)', 'log_product')}, {big('COALESCE(c.n, 0)', 'common')}, {r('COALESCE(c.n, 0) / (x.d + y.d - COALESCE(c.n, 0))', 'jaccard')}, {r('COALESCE(c.aa, 0)', 'adamic_adar')}
FROM pairs p JOIN {DEG} x ON p.id1 = x.a JOIN {DEG} y ON p.id2 = y.a LEFT JOIN (SELECT q.id1, q.id2, COUNT(*) AS n, SUM(1 / ln(greatest(z.d, 2))) AS aa FROM pairs q JOIN {NB} u ON q.id1 = u.a JOIN {NB} v ON q.id2 = v.a AND u.b = v.b JOIN {DEG} z ON u.b = z.a GROUP BY q.id1, q.id2) c ON p.id1 = c.id1 AND p.id2 = c.id2""")
def _(t):
    return rounded(graph.link_features(t.pairs))


ENDS = "(SELECT id1, id2, predict, id1 AS node FROM scores WHERE model = 'm1' UNION ALL SELECT id1, id2, predict, id2 FROM scores WHERE model = 'm1')"
LOO = f"""(SELECT id1, id2, MIN(mean) AS mean_lo, MAX(mean) AS mean_hi, MIN(most) AS max_lo, MAX(most) AS max_hi FROM (SELECT a.id1, a.id2, AVG(b.predict) AS mean, MAX(b.predict) AS most FROM {ENDS} a LEFT JOIN {ENDS} b ON a.node = b.node AND (a.id1 <> b.id1 OR a.id2 <> b.id2) GROUP BY a.id1, a.id2, a.node) GROUP BY id1, id2)"""


def loo(t):
    m1 = t.scores.where("model = 'm1'").select("id1", "id2", "predict")
    return m1, graph.leave_one_out(m1, connected_components(t.pairs))


@query("g10_leave_one_out_scores", components_sql() + f""", s AS (SELECT x.id1, x.id2, x.predict, c.component FROM scores x JOIN comp c ON x.id1 = c.id WHERE x.model = 'm1'), q AS (SELECT id1, id2, predict, (SUM(predict) OVER w - predict) / nullif(COUNT(*) OVER w - 1, 0) AS comp_mean FROM s WINDOW w AS (PARTITION BY component))
SELECT l.id1, l.id2, {', '.join(r(f'l.{c}', c) for c in ('mean_lo', 'mean_hi', 'max_lo', 'max_hi'))}, {r('q.comp_mean', 'comp_mean')}, {r('q.predict - (l.mean_lo + l.mean_hi) / 2', 'gap')} FROM {LOO} l JOIN q ON l.id1 = q.id1 AND l.id2 = q.id2""")
def _(t):
    return rounded(loo(t)[1])


@query("g11_one_step_diffusion", f"""WITH x AS (SELECT s.id1, s.id2, p.category, s.predict, ROUND(l.mean_hi, 9) AS mean_hi FROM scores s JOIN {LOO} l ON s.id1 = l.id1 AND s.id2 = l.id2 JOIN pairs p ON s.id1 = p.id1 AND s.id2 = p.id2 WHERE s.model = 'm1'),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY predict, id1, id2) - 1 AS DOUBLE) / greatest(COUNT(*) OVER (PARTITION BY category) - 1, 1) AS r, CAST(row_number() OVER (PARTITION BY category ORDER BY mean_hi NULLS FIRST, id1, id2) - 1 AS DOUBLE) / greatest(COUNT(*) OVER (PARTITION BY category) - 1, 1) AS o FROM x)
SELECT id1, id2, {r('CASE WHEN mean_hi IS NULL THEN r ELSE 0.8 * r + 0.2 * o END', 'diffused')} FROM k""")
def _(t):
    m1, features_ = loo(t)
    rows = m1.join(features_.select("id1", "id2", "mean_hi"), ["id1", "id2"]).join(t.pairs.select("id1", "id2", "category"), ["id1", "id2"])
    return rounded(graph.diffuse(rows.withColumn("mean_hi", F.round("mean_hi", 9)), 0.2).select("id1", "id2", "diffused"))


@query("g12_chain_summary", CLOSURE + " SELECT COUNT(*) AS judged, CAST(COUNT_IF((id1 + id2) % 3 <> 0) AS BIGINT) AS confirmed, CAST(COUNT_IF((id1 + id2) % 3 = 0) AS BIGINT) AS broken FROM derived WHERE target = 1 AND id1 % 2 = 0")
def _(t):
    derived = graph.closure_pairs(t.folded)
    judged = derived.where("id1 % 2 = 0").select("id1", "id2", F.when((F.col("id1") + F.col("id2")) % 3 == 0, 0).otherwise(1).alias("audited_label"))
    return graph.chain_summary(derived, judged)


def draw_sql(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::UBIGINT AS BIGINT)"


def hash_sql(key: str, seed: str, k: int) -> str:
    return f"CAST(('0x' || substr(sha256(concat('{seed}:', CAST({key} AS STRING))), 1, 16))::UBIGINT % {k} AS INT)"


@query("p1_hash_fold", components_sql() + f" SELECT id, component, {hash_sql('component', 's', 4)} AS fold FROM comp")
def _(t):
    return connected_components(t.pairs).withColumn("fold", splits.hash_fold(F.col("component"), "s", 4))


FOLDING = components_sql() + """, each AS (SELECT c.component, p.category, COUNT(*) AS n, SUM(p.target) AS t FROM pairs p JOIN comp c ON p.id1 = c.id GROUP BY 1, 2),
load AS (SELECT component, arg_min(category, {'less': -n, 'category': category}) AS category, SUM(n) AS n, SUM(t) AS t FROM each GROUP BY component),
seq AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, sha256(concat('s:', CAST(component AS STRING)))) AS k, SUM(n) OVER (PARTITION BY category) / 4.0 AS sn, greatest(SUM(t) OVER (PARTITION BY category) / 4.0, 1.0) AS st FROM load),
deal(category, k, component, f, p, q) AS (SELECT category, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), [0.0, 0.0, 0.0, 0.0]::DOUBLE[], [0.0, 0.0, 0.0, 0.0]::DOUBLE[] FROM (SELECT DISTINCT category FROM seq)
UNION ALL SELECT category, k, component, f, list_transform(range(1, 5), lambda i: p[i] + CASE WHEN i = f THEN n ELSE 0 END)::DOUBLE[], list_transform(range(1, 5), lambda i: q[i] + CASE WHEN i = f THEN t ELSE 0 END)::DOUBLE[]
FROM (SELECT *, CAST(list_position(w, list_min(w)) AS BIGINT) AS f FROM (SELECT s.category, s.k, s.component, CAST(s.n AS DOUBLE) AS n, CAST(s.t AS DOUBLE) AS t, d.p, d.q, list_transform(range(1, 5), lambda i: greatest((d.p[i] + s.n) / s.sn, (d.q[i] + s.t) / s.st)) AS w FROM deal d JOIN seq s ON s.category = d.category AND s.k = d.k + 1)))"""


@query("p2_stratified_fold", FOLDING + " SELECT category, component, CAST(f - 1 AS INT) AS fold FROM deal WHERE k > 0")
def _(t):
    return splits.stratified_fold(splits.component_loads(t.pairs, connected_components(t.pairs)), "s", 4)


@query("p3_build_folds", components_sql() + f" SELECT p.id1, p.id2, c.component, {hash_sql('c.component', 's', 4)} AS fold FROM pairs p JOIN comp c ON p.id1 = c.id")
def _(t):
    return splits.build_folds(t.pairs, "s", 4, stratified=False).select("id1", "id2", "component", "fold")


@query("p3_build_stratified_folds", FOLDING + " SELECT p.id1, p.id2, c.component, CAST(d.f - 1 AS INT) AS fold FROM pairs p JOIN comp c ON p.id1 = c.id JOIN deal d ON d.component = c.component")
def _(t):
    return splits.build_folds(t.pairs, "s", 4, stratified=True).select("id1", "id2", "component", "fold")


@query("p4_fold_balance_report", f"SELECT category, {big('MAX(n) - MIN(n)', 'pair_spread')}, {r('MAX(rate) - MIN(rate)', 'rate_spread')} FROM (SELECT category, fold, COUNT(*) AS n, AVG(target) AS rate FROM folded GROUP BY category, fold) GROUP BY category")
def _(t):
    return rounded(splits.fold_balance(t.folded))


@query("p5_inner_validation_split", components_sql("fold <> 1", "folded") + f" SELECT p.id1, p.id2, {hash_sql('c.component', 'inner-1', 10)} = 0 AS validation FROM folded p JOIN comp c ON p.id1 = c.id WHERE p.fold <> 1")
def _(t):
    return splits.inner_split(t.folded, 1).select("id1", "id2", "validation")


@query("p6_stratified_sample", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY fold, target ORDER BY id1 * 7 % 101, id1, id2) AS k, COUNT(*) OVER (PARTITION BY fold, target) AS n, COUNT(*) OVER (PARTITION BY fold) AS a FROM folded) SELECT id1, id2, fold, target FROM k WHERE k <= round(100.0 * n / a)""")
def _(t):
    return splits.stratified_sample(t.folded, 100, 0, F.col("id1") * 7 % 101).select("id1", "id2", "fold", "target")


@query("p7_uniform_sample", "SELECT id1, id2 FROM pairs ORDER BY (id1 * 31 + id2) % 1009, id1, id2 LIMIT 50")
def _(t):
    return splits.uniform_sample(t.pairs, 50, 0, (F.col("id1") * 31 + F.col("id2")) % 1009).select("id1", "id2")


def candidates(t):
    w = wide(t)
    return w.select("id1", "id2", "category", "fold", "target", F.col("m1").alias("predict"), F.col("m2").alias("similarity"), (F.col("id1") % 2).alias("conflict"))


def pct(c: str) -> str:
    return f"(rank() OVER (PARTITION BY category ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY category, {c}) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY category)"


@query("p8_hard_negatives", f"""WITH h AS (SELECT id1, id2, category, COUNT(*) OVER (PARTITION BY category) AS n, round({pct('m1')} + {pct('m2')} + 0.5 * (id1 % 2), 9) AS hardness FROM {WIDEF} WHERE fold <> 1 AND target = 0)
SELECT id1, id2, {r('hardness', 'hardness')} FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY hardness DESC, id1, id2) AS k FROM h) WHERE k <= greatest(1, round(n * 0.2))""")
def _(t):
    return rounded(splits.hard_negatives(candidates(t), 1, 0.2).select("id1", "id2", "hardness"))


ARMS = f"""arms AS (SELECT id1, id2, category, m1 AS predict, unnest(['soft', 'control']) AS arm, unnest([k, c]) AS place, n FROM (SELECT id1, id2, category, m1, COUNT(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY m1 DESC, id1, id2) AS k,
row_number() OVER (PARTITION BY category ORDER BY {draw_sql('0', 'id1', 'id2')}, id1, id2) AS c FROM {WIDEF} WHERE fold <> 1 AND target = 0)), arm AS (SELECT * FROM arms WHERE place <= greatest(1, round(n * 0.1)))"""


@query("p9_soft_negatives", f"WITH {ARMS} SELECT id1, id2, arm FROM arm")
def _(t):
    return splits.soft_negatives(candidates(t), 1, 0.1).select("id1", "id2", "arm")


@query("p9_arm_statistics", f"""WITH {ARMS} SELECT s.category, s.n, {r('s.mean', 'soft_mean')}, {r('s.least', 'soft_least')}, {r('c.mean', 'control_mean')}, {r('c.least', 'control_least')}, {r('s.mean - c.mean', 'lift')},
(SELECT COUNT(*) FROM arm x JOIN arm y ON x.id1 = y.id1 AND x.id2 = y.id2 AND x.arm = 'soft' AND y.arm = 'control' AND x.category = s.category) AS shared
FROM (SELECT category, COUNT(*) AS n, AVG(predict) AS mean, MIN(predict) AS least FROM arm WHERE arm = 'soft' GROUP BY category) s JOIN (SELECT category, AVG(predict) AS mean, MIN(predict) AS least FROM arm WHERE arm = 'control' GROUP BY category) c ON s.category = c.category""")
def _(t):
    return rounded(splits.arm_statistics(splits.soft_negatives(candidates(t), 1, 0.1)))


@query("p10_batch_pair_audit", """SELECT category, COUNT(*) AS batches, CAST(SUM(least(p, n - p)) AS BIGINT) AS usable FROM (SELECT fold, floor((k - 1) / 64) AS b, category, SUM(target) AS p, COUNT(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY id2 * 17 % 257, id1, id2) AS k FROM folded) GROUP BY fold, b, category) GROUP BY category""")
def _(t):
    return splits.batch_audit(t.folded, 64, [F.col("id2") * 17 % 257, "id1", "id2"])


@query("p11_id_hash_route", f"SELECT id1, id2, {draw_sql('id1', 'id2')} % 8 AS route FROM pairs")
def _(t):
    return splits.hash_route(t.pairs, 8).select("id1", "id2", "route")


@query("b1_blend_weighted", f"SELECT id1, id2, {r('(2 * m1 + m2 + m3) / 4', 'predict')} FROM {WIDE}")
def _(t):
    return rounded(blend.blend(t.scores, {"m1": 2, "m2": 1, "m3": 1}))


@query("b2_blend_rank", f"SELECT id1, id2, {r('AVG(k)', 'predict')} FROM (SELECT id1, id2, CAST(row_number() OVER (PARTITION BY model, category ORDER BY predict, id1, id2) - 1 AS DOUBLE) / greatest(COUNT(*) OVER (PARTITION BY model, category) - 1, 1) AS k FROM scored) GROUP BY id1, id2")
def _(t):
    return rounded(blend.blend(t.scored, {"m1": 1, "m2": 1, "m3": 1}, "rank", ("category",)))


CL = "least(greatest({m}, 1e-7), 1 - 1e-7)"
LOGIT = f"ln({CL} / (1 - {CL}))"


@query("b3_blend_logit", f"SELECT id1, id2, {r('1 / (1 + exp(-((' + ' + '.join(LOGIT.format(m=m) for m in ('m1', 'm2', 'm3')) + ') / 3)))', 'predict')} FROM {WIDE}")
def _(t):
    return rounded(blend.blend(t.scores, {"m1": 1, "m2": 1, "m3": 1}, "logit"))


@query("b4_tta_average", f"SELECT id1, id2, {r('(m1 + m2) / 2', 'predict')} FROM {WIDE}")
def _(t):
    a, b = t.scores.where("model = 'm1'"), t.scores.where("model = 'm2'")
    both = a.select("id1", "id2", "predict").union(b.select("id2", "id1", "predict"))
    return rounded(blend.symmetric_mean(both))


GRID = "(SELECT row_number() OVER (ORDER BY a, b) - 1 AS point, a / 4.0 AS w1, b / 4.0 AS w2, (4 - a - b) / 4.0 AS w3 FROM range(5) x(a), range(5) y(b) WHERE a + b <= 4)"


def gridap_sql(source: str = WIDEF) -> str:
    return ap_sql(f"(SELECT f.fold, f.category, f.target, g.point, f.m1 * w1 + f.m2 * w2 + f.m3 * w3 AS predict FROM {source} f CROSS JOIN {GRID} g)", "fold, category, point")


GRIDAP = gridap_sql()


@query("b5_weight_grid_search", f"SELECT fold, category, CAST(point AS INT) AS point, {r('ap', 'ap')} FROM {GRIDAP}")
def _(t):
    return rounded(blend.grid_ap(wide(t, None), MODELS, blend.simplex(3)).select("fold", "category", "point", "ap"))


def chosen_sql(name: str, by: str = "held, category", only: str = "TRUE", ap: str = GRIDAP) -> str:
    """A table (by, w1, w2, w3) of the best grid points over the other folds."""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY CASE WHEN ap >= most - 1e-12 THEN 0 ELSE 1 END, (w1 - 1/3.0) ** 2 + (w2 - 1/3.0) ** 2 + (w3 - 1/3.0) ** 2, point) AS k FROM (SELECT m.*, g.w1, g.w2, g.w3, MAX(m.ap) OVER (PARTITION BY {by}) AS most
FROM (SELECT {by}, point, AVG(ap) AS ap FROM {ap} a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS held) h WHERE a.fold <> h.held AND a.ap IS NOT NULL GROUP BY {by}, point) m JOIN {GRID} g ON m.point = g.point WHERE {only})) WHERE k = 1)"""


CHOICES = ", ".join([chosen_sql("pick"), chosen_sql("one", only="greatest(w1, w2, w3) = 1"), chosen_sql("every", "held")])
WAYS = [("equal", "1 / 3.0", "1 / 3.0", "1 / 3.0"), ("global", "e.w1", "e.w2", "e.w3"), ("best_single", "o.w1", "o.w2", "o.w3"), ("raw", "p.w1", "p.w2", "p.w3"), *[(f"shrunk_{a}", *[f"{a} * p.w{i} + {1 - a} / 3.0" for i in (1, 2, 3)]) for a in (0.25, 0.5, 0.75)]]


@query("b6_nested_blend", f"WITH {CHOICES}, w AS ({' UNION ALL '.join(f"SELECT '{v}' AS variant, p.held, p.category, {x} AS x, {y} AS y, {z} AS z FROM pick p JOIN one o ON p.held = o.held AND p.category = o.category JOIN every e ON p.held = e.held" for v, x, y, z in WAYS)}) SELECT variant, f.id1, f.id2, ROUND(f.m1 * x + f.m2 * y + f.m3 * z, 8) + 0.0 AS predict FROM {WIDEF} f JOIN w ON f.fold = w.held AND f.category = w.category")
def _(t):
    grid = blend.simplex(3)
    out = blend.nested_variants(wide(t), MODELS, blend.grid_ap(wide(t), MODELS, grid), blend.grid_table(t.spark, grid), FOLDS)
    return out.select("variant", "id1", "id2", F.round("predict", 8).alias("predict"))


@query("b7_shrunk_two_level_weights", f"WITH {CHOICES} SELECT CAST(p.held AS INT) AS held, p.category, {', '.join(r(f'0.75 * p.w{i} + 0.25 * e.w{i}', f'w{i}') for i in (1, 2, 3))} FROM pick p JOIN every e ON p.held = e.held")
def _(t):
    grid = blend.simplex(3)
    ap = blend.grid_ap(wide(t), MODELS, grid)
    table = blend.grid_table(t.spark, grid)
    both = blend.two_level_weights(blend.choose_weights(ap, table, FOLDS), blend.choose_weights(ap, table, FOLDS, ()))
    return rounded(both.select("held", "category", *[F.col("weights")[i].alias(f"w{i + 1}") for i in range(3)]))


def shuffled_sql(column: str, *seeds: str) -> str:
    """wide with v: the column dealt anew within (fold, category)."""
    order = draw_sql(*seeds, "id1", "id2")
    k = f"SELECT *, row_number() OVER (PARTITION BY fold, category ORDER BY id1, id2) AS a, row_number() OVER (PARTITION BY fold, category ORDER BY {order}, id1, id2) AS b FROM {WIDEF}"
    return f"(SELECT x.* EXCLUDE (a, b), y.{column} AS v FROM ({k}) x JOIN ({k}) y ON x.fold = y.fold AND x.category = y.category AND x.a = y.b)"


SCREEN = " UNION ALL ".join(f"SELECT '{c}' AS candidate, '{k}' AS control, fold, target, m1, {v} AS v FROM {src} q" for c in ("m2", "m3") for k, v, src in (("real", c, WIDEF), ("shuffled", "v", shuffled_sql(c, "0", f"'{c}'"))))


@query("b8_residual_screen", f"""WITH s AS ({SCREEN}), ap AS (SELECT * FROM {ap_sql('(SELECT candidate, control, fold, target, w.point, round((1 - w.w) * m1 + w.w * v, 8) AS predict FROM s CROSS JOIN (SELECT i AS point, CAST(i AS DOUBLE) * 0.05 AS w FROM range(8) r(i)) w)', 'candidate, control, fold, point')}),
m AS (SELECT candidate, control, h.held, point, round(AVG(ap), 9) AS m FROM ap CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS held) h WHERE fold <> held AND ap IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate, control, held ORDER BY m DESC, point) AS k FROM m) WHERE k = 1)
SELECT b.candidate, b.control, CAST(b.held AS INT) AS fold, {r('b.point * 0.05', 'weight')}, {r('x.ap - z.ap', 'delta')} FROM best b JOIN ap x ON b.candidate = x.candidate AND b.control = x.control AND b.held = x.fold AND b.point = x.point JOIN ap z ON b.candidate = z.candidate AND b.control = z.control AND b.held = z.fold AND z.point = 0""")
def _(t):
    out = resample.residual_control(wide(t), "m1", ["m2", "m3"], FOLDS)
    return rounded(out.select("candidate", "control", F.explode("folds").alias("f")).select("candidate", "control", F.col("f.fold").cast("int").alias("fold"), "f.weight", "f.delta"))


@query("b9_stack_logit")
def _(t):
    return rounded(blend.fit_stack(wide(t), MODELS, FOLDS)[0])


@query("b9_stack_slopes", "SELECT CAST(unnest([0, 1, 2, 3, NULL]) AS INT) AS held, CAST(0 AS DOUBLE) AS steepest")
def _(t):
    return rounded(blend.stack_slopes(wide(t), MODELS, blend.fit_stack(wide(t), MODELS, FOLDS)[1]))


@query("b9_stack_transforms")
def _(t):
    parts = [blend.fit_stack(wide(t), MODELS, FOLDS, transform=x)[0].withColumn("transform", F.lit(x)) for x in ("prob", "rank")]
    return rounded(parts[0].unionByName(parts[1]))


@query("b9_weight_stability")
def _(t):
    return rounded(blend.weight_stability(t.spark, MODELS, blend.fit_stack(wide(t), MODELS, FOLDS)[1]))


CS = "least(greatest({m}, 1e-6), 1 - 1e-6)"


@query("b10_apply_stack", f"SELECT id1, id2, {r('1 / (1 + exp(-(-0.5 + ' + ' + '.join(f'{c} * ln({CS.format(m=m)} / (1 - {CS.format(m=m)}))' for c, m in ((0.7, 'm1'), (0.2, 'm2'), (0.1, 'm3'))) + ')))', 'predict')} FROM {WIDE}")
def _(t):
    return rounded(blend.apply_stack(files.oof_matrix(t.scored, 4, MODELS), MODELS, -0.5, [0.7, 0.2, 0.1]).select("id1", "id2", "predict"))


@query("b11_feature_stack", f"SELECT CAST(h.held AS INT) AS held, f.id1, f.id2, {r('CASE WHEN (f.id1 + h.held) % 2 = 0 THEN f.m1 END', 'nested_score')} FROM {WIDEF} f CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS held) h")
def _(t):
    nested = wide(t).select("id1", "id2", F.explode(F.array(*map(F.lit, FOLDS))).alias("held"), F.col("m1").alias("predict")).where("(id1 + held) % 2 = 0")
    return rounded(blend.stack_features(t.folded.select("id1", "id2"), nested, FOLDS).select("held", "id1", "id2", "nested_score"))


ROUTES = [("m1", 0.75), ("m2", 0.25)]


def routes(t):
    named = t.pairs.select("category").distinct().where("length(category) % 2 = 0")
    return named.select("category", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("weight")) for m, w in ROUTES])).alias("r")).select("category", "r.*")


@query("b12_route_by_category", f"""WITH k AS (SELECT model, category, id1, id2, CAST(row_number() OVER (PARTITION BY model, category ORDER BY predict, id1, id2) AS DOUBLE) / COUNT(*) OVER (PARTITION BY model, category) AS rk FROM scored WHERE NOT (model = 'm2' AND id1 % 10 = 3)),
w AS (SELECT *, CASE WHEN length(category) % 2 = 0 THEN CASE model WHEN 'm1' THEN 0.75 WHEN 'm2' THEN 0.25 END ELSE 1.0 END AS w FROM k) SELECT id1, id2, {r('SUM(w * rk) / SUM(w)', 'predict')} FROM w WHERE w IS NOT NULL GROUP BY id1, id2""")
def _(t):
    return rounded(blend.route(t.scores.where("not (model = 'm2' and id1 % 10 = 3)"), t.pairs, routes(t)))


@query("b13_route_work_plan", f"SELECT m.model, COUNT(*) AS n_pairs, {r('COUNT(*) / (SELECT COUNT(*) FROM pairs)', 'share')} FROM pairs p CROSS JOIN (SELECT unnest(['m1', 'm2', 'm3']) AS model) m WHERE length(p.category) % 2 <> 0 OR m.model <> 'm3' GROUP BY m.model")
def _(t):
    return rounded(blend.work_plan(t.pairs, routes(t), MODELS))


SIZE = "CASE WHEN json_valid(attributes) THEN json_extract_string(attributes, '$.Size') END"


@query("b14_size_penalty", f"SELECT s.id1, s.id2, {r('CASE WHEN a.s <> b.s THEN 0.25 * predict ELSE predict END', 'predict')} FROM (SELECT * FROM scores WHERE model = 'm1') s JOIN (SELECT id, {SIZE} AS s FROM items) a ON s.id1 = a.id JOIN (SELECT id, {SIZE} AS s FROM items) b ON s.id2 = b.id")
def _(t):
    flags = features.size_mismatch(t.pairs, features.size_sets(t.items))
    return rounded(blend.apply_penalty(t.scores.where("model = 'm1'").select("id1", "id2", "predict"), flags))


@query("b15_default_fill", f"SELECT p.id1, p.id2, {r('COALESCE(s.predict, 0.5)', 'predict')} FROM pairs p LEFT JOIN (SELECT * FROM scores WHERE model = 'm1' AND predict > 0.3) s ON p.id1 = s.id1 AND p.id2 = s.id2")
def _(t):
    return rounded(blend.fill_default(t.scores.where("model = 'm1' and predict > 0.3"), t.pairs))


ISOTONIC = """WITH b AS (SELECT fold, predict, SUM(target) AS t, COUNT(*) AS n, row_number() OVER (PARTITION BY fold ORDER BY predict) AS i FROM scored WHERE model = 'm1' GROUP BY fold, predict),
c AS (SELECT *, SUM(t) OVER w AS ct, SUM(n) OVER w AS cn FROM b WINDOW w AS (PARTITION BY fold ORDER BY i)),
mean AS (SELECT x.fold, x.i AS a, y.i AS z, CAST(y.ct - x.ct + x.t AS DOUBLE) / (y.cn - x.cn + x.n) AS m FROM c x JOIN c y ON x.fold = y.fold AND x.i <= y.i),
least AS (SELECT fold, a, z, MIN(m) OVER (PARTITION BY fold, a ORDER BY z DESC) AS m FROM mean),
iso AS (SELECT fold, z AS i, MAX(m) AS m FROM least GROUP BY fold, z)"""


@query("b16_isotonic_calibrate", ISOTONIC + f" SELECT s.id1, s.id2, s.fold, s.target, {r('s.predict', 'predict')}, {r('least(greatest(iso.m, 0.001), 0.999)', 'calibrated')} FROM scored s JOIN b ON s.fold = b.fold AND s.predict = b.predict JOIN iso ON iso.fold = b.fold AND iso.i = b.i WHERE s.model = 'm1'")
def _(t):
    one = t.scored.where("model = 'm1'").select("id1", "id2", "fold", "target", "predict")
    return rounded(blend.isotonic_by_fold(one))


def training_rows(t):
    """Labelled pairs with corrected targets, and derived pairs of a smaller weight that only train."""
    from pairlab.operators.joins import apply_corrections, shuffled

    derived = graph.closure_pairs(t.folded).select("id1", "id2", "fold", "target", F.lit(0.5).alias("weight"), F.lit(True).alias("train_only"))
    labelled = apply_corrections(t.folded, t.verdicts).select("id1", "id2", "fold", "target", F.lit(1.0).alias("weight"), F.lit(False).alias("train_only"))
    rows = checkpointed(labelled.unionByName(derived))  # read three times
    x = features.pair_features(rows, t.items, features.category_codes(t.items))
    return x.join(shuffled(rows), ["id1", "id2"]), [c for c in x.columns if c not in ("id1", "id2", "known")]


@query("b17_train_pair_classifier")
def _(t):
    return rounded(blend.train_oof(*training_rows(t), FOLDS, "weight")[0])


@query("b17_feature_importance")
def _(t):
    return rounded(blend.train_oof(*training_rows(t), FOLDS, "weight")[1])


@query("b18_graph_meta_model")
def _(t):
    m1, left = loo(t)
    rows = t.folded.join(m1, ["id1", "id2"]).join(left, ["id1", "id2"]).join(graph.link_features(t.pairs), ["id1", "id2"]).join(F.broadcast(features.category_codes(t.items)), "category")
    columns = ["mean_lo", "mean_hi", "max_lo", "max_hi", "comp_mean", "gap", "deg_min", "deg_max", "log_product", "common", "jaccard", "adamic_adar"]
    rows = rows.withColumnRenamed("predict", "score").fillna(-1.0, subset=columns[:6])
    return rounded(resample.graph_model(rows, ["score", "code"], columns, FOLDS))


@query("b19_score_pairs_with_model", """SELECT p.id1, p.id2, CASE WHEN a.name = b.name THEN 1.0 ELSE ROUND(CAST(least(length(a.name), length(b.name)) AS DOUBLE) / greatest(length(a.name), length(b.name)), 6) END AS predict FROM pairs p JOIN items a ON p.id1 = a.id JOIN items b ON p.id2 = b.id""")
def _(t):
    def scorer(a, b):
        la, lb = a.str.len(), b.str.len()
        return (la.where(la < lb, lb) / la.where(la > lb, lb)).where(a != b, 1.0)

    from pairlab.operators.joins import attach_items

    texts = attach_items(t.pairs.select("id1", "id2"), t.items.select("id", F.col("name").alias("text")), ["text"])
    return rounded(blend.score_batches(texts, scorer))


PLACES = "(SELECT *, CAST(row_number() OVER (PARTITION BY model, category ORDER BY predict, id1, id2) - 1 AS DOUBLE) / greatest(COUNT(*) OVER (PARTITION BY model, category) - 1, 1) AS rk FROM scored)"


def macro_sql(source: str) -> str:
    return f"(SELECT model, AVG(ap) AS macro_ap FROM {ap_sql(source, 'model, category')} WHERE positives > 0 AND positives < n_rows GROUP BY model)"


@query("b20_best_step_select", f"""WITH k AS (SELECT * FROM {PLACES}), b AS (SELECT k.*, o.rk AS base_rk, o.predict AS base_predict FROM k JOIN k o ON o.model = 'm1' AND k.id1 = o.id1 AND k.id2 = o.id2),
g AS (SELECT * FROM {macro_sql('(SELECT model, category, target, round((1 - 0.1) * base_rk + 0.1 * rk, 8) AS predict FROM b)')}),
c AS (SELECT model, category, rank() OVER (PARTITION BY model, category ORDER BY base_predict) + (COUNT(*) OVER (PARTITION BY model, category, base_predict) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model, category ORDER BY predict) + (COUNT(*) OVER (PARTITION BY model, category, predict) - 1) / 2.0 AS rb FROM b),
p AS (SELECT model, AVG(x) AS spearman FROM (SELECT model, corr(ra, rb) AS x FROM c GROUP BY model, category) GROUP BY model)
SELECT g.model AS step, {r('g.macro_ap - s.macro_ap', 'delta')}, {r('p.spearman', 'spearman')}, CAST(substr(g.model, 2) AS INT) AS position FROM g JOIN p ON g.model = p.model JOIN {macro_sql('scored')} s ON s.model = 'm1' ORDER BY g.macro_ap - s.macro_ap DESC, position LIMIT 1""")
def _(t):
    steps = blend.step_table(t.scored, "m1").withColumn("position", F.substring("step", 2, 9).cast("int"))
    return rounded(blend.select_step(steps))


FIXED = f"(SELECT s.model, s.fold, s.id1, s.id2, s.predict, s.target AS original, COALESCE(CASE WHEN v.audited_label >= 0 THEN v.audited_label END, s.target) AS target, v.audited_label, v.mode FROM scored s LEFT JOIN {LATEST} v ON s.id1 = v.id1 AND s.id2 = v.id2)"


@query("l1_apply_corrections", f"SELECT fold, COUNT(*) AS n, {big('SUM(target)', 'positives')}, CAST(COUNT_IF(target <> original) AS BIGINT) AS changed FROM {FIXED} WHERE model = 'm1' GROUP BY fold")
def _(t):
    from pairlab.operators.joins import apply_corrections

    return apply_corrections(t.folded, t.verdicts).groupBy("fold").agg(F.count("*").alias("n"), F.sum("target").alias("positives"), F.count_if(F.col("target") != F.col("original_target")).alias("changed"))


OPEN = "NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.id1 = s.id1 AND v.id2 = s.id2)"


JUDGE = "abs(target - predict)"


@query("l2_audit_queue", " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, id1, id2, target, {r(p, 'priority')} FROM {src} s WHERE {cond} AND {OPEN} ORDER BY {p} DESC, id1, id2 LIMIT 25)" for m, src, cond, p in (
    ("fn", "scored", "model = 'm1' AND target = 1", "1 - predict"), ("fp", "scored", "model = 'm1' AND target = 0", "predict"),
    ("consensus", "(SELECT id1, id2, MAX(target) AS target, abs(MAX(target) - AVG(predict)) AS gap FROM scored GROUP BY id1, id2)", "TRUE", "gap"),
    ("judge", "scored", "model = 'm2'", JUDGE), ("judge_fn", "scored", "model = 'm2' AND target = 1", JUDGE), ("judge_fp", "scored", "model = 'm2' AND target = 0", JUDGE),
)))
def _(t):
    return queues(t, ("fn", "fp", "consensus", "judge", "judge_fn", "judge_fp"), 25)


def queues(t, modes, n):
    """(mode, id1, id2, target, priority): the queue of each mode under another."""
    out = None
    for mode in modes:
        part = audit.audit_queue(mode, t.scored, n, model="m1", infold=infold(t), journal=t.verdicts, judge=t.scores.where("model = 'm2'")).select(F.lit(mode).alias("mode"), "id1", "id2", "target", "priority")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


def infold(t):
    return t.scored.select("*", F.explode(F.array(*map(F.lit, FOLDS))).alias("held")).withColumn("predict", F.greatest(F.lit(0.0), F.col("predict") - 0.01 * F.col("held") * (1 - F.col("target"))))


INFOLD = "(SELECT s.* EXCLUDE (predict), h.held, greatest(0, predict - 0.01 * h.held * (1 - target)) AS predict FROM scored s CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS held) h WHERE h.held <> s.fold)"


SEEN = f"(SELECT *, -(target * ln(p) + (1 - target) * ln(1 - p)) AS loss FROM (SELECT id1, id2, MAX(target) AS target, least(greatest(AVG(predict), 1e-6), 1 - 1e-6) AS p FROM {INFOLD} GROUP BY id1, id2))"
GAP = f"(SELECT m.id1, m.id2, m.target, ROUND(CASE WHEN m.target = 1 THEN a.p - m.predict ELSE m.predict - a.p END, 9) AS gap FROM scored m JOIN (SELECT id1, id2, AVG(predict) AS p FROM {INFOLD} GROUP BY id1, id2) a ON m.id1 = a.id1 AND m.id2 = a.id2 WHERE m.model = 'm1')"


@query("l2_audit_queue_infold", " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, id1, id2, target, {r(p, 'priority')} FROM {src} s WHERE {cond} AND {OPEN} ORDER BY {p} DESC, id1, id2 LIMIT 30)" for m, src, cond, p in (
    ("infold", SEEN, "TRUE", "ROUND(loss, 9)"), ("infold_fn", SEEN, "target = 1", "ROUND(loss, 9)"), ("infold_fp", SEEN, "target = 0", "ROUND(loss, 9)"), ("infold_gap", GAP, "TRUE", "gap"),
)))
def _(t):
    return queues(t, ("infold", "infold_fn", "infold_fp", "infold_gap"), 30)


@query("l2_audit_queue_random", f"SELECT id1, id2, target, {draw_sql('0', 'id1', 'id2')} % 1000000 / 1e6 AS priority FROM folded s WHERE {OPEN} ORDER BY priority DESC, id1, id2 LIMIT 30")
def _(t):
    return audit.audit_queue("random", t.scored, 30, journal=t.verdicts)


@query("l3_votes_against_label", "SELECT id1, id2, MAX(target) AS target, COUNT(*) AS voters, CAST(COUNT_IF((predict >= 0.5) <> (target = 1)) AS BIGINT) AS against FROM scored GROUP BY id1, id2")
def _(t):
    return audit.votes_against_label(t.scored)


@query("l4_infold_average", f"SELECT fold, id1, id2, MAX(target) AS target, {r('AVG(predict)', 'predict')} FROM {INFOLD} GROUP BY fold, id1, id2")
def _(t):
    return rounded(audit.infold_average(infold(t)).drop("loss"))


@query("l5_infold_gap", f"""WITH a AS (SELECT * FROM {ap_sql(f'(SELECT model, MAX(target) AS target, AVG(predict) AS predict FROM {INFOLD} GROUP BY model, id1, id2)', 'model')}), b AS (SELECT * FROM {ap_sql('scored', 'model')}) SELECT a.model, {r('a.ap', 'infold_ap')}, {r('b.ap', 'oof_ap')}, {r('a.ap - b.ap', 'gap')} FROM a JOIN b ON a.model = b.model""")
def _(t):
    return rounded(audit.infold_gap(t.scored, infold(t)))


@query("l6_audit_summary", f"""WITH j AS (SELECT l.*, p.target AS original_target FROM {LATEST} l JOIN pairs p ON l.id1 = p.id1 AND l.id2 = p.id2), c AS (SELECT mode, COUNT(*) AS n, CAST(COUNT_IF(audited_label >= 0 AND audited_label <> original_target) AS BIGINT) AS changed, CAST(COUNT_IF(audited_label < 0) AS BIGINT) AS unsure, COUNT_IF(audited_label >= 0) AS sure FROM j GROUP BY mode),
d AS (SELECT *, CASE WHEN mode = 'random' AND sure >= 30 THEN changed / sure END AS p FROM c) SELECT mode, n, changed, unsure, {r('p', 'rate')}, {r('p - 1.96 * sqrt(p * (1 - p) / sure)', 'low')}, {r('p + 1.96 * sqrt(p * (1 - p) / sure)', 'high')} FROM d""")
def _(t):
    return rounded(audit.audit_summary(t.verdicts))


@query("l7_audit_impact", f"""WITH a AS (SELECT model, AVG(ap) AS x FROM {ap_sql('scored', 'model, fold')} GROUP BY model), b AS (SELECT model, AVG(ap) AS x FROM {ap_sql(FIXED, 'model, fold')} GROUP BY model) SELECT a.model, {r('a.x', 'before')}, {r('b.x', 'after')} FROM a JOIN b ON a.model = b.model""")
def _(t):
    return rounded(audit.audit_impact(t.scored, t.verdicts))


@query("l8_judge_agreement", f"""SELECT audited_label <> original AS changed, COUNT(*) AS n, {r('AVG(CASE WHEN (predict >= 0.5) = (original = 1) THEN 1.0 ELSE 0.0 END)', 'with_original')}, {r('AVG(CASE WHEN (predict >= 0.5) = (audited_label = 1) THEN 1.0 ELSE 0.0 END)', 'with_audited')} FROM {FIXED} WHERE model = 'm2' AND audited_label >= 0 GROUP BY 1""")
def _(t):
    return rounded(audit.judge_agreement(t.scores.where("model = 'm2'"), t.verdicts))


@query("l8_verdict_table", f"SELECT audited_label AS human, CAST(predict >= 0.5 AS INT) AS model, COUNT(*) AS n FROM {FIXED} WHERE model = 'm2' AND audited_label IS NOT NULL GROUP BY 1, 2".replace("GROUP BY 1, 2", "GROUP BY audited_label, CAST(predict >= 0.5 AS INT)"))
def _(t):
    return audit.verdict_table(t.scores.where("model = 'm2'"), t.verdicts)


@query("l9_model_freshness", f"""SELECT m.model, (SELECT COUNT(*) FROM {LATEST} l JOIN pairs p ON l.id1 = p.id1 AND l.id2 = p.id2 WHERE l.audited_label >= 0 AND l.audited_label <> p.target AND l.judged_at > m.at_) AS newer FROM (SELECT model, 5000 * CAST(substr(model, 2) AS BIGINT) AS at_ FROM scores GROUP BY model) m""")
def _(t):
    models = t.scores.select("model").distinct().withColumn("trained_at", 5000 * F.substring("model", 2, 9).cast("bigint"))
    return audit.model_freshness(t.verdicts, models)


JUDGED = f"(SELECT * FROM {FIXED} WHERE audited_label IS NOT NULL)"


@query("l10_audited_slice_metrics", f"""WITH a AS (SELECT * FROM {ap_sql(f'(SELECT model, original AS target, predict FROM {JUDGED})', 'model')}), b AS (SELECT * FROM {ap_sql(JUDGED, 'model')}) SELECT a.model, {big('a.n_rows', 'n_rows')}, {r('a.ap', 'ap_original')}, {r('b.ap', 'ap_audited')}, c.flips, c.unsure
FROM a JOIN b ON a.model = b.model JOIN (SELECT model, CAST(COUNT_IF(audited_label >= 0 AND audited_label <> original) AS BIGINT) AS flips, CAST(COUNT_IF(audited_label < 0) AS BIGINT) AS unsure FROM {JUDGED} GROUP BY model) c ON a.model = c.model""")
def _(t):
    return rounded(audit.audited_slice_metrics(t.scored, t.verdicts))


@query("r1_stratified_permutation", f"""WITH k AS (SELECT fold, category, id1, id2, m1, row_number() OVER (PARTITION BY fold, category ORDER BY id1, id2) AS a, row_number() OVER (PARTITION BY fold, category ORDER BY id2 * 37 % 1013, id1, id2) AS b FROM {WIDEF}) SELECT x.id1, x.id2, {r('y.m1', 'm1')} FROM k x JOIN k y ON x.fold = y.fold AND x.category = y.category AND x.a = y.b""")
def _(t):
    return rounded(resample.permute_within(wide(t), ["fold", "category"], "m1", 0, F.col("id2") * 37 % 1013).select("id1", "id2", "m1"))


@query("r1_degree_stratified_permutation", f"""WITH d AS (SELECT id, COUNT(*) AS d FROM (SELECT id1 AS id FROM pairs UNION ALL SELECT id2 FROM pairs) GROUP BY id),
b AS (SELECT w.*, least(5, floor(log2(greatest(x.d, y.d)))) AS degree_bin FROM {WIDEF} w JOIN d x ON w.id1 = x.id JOIN d y ON w.id2 = y.id),
k AS (SELECT *, row_number() OVER (PARTITION BY fold, category, degree_bin ORDER BY id1, id2) AS a, row_number() OVER (PARTITION BY fold, category, degree_bin ORDER BY {draw_sql('0', 'id1', 'id2')}, id1, id2) AS b FROM b)
SELECT x.id1, x.id2, CAST(x.degree_bin AS INT) AS degree_bin, {r('y.m1', 'm1')} FROM k x JOIN k y ON x.fold = y.fold AND x.category = y.category AND x.degree_bin = y.degree_bin AND x.a = y.b""")
def _(t):
    return rounded(resample.permute_within(resample.with_degree_bin(wide(t)), ["fold", "category", "degree_bin"], "m1", 0).select("id1", "id2", "degree_bin", "m1"))


@query("r2_permutation_controls", f"""WITH f AS (SELECT * FROM {WIDEF}), n AS (SELECT unnest(range(20)) AS rep), x AS (SELECT n.rep, f.*, row_number() OVER (PARTITION BY n.rep, fold, category ORDER BY id1, id2) AS k FROM f CROSS JOIN n),
y AS (SELECT rep, fold, category, m2 AS v, row_number() OVER (PARTITION BY rep, fold, category ORDER BY {draw_sql('0', 'rep', 'id1', 'id2')}, id1, id2) AS k FROM x),
s AS (SELECT 'real' AS control, -1 AS rep, target, round((m1 + m2) / 2, 8) AS predict FROM f UNION ALL SELECT 'target', -1, target, round((m1 + target) / 2, 8) FROM f UNION ALL SELECT 'permuted', x.rep, x.target, round((x.m1 + y.v) / 2, 8) FROM x JOIN y ON x.rep = y.rep AND x.fold = y.fold AND x.category = y.category AND x.k = y.k),
a AS (SELECT * FROM {ap_sql('s', 'control, rep')}), b AS (SELECT ap AS start FROM {ap_sql('(SELECT 0 AS g, target, m1 AS predict FROM f)', 'g')}) SELECT control, {r('AVG(ap - start)', 'mean_delta')}, {r('stddev_pop(ap - start)', 'std_delta')} FROM a CROSS JOIN b GROUP BY control""")
def _(t):
    return rounded(resample.permutation_controls(wide(t), "m1", "m2"))


@query("r3_category_bootstrap", f"""WITH c AS (SELECT * FROM {ap_sql('scored', 'model, category')}), d AS (SELECT a.category, a.ap - b.ap AS delta FROM c a JOIN c b ON a.category = b.category AND a.model = 'm2' AND b.model = 'm1'),
v AS (SELECT *, row_number() OVER (ORDER BY category) - 1 AS k, COUNT(*) OVER () AS n FROM d WHERE delta IS NOT NULL), t AS (SELECT x.id, AVG(v.delta) AS m FROM range(10000) x(id) CROSS JOIN (SELECT k + 1 AS i, n FROM v) s JOIN v ON v.k = {draw_sql('0', 'x.id', 's.i')} % s.n GROUP BY x.id)
SELECT {r('AVG(m)', 'mean')}, {r('quantile_cont(m, 0.025)', 'low')}, {r('quantile_cont(m, 0.975)', 'high')} FROM t""")
def _(t):
    cell = metrics.average_precision(t.scored, ["model", "category"]).groupBy("category").pivot("model", MODELS).agg(F.first("ap"))
    return rounded(resample.category_bootstrap(cell.select("category", (F.col("m2") - F.col("m1")).alias("delta"))))


@query("r4_cluster_bootstrap_ap", components_sql() + f""", q AS (SELECT f.*, c.component, dense_rank() OVER (ORDER BY c.component) - 1 AS slot FROM {WIDEF} f JOIN comp c ON f.id1 = c.id), n AS (SELECT DISTINCT slot, (SELECT COUNT(DISTINCT slot) FROM q) AS total FROM q),
w AS (SELECT rep, {draw_sql('0', 'rep', 'slot')} % total AS slot, COUNT(*) AS w FROM n CROSS JOIN range(200) x(rep) GROUP BY 1, 2), s AS (SELECT rep, 'a' AS model, target, m1 AS predict, w FROM q JOIN w ON q.slot = w.slot UNION ALL SELECT rep, 'b', target, m2, w FROM q JOIN w ON q.slot = w.slot),
ap AS (SELECT * FROM {ap_sql('s', 'rep, model', 'w')}), d AS (SELECT a.ap - b.ap AS d FROM ap a JOIN ap b ON a.rep = b.rep AND a.model = 'b' AND b.model = 'a')
SELECT COUNT(d) AS reps, {r('AVG(d)', 'mean_delta')}, {r('quantile_cont(d, 0.025)', 'low')}, {r('quantile_cont(d, 0.975)', 'high')}, {r('AVG(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)', 'p_above')} FROM d""")
def _(t):
    comp = connected_components(t.pairs).withColumnRenamed("id", "id1")
    return rounded(resample.cluster_bootstrap(wide(t).join(comp, "id1"), "m1", "m2", "component"))


PERMUTED = f"(SELECT * EXCLUDE (target, v), v AS target FROM {shuffled_sql('target', '0')})"
SIMPLEX = ", ".join(f"-ln(({draw_sql('0', 'fold', 'category', str(i))} + 0.5) / 4294967296.0) AS e{i}" for i in range(3))


@query("r5_selection_control", f"""WITH {chosen_sql('pick')}, {chosen_sql('lost', ap=gridap_sql(PERMUTED))}, rw AS (SELECT held, category, e0 / (e0 + e1 + e2) AS w1, e1 / (e0 + e1 + e2) AS w2, e2 / (e0 + e1 + e2) AS w3 FROM (SELECT fold AS held, category, {SIMPLEX} FROM (SELECT DISTINCT fold, category FROM folded))),
s AS ({' UNION ALL '.join(f"SELECT '{name}' AS labels, f.target, round(f.m1 * w1 + f.m2 * w2 + f.m3 * w3, 8) AS predict FROM {src} f JOIN {w} w ON f.fold = w.held AND f.category = w.category" for name, src, w in (('real', WIDEF, 'pick'), ('permuted', PERMUTED, 'lost'), ('random', WIDEF, 'rw')))}) SELECT labels, {r('ap', 'ap')} FROM {ap_sql('s', 'labels')}""")
def _(t):
    return rounded(resample.selection_control(wide(t), MODELS, FOLDS))


def journal_table(t):
    """The journal as it comes in three files, merged into a keyed table; its folder."""
    path, out, check = (files.scratch(t.spark, x) for x in ("stream-in", "stream-out", "stream-check"))
    t.journal.repartition(3).write.json(path)
    stream.run_to_table(stream.journal_stream(t.spark, path), out, check)
    return out


@query("t1_journal_latest_stream", "SELECT id1, id2, arg_max(audited_label, judged_at) AS audited_label, MAX(judged_at) AS judged_at FROM journal GROUP BY id1, id2")
def _(t):
    return stream.read_table(t.spark, journal_table(t)).select("id1", "id2", "audited_label", "judged_at")


@query("t1_corrected_labels", "SELECT COUNT(*) AS pairs, CAST(COUNT_IF(audited_label >= 0 AND audited_label <> original_target) AS BIGINT) AS corrected FROM (SELECT id1, id2, arg_max(audited_label, judged_at) AS audited_label, arg_max(original_target, judged_at) AS original_target FROM journal GROUP BY id1, id2)")
def _(t):
    growth = stream.growth(t.spark, journal_table(t))
    return growth.orderBy(F.desc("version")).limit(1).select("pairs", "corrected")
