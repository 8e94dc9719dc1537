"""Golden rows and properties of operators whose results SQL does not give."""

import hashlib
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.operators import audit, blend, contracts, features, graph, joins, metrics, ranks, resample, splits
from pairlab.operators.components import connected_components
from pairlab.plans.fixtures import Tables
from pairlab.sources import files
from pairlab.sources.files import JOURNAL
from pairlab.streaming import journal as stream
from tests.conftest import sent

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def wide(t):
    from pairlab.plans.modelling import wide

    return wide(t).cache()


def one(df, expr):
    return df.select(expr.alias("x")).first().x


# Text


def test_names(spark):
    df = spark.createDataFrame([("  Ёлка-12,5  Ｘ１ кг!",)], "s string")
    assert one(df, T.normalize_name(T.nfkc(F.col("s")))) == "елка 12 5 x1 кг"
    assert one(df, T.number_tokens(F.lit("a 007 x 0 12"))) == ["7", "0", "12"]
    assert one(df, T.prefix_ratio(F.lit("abc"), F.lit("abd"))) == pytest.approx(2 / 3)
    assert one(df, T.prefix_ratio(F.lit(""), F.lit(""))) == 0
    assert one(df, T.jaccard(F.array(), F.array())) == 0


def test_attributes(spark):
    rows = [('{"B":"x","a":["1","2"],"C":null}',), ("[1]",), ("no json",), (None,), ('{"k":true,"n":1.5}',)]
    df = spark.createDataFrame(rows, "s string")
    assert [r.x for r in df.select(T.compact_attrs(F.col("s")).alias("x")).collect()][1:4] == ["", "", ""]
    assert sorted(df.select(T.attribute_tokens(F.col("s")).alias("x")).collect()[4].x) == ["k=true", "n=1.5"]


def test_compare_state_and_probability(spark):
    df = spark.range(1)
    assert one(df, T.compare_state(F.lit("dark blue"), F.lit("blue"))) == "match"
    assert one(df, T.compare_state(F.lit("blue"), F.lit("dark blue"))) == "differ"
    assert one(df, T.compare_state(F.lit(None).cast("string"), F.lit("x"))) == "unknown"
    top = F.array(F.struct(F.lit("1").alias("token"), F.lit(-1.0).alias("logprob")), F.struct(F.lit("x").alias("token"), F.lit(-3.0).alias("logprob")))
    assert one(df, T.two_way_probability(top)) == pytest.approx(1 / (1 + math.exp(-5 + 1)))


@pytest.mark.parametrize("text,want", [("1 кг", {("mass", 1000.0)}), ("1000 г", {("mass", 1000.0)}), ("объем 0,5 л / 500 мл", {("volume", 500.0)}), ("упаковка 10 штук", {("count", 10.0)}), ("12 шт", {("count", 12.0)}), ("х5км", set())])
def test_quantities(spark, text, want):
    got = features.extract_quantities(spark.createDataFrame([(1, text)], "id long, name string")).collect()
    assert {(r.family, float(r.quantity)) for r in got} == want


def test_units_in_place(spark):
    df = spark.createDataFrame([("1 кг",), ("1000 г",), ("вес 1,5 кг нетто",), ("7 л",), (None,)], "s string")
    got = [r.x for r in df.select(features.normalize_units(F.col("s"))["norm"].alias("x")).collect()]
    assert got[0].strip() == got[1].strip() == "1e3g" and got[4] == ""
    assert all(len(a) == len(b.s or "") for a, b in zip(got, df.collect()))


def test_structured_diff_golden(spark):
    items = spark.createDataFrame([(1, "a", "c", '{"бренд":"Ёлка","масса":"1500 г","цвет":"красный"}'), (2, "b", "c", '{"brand":"елка","вес":"1500 г","цвет товара":"синий"}'), (3, "d", "c", '{"цвет":"черный"}')], "id long, name string, category string, attributes string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id1 long, id2 long")
    got = {(r.id2, r.grp): r.state for r in features.structured_diff(pairs, items).collect()}
    assert got[2, "brand"] == "match" and got[2, "weight"] == "match" and got[2, "colour"] == "differ" and got[3, "article"] == "unknown"


def test_pair_features_are_symmetric(t):
    codes = features.category_codes(t.items)
    cosine = features.tfidf_cosine(t.pairs, t.items, features.fit_idf(t.items))
    turned = t.pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"))
    a = {(r.id1, r.id2): r for r in features.pair_features(t.pairs, t.items, codes, cosine).collect()}
    b = {(r.id2, r.id1): r for r in features.pair_features(turned, t.items, codes).collect()}
    names = [c for c in next(iter(a.values())).asDict() if c not in ("id1", "id2", "name_cosine")]
    assert len(names) == 21 and all(math.isclose(float(a[k][c]), float(b[k][c]), abs_tol=1e-9) for k in a for c in names)
    lost = features.pair_features(t.pairs.limit(1).withColumn("id2", F.lit(-5).cast("long")), t.items, codes).first()
    assert lost.known is False and lost.name_equal == 0


def test_attribute_vocabularies_cap_after_filter(spark):
    items = spark.createDataFrame([(1, "n", "c", '{"a":"","b":"x y","c":"z"}')], "id long, name string, category string, attributes string")
    got = {(r.kind, r.token): r.n for r in features.attribute_vocabularies(items, slots=1).collect()}
    assert got == {("key", "b"): 1, ("value", "x"): 1, ("value", "y"): 1}


# Graph and splits


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components_of_shapes(spark, shape):
    rng = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(70)], "star": [(0, i) for i in range(1, 80)], "random": [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)], "empty": []}[shape]
    rng.shuffle(edges)
    got = connected_components(spark.createDataFrame([(b, a) for a, b in edges] + [(5, 5)] * bool(edges) + [(None, 3)] * bool(edges), "id1 long, id2 long")).collect()
    assert {r.id: r.component for r in got} == components([*edges, (5, 5), (3, 3)] if edges else [])


def test_closure_is_idempotent(spark):
    rows = [(1, 2, 1), (2, 3, 1), (4, 5, 1), (5, 6, 1), (3, 4, 0), (7, 8, 1), (8, 9, 1), (7, 9, 0)]
    pairs = spark.createDataFrame([(a, b, y, 0) for a, b, y in rows], "id1 long, id2 long, target int, fold int")
    first = graph.closure_pairs(pairs)
    assert {(r.id1, r.id2) for r in first.where("target = 1").collect()} == {(1, 3), (4, 6)}
    assert first.where("target = 0").count() == 8
    again = graph.closure_pairs(pairs.unionByName(first.select("id1", "id2", F.col("target").cast("int").alias("target"), F.col("fold").cast("int").alias("fold"))))
    assert again.count() == 0
    rejected = spark.createDataFrame([(1, 3)], "id1 long, id2 long")
    assert graph.closure_pairs(pairs, rejected).where("target = 1").count() == 1
    with pytest.raises(ValueError):
        graph.closure_pairs(pairs, max_size=2)


def test_stratified_folds_by_rule(t):
    loads = splits.component_loads(t.pairs, connected_components(t.pairs)).cache()
    a = {(r.category, r.component): r.fold for r in splits.stratified_fold(loads, "s", 4).collect()}
    assert len(a) == loads.count()
    by = {}
    for r in loads.collect():
        by.setdefault(r.category, []).append((-r.pairs, hashlib.sha256(f"s:{r.component}".encode()).hexdigest(), r.component, r.positives))
    for category, rows in by.items():
        n, m = -sum(x[0] for x in rows) / 4, max(sum(x[3] for x in rows) / 4, 1.0)
        p, q = [0] * 4, [0] * 4
        for size, _, c, pos in sorted(rows):
            f = min(range(4), key=lambda i: (max((p[i] - size) / n, (q[i] + pos) / m), i))
            p[f], q[f] = p[f] - size, q[f] + pos
            assert a[category, c] == f
    built = splits.build_folds(t.pairs, "s", 4, stratified=True)
    items = built.select(F.explode(F.array("id1", "id2")).alias("id"), "fold").groupBy("id").agg(F.count_distinct("fold").alias("n"))
    assert built.count() == t.pairs.count() and items.where("n > 1").count() == 0


def test_a_component_of_two_categories_has_one_fold(spark):
    pairs = spark.createDataFrame([(1, 2, "a", 1), (2, 3, "b", 0), (3, 4, "b", 1), (10, 11, "a", 0), (20, 21, "b", 1)], "id1 long, id2 long, category string, target int")
    loads = splits.component_loads(pairs, connected_components(pairs))
    assert sorted(map(tuple, loads.collect())) == [("a", 10, 1, 0), ("b", 1, 3, 2), ("b", 20, 1, 1)]
    built = splits.build_folds(pairs, "s", 2, stratified=True)
    assert built.count() == 5 and built.where("component = 1").select("fold").distinct().count() == 1


def test_repeated_keys_fail(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id long, name string")
    pairs = spark.createDataFrame([(1, 2)], "id1 long, id2 long")
    once = items.where("name <> 'z'")
    assert [tuple(r) for r in joins.attach_items(pairs, once, ["name"]).select("name1", "name2").collect()] == [("x", "y")]
    assert files.scan_needed_items(once, pairs)[0].count() == 2
    scores = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.5)], "id1 long, id2 long, predict double")
    assert joins.join_scores(pairs, scores.limit(1)).first().predict == 0.5
    for failing in (lambda: joins.attach_items(pairs, items, ["name"]), lambda: files.scan_needed_items(items, pairs)[0], lambda: joins.join_scores(pairs, scores)):
        with pytest.raises(Exception, match="repeated id"):
            failing().collect()


def test_strict_reads_fail(spark, tmp_path):
    schema, good = "id1 long, id2 long, target double", [(1, 2, 0.5), (1, 3, 1.0)]
    cases = {"ok": good, "repeated": [*good, (1, 2, 0.1)], "nan": [*good, (4, 5, float("nan"))], "inf": [*good, (4, 5, float("inf"))], "null": [*good, (4, 5, None)], "key": [*good, (None, 5, 0.1)]}
    for name, rows in cases.items():
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.option("header", True).csv(path)
        if name == "ok":
            assert files.read_strict(spark, path, schema, ["id1", "id2"]).count() == 2
        else:
            with pytest.raises(ValueError):
                files.read_strict(spark, path, schema, ["id1", "id2"])
    with pytest.raises(ValueError):
        contracts.strict(spark.createDataFrame([], schema), ["id1", "id2"], ["target"])


def test_changed_data_are_refused(t):
    rows = t.folded.select("fold", "id1", "id2", "target")
    known = files.fingerprint(rows, ["fold"])
    assert files.require_fingerprint(rows, ["fold"], known) is rows
    for changed in (rows.where("id1 > 3"), rows.withColumn("target", F.lit(1)), rows.where("fold <> 1")):
        with pytest.raises(ValueError, match="fingerprint"):
            files.require_fingerprint(changed, ["fold"], known)


def test_soft_negatives_golden(spark):
    rows = [(i, i + 100, "c", 2, 0, float(i)) for i in range(10)] + [(50, 150, "c", 1, 0, 999.0)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, category string, fold int, target int, predict double")
    got = splits.soft_negatives(df, 1, 0.2).collect()
    assert {r.id1 for r in got if r.arm == "soft"} == {8, 9} and sum(r.arm == "control" for r in got) == 2
    assert splits.hash_route(df, 4).where("route not between 0 and 3").count() == 0


# Metrics, blends, controls


def test_average_precision_properties(t):
    scored = t.scored.where("model = 'm1'")
    ap = lambda df: metrics.average_precision(df, ["model"]).first()
    base = ap(scored)
    assert ap(scored.withColumn("predict", F.col("target").cast("double"))).ap == pytest.approx(1)
    assert ap(scored.withColumn("predict", F.lit(0.1))).ap == pytest.approx(base.positives / base.n_rows)
    assert ap(scored.withColumn("predict", F.exp(3 * F.col("predict")))).ap == pytest.approx(base.ap)
    assert ap(scored.orderBy(F.desc("id2"))).ap == pytest.approx(base.ap)
    assert ap(scored.where("target = 0")).ap is None


def test_blends(t, wide):
    a = blend.blend(t.scores, {"m1": 1, "m2": 3})
    b = blend.blend(t.scores, {"m1": 10, "m2": 30})
    assert a.join(b.withColumnRenamed("predict", "p"), ["id1", "id2"]).where("abs(predict - p) > 1e-12").count() == 0
    grid = blend.simplex(3)
    assert len(grid) == 15 and len(blend.simplex(5)) == 70
    ap = blend.grid_ap(wide, ["m1", "m2", "m3"], grid).cache()
    chosen = blend.choose_weights(ap, blend.grid_table(wide.sparkSession, grid), [0, 1, 2, 3])
    rows = ap.where("ap is not null").collect()
    for r in chosen.collect():
        mean = {}
        for x in rows:
            if x.category == r.category and x.fold != r.held:
                mean.setdefault(x.point, []).append(x.ap)
        best = max(sum(v) / len(v) for v in mean.values())
        assert sum(mean[r.point]) / len(mean[r.point]) == pytest.approx(best, abs=2e-9)
    out = blend.nested_blend(wide, ["m1", "m2", "m3"], chosen, 0.0).join(wide.select("id1", "id2", ((F.col("m1") + F.col("m2") + F.col("m3")) / 3).alias("e")), ["id1", "id2"])
    assert out.where("abs(predict - e) > 1e-9").count() == 0
    screen = {r.candidate: r for r in blend.residual_screen(wide, "m1", ["m1", "m2"], [0, 1, 2, 3]).collect()}
    assert screen["m1"].mean_weight == 0 and screen["m1"].delta == 0


def test_stack_and_calibration(t, wide):
    scored, coefficients = blend.fit_stack(wide, ["m1", "m2", "m3"], [0, 1, 2, 3])
    assert scored.count() == wide.count() and [f for f, _, _ in coefficients] == [0, 1, 2, 3, None]
    stable = {r.model: r for r in blend.weight_stability(wide.sparkSession, ["m1", "m2", "m3"], coefficients).collect()}
    assert stable["m1"].final == coefficients[4][2][0] and sum(r.share for r in stable.values()) == pytest.approx(1)
    assert stable["m2"].mean == pytest.approx(sum(c[2][1] for c in coefficients[:4]) / 4) and stable["m2"].std >= 0
    for transform in ("prob", "rank"):
        got, cs = blend.fit_stack(wide, ["m1", "m2", "m3"], [0, 1, 2, 3], transform=transform)
        same = blend.apply_stack(wide, ["m1", "m2", "m3"], cs[1][1], cs[1][2], transform=transform).where("fold = 1").select("id1", "id2", F.col("predict").alias("p"))
        assert got.where("fold = 1").join(same, ["id1", "id2"]).where("abs(predict - p) <= 1e-9").count() == same.count() > 0
    with pytest.raises(ValueError):
        blend.stack_inputs(wide, ["m1"], "cube")
    held, intercept, cs = coefficients[0]
    again = blend.apply_stack(wide.where(F.col("fold") == held), ["m1", "m2", "m3"], intercept, cs).select("id1", "id2", F.col("predict").alias("p"))
    assert scored.join(again, ["id1", "id2"]).where("abs(predict - p) > 1e-9").count() == 0
    iso = blend.isotonic_by_fold(wide.select("id1", "id2", "fold", "target", F.col("m1").alias("predict")))
    assert iso.where("calibrated not between 0.001 and 0.999").count() == 0
    pairs = iso.groupBy("fold").agg(F.corr("predict", "calibrated").alias("c")).collect()
    assert all(r.c is None or r.c >= 0 for r in pairs)


def test_diffusion_keeps_lone_edges(spark):
    df = spark.createDataFrame([(1, 2, "c", 0.1, None), (3, 4, "c", 0.9, 0.2), (4, 5, "c", 0.5, 0.9)], "id1 long, id2 long, category string, predict double, mean_hi double")
    got = {r.id1: r.diffused for r in graph.diffuse(df, 0.5).collect()}
    assert got[1] == 0 and got[3] == pytest.approx(0.75) and got[4] == pytest.approx(0.75)


def test_controls(t, wide):
    got = {r.control: r for r in resample.permutation_controls(wide, "m1", "m2", 6).collect()}
    assert got["target"].mean_delta > got["real"].mean_delta and got["target"].mean_delta > got["permuted"].mean_delta
    shuffled = resample.permute_within(wide, ["fold", "category"], "m1", 3)
    a = wide.groupBy("fold", "category").agg(F.sort_array(F.collect_list("m1")).alias("v"))
    b = shuffled.groupBy("fold", "category").agg(F.sort_array(F.collect_list("m1")).alias("w"))
    assert a.join(b, ["fold", "category"]).where("v <> w").count() == 0 and shuffled.count() == wide.count()
    comp = connected_components(t.pairs).withColumnRenamed("id", "id1")
    boot = resample.cluster_bootstrap(wide.join(comp, "id1"), "m1", "m2", "component", 60).first()
    ap = {r.model: r.ap for r in metrics.average_precision(t.scored, ["model"]).collect()}
    assert boot.low <= boot.mean_delta <= boot.high and abs(boot.mean_delta - (ap["m2"] - ap["m1"])) < 0.1
    same = resample.cluster_bootstrap(wide.join(comp, "id1"), "m1", "m1", "component", 5).first()
    assert same.mean_delta is None or same.mean_delta == 0
    deltas = wide.sparkSession.createDataFrame([("a", 0.1), ("b", 0.3), ("c", 0.2)], "category string, delta double")
    r = resample.category_bootstrap(deltas, 4000).first()
    assert 0.1 <= r.low < r.mean < r.high <= 0.3 and abs(r.mean - 0.2) < 0.01
    labels = {r.labels: r.ap for r in resample.selection_control(wide, ["m1", "m2", "m3"], [0, 1, 2, 3]).collect()}
    assert set(labels) == {"real", "permuted", "random"}


def test_tree_models_rank_above_chance(t):
    from pairlab.plans.modelling import training_rows

    x, columns = training_rows(t)
    x = x.where("not train_only")
    x = x.withColumn("signal", F.col("target") + (F.col("id1") % 7) / 7.0)
    got, importance = blend.train_oof(x, [*columns, "signal"], [0, 1], rounds=3, depth=2)
    best = {r.fold: r.feature for r in importance.groupBy("fold").agg(F.max_by("feature", "importance").alias("feature")).collect()}
    assert best == {0: "signal", 1: "signal"}
    ap = metrics.average_precision(got.withColumn("g", F.lit(0)), ["g"]).first()
    assert got.count() == x.where("fold in (0, 1)").count() and ap.ap > 0.9


def test_derived_pairs_train_but_are_not_scored(t):
    from pairlab.plans.modelling import training_rows

    x, columns = training_rows(t)
    x = x.withColumn("train_only", F.col("id1") % 5 == 0)
    got = blend.train_oof(x, columns[:3], [0], "weight", rounds=1, depth=1)[0]
    assert got.count() == x.where("fold = 0 and id1 % 5 <> 0").count() > 0


def test_graph_columns_that_carry_the_label_lose_it_when_shuffled(t):
    rows = t.folded.withColumns({"score": F.rand(3), "g": F.col("target") + F.rand(4) / 10, "h": F.col("id1") % 3})
    got = resample.graph_model(rows, ["score"], ["g", "h"], [0, 1], rounds=2, depth=2)
    ap = {r.control: r.ap for r in metrics.average_precision(got, ["control"]).collect()}
    assert ap["graph"] > 0.95 and ap["shuffled"] < 0.6


def test_scores_of_any_scale_spread_over_ranges(spark):
    inf = float("inf")
    xs = [-inf, -1e300, -50.0, -3.2, -1.0, -1e-300, 0.0, 5e-324, 1e-9, 0.002, 0.0039, 0.25, 0.5, 0.9, 0.998, 0.9999999, 1.0, 1.0000001, 7.5, 1e6, 1e300, inf, float("nan")]
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", metrics.score_range(F.col("x")).alias("r")).orderBy("i").collect()]
    assert got == sorted(got) and one(spark.range(1), metrics.score_range(F.lit(None).cast("double"))) < got[0]
    logits = spark.range(20000).select(metrics.score_range((F.col("id") - 10000) / 1000.0).alias("r"))
    assert logits.groupBy("r").count().agg(F.max("count")).first()[0] < 1000


def test_leaks_and_open_chains_raise(spark):
    pairs = spark.createDataFrame([(1, 2, 1, 0), (2, 3, 1, 1)], "id1 long, id2 long, target int, fold int")
    with pytest.raises(Exception, match="crosses folds"):
        graph.closure_pairs(pairs).collect()
    line = spark.createDataFrame([(i, i + 1, 1) for i in range(6)], "id1 long, id2 long, target int")
    far = spark.createDataFrame([(0, 6)], "id1 long, id2 long")
    assert graph.shortest_chains(line, far).first().steps == 6
    with pytest.raises(ValueError, match="longer than 3"):
        graph.shortest_chains(line, far, max_steps=3)


def test_sizes_and_dimensions(spark):
    df = spark.createDataFrame([(1, "Коврик 10,5х20 см, размер XL / 42 EU")], "id long, name string")
    assert {(r.family, r.value) for r in features.extract_sizes(df).collect()} == {("dimension", "10.5x20cm"), ("size", "sz=xl"), ("size", "eu=42")}
    text = one(df, features.normalize_units(F.col("name"))["norm"])
    assert text.startswith("Коврик 10.5x20cm ,") and "sz=xl" in text and "eu=42" in text and len(text) == len(df.first().name)


def test_numeric_groups_compare_quantities(spark):
    items = spark.createDataFrame([(1, "a", "c", '{"вес":"1,5 кг","объем":"1 л","длина":"10 см","ширина":"4"}'), (2, "b", "c", '{"масса нетто":"1500 г","объем":"500 мл","длина":"12 см","ширина":"4"}'), (3, "d", "c", '{"ширина":"4 мм","страна бренда":"x","вес":"много"}')], "id long, name string, category string, attributes string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "id1 long, id2 long")
    got = {(r.id1, r.id2, r.grp): r.state for r in features.structured_diff(pairs, items).collect()}
    assert got[1, 2, "weight"] == "match" and got[1, 2, "volume"] == "differ" and got[1, 2, "other_numbers"] == "differ_1"
    assert got[1, 3, "weight"] == "differ" and got[1, 3, "brand"] == "unknown" and got[2, 9, "other_numbers"] == "unknown"


def test_random_audits_leave_judged_pairs_out(t):
    got = audit.audit_queue("random", t.scored, 20, journal=t.verdicts)
    assert got.count() == 20 and got.join(t.verdicts, ["id1", "id2"], "left_semi").count() == 0
    with pytest.raises(ValueError):
        audit.audit_queue("nothing", t.scored, 5)


# Large groups, classes, the keyed table


def test_places_in_one_group_are_spread(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("id1"), (F.col("id") % 7).alias("id2"), F.lit("one").alias("category"), (F.xxhash64("id") % 50).cast("double").alias("predict"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with partitions of a useful size
    placed = ranks.place_in_group(df, ["category"], ["predict", "id1", "id2"])
    most = placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most <= 0.6 * n  # of 4 partitions
    want = {r.id1: k for k, r in enumerate(sorted(df.collect(), key=lambda r: (r.predict, r.id1)), 1)}
    assert {r.id1: r._place for r in placed.collect()} == want
    average = ranks.rank_average_pct(df, ["category"])
    values = [r.predict for r in df.collect()]
    share = {v: (sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2) / n for v in set(values)}
    assert all(abs(r["rank"] - share[r.predict]) < 1e-12 for r in average.collect())
    assert ranks.rank_ordinal(df.where("false"), ["category"]).count() == 0


def test_places_take_null_groups_and_ties(spark):
    df = spark.createDataFrame([(1, 1, None, 0.5), (2, 1, None, None), (3, 1, "a", 0.5), (4, 1, None, 0.5)], "id1 long, id2 long, category string, predict double")
    assert {r.id1: r["rank"] for r in ranks.rank_ordinal(df, ["category"]).collect()} == {2: 0, 1: 0.5, 4: 1, 3: 0}
    assert {r.id1: r["rank"] for r in ranks.rank_average_pct(df, ["category"]).collect()} == pytest.approx({2: 1 / 3, 1: 2.5 / 3, 4: 2.5 / 3, 3: 1})


def test_quantiles_from_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.randrange(9))) for _ in range(500)]
    counts = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("m"))
    got = {r.g: r for r in ranks.quantiles_of_counts(counts, ["g"], "v", "m", {"low": 0.01, "mid": 0.5, "top": 1.0}).collect()}
    for g in "ab":
        values = sorted(v for x, v in rows if x == g)
        for name, q in (("low", 0.01), ("mid", 0.5), ("top", 1.0)):
            k = (len(values) - 1) * q
            want = values[int(k)] + (values[min(int(k) + 1, len(values) - 1)] - values[int(k)]) * (k - int(k))
            assert got[g][name] == pytest.approx(want)


def test_only_needed_items_are_shuffled(spark):
    items = spark.range(5000).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    pairs = spark.createDataFrame([(1, 2), (3, 99_999)], "id1 long, id2 long")
    plan = joins.attach_items(pairs, items, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "LeftSemi" in plan
    twice = items.union(items.where("id > 10"))
    assert {(r.name1, r.name2) for r in joins.attach_items(pairs, twice, ["name"]).collect()} == {("n1", "n2"), ("n3", None)}
    assert joins.needed_items(items, pairs, sent=1).count() == joins.needed_items(items, pairs).count() == 3
    needed, missing = files.scan_needed_items(twice, pairs)
    assert needed.count() == 3 and [r.id for r in missing.collect()] == [99_999]


def test_closure_classes_count_what_closure_pairs_lists(spark, t):
    for pairs, rejected in ((t.folded, None), (t.folded, t.folded.where("target = 1").limit(3))):
        members, classes, links = graph.closure_classes(pairs, rejected)
        listed = graph.closure_pairs(pairs, rejected).groupBy("target").count().collect()
        assert {r.target: r["count"] for r in listed} == {1: classes.agg(F.sum("derived")).first()[0], 0: links.agg(F.sum("derived")).first()[0]}
        both = graph.pairs_of(members, links.limit(5))
        assert both.groupBy("c1", "c2").count().join(links, ["c1", "c2"]).where("count <> labelled + derived").count() == 0


def test_a_class_is_a_row_whatever_its_size(spark):
    star = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("id1"), F.col("id").alias("id2"), F.lit(1).alias("target"), F.lit(0).alias("fold"))
    members, classes, links = graph.closure_classes(star)
    assert [tuple(r) for r in classes.collect()] == [(0, 0, 20_001, 20_000, 20_001 * 20_000 // 2 - 20_000)] and links.count() == 0 and members.count() == 20_001
    with pytest.raises(Exception, match="crosses folds"):
        graph.closure_classes(star.withColumn("fold", (F.col("id2") % 2).cast("int")))[1].collect()


def test_journal_table_takes_late_and_repeated_batches(spark, tmp_path):
    rows = [(i % 6, i % 4, (i * 7) % 3 - 1, i % 2, "m", i) for i in range(60)]
    out = str(tmp_path / "table")
    batches = [rows[40:], rows[:20], rows[20:40]]
    for k, batch in enumerate(batches):
        stream.merge(spark.createDataFrame(batch, JOURNAL), k, out, buckets=4)
        last = {}
        for r in sorted(sum(batches[: k + 1], []), key=lambda r: r[5]):
            last[r[:2]] = r
        assert {tuple(r) for r in stream.read_table(spark, out).collect()} == set(last.values())
        now = stream.growth(spark, out).orderBy(F.desc("version")).first()
        assert tuple(now) == (k, len(last), sum(r[2] >= 0 and r[2] != r[3] for r in last.values()))
    before = {tuple(r) for r in stream.read_table(spark, out, 1).collect()}
    stream.merge(spark.createDataFrame(batches[2], JOURNAL), 2, out, buckets=4)
    assert {tuple(r) for r in stream.read_table(spark, out).collect()} == set(last.values())
    stream.merge(spark.createDataFrame([(100, 200, 1, 0, "m", 999)], JOURNAL), 3, out, buckets=4)
    plan = [f for f in stream.read_table(spark, out).inputFiles()]
    assert len([f for f in plan if "version=3" in f]) == 1 and {tuple(r) for r in stream.read_table(spark, out, 1).collect()} == before
    assert stream.read_table(spark, str(tmp_path / "none")).count() == 0


def test_isotonic_map_is_that_of_one_pass(spark):
    rng = random.Random(8)
    rows = [(k, k, f, int(rng.random() < x), x) for f in (0, 1) for k, x in enumerate(round(rng.random(), 2) * rng.choice([1, 1, 7, -3]) for _ in range(400))]
    df = spark.createDataFrame([*rows, (9, 9, 0, 1, None), (8, 8, 0, 1, float("nan"))], "id1 long, id2 long, fold int, target int, predict double")
    got = {(r.fold, r.id1, r.predict): r.calibrated for r in blend.isotonic_by_fold(df).collect()}
    for f in (0, 1):
        blocks = {}
        for *_, y, x in (r for r in rows if r[2] == f):
            blocks.setdefault(x, []).append(y)
        stack = []
        for x in sorted(blocks):
            stack.append([[x], sum(blocks[x]), len(blocks[x])])
            while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
                xs, t, n = stack.pop()
                stack[-1] = [stack[-1][0] + xs, stack[-1][1] + t, stack[-1][2] + n]
        want = {x: min(max(t / n, 0.001), 0.999) for xs, t, n in stack for x in xs}
        assert all(got[f, r[0], r[4]] == pytest.approx(want[r[4]]) for r in rows if r[2] == f)
    assert got[0, 9, None] is None


def test_chains_meet_in_the_middle(spark):
    rng = random.Random(6)
    edges = {tuple(sorted((rng.randrange(25), rng.randrange(25)))) for _ in range(32)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    wanted = [(a, b) for a in range(25) for b in range(a + 1, 25)]

    def shortest(a, b):
        paths = [[a]]
        for _ in range(25):
            if hit := [p for p in paths if p[-1] == b]:
                return min(hit)
            best = {}
            for p in paths:
                for x in near.get(p[-1], ()):
                    if x not in p and (x not in best or p + [x] < best[x]):
                        best[x] = p + [x]
            paths = list(best.values())

    pairs = spark.createDataFrame([(a, b, 1) for a, b in edges if a != b], "id1 long, id2 long, target int")
    got = {(r.id1, r.id2): r.path for r in graph.shortest_chains(pairs, spark.createDataFrame(wanted, "id1 long, id2 long")).collect()}
    assert got == {(a, b): p for a, b in wanted if (p := shortest(a, b))}


def test_unit_edits_overlap_and_width(spark):
    cases = {
        "0,5 кг и 10 шт.": [("0,5 кг", "500g  ", "000g  ", "mass")], "размер 42 EU": [("размер 42", "sz=42    ", "sz=92    ", "fashion_size")], "100 г": [("100 г", "100g ", "600g ", "mass")],
        "Size: XL, 1000 KG": [("Size: XL", "sz=xl   ", "lz=xl   ", "fashion_size"), ("1000 KG", "1e6g   ", "6e6g   ", "mass")], "10x20 см 5 л": [("10x20 см", "10x20cm ", "60x20cm ", "dimension")],
        "1500 мл": [("1500 мл", "1500ml ", "6500ml ", "volume")], "007 граммов": [("007 граммов", "7g         ", "2g         ", "mass")], "х5кг": [], "": [], None: [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    for r in df.select("s", features.normalize_units(F.col("s")).alias("x")).collect():
        assert [(e.source, e.normalized, e.corrupted, e.family) for e in r.x.edits] == cases[r.s] or r.s in ("0,5 кг и 10 шт.", "10x20 см 5 л")
        norm, bad = r.s or "", r.s or ""
        for e in r.x.edits:
            assert (r.s or "")[e.start : e.end] == e.source and len(e.normalized) == len(e.corrupted) == len(e.source) and e.normalized != e.corrupted
            norm, bad = norm[: e.start] + e.normalized + norm[e.end :], bad[: e.start] + e.corrupted + bad[e.end :]
        assert (r.x.norm, r.x.corrupt) == (norm, bad)


def test_stack_fits_have_no_slope(wide):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    models = ["m1", "m2", "m3"]
    fits = blend.fit_stack(wide, models, [0, 1, 2, 3])[1]
    assert [f for f, *_ in fits] == [0, 1, 2, 3, None]
    rows = VectorAssembler(inputCols=[f"x_{m}" for m in models], outputCol="x").transform(blend.stack_inputs(wide, models, "logit")).withColumn("label", F.col("target").cast("double")).where("fold <> 2")
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1 / rows.count(), standardization=False, maxIter=200, tol=1e-12).fit(rows)
    assert [fits[2][1], *fits[2][2]] == pytest.approx([model.intercept, *model.coefficients], abs=1e-5)


def test_stratified_fold_deals_a_category_as_one_sequence_whatever_the_plan(spark):
    rows = [("ab"[i % 2], i, 1 + i * 7 % 5, i * 3 % 2) for i in range(4000)]
    components = spark.createDataFrame(rows, "category string, component long, pairs long, positives long").repartition(8, "component")
    want = {}
    for category in "ab":
        mine = [x for x in rows if x[0] == category]
        share_p, share_t = sum(x[2] for x in mine) / 4, max(sum(x[3] for x in mine) / 4, 1.0)
        p, q = [0] * 4, [0] * 4
        for _, component, n, m in sorted(mine, key=lambda x: (-x[2], hashlib.sha256(f"s:{x[1]}".encode()).hexdigest())):
            f = min(range(4), key=lambda i: (max((p[i] + n) / share_p, (q[i] + m) / share_t), i))
            p[f], q[f], want[component] = p[f] + n, q[f] + m, f
    # The shares are found small while the join runs, as with large tables.
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert {r.component: r.fold for r in splits.stratified_fold(components, "s", 4).collect()} == want
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_items_of_unknown_size_meet_pairs_by_a_shuffle(spark, t):
    pairs = t.pairs.select("id1", "id2", "target")
    idf = features.fit_idf(t.items)
    frames = [joins.attach_items(pairs, t.items, ["name"]), features.structured_diff(pairs, t.items), features.tfidf_cosine(pairs, t.items, idf), features.baseline_scores(pairs, t.items), features.pair_features(pairs, t.items, features.category_codes(t.items), features.tfidf_cosine(pairs, t.items, idf))]
    for df in frames:
        assert not any("Generate" in x or "p_name" in x or "p_brand" in x for x in sent(df))
    ids = spark.range(5)
    assert not sent(joins.semi_join(spark.range(9), ids, sent=4)) and len(sent(joins.semi_join(spark.range(9), ids, sent=5))) == 1


def test_tree_fits_read_few_partitions_side_by_side(spark, monkeypatch):
    rows = spark.range(400).repartition(64, "id").select(F.col("id").alias("id1"), F.col("id").alias("id2"), (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("target"), (F.col("id") % 3).cast("double").alias("signal"))
    seen, waiting = [], threading.Barrier(2, timeout=60)

    def fit(self, df, fit=blend.GBTClassifier.fit):
        waiting.wait()  # breaks if one fit waits for the other to end
        seen.append(df.rdd.getNumPartitions())
        return fit(self, df)

    monkeypatch.setattr(blend.GBTClassifier, "fit", fit)
    got, importance = blend.train_oof(rows, ["signal"], [0, 1], rounds=1, depth=1)
    assert len(seen) == 2 and max(seen) <= 4 and got.count() == 400 and {r.fold for r in importance.collect()} == {0, 1}
    assert got.agg(F.min(F.when(F.col("target") == 1, F.col("predict")))).first()[0] > got.agg(F.max(F.when(F.col("target") == 0, F.col("predict")))).first()[0]
