"""The pair graph: components, contradictions, closure, chains and link features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.operators import ranks
from pairlab.operators.components import checkpointed, connected_components
from pairlab.operators.joins import unordered_anti


def positive_components(pairs: DataFrame) -> DataFrame:
    """(id, component) over target = 1 edges; items seen only in other pairs are components of their own."""
    found = connected_components(pairs.where("target = 1"))
    items = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct()
    return items.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def on_edges(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs plus c1, c2: the components of both ends."""
    return pairs.join(comp.select(F.col("id").alias("id1"), F.col("component").alias("c1")), "id1").join(comp.select(F.col("id").alias("id2"), F.col("component").alias("c2")), "id2")


def component_stats(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(component, nodes, edges, cyclomatic, positive_rate)."""
    nodes = comp.groupBy("component").agg(F.count("*").alias("nodes"))
    edges = on_edges(pairs, comp).where("c1 = c2").groupBy(F.col("c1").alias("component")).agg(F.count("*").alias("edges"), F.avg("target").alias("positive_rate"))
    return nodes.join(edges, "component", "left").select("component", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), (F.coalesce("edges", F.lit(0)) - F.col("nodes") + 1).alias("cyclomatic"), "positive_rate")


def size_histogram(stats: DataFrame) -> DataFrame:
    """(nodes, components, positive_rate): how many components have so many nodes, and their mean positive rate."""
    return stats.groupBy("nodes").agg(F.count("*").alias("components"), F.avg("positive_rate").alias("positive_rate"))


def contradictions(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """(id1, id2, component): negative edges within a positive component."""
    return on_edges(pairs.where("target = 0"), comp).where("c1 = c2").select("id1", "id2", F.col("c1").alias("component"))


def clean_components(pairs: DataFrame, comp: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(component, size): positive components without a negative edge or a rejected pair inside."""
    bad = contradictions(pairs, comp).select("component")
    if rejected is not None:
        bad = bad.unionByName(on_edges(rejected.select("id1", "id2"), comp).where("c1 = c2").select(F.col("c1").alias("component")))
    return comp.groupBy("component").agg(F.count("*").alias("size")).join(bad.distinct(), "component", "left_anti")


def closure_classes(pairs: DataFrame, rejected: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The closure without its pairs: (members, classes, links).

    members (id, component): a row for each item of a clean positive component. classes (component, fold, size,
    labelled, derived): derived is the number of pairs of a class that closure_pairs would give as positives.
    links (c1, c2, fold, labelled, derived): classes between which a negative edge stands, c1 < c2, and the
    negatives it would give. A class is a row whatever its size, a link is one whatever the sizes at its ends;
    pairs_of lists the pairs of those that are wanted. Items of a class or link in different folds would be a
    leak, so that raises.
    """
    comp = checkpointed(positive_components(pairs))
    clean = clean_components(pairs, comp, rejected)
    members = comp.join(clean.select("component"), "component").select("id", "component")
    folds = pairs.select(F.explode(F.array("id1", "id2")).alias("id"), "fold").distinct()
    at = members.join(folds, "id").groupBy("component").agg(F.min("fold").alias("fold"), F.max("fold").alias("other"))
    leak = F.raise_error("a derived pair crosses folds").cast("boolean")
    edges = on_edges(pairs.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "target"), comp)
    edges = edges.where("id1 <> id2").groupBy("id1", "id2").agg(F.least(F.min("c1"), F.min("c2")).alias("c1"), F.greatest(F.min("c1"), F.min("c2")).alias("c2"), F.count_if(F.col("target") == 0).alias("negative"))
    between = edges.groupBy("c1", "c2").agg(F.count("*").alias("labelled"), F.sum("negative").alias("negative"))
    inside = between.where("c1 = c2").select(F.col("c1").alias("component"), "labelled")
    classes = clean.join(at, "component").where(F.when((F.col("size") >= 3) & (F.col("fold") != F.col("other")), leak).otherwise(True)).join(inside, "component", "left")
    labelled = F.coalesce("labelled", F.lit(0))
    classes = checkpointed(classes.select("component", "fold", "size", labelled.alias("labelled"), F.when(F.col("size") >= 3, F.expr("size * (size - 1) div 2") - labelled).otherwise(0).cast("bigint").alias("derived")))
    one, two = (classes.select(F.col("component").alias(f"c{s}"), F.col("size").alias(f"n{s}"), F.col("fold").alias(f"f{s}")) for s in "12")
    links = between.where("c1 <> c2 and negative > 0").join(one, "c1").join(two, "c2").where(F.when(F.col("f1") != F.col("f2"), leak).otherwise(True))
    return members, classes, links.select("c1", "c2", F.col("f1").alias("fold"), "labelled", (F.col("n1") * F.col("n2") - F.col("labelled")).alias("derived"))


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id1, id2, c1, c2): the item pairs of wanted links (c1, c2; a class with itself for its own pairs), id1 < id2, labelled ones among them."""
    one, two = (members.select(F.col("id").alias(f"id{s}"), F.col("component").alias(f"c{s}")) for s in "12")
    pairs = links.select("c1", "c2").distinct().join(one, "c1").join(two, "c2").where("c1 <> c2 or id1 < id2")
    return pairs.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "c1", "c2")


def closure_pairs(pairs: DataFrame, rejected: DataFrame | None = None, max_size: int | None = None) -> DataFrame:
    """(id1, id2, target, fold): derived pairs.

    Positives join two items of a clean positive component of three or more; negatives join two clean components
    between which a negative edge stands. A component is clean without a negative edge or a rejected pair
    (id1, id2) inside it. Labelled pairs, in either order, are left out; positives win over negatives. A pair across
    folds would be a leak, so it raises. The output is quadratic in a component's size: with max_size, a larger
    component raises.
    """
    comp = checkpointed(positive_components(pairs))
    clean = clean_components(pairs, comp, rejected)
    if max_size is not None and (most := clean.agg(F.max("size")).first()[0] or 0) > max_size:
        raise ValueError(f"a component has {most} items, more than {max_size}")
    folds = pairs.select(F.explode(F.array("id1", "id2")).alias("id"), "fold").groupBy("id").agg(F.min("fold").alias("fold"))
    members = comp.join(clean, "component").join(folds, "id")
    left, right = (members.select("component", F.col("id").alias(f"id{s}"), F.col("fold").alias(f"f{s}"), "size") for s in "12")
    one_fold = F.when(F.col("f1") == F.col("f2"), True).otherwise(F.raise_error("a derived pair crosses folds"))
    positives = left.where("size >= 3").join(right.drop("size"), "component").where("id1 < id2").where(one_fold).select("id1", "id2", F.lit(1).alias("target"), F.col("f1").alias("fold"))
    edges = on_edges(pairs.where("target = 0"), comp).where("c1 <> c2").select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct()
    across = edges.join(left.select(F.col("component").alias("c1"), "id1", "f1"), "c1").join(right.select(F.col("component").alias("c2"), "id2", "f2"), "c2").where(one_fold)
    negatives = across.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), F.lit(0).alias("target"), F.col("f1").alias("fold"))
    derived = positives.unionByName(negatives).groupBy("id1", "id2").agg(F.max("target").alias("target"), F.min("fold").alias("fold"))
    return unordered_anti(derived, pairs).select("id1", "id2", "target", "fold")


def shortest_chains(pairs: DataFrame, derived: DataFrame, max_steps: int = 30) -> DataFrame:
    """(id1, id2, path, steps): the shortest path over positive edges for each derived pair; of equal ones the smallest.

    Searches go from both ends in turn and meet in the middle, so a frontier goes half as far. It keeps one path, the
    smallest, for each (end, node), and only for ends of pairs that are still open. Pairs without a path are absent; a
    search still open after max_steps raises.
    """
    edges = pairs.where("target = 1").select("id1", "id2")
    edges = checkpointed(edges.union(edges.select(F.col("id2"), F.col("id1"))).toDF("a", "b").distinct())
    open_ = checkpointed(derived.select("id1", "id2").distinct())
    ends = {side: open_.select(F.col(side).alias("end")).distinct().withColumns({"node": F.col("end"), "path": F.array("end")}) for side in ("id1", "id2")}
    seen = {side: x.select("end", "node") for side, x in ends.items()}
    found = None
    for step in range(max_steps):
        side = ("id1", "id2")[step % 2]
        near = ends[side].join(open_.select(F.col(side).alias("end")).distinct(), "end", "left_semi")
        longer = F.concat("path", F.array("b")) if side == "id1" else F.concat(F.array("b"), F.col("path"))
        far = near.join(edges, near.node == edges.a).select("end", F.col("b").alias("node"), longer.alias("path"))
        ends[side] = checkpointed(far.groupBy("end", "node").agg(F.min("path").alias("path")).join(seen[side], ["end", "node"], "left_anti"))
        if ends[side].isEmpty():
            break
        seen[side] = checkpointed(seen[side].union(ends[side].select("end", "node")))
        one, two = (ends[s].select(F.col("end").alias(s), "node", F.col("path").alias(f"p{s}")) for s in ("id1", "id2"))
        met = open_.join(one, "id1").join(two, ["id2", "node"]).select("id1", "id2", F.concat("pid1", F.slice("pid2", F.lit(2), F.size("pid2"))).alias("path"))
        hit = checkpointed(met.groupBy("id1", "id2").agg(F.min("path").alias("path")))
        found = hit if found is None else found.union(hit)
        open_ = checkpointed(open_.join(hit, ["id1", "id2"], "left_anti"))
        if open_.isEmpty():
            break
    else:
        if not open_.isEmpty():
            raise ValueError(f"a chain may be longer than {max_steps} steps")
    if found is None:
        found = open_.select("id1", "id2", F.array("id1").alias("path")).limit(0)
    return found.withColumn("steps", (F.size("path") - 1).cast("bigint"))


def closure_queue(derived: DataFrame, chains: DataFrame, scores: DataFrame, journal: DataFrame, comp: DataFrame) -> DataFrame:
    """(id1, id2, predict, size, steps): derived positives without a verdict, by score, then component size, then ids."""
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    size_of = comp.join(sizes, "component").select(F.col("id").alias("id1"), "size")
    open_ = unordered_anti(derived.where("target = 1"), journal)
    out = open_.join(chains.select("id1", "id2", "steps"), ["id1", "id2"], "left").join(scores, ["id1", "id2"], "left").join(size_of, "id1", "left")
    return out.select("id1", "id2", "predict", "size", "steps").orderBy(F.asc_nulls_last("predict"), F.desc("size"), "id1", "id2")


def weakest_link(chains: DataFrame, scores: DataFrame) -> DataFrame:
    """(id1, id2, a, b, predict, weak): the least-scored edge of each chain, flagged below 0.5."""
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("x"), F.get("path", i + 1).alias("y")))
    edges = chains.where("steps >= 1").select("id1", "id2", F.explode(steps).alias("e")).select("id1", "id2", F.least("e.x", "e.y").alias("a"), F.greatest("e.x", "e.y").alias("b"))
    known = scores.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "predict")
    least = edges.join(known, ["a", "b"]).groupBy("id1", "id2").agg(F.min(F.struct("predict", "a", "b")).alias("m"))
    return least.select("id1", "id2", "m.a", "m.b", "m.predict", (F.col("m.predict") < 0.5).alias("weak"))


def link_features(edges: DataFrame) -> DataFrame:
    """(id1, id2, deg_min, deg_max, log_product, common, jaccard, adamic_adar) of distinct undirected edges.

    Common neighbours come from a join of each edge's shorter neighbour list with the edge table, so a hub's
    list is not squared.
    """
    e = edges.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).where("id1 <> id2").distinct()
    both = e.union(e.select("id2", "id1")).toDF("a", "b")
    degree = both.groupBy("a").agg(F.count("*").alias("d"))
    base = e.join(degree.toDF("id1", "d1"), "id1").join(degree.toDF("id2", "d2"), "id2")
    # Walk from the end of smaller degree, look the third node up at the other end.
    ends = base.select("id1", "id2", F.when(F.col("d1") <= F.col("d2"), F.col("id1")).otherwise(F.col("id2")).alias("small"), F.when(F.col("d1") <= F.col("d2"), F.col("id2")).otherwise(F.col("id1")).alias("large"))
    third = ends.join(both.toDF("small", "c"), "small").where("c <> large").join(both.toDF("large", "c"), ["large", "c"], "left_semi")
    common = third.join(degree.toDF("c", "dc"), "c").groupBy("id1", "id2").agg(F.count("*").alias("common"), F.sum(1 / F.ln(F.greatest(F.col("dc"), F.lit(2)))).alias("adamic_adar"))
    out = base.join(common, ["id1", "id2"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.select("id1", "id2", F.least("d1", "d2").alias("deg_min"), F.greatest("d1", "d2").alias("deg_max"), F.ln(1 + F.col("d1") * F.col("d2")).alias("log_product"), "common", (F.col("common") / (F.col("d1") + F.col("d2") - F.col("common"))).alias("jaccard"), F.coalesce("adamic_adar", F.lit(0.0)).alias("adamic_adar"))


def leave_one_out(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(id1, id2, mean_lo, mean_hi, max_lo, max_hi, comp_mean, gap): an edge's neighbours without itself; null if none.

    Means and maxima of the other edges at either end; lo and hi are the least and greatest over the ends. The
    maximum without the edge is the second largest where the edge holds the largest.
    """
    ends = edges.select("id1", "id2", "predict", F.explode(F.array("id1", "id2")).alias("node"))
    edge = F.struct("predict", "id1", "id2")
    stat = ends.groupBy("node").agg(F.sum("predict").alias("s"), F.count("*").alias("n"), F.max(edge).alias("top"))
    met = ends.join(stat, "node").withColumn("is_top", F.struct("predict", "id1", "id2") == F.col("top"))
    second = met.groupBy("node").agg(F.max(F.when(~F.col("is_top"), F.col("predict"))).alias("rest"), F.count_if("is_top").alias("twice"))
    met = met.join(second, "node")
    mean = F.when(F.col("n") > 1, (F.col("s") - F.col("predict")) / (F.col("n") - 1))
    most = F.when(F.col("is_top") & (F.col("twice") == 1), F.col("rest")).otherwise(F.col("top.predict"))
    side = met.select("id1", "id2", mean.alias("mean"), most.alias("most")).groupBy("id1", "id2").agg(F.min("mean").alias("mean_lo"), F.max("mean").alias("mean_hi"), F.min("most").alias("max_lo"), F.max("most").alias("max_hi"))
    inner = edges.join(comp.withColumnRenamed("id", "id1"), "id1").select("id1", "id2", "predict", "component")
    whole = inner.groupBy("component").agg(F.sum("predict").alias("s"), F.count("*").alias("n"))
    inner = inner.join(whole, "component").select("id1", "id2", "predict", F.when(F.col("n") > 1, (F.col("s") - F.col("predict")) / (F.col("n") - 1)).alias("comp_mean"))
    return side.join(inner, ["id1", "id2"]).withColumn("gap", F.col("predict") - (F.col("mean_lo") + F.col("mean_hi")) / 2).drop("predict")


def diffuse(df: DataFrame, weight: float) -> DataFrame:
    """df plus diffused: (1 - w) * rank + w * rank of mean_hi, both within the category, where a neighbour exists; else the rank."""
    both = ranks.rank_ordinal(df, ["category"]).withColumnRenamed("rank", "r")
    both = ranks.place_in_group(both, ["category"], [F.asc_nulls_first("mean_hi"), "id1", "id2"])
    o = (F.col("_place") - 1) / F.greatest(F.col("_size") - 1, F.lit(1))
    return both.withColumn("diffused", F.when(F.col("mean_hi").isNotNull(), (1 - weight) * F.col("r") + weight * o).otherwise(F.col("r"))).drop("r", "_place", "_size")


def chain_summary(derived: DataFrame, journal: DataFrame) -> DataFrame:
    """(judged, confirmed, broken): derived positives with a verdict (id1, id2, audited_label)."""
    last = journal.select("id1", "id2", "audited_label")
    j = derived.where("target = 1").select("id1", "id2").join(last, ["id1", "id2"])
    return j.agg(F.count("*").alias("judged"), F.count_if(F.col("audited_label") == 1).alias("confirmed"), F.count_if(F.col("audited_label") == 0).alias("broken"))
