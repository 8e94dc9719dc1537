"""Queries: text and attribute functions, pair features, vocabularies and ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.functions import text as T
from pairlab.operators import features, metrics
from pairlab.operators.components import connected_components
from pairlab.plans.basics import WIDE
from pairlab.plans.modelling import components_sql
from pairlab.plans.registry import ap_sql, big, query, r, rounded
from pairlab.sources import files

CFG = T.TextConfig()
NORM = "trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g'))"
KV = """(SELECT DISTINCT id, lower(k) AS key, lower(concat(k, '=', v)) AS kv, lower(v) AS v FROM (
SELECT id, k, json_extract_string(attributes, '$.' || k) AS v FROM items, unnest(['Brand', 'Size', 'Article']) u(k) WHERE json_valid(attributes)
UNION ALL SELECT id, 'Colour', unnest(json_extract_string(attributes, '$.Colour[*]')) FROM items WHERE json_valid(attributes)))"""
SETS = f"(SELECT i.id, COALESCE(list(DISTINCT kv) FILTER (kv IS NOT NULL), []) AS kv, COALESCE(list(DISTINCT key) FILTER (key IS NOT NULL), []) AS keys FROM items i LEFT JOIN {KV} k ON i.id = k.id GROUP BY i.id)"
BOTH = f"(SELECT p.id1, p.id2, a.kv AS kv1, b.kv AS kv2, a.keys AS k1, b.keys AS k2 FROM pairs p JOIN {SETS} a ON p.id1 = a.id JOIN {SETS} b ON p.id2 = b.id)"
NAMES = f"(SELECT p.*, a.n AS n1, b.n AS n2 FROM folded p JOIN (SELECT id, {NORM} AS n FROM items) a ON p.id1 = a.id JOIN (SELECT id, {NORM} AS n FROM items) b ON p.id2 = b.id)"


def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


def words(x: str) -> str:
    return f"list_distinct(string_split({x}, ' '))"


def named(t):
    norm = t.items.select("id", T.normalize_name(F.col("name")).alias("n"))
    return t.folded.join(norm.withColumnsRenamed({"id": "id1", "n": "n1"}), "id1").join(norm.withColumnsRenamed({"id": "id2", "n": "n2"}), "id2")


TOKEN_JAC = jac(words("n1"), words("n2"))


@query("entry_name_similarity", f"""SELECT category, {big('n_rows', 'n_rows')}, {big('positives', 'positives')}, {r('ap', 'ap')} FROM {ap_sql(f"(SELECT category, target, {TOKEN_JAC} AS predict FROM {NAMES})", 'category')} WHERE positives > 0 AND positives < n_rows""")
def _(t):
    token = T.jaccard(F.array_distinct(F.split("n1", " ")), F.array_distinct(F.split("n2", " ")))
    return rounded(metrics.average_precision(named(t).withColumn("predict", token), ["category"]).where("positives > 0 and positives < n_rows"))


@query("f1_normalize_name", f"SELECT id, {NORM} AS norm FROM items")
def _(t):
    return t.items.select("id", T.normalize_name(T.nfkc(F.col("name"))).alias("norm"))


@query("f2_name_tokens", f"SELECT id, array_to_string(string_split({NORM}, ' ')[1:3], '|') AS tokens FROM items")
def _(t):
    return t.items.select("id", F.array_join(T.name_tokens(F.col("name"), 3), "|").alias("tokens"))


@query("f3_number_tokens", f"SELECT id, array_to_string(list_distinct(regexp_extract_all({NORM}, '\\d+')).list_sort(), '|') AS numbers FROM items")
def _(t):
    return t.items.select("id", F.array_join(F.array_sort(T.number_tokens(F.col("name"))), "|").alias("numbers"))


@query("f4_jaccard", f"SELECT id1, id2, {r(TOKEN_JAC, 'jaccard')} FROM {NAMES}")
def _(t):
    return rounded(named(t).select("id1", "id2", T.jaccard(F.array_distinct(F.split("n1", " ")), F.array_distinct(F.split("n2", " "))).alias("jaccard")))


@query("f5_common_prefix_ratio", f"SELECT id1, id2, {r('COALESCE((SELECT MAX(k) FROM range(1, 200) s(k) WHERE k <= least(length(n1), length(n2)) AND n1[1:k] = n2[1:k]), 0) / greatest(length(n1), length(n2), 1)', 'ratio')} FROM {NAMES}")
def _(t):
    return rounded(named(t).select("id1", "id2", T.prefix_ratio(F.col("n1"), F.col("n2")).alias("ratio")))


@query("f6_parse_attributes_kv", f"SELECT id, key, kv FROM {KV}")
def _(t):
    return features.attribute_rows(t.items)


SHARED, AGREE = "len(list_intersect(k1, k2))", "len(list_distinct(list_transform(list_intersect(kv1, kv2), lambda x: split_part(x, '=', 1))))"


@query("f7_attribute_agreement", f"""SELECT id1, id2, {big(SHARED, 'shared_keys')}, {big(AGREE, 'agreeing_keys')}, {big(f'{SHARED} - {AGREE}', 'conflicting_keys')}, {big('least(len(k1), len(k2))', 'min_keys')},
{big('abs(len(k1) - len(k2))', 'size_gap')}, {r(jac('kv1', 'kv2'), 'kv_jaccard')}, {r(jac('k1', 'k2'), 'key_jaccard')} FROM {BOTH}""")
def _(t):
    out = rounded(features.attribute_agreement(t.pairs, t.items))
    return out.select(*[F.col(c).cast("bigint").alias(c) if kind == "int" else F.col(c) for c, kind in out.dtypes])


COMPACT = """CASE WHEN json_valid(attributes) THEN concat('Article:', json_extract_string(attributes, '$.Article'), '; Brand:', json_extract_string(attributes, '$.Brand'), '; Colour:',
array_to_string(json_extract_string(attributes, '$.Colour[*]'), ','), '; Size:', json_extract_string(attributes, '$.Size')) ELSE '' END"""
LOWCOMPACT = COMPACT.replace("'Article:'", "'article:'").replace("'; Brand:'", "'; brand:'").replace("'; Colour:'", "'; colour:'").replace("'; Size:'", "'; size:'")
PRIO = """CASE WHEN json_valid(attributes) THEN concat('brand:', json_extract_string(attributes, '$.Brand'), '; article:', json_extract_string(attributes, '$.Article'), '; colour:',
array_to_string(json_extract_string(attributes, '$.Colour[*]'), ','), CASE WHEN {drop} THEN '' ELSE concat('; size:', json_extract_string(attributes, '$.Size')) END) ELSE '' END"""


@query("f8_compact_attrs", f"SELECT id, {COMPACT} AS compact FROM items")
def _(t):
    return t.items.select("id", T.compact_attrs(F.col("attributes")).alias("compact"))


@query("f9_parse_compact_kv", f"SELECT id, COUNT(*) AS n, MIN(k) AS first_key, MAX(v) AS last_value FROM (SELECT id, split_part(x, ':', 1) AS k, split_part(x, ':', 2) AS v FROM (SELECT id, unnest(string_split({LOWCOMPACT}, '; ')) AS x FROM items)) WHERE v <> '' GROUP BY id")
def _(t):
    rows = t.items.select("id", F.explode(T.parse_compact(T.compact_attrs(F.col("attributes")))).alias("e"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.min("e.k").alias("first_key"), F.max("e.v").alias("last_value"))


FASHION = "category LIKE 'S%'"


@query("f10_prio_attrs", f"SELECT id, {PRIO.format(drop=FASHION)} AS attrs FROM items")
def _(t):
    return t.items.select("id", T.prio_attrs(T.compact_attrs(F.col("attributes")), CFG, F.col("category").startswith("S")).alias("attrs"))


@query("f11_first_value_for", "SELECT id, CASE WHEN json_valid(attributes) THEN lower(array_to_string(json_extract_string(attributes, '$.Colour[*]'), ',')) END AS colour FROM items")
def _(t):
    return t.items.select("id", T.first_value(T.compact_attrs(F.col("attributes")), CFG.colour).alias("colour"))


ARTICLE = "CASE WHEN json_valid(attributes) THEN lower(json_extract_string(attributes, '$.Article')) END"
COLOUR = "CASE WHEN json_valid(attributes) THEN lower(array_to_string(json_extract_string(attributes, '$.Colour[*]'), ',')) END"


def state(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'unknown' WHEN {a} = {b} OR (length({a}) > 4 AND (contains({a}, {b}) OR contains({b}, {a}))) THEN 'match' ELSE 'differ' END"


@query("f12_compare_state", f"SELECT p.id1, p.id2, {state('a.v', 'b.v')} AS state FROM pairs p JOIN (SELECT id, {COLOUR} AS v FROM items) a ON p.id1 = a.id JOIN (SELECT id, {COLOUR} AS v FROM items) b ON p.id2 = b.id")
def _(t):
    v = t.items.select("id", T.first_value(T.compact_attrs(F.col("attributes")), CFG.colour).alias("v"))
    both = t.pairs.join(v.withColumnsRenamed({"id": "id1", "v": "a"}), "id1").join(v.withColumnsRenamed({"id": "id2", "v": "b"}), "id2")
    return both.select("id1", "id2", T.compare_state(F.col("a"), F.col("b")).alias("state"))


PLAIN = f"concat_ws(' | ', name, category, nullif({PRIO.format(drop='false')}, ''))"


@query("f13_build_pair_text", f"""SELECT p.id1, p.id2, concat(a.t, ' @@ compare: ', s) AS text1, concat(b.t, ' @@ compare: ', s) AS text2 FROM (SELECT p.id1, p.id2,
concat('colour=', {state('a.c', 'b.c')}, '; article=', {state('a.v', 'b.v')}) AS s FROM pairs p JOIN (SELECT id, {ARTICLE} AS v, {COLOUR} AS c FROM items) a ON p.id1 = a.id JOIN (SELECT id, {ARTICLE} AS v, {COLOUR} AS c FROM items) b ON p.id2 = b.id) p
JOIN (SELECT id, {PLAIN} AS t FROM items) a ON p.id1 = a.id JOIN (SELECT id, {PLAIN} AS t FROM items) b ON p.id2 = b.id""")
def _(t):
    return features.pair_texts(t.pairs, t.items, CFG)


@query("f14_build_item_text", f"SELECT id, concat_ws(' | ', name, category, nullif({COMPACT}, '')) AS text FROM items")
def _(t):
    return t.items.select("id", T.item_text(F.col("name"), F.col("category"), T.compact_attrs(F.col("attributes"))).alias("text"))


@query("f15_size_sets", "SELECT id, 'plain' AS system, json_extract_string(attributes, '$.Size') AS numbers FROM items WHERE json_valid(attributes)")
def _(t):
    return features.size_sets(t.items).select("id", "system", F.array_join("numbers", ",").alias("numbers"))


SIZE = "CASE WHEN json_valid(attributes) THEN json_extract_string(attributes, '$.Size') END"


@query("f16_size_mismatch", f"SELECT p.id1, p.id2, COALESCE(a.s <> b.s, false) AS mismatch FROM pairs p JOIN (SELECT id, {SIZE} AS s FROM items) a ON p.id1 = a.id JOIN (SELECT id, {SIZE} AS s FROM items) b ON p.id2 = b.id")
def _(t):
    return features.size_mismatch(t.pairs, features.size_sets(t.items))


SIZED = "(SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey % 5 AS k, CAST(40 + p_size % 4 AS STRING) AS n, CAST(50 + p_size % 3 AS STRING) AS m FROM part)"
#: Attributes in which the system of a size stands in the value, in the key, in both or nowhere, and a size that is none.
SIZE_TEXTS = ['{"Размер":"#n RU","Size":"EU #m"}', '{"Size":"EU #n"}', '{"Размер производителя":"#n","Российский размер":"#m"}', '{"Российский размер":"#n"}', '{"Размер упаковки":"#n","Размер":"#n,5"}']
SYSTEMS = f"(SELECT id, unnest(CASE k WHEN 0 THEN ['ru', 'mk'] WHEN 1 THEN ['mk'] WHEN 2 THEN ['mk', 'ru'] WHEN 3 THEN ['ru'] ELSE ['plain'] END) AS system, unnest(CASE k WHEN 0 THEN [n, m] WHEN 2 THEN [n, m] WHEN 4 THEN [concat(n, '.5')] ELSE [n] END) AS numbers FROM {SIZED})"


def sized_items(t):
    n, m, k = (40 + F.col("p_size") % 4).cast("string"), (50 + F.col("p_size") % 3).cast("string"), F.col("p_partkey") % 5
    texts = F.element_at(F.array(*map(F.lit, SIZE_TEXTS)), (k + 1).cast("int"))
    return t.part.select(F.col("p_partkey").cast("bigint").alias("id"), F.replace(F.replace(texts, F.lit("#n"), n), F.lit("#m"), m).alias("attributes"))


@query("f15_size_systems", f"SELECT id, system, numbers FROM {SYSTEMS}")
def _(t):
    return features.size_sets(sized_items(t)).select("id", "system", F.array_join("numbers", ",").alias("numbers"))


@query("f16_size_system_mismatch", f"SELECT p.id1, p.id2, COALESCE(MIN_BY(a.numbers <> b.numbers, CASE a.system WHEN 'ru' THEN 0 WHEN 'plain' THEN 1 ELSE 2 END), false) AS mismatch FROM pairs p LEFT JOIN {SYSTEMS} a ON p.id1 = a.id LEFT JOIN {SYSTEMS} b ON p.id2 = b.id AND a.system = b.system WHERE b.id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM {SYSTEMS} x JOIN {SYSTEMS} y ON x.system = y.system WHERE x.id = p.id1 AND y.id = p.id2) GROUP BY p.id1, p.id2")
def _(t):
    return features.size_mismatch(t.pairs, features.size_sets(sized_items(t)))


WEIGHTS = "concat(CAST(p_size AS STRING), CASE p_partkey % 3 WHEN 0 THEN ' кг' WHEN 1 THEN ' г' ELSE ' мл' END)"
GRAMS = "CASE p_partkey % 3 WHEN 0 THEN p_size * 1000 ELSE p_size END"


def weighed(t):
    unit = F.when(F.col("p_partkey") % 3 == 0, " кг").when(F.col("p_partkey") % 3 == 1, " г").otherwise(" мл")
    return t.part.select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), unit).alias("name"))


@query("f17_extract_quantities", f"SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 3 = 2 THEN 'volume' ELSE 'mass' END AS family, {r(GRAMS, 'quantity')} FROM part")
def _(t):
    return rounded(features.extract_quantities(weighed(t)).select("id", "family", F.col("quantity").cast("double").alias("quantity")))


def sized(t):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    form = F.when(k == 0, F.concat(n, F.lit("x7,5 см"))).when(k == 1, F.concat(F.lit("размер: "), n)).when(k == 2, F.concat(n, F.lit(" EU"))).otherwise("size XL")
    return t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), form).alias("name"))


@query("f17_extract_sizes", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'dimension' ELSE 'size' END AS family, CASE p_partkey % 4 WHEN 0 THEN concat(p_size, 'x7.5cm') WHEN 1 THEN concat('sz=', p_size) WHEN 2 THEN concat('eu=', p_size) ELSE 'sz=xl' END AS value FROM part")
def _(t):
    return features.extract_sizes(sized(t))


def compact_sql(x: str) -> str:
    """Whole numbers as text, 15e3 where that is shorter."""
    v, e = f"CAST({x} AS STRING)", f"concat(rtrim(CAST({x} AS STRING), '0'), 'e', length(CAST({x} AS STRING)) - length(rtrim(CAST({x} AS STRING), '0')))"
    return f"CASE WHEN {v} LIKE '%0' AND (length({e}) < length({v}) OR (length({e}) = length({v}) AND {e} < {v})) THEN {e} ELSE {v} END"


def spoilt_sql(x: str) -> str:
    p = f"length(regexp_extract({x}, '^[^0-9]*'))"
    return f"CASE WHEN {p} = length({x}) THEN concat('l', substr({x}, 2)) ELSE concat(substr({x}, 1, {p}), translate(substr({x}, {p} + 1, 1), '0123456789', '5678901234'), substr({x}, {p} + 2)) END"


#: Names with a quantity and a size; of `размер: 42 EU` only the size word counts, as it begins first, and 0,25 т is no quantity.
UNIT_NAMES = f"""(SELECT id, p_name, q, rpad(qn, CAST(length(q) AS INT), ' ') AS qn, s, rpad(sn, CAST(length(s) AS INT), ' ') AS sn, rest FROM (SELECT CAST(p_partkey AS BIGINT) AS id, p_name, {WEIGHTS} AS q, CASE p_partkey % 3 WHEN 0 THEN concat({compact_sql('CAST(p_size AS BIGINT) * 1000')}, 'g') WHEN 1 THEN concat(CAST(p_size AS STRING), 'g') ELSE concat(CAST(p_size AS STRING), 'ml') END AS qn,
CASE p_partkey % 5 WHEN 0 THEN concat(p_size, 'x7,5 см') WHEN 1 THEN concat('размер: ', p_size) WHEN 2 THEN concat(p_size, ' EU') WHEN 3 THEN 'size XL' ELSE concat('Размер: ', p_size) END AS s, CASE p_partkey % 5 WHEN 0 THEN concat(p_size, 'x7.5cm') WHEN 2 THEN concat('eu=', p_size) WHEN 3 THEN 'sz=xl' ELSE concat('sz=', p_size) END AS sn,
CASE p_partkey % 5 WHEN 4 THEN ' EU, 0,25 т' ELSE '' END AS rest FROM part))"""


def unit_names(t):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    form = F.when(k == 0, F.concat(n, F.lit("x7,5 см"))).when(k == 1, F.concat(F.lit("размер: "), n)).when(k == 2, F.concat(n, F.lit(" EU"))).when(k == 3, "size XL").otherwise(F.concat(F.lit("Размер: "), n, F.lit(" EU, 0,25 т")))
    return weighed(t).join(t.part.select(F.col("p_partkey").alias("id"), form.alias("form")), "id").select(F.col("id").cast("bigint").alias("id"), F.concat_ws(", ", "name", "form").alias("name"))


@query("f17_normalize_units", f"SELECT id, concat(p_name, ' ', qn, ', ', sn, rest) AS norm, concat(p_name, ' ', {spoilt_sql('qn')}, ', ', {spoilt_sql('sn')}, rest) AS corrupt FROM {UNIT_NAMES}")
def _(t):
    return unit_names(t).select("id", features.normalize_units(F.col("name")).alias("x")).select("id", "x.norm", "x.corrupt")


@query("f17_unit_edits", f"""SELECT id, CAST(length(p_name) + 1 AS INT) AS start, CAST(length(p_name) + 1 + length(q) AS INT) AS "end", CASE WHEN id % 3 = 2 THEN 'volume' ELSE 'mass' END AS family, q AS source, qn AS normalized, {spoilt_sql('qn')} AS corrupted FROM {UNIT_NAMES}
UNION ALL SELECT id, CAST(length(p_name) + 3 + length(q) AS INT), CAST(length(p_name) + 3 + length(q) + length(s) AS INT), CASE WHEN id % 5 = 0 THEN 'dimension' ELSE 'fashion_size' END, s, sn, {spoilt_sql('sn')} FROM {UNIT_NAMES}""")
def _(t):
    return unit_names(t).select("id", F.explode(features.normalize_units(F.col("name"))["edits"]).alias("e")).select("id", "e.*")


@query("f18_quantity_set", f"SELECT CAST(p_partkey AS BIGINT) AS id, concat(CASE WHEN p_partkey % 3 = 2 THEN 'volume' ELSE 'mass' END, ':', CAST(CAST({GRAMS} AS DOUBLE) AS STRING)) AS quantities FROM part")
def _(t):
    return features.quantity_set(weighed(t)).select("id", F.array_join("quantities", ",").alias("quantities"))


VALUES = f"(SELECT id, key, list(trim(regexp_replace(v, '[^0-9a-z.]+', ' ', 'g'))) AS vs FROM {KV} GROUP BY id, key)"
#: Sizes belong to no group of keys, so they are the other numbers.
DIFF = f"""(SELECT p.id1, p.id2, p.category, g.grp, concat(CASE WHEN a.vs IS NULL OR b.vs IS NULL THEN 'unknown' WHEN len(list_intersect(a.vs, b.vs)) > 0 THEN 'match' ELSE 'differ' END, CASE WHEN g.grp = 'other_numbers' AND a.vs IS NOT NULL AND b.vs IS NOT NULL THEN '_1' ELSE '' END) AS state
FROM pairs p CROSS JOIN (SELECT unnest(['brand', 'article', 'colour', 'material', 'count', 'volume', 'weight', 'other_numbers']) AS grp) g
LEFT JOIN {VALUES} a ON p.id1 = a.id AND a.key = replace(g.grp, 'other_numbers', 'size') LEFT JOIN {VALUES} b ON p.id2 = b.id AND b.key = replace(g.grp, 'other_numbers', 'size'))"""


@query("f19_structured_diff", f"SELECT id1, id2, grp, state FROM {DIFF}")
def _(t):
    return features.structured_diff(t.pairs, t.items)


@query("f20_state_coverage", f"SELECT category, grp, {r('''AVG(CASE WHEN state <> 'unknown' THEN 1.0 ELSE 0.0 END)''', 'known_share')} FROM {DIFF} GROUP BY GROUPING SETS ((grp), (category, grp))")
def _(t):
    return rounded(features.state_coverage(features.structured_diff(t.pairs, t.items), t.pairs))


@query("f21_relation_bucket", f"SELECT id1, id2, CASE WHEN len(kv1) = 0 AND len(kv2) = 0 THEN 'both_missing' WHEN len(kv1) = 0 OR len(kv2) = 0 THEN 'one_missing' WHEN len(list_intersect(kv1, kv2)) > 0 THEN 'agree' ELSE 'conflict' END AS relation FROM {BOTH}")
def _(t):
    from pairlab.operators.joins import attach_items

    both = attach_items(t.pairs, features.item_features(t.items).select("id", "kv"), ["kv"])
    return both.select("id1", "id2", T.relation_bucket(F.col("kv1"), F.col("kv2")).alias("relation"))


@query("f22_attr_conflict", f"SELECT id1, id2, {SHARED} > {AGREE} AS conflict FROM {BOTH}")
def _(t):
    return features.attr_conflict(t.pairs, t.items)


RATIO = "CAST(least(length(n1), length(n2)) AS DOUBLE) / greatest(length(n1), length(n2), 1)"


@query("f23_field_asymmetry", f"""SELECT n.id1, n.id2, {big('len(k1)', 'fields1')}, {big('len(k2)', 'fields2')}, {r(jac('k1', 'k2'), 'key_jaccard')}, {r(RATIO, 'length_ratio')},
abs(len(k1) - len(k2)) >= 2 OR {RATIO} < 0.7 AS asymmetric FROM {NAMES} n JOIN {BOTH} b ON n.id1 = b.id1 AND n.id2 = b.id2""")
def _(t):
    return rounded(features.field_asymmetry(t.pairs, t.items))


@query("f24_length_profile", f"""SELECT fold, category, COUNT(*) AS n, {', '.join(r(f'quantile_cont(length(n1) + length(n2), {q})', f'p{int(q * 100)}') for q in (0.5, 0.9, 0.95, 0.99))},
{big('MAX(length(n1) + length(n2))', 'most')}, {r('AVG(CASE WHEN length(n1) + length(n2) > 40 THEN 1.0 ELSE 0.0 END)', 'over_40')} FROM {NAMES} GROUP BY GROUPING SETS ((), (fold), (category))""")
def _(t):
    return rounded(features.length_profile(named(t), F.length("n1") + F.length("n2"), [40]))


LEFT = "CASE WHEN length(n1) + length(n2) <= 36 THEN length(n1) WHEN length(n1) <= 18 THEN length(n1) WHEN length(n2) <= 18 THEN 36 - length(n2) ELSE 18 END"


@query("f25_budget_allocation", f"SELECT id1, id2, {big(LEFT, 'left_budget')}, {big(f'least(length(n2), 36 - ({LEFT}))', 'right_budget')} FROM {NAMES}")
def _(t):
    b = T.allocate_budget(F.length("n1"), F.length("n2"), 36)
    return named(t).select("id1", "id2", b["left"].alias("left_budget"), b["right"].alias("right_budget"))


@query("f26_name_similarity_bucket", f"SELECT id1, id2, CASE WHEN n1 = n2 THEN 'exact' WHEN 1 - CAST(levenshtein(n1, n2) AS DOUBLE) / greatest(length(n1), length(n2), 1) >= 0.85 THEN 'near' ELSE 'other' END AS bucket FROM {NAMES}")
def _(t):
    return named(t).select("id1", "id2", T.similarity_bucket(F.col("n1"), F.col("n2")).alias("bucket"))


@query("f27_llm_prompt_rows", f"""SELECT p.id1, p.id2, concat('A: ', a.name, ' (', a.c, ')', chr(10), 'B: ', b.name, ' (', b.c, ')', chr(10), 'Same product? 1 or 0:') AS prompt
FROM pairs p JOIN (SELECT id, name, {COMPACT} AS c FROM items) a ON p.id1 = a.id JOIN (SELECT id, name, {COMPACT} AS c FROM items) b ON p.id2 = b.id""")
def _(t):
    from pairlab.operators.joins import attach_items

    both = attach_items(t.pairs, t.items.select("id", "name", T.compact_attrs(F.col("attributes")).alias("c")), ["name", "c"])
    return both.select("id1", "id2", T.prompt(F.col("name1"), F.col("c1"), F.col("name2"), F.col("c2")).alias("prompt"))


@query("f28_two_way_probability", f"""SELECT id1, id2, model, {r('''CASE id1 % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1 / (1 + exp((predict - 3) - predict)) WHEN 2 THEN 1 / (1 + exp((-predict) - ((-predict) - 2))) ELSE 1 / (1 + exp((-predict) - (predict - 1))) END''', 'p')} FROM scored""")
def _(t):
    def top(token, x):
        return F.struct(F.lit(token).alias("token"), x.cast("double").alias("logprob"))

    p = F.col("predict")
    tops = F.when(F.col("id1") % 4 == 0, F.array(top("x", p))).when(F.col("id1") % 4 == 1, F.array(top("1", p), top("x", p - 1))).when(F.col("id1") % 4 == 2, F.array(top("0", -p), top("x", -p + 1))).otherwise(F.array(top(" 1", p - 1), top("0", -p)))
    return rounded(t.scored.select("id1", "id2", "model", T.two_way_probability(tops).alias("p")))


@query("x1_pair_features", f"""SELECT n.id1, n.id2, true AS known, {r(TOKEN_JAC, 'token_jaccard')}, {r('CASE WHEN n1 = n2 THEN 1 ELSE 0 END', 'name_equal')}, {r(RATIO, 'length_ratio')}, {r(jac('kv1', 'kv2'), 'kv_jaccard')}, {r(f'{SHARED} - {AGREE}', 'conflicting_keys')},
{r('(SELECT COUNT(DISTINCT i.category) FROM items i WHERE i.category < n.category)', 'category_code')} FROM {NAMES} n JOIN {BOTH} b ON n.id1 = b.id1 AND n.id2 = b.id2""")
def _(t):
    out = features.pair_features(t.pairs, t.items, features.category_codes(t.items))
    return rounded(out.select("id1", "id2", "known", "token_jaccard", "name_equal", "length_ratio", "kv_jaccard", "conflicting_keys", "category_code"))


@query("x1_pair_features_full")
def _(t):
    cosine = features.tfidf_cosine(t.pairs, t.items, features.fit_idf(t.items))
    return rounded(features.pair_features(t.pairs, t.items, features.category_codes(t.items), cosine))


GRAM = """(SELECT id, gram, COUNT(*) AS tf FROM (SELECT id, substr(p, s.i, n.n) AS gram FROM (SELECT id, concat(' ', w, ' ') AS p FROM (SELECT id, unnest(string_split(lower(name), ' ')) AS w FROM items))
CROSS JOIN (SELECT unnest([3, 4, 5]) AS n) n CROSS JOIN (SELECT unnest(range(1, 60)) AS i) s WHERE s.i + n.n - 1 <= length(p)) GROUP BY id, gram)"""
IDF = f"(SELECT gram, ln((1.0 + (SELECT COUNT(*) FROM items)) / (1 + COUNT(*))) + 1 AS idf FROM {GRAM} {{where}} GROUP BY gram HAVING COUNT(*) >= 2)"


def cosine_sql(where: str = "") -> str:
    idf = IDF.format(where=where)
    if where:
        idf = idf.replace("FROM items))", f"FROM items {where}))")
    w = f"(SELECT g.id, g.gram, (1 + ln(tf)) * idf AS w FROM {GRAM} g JOIN {idf} f ON g.gram = f.gram)"
    unit = f"(SELECT id, gram, w / sqrt(SUM(w * w) OVER (PARTITION BY id)) AS w FROM {w})"
    return f"(SELECT p.id1, p.id2, COALESCE(SUM(a.w * b.w), 0) AS cosine FROM pairs p LEFT JOIN {unit} a ON p.id1 = a.id LEFT JOIN {unit} b ON p.id2 = b.id AND a.gram = b.gram GROUP BY p.id1, p.id2)"


@query("x2_name_tfidf_cosine", f"SELECT id1, id2, {r('cosine', 'cosine')} FROM {cosine_sql()}")
def _(t):
    return rounded(features.tfidf_cosine(t.pairs, t.items, features.fit_idf(t.items)))


@query("x3_fit_vocabulary_shared", f"SELECT gram, {r('ln((1.0 + (SELECT COUNT(*) FROM items WHERE id % 2 = 0)) / (1 + COUNT(*))) + 1', 'idf')} FROM {GRAM} WHERE id % 2 = 0 GROUP BY gram HAVING COUNT(*) >= 2")
def _(t):
    return rounded(features.fit_idf(t.items.where("id % 2 = 0")))


@query("x3_apply_vocabulary", f"SELECT id1, id2, {r('cosine', 'cosine')} FROM {cosine_sql('WHERE id % 2 = 0')}")
def _(t):
    return rounded(features.tfidf_cosine(t.pairs, t.items, features.fit_idf(t.items.where("id % 2 = 0"))))


@query("x4_baseline_scores", f"""SELECT u.baseline, p.id1, p.id2, ROUND(CAST(CASE u.baseline WHEN 'prior' THEN (SELECT AVG(target) FROM pairs) WHEN 'exact' THEN CASE WHEN n1 = n2 THEN 1 ELSE 0 END WHEN 'cosine' THEN cosine
WHEN 'attributes' THEN j ELSE 0.5 * cosine + 0.5 * j END AS DOUBLE), 6) AS predict FROM {NAMES} p JOIN {cosine_sql()} c ON p.id1 = c.id1 AND p.id2 = c.id2 JOIN (SELECT id1, id2, {jac('kv1', 'kv2')} AS j FROM {BOTH}) b ON p.id1 = b.id1 AND p.id2 = b.id2
CROSS JOIN (SELECT unnest(['prior', 'exact', 'cosine', 'attributes', 'blend']) AS baseline) u""")
def _(t):
    return rounded(features.baseline_scores(t.pairs, t.items))


def vector_tokens(t):
    vectors = t.embeddings.select(F.col("vec_id").cast("long").alias("token"), F.col("embedding").alias("vec"))
    tokens = t.items.select("id", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("id") * m + m, F.lit(500)) for m in (1, 7, 31)]))).alias("token"))
    return tokens, vectors


UNIT = "(SELECT CAST(vec_id AS BIGINT) AS token, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings)"
TOK = f"(SELECT DISTINCT i.id, u.token, u.v FROM items i CROSS JOIN (SELECT unnest([1, 7, 31]) AS m) m JOIN {UNIT} u ON u.token = (i.id * m.m + m.m) % 500)"


@query("x5_kernel_pool_features", f"""WITH s AS (SELECT p.id1, p.id2, a.token AS t1, b.token AS t2, list_dot_product(a.v, b.v) AS c FROM pairs p JOIN {TOK} a ON p.id1 = a.id JOIN {TOK} b ON p.id2 = b.id)
SELECT id1, id2, {r('AVG(k1)', 'k1')}, {r('AVG(k5)', 'k5')} FROM (
SELECT id1, id2, AVG(k1) AS k1, AVG(k5) AS k5 FROM (SELECT id1, id2, t1, ln(greatest(SUM(exp(-((c - 0.9) ** 2) / 0.02)), 1e-4)) AS k1, ln(greatest(SUM(exp(-((c - 0.1) ** 2) / 0.02)), 1e-4)) AS k5 FROM s GROUP BY ALL) GROUP BY id1, id2
UNION ALL SELECT id1, id2, AVG(k1), AVG(k5) FROM (SELECT id1, id2, t2, ln(greatest(SUM(exp(-((c - 0.9) ** 2) / 0.02)), 1e-4)) AS k1, ln(greatest(SUM(exp(-((c - 0.1) ** 2) / 0.02)), 1e-4)) AS k5 FROM s GROUP BY ALL) GROUP BY id1, id2) GROUP BY id1, id2""")
def _(t):
    return rounded(features.kernel_pool(t.pairs, *vector_tokens(t)).select("id1", "id2", "k1", "k5"))


@query("x6_category_codes", "SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INT) AS code FROM (SELECT DISTINCT category FROM items)")
def _(t):
    return features.category_codes(t.items)


VOCAB = f"(SELECT 'name' AS field, unnest(string_split({NORM}, ' ')) AS token FROM items UNION ALL SELECT 'key', key FROM {KV} UNION ALL SELECT 'value', v FROM {KV})"


@query("x7_vocabulary_counts", f"""SELECT field, CAST(threshold AS INT) AS threshold, CAST(COUNT_IF(n >= threshold) AS BIGINT) AS size, {r('SUM(CASE WHEN n >= threshold THEN n ELSE 0 END) / SUM(n)', 'coverage')}
FROM (SELECT field, token, COUNT(*) AS n FROM {VOCAB} GROUP BY field, token) CROSS JOIN (SELECT unnest([1, 2, 5, 10]) AS threshold) GROUP BY field, threshold""")
def _(t):
    return rounded(features.vocabulary_counts(t.items))


VCODE = f"(SELECT token, row_number() OVER (ORDER BY token) AS code FROM (SELECT token FROM {VOCAB} WHERE field = 'name' GROUP BY token HAVING COUNT(*) >= 40 UNION SELECT unnest(string_split({NORM}, ' ')) FROM items WHERE id % 100 = 1))"


def vocab(t):
    keep = t.items.where("id % 100 = 1").select(F.explode(T.name_tokens(F.col("name"))).alias("token"))
    return features.select_vocabulary(features.vocabulary_rows(t.items).where("field = 'name'"), keep, 40)


@query("x8_select_vocabulary", f"SELECT token, CAST(code AS BIGINT) AS code FROM {VCODE}")
def _(t):
    return vocab(t)


@query("x9_encode_tokens", f"""SELECT id, array_to_string(list_concat(list(COALESCE(code, 0) ORDER BY place), list_transform(range(5 - COUNT(*)), lambda x: 0)), ',') AS codes, {r('AVG(CASE WHEN code IS NULL THEN 1.0 ELSE 0.0 END)', 'unknown_share')}
FROM (SELECT id, generate_subscripts(ts, 1) AS place, unnest(ts) AS token FROM (SELECT id, string_split({NORM}, ' ')[1:5] AS ts FROM items)) x LEFT JOIN {VCODE} v ON x.token = v.token GROUP BY id""")
def _(t):
    return rounded(features.encode_tokens(t.items, vocab(t), 5).select("id", F.array_join("codes", ",").alias("codes"), "unknown_share"))


ENTRY = "(SELECT lower(k) AS key, trim(regexp_replace(lower(json_extract_string(attributes, '$.' || k)), '[^0-9a-z]+', ' ', 'g')) AS v FROM items, unnest(['Brand', 'Size', 'Colour', 'Article']) u(k) WHERE json_valid(attributes))"


@query("x10_attribute_vocabularies", f"SELECT kind, token, COUNT(*) AS n FROM (SELECT 'key' AS kind, key AS token FROM {ENTRY} UNION ALL SELECT 'value', unnest(string_split(v, ' ')) FROM {ENTRY}) GROUP BY kind, token")
def _(t):
    return features.attribute_vocabularies(t.items)


AP_OUT = f"{big('n_rows', 'n_rows')}, {big('positives', 'positives')}, {r('ap', 'ap')}"


@query("a1_average_precision", f"SELECT model, category, {AP_OUT} FROM {ap_sql('scored', 'model, category')}")
def _(t):
    return rounded(metrics.average_precision(t.scored, ["model", "category"]))


LABELLED = "(SELECT lang AS category, doc_id % 4 AS fold, quality AS target, CAST(n_chars AS DOUBLE) AS predict FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query("a1_average_precision_labels", f"SELECT category, {AP_OUT} FROM {ap_sql(LABELLED, 'category')}")
def _(t):
    d = t.documents.join(t.labels, "doc_id").select(F.col("lang").alias("category"), F.col("quality").alias("target"), F.col("n_chars").cast("double").alias("predict"))
    return rounded(metrics.average_precision(d, ["category"]))


MACRO = f"""SELECT model, {r('AVG(CASE WHEN two THEN ap END)', 'macro_ap')}, CAST(COUNT_IF(two) AS BIGINT) AS categories, CAST(COUNT_IF(NOT two) AS BIGINT) AS skipped, arg_min(category, CASE WHEN two THEN ap END) AS worst
FROM (SELECT *, positives > 0 AND positives < n_rows AS two FROM {ap_sql('scored', 'model, category')}) GROUP BY model"""


@query("a2_macro_ap", MACRO)
def _(t):
    return rounded(metrics.macro_ap(t.scored, ["model"]))


@query("a3_weighted_ap", f"SELECT model, {r('n_rows', 'n_rows')}, {r('positives', 'positives')}, {r('ap', 'ap')} FROM {ap_sql('(SELECT *, 1.0 + id1 % 3 AS w FROM scored)', 'model', 'CAST(w AS DOUBLE)')}")
def _(t):
    return rounded(metrics.average_precision(t.scored.withColumn("w", (1 + F.col("id1") % 3).cast("double")), ["model"], weight="w"))


@query("a4_score_report", " UNION ALL ".join(f"SELECT model, '{level}' AS level, {fold} AS fold, {cat} AS category, {AP_OUT} FROM {ap_sql('scored', by)}" for level, by, fold, cat in (("pooled", "model", "CAST(NULL AS BIGINT)", "NULL"), ("fold", "model, fold", "fold", "NULL"), ("category", "model, category", "CAST(NULL AS BIGINT)", "category"), ("cell", "model, fold, category", "fold", "category"))))
def _(t):
    return rounded(metrics.score_report(t.scored))


MACRO = f"(SELECT model, fold, AVG(CASE WHEN positives > 0 AND positives < n_rows THEN ap END) AS macro_ap, COUNT_IF(positives = 0 OR positives = n_rows) AS skipped FROM {ap_sql('scored', 'model, fold, category')} GROUP BY model, fold)"


@query("a4_fold_report", f"SELECT a.model, a.fold, {AP_OUT}, {r('m.macro_ap', 'macro_ap')}, {big('m.skipped', 'skipped')} FROM {ap_sql('scored', 'model, fold')} a JOIN {MACRO} m ON a.model = m.model AND a.fold = m.fold")
def _(t):
    return rounded(metrics.fold_report(metrics.score_report(t.scored)))


@query("a4_report_summary", f"""WITH c AS (SELECT *, positives > 0 AND positives < n_rows AS two FROM {ap_sql('scored', 'model, category')}) SELECT f.model, {r('f.mean_fold', 'mean_fold')}, {r('f.min_fold', 'min_fold')}, {r('p.ap', 'pooled')}, {r('c.pooled_macro', 'pooled_macro')}, {big('c.skipped', 'skipped')}, c.worst_category, {r('c.worst_ap', 'worst_ap')}
FROM (SELECT model, AVG(ap) AS mean_fold, MIN(ap) AS min_fold FROM {ap_sql('scored', 'model, fold')} GROUP BY model) f JOIN {ap_sql('scored', 'model')} p ON f.model = p.model
JOIN (SELECT model, AVG(CASE WHEN two THEN ap END) AS pooled_macro, COUNT_IF(NOT two) AS skipped, arg_min(category, (ap, category)) FILTER (two) AS worst_category, MIN(ap) FILTER (two) AS worst_ap FROM c GROUP BY model) c ON f.model = c.model""")
def _(t):
    return rounded(metrics.report_summary(metrics.score_report(t.scored)))


BOARD = f"""(SELECT a.model, mean_ap, macro_ap, CASE WHEN a.model <> 'm2' THEN 1 - mean_ap END AS public FROM (SELECT model, AVG(ap) AS mean_ap FROM {ap_sql('scored', 'model, fold')} GROUP BY model) a
JOIN (SELECT model, AVG(ap) AS macro_ap FROM {ap_sql('scored', 'model, category')} WHERE positives > 0 AND positives < n_rows GROUP BY model) b ON a.model = b.model)"""


def board(t):
    mean = metrics.average_precision(t.scored, ["model", "fold"]).groupBy("model").agg(F.avg("ap").alias("mean_ap"))
    return mean.join(metrics.macro_ap(t.scored, ["model"]).select("model", "macro_ap"), "model").withColumn("public", F.when(F.col("model") != "m2", 1 - F.col("mean_ap")))


@query("a5_leaderboard", f"""SELECT b.model, {r('mean_ap', 'mean_ap')}, {r('macro_ap', 'macro_ap')}, {r('public', 'public')}, CAST(row_number() OVER (ORDER BY mean_ap DESC, b.model) AS INT) AS rank, CAST(p.public_rank AS INT) AS public_rank,
CAST(p.public_rank - row_number() OVER (ORDER BY mean_ap DESC, b.model) AS INT) AS delta FROM {BOARD} b LEFT JOIN (SELECT model, row_number() OVER (ORDER BY public DESC, model) AS public_rank FROM {BOARD} WHERE public IS NOT NULL) p ON b.model = p.model""")
def _(t):
    return rounded(metrics.leaderboard(board(t)))


@query("a6_top_n_board", f"SELECT model, {r('mean_ap', 'mean_ap')} FROM {BOARD} ORDER BY 2 DESC, model LIMIT 2")
def _(t):
    return rounded(metrics.top_n(board(t), 2).select("model", "mean_ap"))


@query("a7_fold_summary", components_sql() + f""", u AS (SELECT DISTINCT id, fold FROM (SELECT id1 AS id, fold FROM folded UNION ALL SELECT id2, fold FROM folded)), n AS (SELECT u.fold, COUNT(*) AS items, COUNT(DISTINCT c.component) AS components FROM u JOIN comp c ON u.id = c.id GROUP BY u.fold)
SELECT f.fold, COUNT(*) AS n_pairs, {big('SUM(target)', 'positives')}, {r('AVG(target)', 'rate')}, MAX(n.items) AS items, MAX(n.components) AS components FROM folded f JOIN n ON f.fold = n.fold GROUP BY f.fold""")
def _(t):
    return rounded(metrics.fold_summary(t.folded, connected_components(t.pairs)))


@query("a8_confusion_at", f"""SELECT model, tp, fp, fn, tn, {r('COALESCE(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')} FROM (SELECT model, CAST(COUNT_IF(predict >= 0.5 AND target = 1) AS BIGINT) AS tp, CAST(COUNT_IF(predict >= 0.5 AND target = 0) AS BIGINT) AS fp,
CAST(COUNT_IF(predict < 0.5 AND target = 1) AS BIGINT) AS fn, CAST(COUNT_IF(predict < 0.5 AND target = 0) AS BIGINT) AS tn FROM scored GROUP BY model)""")
def _(t):
    return rounded(metrics.confusion_at(t.scored, 0.5, ["model"]))


@query("a9_calibration", f"""SELECT model, {r('SUM(sq) / SUM(n)', 'brier')}, {r('SUM(ll) / SUM(n)', 'log_loss')}, {r('SUM(abs(sp - st)) / SUM(n)', 'ece')} FROM (SELECT model, least(floor(predict * 20), 19) AS bin, COUNT(*) AS n, SUM(predict) AS sp, SUM(target) AS st, SUM((predict - target) ** 2) AS sq,
SUM(-(target * ln(least(greatest(predict, 1e-6), 1 - 1e-6)) + (1 - target) * ln(1 - least(greatest(predict, 1e-6), 1 - 1e-6)))) AS ll FROM scored GROUP BY model, bin) GROUP BY model""")
def _(t):
    return rounded(metrics.calibration(t.scored, ["model"]))


SLICED = "(SELECT model, 'all' AS slice, target, predict FROM scored UNION ALL SELECT model, 'confident', target, predict FROM scored WHERE predict < 0.2 OR predict > 0.8 UNION ALL SELECT model, 'near', target, predict FROM scored WHERE id2 - id1 <= 5)"


@query("a10_slice_metrics", f"""WITH e AS (SELECT * FROM {ap_sql(SLICED, 'model, slice')}) SELECT e.model, e.slice, {big('e.n_rows', 'n_rows')}, {big('e.positives', 'positives')}, {r('e.ap', 'ap')}, {r('CAST(e.n_rows AS DOUBLE) / w.n_rows', 'coverage')}, {r('e.ap - w.ap', 'delta')} FROM e JOIN e w ON e.model = w.model AND w.slice = 'all'""")
def _(t):
    slices = {"confident": (F.col("predict") < 0.2) | (F.col("predict") > 0.8), "near": F.col("id2") - F.col("id1") <= 5}
    return rounded(metrics.slice_metrics(t.scored, slices, ["model"]))


@query("a11_prediction_distribution", f"""SELECT model, {r('AVG(predict)', 'mean')}, {r('AVG(CASE WHEN target = 0 THEN predict END)', 'mean0')}, {r('AVG(CASE WHEN target = 1 THEN predict END)', 'mean1')}, {r('stddev_pop(predict)', 'std')},
{', '.join(r(f'quantile_cont(predict, {q})', n) for q, n in ((0.01, 'q01'), (0.5, 'q50'), (0.99, 'q99')))} FROM scored GROUP BY model""")
def _(t):
    return rounded(metrics.distribution(t.scored, ["model"]))


RANKED = f"""(SELECT id1, id2, category, {', '.join(f'(rank() OVER (ORDER BY {m}) + (COUNT(*) OVER (PARTITION BY {m}) - 1) / 2.0) / COUNT(*) OVER () AS {n}' for m, n in (('m1', 'ra'), ('m2', 'rb')))} FROM (SELECT w.*, 'x' AS category FROM {WIDE} w))"""


@query("a12_ranking_change", f"""SELECT category, {r('corr(ra, rb)', 'spearman')}, {r('AVG(abs(ra - rb))', 'mean_move')}, {r('median(abs(ra - rb))', 'median_move')}, {r('AVG(CASE WHEN abs(ra - rb) >= 0.01 THEN 1.0 ELSE 0.0 END)', 'moved_share')},
{r('CAST(COUNT_IF(ra > 0.9 AND rb > 0.9) AS DOUBLE) / COUNT_IF(ra > 0.9 OR rb > 0.9)', 'top_jaccard')} FROM {RANKED} GROUP BY category""")
def _(t):
    wide = files.oof_matrix(t.scored, 4, ["m1", "m2", "m3"]).withColumn("category", F.lit("x"))
    return rounded(metrics.ranking_change(wide, "m1", "m2", ["category"]))


CELL = f"(SELECT category, fold, MAX(CASE WHEN model = 'm1' THEN ap END) AS m1, MAX(CASE WHEN model = 'm2' THEN ap END) AS m2, MAX(CASE WHEN model = 'm3' THEN ap END) AS m3 FROM {ap_sql('scored', 'model, fold, category')} GROUP BY category, fold)"


@query("a13_pivot_deltas", " UNION ALL ".join(f"SELECT category, '{m}' AS variant, {r(f'AVG({m} - m1)', 'mean_delta')}, {r(f'MIN({m} - m1)', 'min_delta')}, {r(f'MAX({m} - m1)', 'max_delta')}, MIN({m} - m1) > 0 OR MAX({m} - m1) < 0 AS same_sign FROM {CELL} GROUP BY category" for m in ("m2", "m3")))
def _(t):
    each = metrics.average_precision(t.scored, ["model", "fold", "category"]).withColumnRenamed("model", "variant")
    return rounded(metrics.pivot_deltas(each, "m1", ["m2", "m3"]))


FOLD = ap_sql("scored", "model, fold")


@query("a14_gate_decision", f"""WITH f AS (SELECT * FROM {FOLD}), p AS (SELECT * FROM {ap_sql('scored', 'model')}) SELECT a.model AS variant, {r('MIN(a.ap - b.ap)', 'min_fold_delta')}, {r('MAX(c.ap - d.ap)', 'pooled_delta')}, MIN(a.ap - b.ap) > 0 AND MAX(c.ap - d.ap) > 0.001 AS go, MIN(a.ap - b.ap) > 0.001 AS go_every_fold
FROM f a JOIN f b ON a.fold = b.fold AND b.model = 'm1' JOIN p c ON c.model = a.model JOIN p d ON d.model = 'm1' WHERE a.model <> 'm1' GROUP BY a.model""")
def _(t):
    f, p = metrics.average_precision(t.scored, ["model", "fold"]), metrics.average_precision(t.scored, ["model"])
    base = f.where("model = 'm1'").select("fold", F.col("ap").alias("b"))
    deltas = f.where("model <> 'm1'").join(base, "fold").select(F.col("model").alias("variant"), (F.col("ap") - F.col("b")).alias("delta"))
    pooled = p.where("model <> 'm1'").crossJoin(F.broadcast(p.where("model = 'm1'").select(F.col("ap").alias("b")))).select(F.col("model").alias("variant"), (F.col("ap") - F.col("b")).alias("delta"))
    return rounded(metrics.gate_decision(deltas, pooled))


SPLITS = f"(SELECT model, CASE WHEN fold < 2 THEN 'validation' ELSE 'board' END AS split, AVG(ap) AS value FROM {FOLD} WHERE NOT (model = 'm3' AND fold < 2) GROUP BY ALL)"


def splits(t):
    f = metrics.average_precision(t.scored, ["model", "fold"]).where("not (model = 'm3' and fold < 2)")
    return f.groupBy("model", F.when(F.col("fold") < 2, "validation").otherwise("board").alias("split")).agg(F.avg("ap").alias("value"))


@query("a15_validation_vs_board", f"SELECT COALESCE(a.model, b.model) AS model, {r('a.value', 'validation')}, {r('b.value', 'board')}, {r('b.value - a.value', 'difference')}, {r('b.value / a.value', 'ratio')} FROM (SELECT * FROM {SPLITS} WHERE split = 'validation') a FULL OUTER JOIN (SELECT * FROM {SPLITS} WHERE split = 'board') b ON a.model = b.model")
def _(t):
    return rounded(metrics.split_compare(splits(t)))


MEANS = f"(SELECT model, AVG(CASE WHEN fold < 2 THEN ap END) AS a, AVG(CASE WHEN fold >= 2 THEN ap END) AS b FROM {FOLD} GROUP BY model)"


@query("a16_pairwise_model_gaps", f"SELECT x.model AS model_a, y.model AS model_b, {r('x.a - y.a', 'gap_a')}, {r('x.b - y.b', 'gap_b')}, sign(x.a - y.a) = sign(x.b - y.b) AS sign_kept, {r('(x.b - y.b) / nullif(x.a - y.a, 0)', 'shrink')} FROM {MEANS} x JOIN {MEANS} y ON x.model < y.model")
def _(t):
    f = metrics.average_precision(t.scored, ["model", "fold"])
    wide = f.groupBy("model").agg(F.avg(F.when(F.col("fold") < 2, F.col("ap"))).alias("a"), F.avg(F.when(F.col("fold") >= 2, F.col("ap"))).alias("b"))
    return rounded(metrics.model_gaps(wide, "a", "b"))


@query("a17_rank_corr_by_category", f"""SELECT model, COUNT(*) AS n, {r('corr(ra, rb)', 'spearman')} FROM (SELECT model, rank() OVER (PARTITION BY model ORDER BY ap) + (COUNT(*) OVER (PARTITION BY model, ap) - 1) / 2.0 AS ra,
rank() OVER (PARTITION BY model ORDER BY n_rows) + (COUNT(*) OVER (PARTITION BY model, n_rows) - 1) / 2.0 AS rb FROM {ap_sql('scored', 'model, category')}) GROUP BY model HAVING COUNT(*) >= 3""")
def _(t):
    each = metrics.average_precision(t.scored, ["model", "category"])
    return rounded(metrics.rank_corr(each, "ap", "n_rows", "model"))


@query("a18_arm_comparison", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY ap DESC, model) = 1 AS won FROM {FOLD}) SELECT model AS arm, {r('AVG(ap)', 'mean_ap')}, {r('AVG(ap) - MAX(AVG(ap)) OVER ()', 'delta_to_best')}, CAST(COUNT_IF(won) AS BIGINT) AS wins FROM e GROUP BY model""")
def _(t):
    return rounded(metrics.compare_arms(metrics.average_precision(t.scored, ["model", "fold"]).withColumnRenamed("model", "arm")))


@query("a19_label_histogram", f"SELECT CAST(floor(predict * 9) / 9 AS DOUBLE) AS value, COUNT(*) AS n, {r('COUNT(*) / (SELECT COUNT(*) FROM scored)', 'share')} FROM scored GROUP BY 1".replace("CAST(floor(predict * 9) / 9 AS DOUBLE)", "ROUND(floor(predict * 9) / 9, 6)"))
def _(t):
    return rounded(metrics.label_histogram(t.scored.withColumn("target", F.round(F.floor(F.col("predict") * 9) / 9, 6))))


@query("a20_trivial_signal_price", f"SELECT {r('COUNT_IF(id1 % 4 = 0) / COUNT(*)', 'coverage')}, {r('COUNT_IF(id1 % 4 = 0 AND target = 1) / nullif(COUNT_IF(id1 % 4 = 0), 0)', 'precision')}, {r('COUNT_IF(id1 % 4 = 0 AND target = 0) / nullif(COUNT_IF(target = 0), 0)', 'fp_share')} FROM pairs")
def _(t):
    return rounded(metrics.signal_price(t.pairs, F.col("id1") % 4 == 0))


@query("a21_model_correlation", f"""WITH k AS (SELECT model, id1, id2, predict, rank() OVER (PARTITION BY model ORDER BY predict) + (COUNT(*) OVER (PARTITION BY model, predict) - 1) / 2.0 AS rk FROM scored) SELECT a.model AS model_a, b.model AS model_b, {r('corr(a.predict, b.predict)', 'pearson')}, {r('corr(a.rk, b.rk)', 'spearman')} FROM k a JOIN k b ON a.id1 = b.id1 AND a.id2 = b.id2 AND a.model < b.model GROUP BY a.model, b.model""")
def _(t):
    return rounded(metrics.model_correlation(t.scored, []))


@query("a22_seed_noise", f"SELECT COUNT(*) AS n_pairs, {r('AVG(s)', 'mean_std')}, {r('MAX(s)', 'max_std')} FROM (SELECT stddev_pop(predict) AS s FROM scores GROUP BY id1, id2)")
def _(t):
    return rounded(metrics.seed_noise(t.scores))


SUBS = f"(SELECT concat(model, '-', fold) AS submission, CASE WHEN fold = 3 AND model = 'm3' THEN 'failed' ELSE 'success' END AS status, fold * 10 + CAST(substr(model, 2) AS INT) AS created_at, CASE WHEN model <> 'm2' OR fold <> 3 THEN AVG(ap) END AS public FROM {ap_sql('scored', 'model, fold, category')} GROUP BY model, fold)"


@query("a23_submission_board", f"""WITH c AS (SELECT concat(model, '-', fold) AS submission, category, ap FROM {ap_sql('scored', 'model, fold, category')}), s AS (SELECT *, row_number() OVER (ORDER BY public DESC, submission) AS place, row_number() OVER (ORDER BY created_at DESC, submission DESC) AS age FROM {SUBS} WHERE status = 'success' AND public IS NOT NULL),
d AS (SELECT category, MAX(CASE WHEN age = 1 THEN ap END) AS latest, MAX(CASE WHEN place = 1 THEN ap END) AS best, MAX(CASE WHEN place = 2 THEN ap END) AS runner_up FROM c JOIN s ON c.submission = s.submission WHERE place <= 2 OR age = 1 GROUP BY category)
SELECT category, {r('latest', 'latest')}, {r('best', 'best')}, {r('runner_up', 'runner_up')}, {r('best - runner_up', 'delta')}, row_number() OVER (ORDER BY best - runner_up DESC NULLS LAST, category) <= 4 AS top_gain FROM d""")
def _(t):
    each = metrics.average_precision(t.scored, ["model", "fold", "category"])
    c = each.select(F.concat_ws("-", "model", F.col("fold").cast("string")).alias("submission"), "model", "fold", "category", "ap")
    subs = c.groupBy("submission", "model", "fold").agg(F.avg("ap").alias("public"))
    subs = subs.withColumns({"status": F.when((F.col("fold") == 3) & (F.col("model") == "m3"), "failed").otherwise("success"), "created_at": F.col("fold") * 10 + F.substring("model", 2, 9).cast("int"), "public": F.when((F.col("model") != "m2") | (F.col("fold") != 3), F.col("public"))})
    return rounded(metrics.submission_board(subs, c.select("submission", "category", "ap")))


@query("a24_constant_score_prior", f"SELECT category, COUNT(*) AS n_rows, {big('SUM(target)', 'positives')}, {r('AVG(target)', 'ap')} FROM pairs GROUP BY category")
def _(t):
    return rounded(metrics.prior_from_constant(t.pairs, ["category"]))


@query("a25_variant_report", f"""WITH f AS (SELECT * FROM {FOLD}), g AS (SELECT model, fold, AVG(ap) AS macro_ap FROM {ap_sql('scored', 'model, fold, category')} WHERE positives > 0 AND positives < n_rows GROUP BY model, fold), c AS (SELECT * FROM {ap_sql('scored', 'model, category')})
SELECT x.*, w.worst_category, w.worst_delta, g.pooled_delta, x.least > 0 AND g.raw > 0.001 AS go FROM (SELECT f.model AS variant, MIN(f.ap - b.ap) AS least, {r('AVG(f.ap)', 'mean_ap')}, {r('AVG(g.macro_ap)', 'mean_macro')}, {r('AVG(f.ap - b.ap)', 'mean_delta')}, {r('stddev_pop(f.ap - b.ap)', 'std_delta')}, MIN(f.ap - b.ap) > 0 OR MAX(f.ap - b.ap) < 0 AS same_sign
FROM f JOIN g ON f.model = g.model AND f.fold = g.fold JOIN f b ON f.fold = b.fold AND b.model = 'm1' GROUP BY f.model) x JOIN (SELECT c.model, arg_min(c.category, (c.ap - b.ap, c.category)) AS worst_category, {r('MIN(c.ap - b.ap)', 'worst_delta')} FROM c JOIN c b ON c.category = b.category AND b.model = 'm1' GROUP BY c.model) w ON x.variant = w.model
JOIN (SELECT a.model, a.ap - b.ap AS raw, {r('a.ap - b.ap', 'pooled_delta')} FROM {ap_sql('scored', 'model')} a JOIN {ap_sql('scored', 'model')} b ON b.model = 'm1') g ON x.variant = g.model""".replace("SELECT x.*", "SELECT x.* EXCLUDE (least)"))
def _(t):
    return rounded(metrics.variant_report(t.scored, "m1"))


@query("a25_category_deltas", f"WITH c AS (SELECT * FROM {ap_sql('scored', 'model, fold, category')}) SELECT c.model AS variant, c.fold, c.category, {r('c.ap', 'ap')}, {r('c.ap - b.ap', 'delta')} FROM c JOIN c b ON b.model = 'm1' AND c.fold = b.fold AND c.category = b.category WHERE c.model <> 'm1'")
def _(t):
    return rounded(metrics.variant_category_deltas(t.scored, "m1"))


@query("a26_factorial_effects", f"""WITH w AS (SELECT fold, MAX(CASE WHEN v = 'none' THEN ap END) AS n, MAX(CASE WHEN v = 'a' THEN ap END) AS a, MAX(CASE WHEN v = 'b' THEN ap END) AS b, MAX(CASE WHEN v = 'ab' THEN ap END) AS ab FROM (SELECT v, fold, ap FROM
{ap_sql("(SELECT CASE model WHEN 'm1' THEN CASE WHEN id1 % 2 = 0 THEN 'none' ELSE 'a' END WHEN 'm2' THEN CASE WHEN id1 % 2 = 0 THEN 'b' ELSE 'ab' END END AS v, fold, target, predict FROM scored WHERE model <> 'm3')", 'v, fold')}) GROUP BY fold)
SELECT fold, {r('(a - n + ab - b) / 2', 'effect_a')}, {r('(b - n + ab - a) / 2', 'effect_b')}, {r('a - n', 'simple_a')}, {r('b - n', 'simple_b')}, {r('ab - a - b + n', 'interaction')} FROM w""")
def _(t):
    even = F.col("id1") % 2 == 0
    v = F.when(F.col("model") == "m1", F.when(even, "none").otherwise("a")).otherwise(F.when(even, "b").otherwise("ab"))
    each = metrics.average_precision(t.scored.where("model <> 'm3'").withColumn("variant", v), ["variant", "fold"])
    return rounded(metrics.factorial_effects(each, ("none", "a", "b", "ab")))


