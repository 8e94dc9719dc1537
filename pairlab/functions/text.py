"""Names, attributes and pair texts as column functions (Column -> Column)."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

NUMBER = r"(\d+(?:[.,]\d+)?)"


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(x: Column) -> Column:
    """Compatibility composition; Spark has none. Only texts that are not ASCII travel to Python."""
    return F.coalesce(_nfkc(F.when(~x.rlike(r"^[\x00-\x7F]*$"), x)), x)


def normalize_name(x: Column) -> Column:
    """Lower case, ё as е, each run of other characters than digits, Latin and Russian letters one blank, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), "ё", "е"), "[^0-9a-zа-я]+", " "))


def name_tokens(x: Column, n: int | None = None) -> Column:
    """Words of a normalised name in order, the first n of them if n is given."""
    tokens = F.filter(F.split(normalize_name(x), " "), lambda t: t != "")
    return F.slice(tokens, 1, n) if n else tokens


def number_tokens(x: Column) -> Column:
    """Distinct numbers of a normalised name; comma as dot, leading zeros dropped."""
    found = F.regexp_extract_all(normalize_name(x), F.lit(NUMBER), 1)
    plain = F.transform(found, lambda t: F.regexp_replace(F.replace(t, F.lit(","), F.lit(".")), "^0+", ""))
    return F.array_distinct(F.transform(plain, lambda t: F.when(t == "", F.lit("0")).otherwise(t)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if a side is empty or null."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the common beginning over the longer length."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.when(first == 0, F.length(a)).otherwise(first - 1) / longest)


def attribute_map(raw: Column) -> Column:
    """The JSON object as map<string,string>; null for bad JSON and for what is no object."""
    return F.from_json(raw, "map<string,string>")


def values_of(value: Column) -> Column:
    """A JSON list's elements, or the value alone."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))


def attribute_tokens(raw: Column) -> Column:
    """Distinct lower-case key=value tokens; a list gives one for each element."""
    pairs = F.transform(F.map_entries(attribute_map(raw)), lambda e: F.transform(values_of(e["value"]), lambda v: F.lower(F.concat(e["key"], F.lit("="), v))))
    return F.coalesce(F.array_distinct(F.flatten(pairs)), F.array().cast("array<string>"))


def compact_attrs(raw: Column, limit: int = 800) -> Column:
    """`k:v; k:v` sorted by lower-case key, lists by their first six elements, cut to limit characters."""
    entries = F.transform(F.map_entries(attribute_map(raw)), lambda e: F.struct(F.lower(e["key"]).alias("low"), e["key"].alias("k"), F.array_join(F.slice(values_of(e["value"]), 1, 6), ",").alias("v")))
    text = F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["k"], F.lit(":"), e["v"])), "; ")
    return F.coalesce(F.left(text, F.lit(limit)), F.lit(""))


def parse_compact(x: Column) -> Column:
    """array of (k, v) from `k:v; k:v`: the first colon splits, keys lower and trimmed, empty values dropped."""
    parts = F.transform(F.split(x, "; "), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:?", "")).alias("v")))
    return F.filter(parts, lambda e: e["v"] != "")


@dataclass(frozen=True)
class TextConfig:
    """What a catalogue calls things; pass another one for another catalogue."""

    priority: tuple[str, ...] = ("brand", "article", "colour", "size")
    colour: tuple[str, ...] = ("colour", "color")
    article: tuple[str, ...] = ("article", "model")
    size_keys: tuple[str, ...] = ("size",)
    no_size: tuple[str, ...] = ()
    limit: int = 700
    compare: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"colour": ("colour", "color"), "article": ("article", "model")})


def prio_attrs(x: Column, cfg: TextConfig, drop_size: Column | None = None) -> Column:
    """Attributes sorted by the first priority key that their key contains, then by key; size keys go where drop_size holds."""

    def rank(k: Column) -> Column:
        out = F.lit(len(cfg.priority))
        for i, p in reversed(list(enumerate(cfg.priority))):
            out = F.when(k.contains(p), F.lit(i)).otherwise(out)
        return out

    rows = F.transform(parse_compact(x), lambda e: F.struct(rank(e["k"]).alias("i"), e["k"].alias("k"), e["v"].alias("v")))
    if drop_size is not None:
        def is_size(k: Column) -> Column:
            out = F.lit(False)
            for s in cfg.size_keys:
                out = out | k.contains(s)
            return out

        rows = F.when(drop_size, F.filter(rows, lambda e: ~is_size(e["k"]))).otherwise(rows)
    return F.left(F.array_join(F.transform(F.array_sort(rows), lambda e: F.concat(e["k"], F.lit(":"), e["v"])), "; "), F.lit(cfg.limit))


def first_value(x: Column, aliases: tuple[str, ...]) -> Column:
    """Lower-case value of the first attribute whose key contains an alias; null without one."""

    def hit(k: Column) -> Column:
        out = F.lit(False)
        for a in aliases:
            out = out | k.contains(a)
        return out

    return F.get(F.transform(F.filter(parse_compact(x), lambda e: hit(e["k"])), lambda e: F.lower(e["v"])), F.lit(0))


def compare_state(a: Column, b: Column) -> Column:
    """unknown, match or differ; containment counts if the left value is longer than four characters."""
    within = (F.length(a) > 4) & (F.contains(a, b) | F.contains(b, a))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), "unknown").when((a == b) | within, "match").otherwise("differ")


def item_text(name: Column, category: Column, attrs: Column) -> Column:
    """`name | category | attrs` without empty parts."""
    def part(c: Column) -> Column:
        return F.when(c != "", c)

    return F.concat_ws(" | ", part(name), part(category), part(attrs))


def relation_bucket(a: Column, b: Column) -> Column:
    """both_missing, one_missing, agree or conflict of two value sets."""
    na, nb = F.coalesce(F.size(a), F.lit(0)) <= 0, F.coalesce(F.size(b), F.lit(0)) <= 0
    return F.when(na & nb, "both_missing").when(na | nb, "one_missing").when(F.arrays_overlap(a, b), "agree").otherwise("conflict")


def similarity_bucket(a: Column, b: Column, near: float = 0.85) -> Column:
    """exact, near or other by edit distance over the longer length."""
    ratio = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(a == b, "exact").when(ratio >= near, "near").otherwise("other")


def allocate_budget(a: Column, b: Column, budget: int) -> Column:
    """struct(left, right): shares of a length budget; what one side leaves goes to the other."""
    half = budget // 2
    left = F.when(a + b <= budget, a).when(a <= half, a).when(b <= budget - half, budget - b).otherwise(F.lit(half))
    return F.struct(left.cast("bigint").alias("left"), F.least(b, budget - left).cast("bigint").alias("right"))


def two_way_probability(tops: Column, yes: str = "1", no: str = "0") -> Column:
    """exp(l1) / (exp(l1) + exp(l0)) from array of (token, logprob); a missing side lies 2 below the least; both missing 0.5."""
    def best(token: str) -> Column:
        return F.array_max(F.transform(F.filter(tops, lambda t: F.trim(t["token"]) == token), lambda t: t["logprob"]))

    floor = F.array_min(F.transform(tops, lambda t: t["logprob"])) - 2
    l1, l0 = best(yes), best(no)
    p = 1 / (1 + F.exp(F.coalesce(l0, floor) - F.coalesce(l1, floor)))
    return F.when(l1.isNull() & l0.isNull(), F.lit(0.5)).otherwise(p)


def prompt(name1: Column, attrs1: Column, name2: Column, attrs2: Column, cut: int = 500) -> Column:
    """The question about a pair that a judge model gets."""
    return F.concat(F.lit("A: "), name1, F.lit(" ("), F.left(attrs1, F.lit(cut)), F.lit(")\nB: "), name2, F.lit(" ("), F.left(attrs2, F.lit(cut)), F.lit(")\nSame product? 1 or 0:"))
