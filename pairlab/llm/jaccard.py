"""Similarity join on word shingles: documents whose shingle sets overlap by 0.8 or more, and their classes.

A document of n shingles links only with one that has T = ceil(0.8 n) of them, so the inverted lists of the whole
corpus decide who takes part: blocks of documents send their different shingles, as packed keys, to key ranges that
sum how many documents have each; a document with fewer than T shingles that stand in two documents links with none.
Of the others the n - T + 1 rarest shingles, of which a partner has at least one, join them into candidate groups.

Within a group, or a block of a large one, links come from a T-occurrence search: a query's longest inverted lists
are set aside, the short ones are merged with a heap, and documents that reach T less the number of lists set aside
probe those by binary search (DivideSkip). As classes are wanted, a query seeks documents outside its own class only.
"""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import ASCII_LOWER, materialise, mix, run_hash, spans, text_bytes
from pairlab.llm.lm import GRAMS, SPARE_BITS, TOTALS, block_grams, blocks, range_totals, texts_of, unpacked
from pairlab.operators.components import connected_components

WORDS = 5
#: Least Jaccard similarity as a fraction, so that it is tested in whole numbers.
SIMILAR, OF = 4, 5
#: Bytes of words: all but blanks (0x20 and 0x09 to 0x0D).
WORD = np.array([b != 0x20 and not 9 <= b <= 13 for b in range(256)])
#: Bytes of text of a block.
BLOCK_BYTES = 16_000_000
#: Shingles, and documents, of a part of a candidate group; a group of several parts is compared part by part.
PART_SHINGLES, PART_DOCS = 400_000, 500
#: How much dearer a probe of a long list is than a step of the merge; sets how many lists count as long.
PROBE = 0.01
SET = "id {kind}, node long, n long, rare array<long>, shared array<long>"
CELL = "grp long, part int, asks int, pivot boolean, query boolean, node long, n long, shared array<long>"


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each different shingle, by text and hash; shorter texts have their whole sequence."""
    data, offsets = text_bytes(column)
    data = ASCII_LOWER[data]
    start, end, doc = spans(data, offsets, WORD)
    word, size = run_hash(data, start, end), np.bincount(doc, minlength=len(column))
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.cumsum(size) - size
    place = np.arange(len(doc)) - np.repeat(at, size)
    code = np.zeros(len(word), np.uint64)
    for k in range(words):
        with np.errstate(over="ignore"):  # code[i]: the k + 1 words from i on, as far as its text goes
            following = np.where(place + k < size[doc], word[np.minimum(np.arange(len(word)) + k, len(word) - 1)], np.uint64(0))
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + following + np.uint64(k + 1))
    whole = (place + words <= size[doc]) | ((place == 0) & (size[doc] < words))
    doc, code = doc[whole], code[whole]
    by = np.lexsort((code, doc))
    doc, code = doc[by], code[by]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])
    return doc[fresh], code[fresh]


def least_shared(n: np.ndarray) -> np.ndarray:
    """T: a partner of a set of n shingles has so many of them at least."""
    return -(-SIMILAR * n // OF)


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return OF * shared >= SIMILAR * (a + b - shared)


class Lists:
    """Inverted lists of a number of shingle sets: for each shingle the places of the sets that have it, in order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate([*sets, np.zeros(0, np.int64)])
        by = np.lexsort((owner, tokens))
        self.tokens, first = np.unique(tokens[by], return_index=True)
        self.places, self.cut = owner[by], np.append(first, len(by))

    def lists(self, tokens: np.ndarray) -> list[np.ndarray]:
        """The lists of those tokens that have one, the longest first."""
        at = np.searchsorted(self.tokens, tokens)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == tokens)] if len(self.tokens) else at[:0]
        at = at[np.argsort(self.cut[at] - self.cut[at + 1], kind="stable")]
        return [self.places[self.cut[k] : self.cut[k + 1]] for k in at.tolist()]

    def partners(self, tokens: np.ndarray, n: int, closed: np.ndarray) -> np.ndarray:
        """Places of the sets that are similar to one of n shingles, but for those where closed holds (DivideSkip)."""
        lists, most = self.lists(tokens), int(least_shared(np.int64(n)))
        if len(lists) < most:
            return np.zeros(0, np.int64)
        n_long = min(most - 1, int(most / (PROBE * math.log2(1 + len(lists[0])) + 1)))
        long, short = lists[:n_long], lists[n_long:]
        open_lists = (x[~closed[x]].tolist() for x in short)
        merged = ((place, sum(1 for _ in same)) for place, same in itertools.groupby(heapq.merge(*open_lists)))
        kept = [(place, c) for place, c in merged if c >= most - n_long]
        found = np.array([p for p, _ in kept], np.int64)
        count = np.array([c for _, c in kept], np.int64)
        for k, probed in enumerate(long):
            alive = count + (n_long - k) >= most
            found, count = found[alive], count[alive]
            if not len(found):
                break
            at = np.searchsorted(probed, found)
            count += probed[np.minimum(at, len(probed) - 1)] == found
        return found[similar(count, n, self.sizes[found])]


def spanning_links(sets: list[np.ndarray], sizes: np.ndarray, asks: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the classes of the given sets as all their links do; asks: the queries, label: classes known before.

    A query seeks partners outside its class only, and none is asked once all open queries and sets are of one class.
    Without a restriction of the queries those of the largest class need not ask: a link between classes has an end
    in another one.
    """
    index, label, out = Lists(sets, sizes), label.copy(), []
    open_ = asks.copy()
    everyone = bool(asks.all())
    while open_.any():
        if everyone:
            names, count = np.unique(label, return_counts=True)
            left = np.flatnonzero(open_ & (label != names[count.argmax()])) if len(names) > 1 else []
            if len(names) > 1 and count.max() == 1:
                left = np.flatnonzero(open_)
        else:
            left = np.flatnonzero(open_) if (label != label[0]).any() else []
        if not len(left):
            break
        q = int(left[sizes[left].argmax()])
        open_[q] = False
        found = index.partners(sets[q], int(sizes[q]), label == label[q])
        for other in np.unique(label[found]).tolist():
            out.append((q, int(found[label[found] == other][0])))
            label[label == other] = label[q]
    return out


def group_links(t: pa.Table) -> pa.Table:
    """(a, b): a forest of the links in one cell of a candidate group.

    A whole group asks with every set. Of a group in parts, the first pass asks with its pivot alone; the second asks
    with sets that the pivot did not reach, while those it did are of one class.
    """
    node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
    sets = [np.asarray(x.values if x.is_valid else [], np.int64) for x in t.column("shared").combine_chunks()]
    asks, pivot = np.asarray(t.column("query").to_numpy(zero_copy_only=False), bool), np.asarray(t.column("pivot").to_numpy(zero_copy_only=False), bool)
    label = np.where(pivot, -1, np.arange(len(node)))
    pairs = spanning_links(sets, n, asks, label) if asks.any() else []
    return pa.table({"a": pa.array([int(node[x]) for x, _ in pairs], pa.int64()), "b": pa.array([int(node[y]) for _, y in pairs], pa.int64())})


def document_sets(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(id, node, n, rare, shared) for each row: its set's name and size, and of sets that may have partners the
    n - T + 1 rarest shingles and all that stand in two documents or more (null for others, and for repeats in a block)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    name = f"shingle_blocks_{uuid.uuid4().hex}"
    texts = blocks(docs.select(id_col, F.col(f"`{text_col}`").alias("text")), id_col, block_bytes, name)
    n_blocks, total = texts.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    ranges, bits = max(1, n_blocks), min(64, (total + 1).bit_length() + SPARE_BITS)
    own, shift = texts.select("block", "texts"), np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("texts")):
                _, code = shingle_sets(texts_of(raw.as_py()).column("text").combine_chunks())
                yield block_grams(block, 1, code >> shift, ranges, bits)

    def sets(t: pa.Table, totals: pa.Table) -> pa.Table:
        out = []
        for raw in t.column("texts"):
            rows = texts_of(raw.as_py())
            doc, code = shingle_sets(rows.column("text").combine_chunks())
            key = code >> shift
            known, which = np.unique(key, return_inverse=True)
            df = np.concatenate([*(unpacked(r["totals"], r["n"]) for r in totals.sort_by("range").to_pylist()), np.zeros(0, np.uint64)]).astype(np.int64)
            if len(df) != len(known):
                raise ValueError(f"{len(df)} totals for {len(known)} shingles")
            df = df[which]
            size = np.bincount(doc, minlength=len(rows))
            with np.errstate(over="ignore"):
                name = np.zeros(len(rows), np.uint64)
                if len(doc):
                    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    name[doc[heads]] = mix(np.add.reduceat(mix(code), heads) + size[doc[heads]].astype(np.uint64))
            node, first = name.view(np.int64), np.cumsum(size) - size
            twice = df > 1
            enough = np.bincount(doc, twice, minlength=len(rows)) >= np.maximum(1, least_shared(size))
            fresh = np.zeros(len(rows), bool)
            fresh[np.unique(node, return_index=True)[1]] = True
            rare, shared = [None] * len(rows), [None] * len(rows)
            for d in np.flatnonzero(enough & fresh).tolist():
                a, b = first[d], first[d] + size[d]
                many = size[d] - int(least_shared(size[d])) + 1
                by = a + np.lexsort((code[a:b], df[a:b]))[:many]
                rare[d] = code[by[twice[by]]].view(np.int64)
                shared[d] = code[a:b][twice[a:b]].view(np.int64)
            out.append(pa.table([rows.column("id"), pa.array(node), pa.array(size.astype(np.int64)), pa.array(rare, pa.list_(pa.int64())), pa.array(shared, pa.list_(pa.int64()))], names=["id", "node", "n", "rare", "shared"]))
        return pa.concat_tables(out)

    totals = materialise(own.mapInArrow(send, GRAMS).groupBy("range").applyInArrow(lambda t: pa.Table.from_batches(range_totals(t)), TOTALS), "shingle-totals")
    got = own.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(sets, SET.format(kind=kind))
    got = materialise(got, "shingle-sets")
    spark.sql(f"DROP TABLE {name}")
    return got


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, grp): sets that rare shingles join, directly or by others; grp is the smallest node. Sets without any are left out."""
    rare = nodes.select("node", F.explode("rare").alias("token"))
    heads = rare.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("token", "head")
    edges = materialise(rare.join(heads, "token").where("node <> head").select("head", "node").distinct(), "candidate-edges")
    return connected_components(edges, "head", "node").select(F.col("id").alias("node"), F.col("component").alias("grp"))


def links(nodes: DataFrame, part_shingles: int = PART_SHINGLES, part_docs: int = PART_DOCS) -> DataFrame:
    """(a, b): links between sets whose classes are those of all links.

    nodes: (node, n, rare, shared), a row for each different set. A group in one part is a task's work. In a larger
    one all parts meet the group's smallest node first; sets that are not similar to it then meet every part, so
    neither a group nor the pairs of those that are similar to it come together in one place.
    """
    groups = materialise(candidate_groups(nodes), "candidate-groups")
    held = materialise(nodes.join(groups, "node").select("grp", "node", "n", "shared"), "candidates")
    weight = held.groupBy("grp").agg(F.sum(F.size("shared")).alias("w"), F.count("*").alias("c"))
    parts = weight.select("grp", F.greatest(F.ceil(F.col("w") / part_shingles), F.ceil(F.col("c") / part_docs)).cast("int").alias("parts"))
    placed = held.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    no, yes = F.lit(False), F.lit(True)
    cell = ["grp", "part", "asks", "pivot", "query", "node", "n", "shared"]

    def compared(rows: DataFrame) -> DataFrame:
        # Dealt by all three, else a join by grp before would leave a whole group in one task.
        return rows.repartition("grp", "part", "asks").groupBy("grp", "part", "asks").applyInArrow(group_links, "a long, b long")

    one = placed.where("parts = 1").withColumns({"asks": F.lit(0), "pivot": no, "query": yes}).select(cell)
    large = placed.where("parts > 1")
    heads = large.where("node = grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = large.where("node <> grp").withColumns({"asks": F.lit(0), "pivot": no, "query": no}).select(cell)
    first = first.unionByName(heads.withColumns({"asks": F.lit(0), "pivot": no, "query": yes}).select(cell))
    near = materialise(compared(one).unionByName(compared_to_pivot(first)), "links-in-parts")
    reached = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    far = materialise(large.where("node <> grp").join(reached, "node", "left_anti").select("grp", "node", "n", "shared", "parts"), "far-sets")
    load = far.groupBy("grp").agg(F.greatest(F.ceil(F.sum(F.size("shared")) / part_shingles), F.ceil(F.count("*") / part_docs)).cast("int").alias("n_asks"))
    asking = far.join(load, "grp").withColumn("asks", F.pmod(F.xxhash64("node", F.lit("asks")), "n_asks").cast("int"))
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"pivot": no, "query": yes}).select(cell)
    marked = large.join(reached.withColumn("near", yes), "node", "left").withColumn("pivot", F.coalesce("near", no) | (F.col("node") == F.col("grp")))
    asked = marked.join(load, "grp").withColumn("asks", F.explode(F.sequence(F.lit(0), F.col("n_asks") - 1))).withColumn("query", no).select(cell)
    return near.unionByName(compared(asked.unionByName(asking)))


def compared_to_pivot(rows: DataFrame) -> DataFrame:
    """(a, b): for each cell all sets that are similar to its query, the pivot."""

    def run(t: pa.Table) -> pa.Table:
        node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
        sets = [np.asarray(x.values, np.int64) for x in t.column("shared").combine_chunks()]
        asks = np.asarray(t.column("query").to_numpy(zero_copy_only=False), bool)
        out = []
        for q in np.flatnonzero(asks).tolist():
            found = Lists(sets, n).partners(sets[q], int(n[q]), np.arange(len(n)) == q)
            out += [(int(node[q]), int(node[k])) for k in found.tolist()]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.repartition("grp", "part").groupBy("grp", "part").applyInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_shingles: int = PART_SHINGLES, part_docs: int = PART_DOCS) -> DataFrame:
    """(id_col, n_shingles, component_id): a row for each document.

    n_shingles is the number of different five-word shingles (A-Z in lower case, words parted by blanks); a text of
    fewer words has one. component_id is the smallest id that links reach, the row's own included; documents link if
    their sets have a Jaccard similarity of 0.8 or more. A null, empty or wordless text has no shingle and links with
    nothing, not even its own kind. Equal sets are one node, so copies cost a row. Repeated ids keep a row each; a null
    id takes the smallest id of its class that is not null. An empty table gives no rows. A text of any length is
    read whole, by one task; other columns are not read.
    """
    rows = document_sets(docs, id_col, text_col, block_bytes)
    named = rows.where("n > 0")
    nodes = materialise(named.where("shared is not null").groupBy("node").agg(F.first(F.struct("n", "rare", "shared")).alias("s")).select("node", "s.*"), "different-sets")
    edges = materialise(links(nodes, part_shingles, part_docs), "links")
    member = connected_components(edges, "a", "b").withColumnRenamed("id", "node")
    least = named.groupBy("node").agg(F.min("id").alias("least"))
    classes = materialise(least.join(member, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
    lowest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    found = materialise(classes.join(lowest, "component").select("node", "component_id"), "class-ids")
    linked = named.join(found, "node").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
