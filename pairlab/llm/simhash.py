"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits in three segments of 22, 21 and 21. Two fingerprints at 4 or fewer differing bits
agree in one segment up to its radius, as the radii (1, 1, 0) and one for each segment sum to 5. Every
fingerprint is a row of each segment's table; it also probes each table with the Hamming ball of its
segment, bits going from set to clear only, since the other fingerprint of a pair makes the opposite step.
Matches are verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import chunks, materialise
from pairlab.operators.components import checkpointed, connected_components
from pairlab.operators.joins import by_size, shuffled

WORDS, MAX_BITS, SEED = 4, 4, 42
#: (lowest bit, width, radius) of each segment.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
#: A bucket with more probes or rows than this is compared in blocks of this size, each a task's work.
BLOCK = 1024
#: Hashes whose bits are unpacked at one time.
SLICE = 255 * 256
#: Groups of fingerprints that are sent to all tasks at most; smaller groups than those join by their key.
LARGE_GROUPS = 100_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return []
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1).tolist()
    return [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :])]


def majority(hashes: list[int]) -> int:
    """The bits that are set in over half of the hashes; 0 without any. Bits are unpacked for SLICE hashes at a time."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        part = np.array(hashes[at : at + SLICE], "<u8")
        bits = np.zeros((-(-len(part) // 255) * 255, 64), np.uint8)
        bits[: len(part)] = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits.reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, row, fp): a row for each document. A null or wordless text has fingerprint 0.

    row is a hash of all columns of the row: it tells rows of one id apart, and only repeats share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = np.fromiter((majority(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column("id"), batch.column("row"), pa.array(got.view(np.int64))], names=["id", "row", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), row_hash(docs).alias("row"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, row long, fp long")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns, in the order of their names."""
    return F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(docs.columns)])


def block_links(t: pd.DataFrame, max_bits: int = MAX_BITS) -> pd.DataFrame:
    """A spanning forest of the links between the probes and rows of one block, not the links themselves."""
    rows, probes = (np.unique(t.fp[t.probe == k].to_numpy(np.int64)) for k in (False, True))
    if not len(rows) or not len(probes):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    near = np.bitwise_count((rows[:, None] ^ probes[None, :]).view(np.uint64)) <= max_bits
    label_r, label_p, most = rows.copy(), probes.copy(), np.iinfo(np.int64).max
    while True:
        p = np.minimum(label_p, np.where(near, label_r[:, None], most).min(0))
        r = np.minimum(label_r, np.where(near, p[None, :], most).min(1))
        if (p == label_p).all() and (r == label_r).all():
            break
        label_p, label_r = p, r
    a, b = np.concatenate([rows, probes]), np.concatenate([label_r, label_p])
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def links(prints: DataFrame, max_bits: int = MAX_BITS, segments=SEGMENTS, block: int = BLOCK) -> DataFrame:
    """(a, b): edges whose components are those of all fingerprint pairs at max_bits or fewer differing bits.

    prints: distinct fingerprints, column fp. Buckets of ordinary size are joined and verified in the JVM.
    In a bucket that is large on either side, rows and probes are dealt over a grid of blocks; a task
    compares one block and returns a spanning forest, so neither all pairs nor a whole bucket meet anywhere.
    """
    if sum(r + 1 for *_, r in segments) <= max_bits:
        raise ValueError("the radii do not cover max_bits")
    if any(r > 1 for *_, r in segments):
        raise ValueError("a radius is 0 or 1")

    def key(low: int, width: int):
        return F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)

    entries = prints.select("fp", F.posexplode(F.array(*[key(low, w) for low, w, _ in segments])).alias("seg", "key"))
    balls = []
    for low, width, radius in segments:
        k = key(low, width)
        steps = [F.when(k.bitwiseAND(1 << i) != 0, k.bitwiseAND(((1 << width) - 1) ^ (1 << i))) for i in range(width)] if radius else []
        balls.append(F.filter(F.array(k, *steps), lambda x: x.isNotNull()))
    probes = prints.select("fp", F.posexplode(F.array(*balls)).alias("seg", "ball")).select("fp", "seg", F.explode("ball").alias("key"))
    sizes = entries.groupBy("seg", "key").agg(F.count("*").alias("n_rows"))
    asked = probes.groupBy("seg", "key").agg(F.count("*").alias("n_probes"))
    # Entries and probes are 3 and some 24 rows for each fingerprint, which Spark sizes as one: neither may be sent to all tasks.
    hot = checkpointed(sizes.join(shuffled(asked), ["seg", "key"]).where((F.col("n_rows") > block) | (F.col("n_probes") > block)))
    on = ["seg", "key"]
    hot = by_size(hot)
    left = entries.join(hot, on, "left_anti").withColumnRenamed("fp", "a")
    right = probes.join(hot, on, "left_anti").withColumnRenamed("fp", "b")
    usual = left.join(shuffled(right), on).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")

    def parts(n: str):
        return F.ceil(F.col(n) / block).cast("int")

    grid = hot.select(*on, parts("n_rows").alias("down"), parts("n_probes").alias("across"))  # the hint stays with the rows
    rows = entries.join(grid, on).select(*on, "fp", F.lit(False).alias("probe"), F.pmod(F.xxhash64("fp"), "down").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    asks = probes.join(grid, on).select(*on, "fp", F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.pmod(F.xxhash64("fp"), "across").cast("int").alias("j"))
    dense = rows.unionByName(asks).groupBy(*on, "i", "j").applyInPandas(lambda t: block_links(t, max_bits), "a long, b long")
    return usual.union(dense)


def groups_of(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, group, component_id) for each different fingerprint; group: a fingerprint that stands for its group.

    A group may hold a large share of all fingerprints. Its smallest id is aggregated on the map side; at most
    LARGE_GROUPS groups exceed LARGE_GROUPS'th part of the fingerprints (and 1,024), these are broadcast, and
    the others join by their key.
    """
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    edges = materialise(links(distinct.select("fp"), max_bits), "links")
    member = connected_components(edges, "a", "b").withColumnRenamed("id", "fp")
    linked = materialise(distinct.join(member, "fp"), "linked-fingerprints")
    count, total = F.count("*").alias("n"), linked.count()
    least = materialise(linked.groupBy("component").agg(F.min("least").alias("component_id"), count), "groups")
    large = F.broadcast(least.where(F.col("n") > max(1024, total // LARGE_GROUPS)).select("component", "component_id"))
    small = least.where(F.col("n") <= max(1024, total // LARGE_GROUPS)).select("component", "component_id")
    columns = ["fp", F.col("component").alias("group"), "component_id"]
    one = linked.join(large, "component").select(*columns)
    two = linked.join(large, "component", "left_anti").join(small, "component").select(*columns)
    alone = distinct.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("group"), F.col("least").alias("component_id"))
    return materialise(one.unionByName(two).unionByName(alone), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id): a row for each document.

    component_id is the smallest id that links of max_bits or fewer differing bits reach, the row itself
    included; wordless texts have fingerprint 0 and link like others. Rows with equal fingerprints are one
    node, so groups of copies cost a row. Repeated ids keep a row each; a null id keeps its fingerprint and
    takes the smallest id of its group that is not null. An empty table gives no rows. A text of any length is
    hashed whole, by one task. Other columns only tell rows apart.
    """
    prints = materialise(fingerprints(docs.select(id_col, text_col), id_col, text_col), "fingerprints")
    named = groups_of(prints, max_bits).select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: of those of the smallest id the least row.

    Rows of one id with different texts are different documents, so each is kept or goes by its own group; a
    row that is there several times in full is kept once. Rows without an id all stay. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    own = materialise(prints.where("id is not null").groupBy("id", "row").agg(F.first("fp").alias("fp"), F.count("*").alias("n")), "rows")
    firsts = own.groupBy("fp").agg(F.min(F.struct("id", "row")).alias("head")).join(groups_of(prints, max_bits), "fp")
    kept = firsts.groupBy("group").agg(F.min("head").alias("head")).select("head.*")
    gone = own.join(kept, ["id", "row"], "left_anti").select("id", "row")
    twice = materialise(own.where("n > 1").join(kept, ["id", "row"], "left_semi").select("id", "row"), "repeated-rows")
    key = "row hash"  # a name that no other operator gives
    rows = docs.withColumn(key, row_hash(docs))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def joined(other: DataFrame, how: str) -> DataFrame:
        return rows.join(other.withColumnsRenamed({"id": "other id", "row": "other row"}), (rows[f"`{id_col}`"] == F.col("other id")) & (rows[f"`{key}`"] == F.col("other row")), how)

    if twice.isEmpty():
        return joined(gone, "left_anti").select(*columns)
    once = joined(gone.unionByName(twice), "left_anti").select(*columns)
    return once.unionByName(joined(twice, "left_semi").dropDuplicates([id_col, key]).select(*columns))
