"""Stupid-backoff scores of documents under n-gram counts of all other documents of the corpus.

n-grams are over the words, A-Z in lower case, so the count table grows with the corpus. A document's own
occurrences are taken out of every count, so that it is not its own evidence and no threshold is wanted.

plain_score writes it out: one row for each n-gram of each place, joined to the count table on its text, summed
by document. word_score does the same joins with the rows of a block of documents packed. Blocks give their
different n-grams with their counts as sorted keys, cut by key range; each range sums them over all blocks and
returns every block the totals of its own; each block takes out what its documents gave and sums their scores.
Words and pairs go first, then one order after the other: an n-gram that holds one no other document has is in
no other document either, and is not sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import ASCII_LOWER, chunks, delete, materialise, mix, run_hash, shared_dir, spans, text_bytes

ORDER, BACKOFF = 4, 0.4
#: zstd level of the texts between the passes.
LEVEL = 9
#: Bytes of text of a block; there is a key range for each block. A longer document is a block of its own.
WORD_BLOCK = 16_000_000
#: A key has so many bits beyond those that number the n-grams: one n-gram in 2^24 shares its key with another.
SPARE_BITS = 24
#: Bytes of words: all but blanks and control characters.
WORD = np.arange(256) > 0x20
TOTALS = "block long, level int, range int, n long, totals binary"
GRAMS = "range int, block long, level int, n long, grams binary, counts binary"


def plain_score(docs: DataFrame, id_col: str = "doc_id", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """The result of word_score by exploded n-grams and joins; some ten times its shuffle."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(low, F.lit(r"[^\x00-\x20]+"), F.lit(0)).alias("w"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "words")
    total = F.broadcast(rows.agg(F.sum(F.size("w")).alias("total")))  # a single row
    places = rows.select("row", "w", F.posexplode("w").alias("i", "word"))

    def gram(n: int, back: int = 0):
        return F.array_join(F.slice("w", F.col("i") + 2 - n, F.lit(n - back)), " ")

    levels = [F.when(F.col("i") >= n - 1, F.struct(F.lit(n).alias("n"), gram(n).alias("gram"), (gram(n, 1) if n > 1 else F.lit("")).alias("context"))) for n in range(1, order + 1)]
    grams = places.select("row", "i", F.size("w").alias("size"), F.explode(F.filter(F.array(*levels), lambda x: x.isNotNull())).alias("g")).select("row", "i", "size", "g.*")
    own = grams.groupBy("row", "n", "gram").agg(F.count("*").alias("own"))
    counts = own.groupBy("n", "gram").agg(F.sum("own").alias("c"))
    others = own.join(counts, ["n", "gram"]).where("c > own").select("row", "n", "gram", (F.col("c") - F.col("own")).alias("o"))
    contexts = others.select("row", (F.col("n") + 1).alias("n"), F.col("gram").alias("context"), F.col("o").alias("before"))
    found = grams.join(others, ["row", "n", "gram"])
    one = found.where("n = 1").join(total).withColumn("before", F.col("total") - F.col("size"))
    more = found.where("n > 1").join(contexts, ["row", "n", "context"])
    steps = F.least(F.lit(order), F.col("i") + 1) - F.col("n")
    seen = one.select("row", "i", "n", "o", "before").unionByName(more.select("row", "i", "n", "o", "before"))
    unseen = places.join(total).select("row", "i", F.lit(0).alias("n"), F.lit(1).alias("o"), F.col("total").alias("before"))
    points = F.ln(F.col("o") / F.col("before")) + steps * F.ln(F.lit(backoff))
    best = seen.unionByName(unseen).groupBy("row", "i").agg(F.max_by(points, "n").alias("points"))
    sums = best.groupBy("row").agg(F.sum("points").alias("log_score"))
    return _named(rows.select("id", "row", F.size("w").cast("long").alias("n_grams")).join(sums, "row", "left").withColumn("log_score", F.coalesce("log_score", F.lit(0.0))), id_col)


def _named(scored: DataFrame, id_col: str) -> DataFrame:
    mean = F.when(F.col("n_grams") > 0, F.col("log_score") / F.col("n_grams"))
    return scored.select(F.col("id").alias(id_col), "n_grams", "log_score", mean.alias("mean_log_score"))


def blocks(docs: DataFrame, id_col: str, block_bytes: int, name: str | None = None) -> DataFrame:
    """(block, words, texts): the rows of each task in blocks, id and text compressed; a table of that name, in buckets by block."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, words, number = 0, 0, TaskContext.get().partitionId() << 32

        def packed_block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
                for b in held:
                    out.write_batch(b)
            return pa.record_batch([pa.array([number]), pa.array([words]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "words", "texts"])

        for batch in chunks(batches, limit=min(block_bytes, 1_000_000)):
            data, offsets = text_bytes(batch.column("text"))
            if held and size + len(data) > block_bytes:
                yield packed_block()
                held, size, words, number = [], 0, 0, number + 1
            held.append(batch)
            size, words = size + len(data), words + len(spans(data, offsets, WORD)[0])
        if held:
            yield packed_block()

    name = name or f"lm_blocks_{uuid.uuid4().hex}"
    got = rows.mapInArrow(gather, "block long, words long, texts binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").saveAsTable(name)
    return spark.table(name)


def texts_of(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def word_levels(column: pa.Array, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Text number of each word, its place in the text, and for n = 1..order the key of the n-gram that ends at each word."""
    data, offsets = text_bytes(column)
    data = ASCII_LOWER[data]
    start, end, doc = spans(data, offsets, WORD)
    word = run_hash(data, start, end)
    size = np.bincount(doc, minlength=len(column))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)

    def keys() -> Iterator[np.ndarray]:
        code = np.zeros(len(word), np.uint64)
        for n in range(1, order + 1):
            earlier = np.zeros(len(word), np.uint64)
            earlier[n - 1 :] = word[: len(word) - n + 1]
            with np.errstate(over="ignore"):
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + earlier + np.uint64(n))
            yield code >> np.uint64(64 - bits)

    return doc, place, keys()


def packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def block_grams(block: int, level: int, keys: np.ndarray, ranges: int, bits: int) -> pa.RecordBatch:
    """GRAMS of a block and level: its different n-grams in order of their keys, as packed differences, with their counts."""
    edges = np.array([(k << bits) // ranges for k in range(1, ranges)], np.uint64)
    grams, counts = np.unique(keys, return_counts=True)
    cuts = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
    full = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    columns = [
        pa.array([k for k, _, _ in full], pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array([level] * len(full), pa.int32()), pa.array([b - a for _, a, b in full], pa.int64()),
        pa.array([packed(np.diff(grams[a:b], prepend=np.uint64(0))) for _, a, b in full], pa.binary()), pa.array([packed(counts[a:b]) for _, a, b in full], pa.binary()),
    ]
    return pa.record_batch(columns, names=["range", "block", "level", "n", "grams", "counts"])


def range_totals(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """TOTALS: the n-grams' counts in the whole corpus, for each block in the order of its own."""
    levels = t.column("level").to_numpy()
    for level in np.unique(levels).tolist():
        rows = t.filter(pa.array(levels == level))
        size = rows.column("n").to_numpy()
        keys = np.concatenate([np.cumsum(unpacked(g, n), dtype=np.uint64) for g, n in zip(rows.column("grams").to_pylist(), size.tolist())])
        counts = np.concatenate([unpacked(c, n) for c, n in zip(rows.column("counts").to_pylist(), size.tolist())])
        by = np.argsort(keys)
        keys = keys[by]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        totals = np.empty(len(by), np.uint64)
        totals[by] = np.add.reduceat(counts[by], np.flatnonzero(first))[np.cumsum(first) - 1]
        ends = np.cumsum(size).tolist()
        out = pa.array([packed(totals[b - n : b]) for b, n in zip(ends, size.tolist())], pa.binary())
        one = rows.select(["block", "level", "range", "n"]).combine_chunks()
        yield pa.record_batch([*[c.combine_chunks() for c in one.columns], out], names=["block", "level", "range", "n", "totals"])


def other_counts(keys: np.ndarray, doc: np.ndarray, sent: np.ndarray, totals: list[np.ndarray]) -> np.ndarray:
    """How often other texts hold the n-gram at each place that was sent, else 0; totals: by range, in order of the keys."""
    at, count = np.flatnonzero(sent), np.zeros(len(keys), np.int64)
    if len(at):
        at = at[np.argsort(keys[at], kind="stable")]  # places of a key stay in order of their texts
        new_key = np.ones(len(at), bool)
        new_key[1:] = keys[at[1:]] != keys[at[:-1]]
        known = np.concatenate(totals or [np.zeros(0, np.uint64)]).astype(np.int64)
        if len(known) != new_key.sum():
            raise ValueError(f"{len(known)} totals for {new_key.sum()} n-grams")
        starts = np.flatnonzero(new_key | np.concatenate([[True], doc[at[1:]] != doc[at[:-1]]]))
        own = np.diff(np.append(starts, len(at)))
        count[at] = np.repeat(known[np.cumsum(new_key)[starts] - 1] - own, own)
    return count


def block_levels(t: pa.Table, totals: pa.Table, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]]:
    """Text number and place of each word, and for each level (n, keys, places that are sent, counts in other texts if totals has them)."""
    doc, place, levels = word_levels(t.column("text").combine_chunks(), order, bits)
    rows: dict[int, list] = {}
    for r in totals.sort_by("range").to_pylist():
        rows.setdefault(r["level"], []).append(unpacked(r["totals"], r["n"]))

    def each() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        before = None
        for n, keys in enumerate(levels, 1):
            sent = place >= n - 1
            if n > 2:  # other texts must have both n-grams of the order before
                sent &= before > 0
                sent[1:] &= before[:-1] > 0
            count = other_counts(keys, doc, sent, rows.get(n, [])) if n in rows or not sent.any() else None
            before = count
            yield n, keys, sent, count

    return doc, place, each()


def backed_off(seen: list[np.ndarray], place: np.ndarray, others: np.ndarray, total: int, backoff: float) -> np.ndarray:
    """Logarithm of each place's score; seen[n - 1]: other texts' count of the n-gram that ends there; others: of all their words."""
    points, weight, open_ = np.zeros(len(place)), np.zeros(len(place)), np.ones(len(place), bool)
    for n in range(len(seen), 0, -1):
        here = open_ & (seen[n - 1] > 0)
        before = others.astype(np.float64)
        if n > 1:
            before[1:] = seen[n - 2][:-1]  # the context ends one place earlier
        points[here] = weight[here] + np.log(seen[n - 1][here] / before[here])
        open_ &= ~here
        weight = np.where(open_ & (place >= n - 1), weight + np.log(backoff), weight)
    points[open_] = weight[open_] - np.log(max(1, total))
    return points


def word_score(docs: DataFrame, id_col: str = "doc_id", order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = WORD_BLOCK) -> DataFrame:
    """(id_col, n_grams, log_score, mean_log_score): a row for each row.

    n_grams is the number of words (runs of bytes above the blank), each scored by the longest of its n-grams that
    other rows have, over the count of its context in other rows; each step down within the text multiplies by
    backoff. A word that no other row has is one step below the single words, at 1 over all words of the corpus. A
    null, empty or wordless text has n_grams 0, log_score 0 and no mean. Repeated rows count and score each, and are
    each other's evidence; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark, name = docs.sparkSession, f"lm_blocks_{uuid.uuid4().hex}"
    texts = blocks(docs, id_col, block_bytes, name)
    n_blocks, total = texts.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    ranges, bits = max(1, n_blocks), min(64, (order * total + 1).bit_length() + SPARE_BITS)
    none = pa.table({"block": pa.array([], pa.int64()), "level": pa.array([], pa.int32()), "range": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "totals": pa.array([], pa.binary())})

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("texts")):
                _, _, levels = block_levels(texts_of(raw.as_py()), none, min(order, 2), bits)
                for n, keys, sent, _ in levels:
                    yield block_grams(block, n, keys[sent], ranges, bits)

    def long(level: int):
        def run(t: pa.Table, totals: pa.Table) -> pa.Table:
            parts = [pa.schema([("range", pa.int32()), ("block", pa.int64()), ("level", pa.int32()), ("n", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())]).empty_table()]
            for block, raw in zip(t.column("block").to_pylist(), t.column("texts")):
                _, _, levels = block_levels(texts_of(raw.as_py()), totals, level, bits)
                parts += [pa.Table.from_batches([block_grams(block, n, keys[sent], ranges, bits)]) for n, keys, sent, _ in levels if n == level]
            return pa.concat_tables(parts)

        return run

    def scores(t: pa.Table, totals: pa.Table) -> pa.Table:
        parts = [pa.schema([("id", pa.int64()), ("n_grams", pa.int64()), ("log_score", pa.float64())]).empty_table()]
        for raw in t.column("texts"):
            rows = texts_of(raw.as_py())
            doc, place, levels = block_levels(rows, totals, order, bits)
            size = np.bincount(doc, minlength=len(rows)).astype(np.int64)
            points = backed_off([count for *_, count in levels], place, total - size[doc], total, backoff)
            parts.append(pa.table({"id": rows.column("id"), "n_grams": size, "log_score": np.bincount(doc, points, minlength=len(rows)).astype(np.float64)}))
        return pa.concat_tables(parts[1:] or parts)

    def summed(grams: DataFrame) -> DataFrame:
        return grams.groupBy("range").applyInArrow(lambda t: pa.Table.from_batches(range_totals(t)), TOTALS)

    own = texts.select("block", "texts")
    found = [materialise(summed(own.mapInArrow(short, GRAMS)), "lm-totals")]
    for level in range(3, order + 1):
        known = reduce(DataFrame.unionByName, found)
        longer = own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(long(level), GRAMS)
        found.append(materialise(summed(longer), "lm-totals"))
    known = reduce(DataFrame.unionByName, found)
    got = own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scores, f"id {kind}, n_grams long, log_score double")
    got = materialise(got, "lm-scores")
    spark.sql(f"DROP TABLE {name}")
    delete(spark, f"{shared_dir(spark)}/{name}", *{f.rsplit("/", 1)[0] for t in found for f in t.inputFiles()})
    return _named(got, id_col)
