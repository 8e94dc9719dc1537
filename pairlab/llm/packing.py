"""Best-fit packing of token sequences with bounds that certify it.

Dual feasible functions give lower bounds on the sequences; the best one over all lengths certifies every
partition. Pieces are dealt to partitions so that all get a like mixture of lengths; each packs its own by
best-fit decreasing. One whose sequences equal its share of the bound, rounded up, is certified: it stands,
but for its emptiest sequence, which is the rounding. One with a gap hands over the pieces of all sequences that are not full. What is
handed over is dealt anew and packed again, while the whole count is above the bound and an exchange saves
sequences. So if all partitions are certified, the result is at most one sequence a partition above the bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import chunks, materialise

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k"
#: Pieces that one task packs.
GROUP = 60_000
#: Exchanges at most; each goes on with what the last one left open.
MAX_ROUNDS = 12
#: Fixed value of the vocabulary file: its special token.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(2)
def encoder(name: str = TOKENIZER):
    """The byte-level BPE of a public vocabulary file with its special token."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(column: pa.Array, name: str = TOKENIZER) -> list[np.ndarray]:
    """Token ids of each text, END_ID after them. A null text is empty.

    The ids are those of the `tokenizers` file of that name in its default state: its special token's name in
    a text gives its id.
    """
    coder, end = encoder(name), np.array([END_ID], np.uint32)
    return [np.concatenate([coder.encode_to_numpy(t, allowed_special="all"), end]) if t else end for t in column.to_pylist()]


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut to at most capacity ids, a short piece first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for d, ids in enumerate(encode(batch.column("text"), name)):
                at, n = 0, len(ids)
                for k, to in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                    rows.append((d, k, at, to - at, zlib.crc32(ids[at:to].astype("<u4").tobytes())))
                    at = to
            cols = list(zip(*rows))
            yield pa.record_batch([batch.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length by best-fit decreasing; open bins are kept by their free room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            b, free, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins, offsets


def dual_functions(capacity: int) -> Iterator[tuple[np.ndarray, int]]:
    """(f, scale): f(x) / scale summed over the lengths x of any set that fits a bin is at most 1."""
    x = np.arange(capacity + 1)
    yield x, capacity
    for p in range(1, capacity // 2 + 1):
        yield np.where(x > capacity - p, capacity, np.where(x < p, 0, x)), capacity
    for k in range(1, 65):
        even = (k + 1) * x % capacity == 0
        yield np.where(even, x * k, (k + 1) * x // capacity * capacity), capacity * k


def best_bound(count: np.ndarray, capacity: int) -> tuple[int, np.ndarray, int]:
    """The best bound on bins, and the dual feasible function (f, scale) that gives it; of equals the first.

    count[x]: number of pieces of length x.
    """
    found = [(-(-int(f @ count) // scale), f, scale) for f, scale in dual_functions(capacity)]
    return max(found, key=lambda x: x[0])


def lower_bound(count: np.ndarray, capacity: int) -> int:
    return best_bound(count, capacity)[0]


def packer(turn: int, capacity: int, f: np.ndarray, scale: int):
    """Packs one partition of a round; open: the pieces that it hands over, see the module's text."""

    def run(t: pa.Table) -> pa.Table:
        g = t.column("grp")[0].as_py()
        t = t.drop_columns(["grp"]).sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")])
        length = t.column("length").to_numpy()
        bins, offset = best_fit(length, capacity)
        used = np.bincount(bins, length).astype(np.int64)
        certified = len(used) <= -(-int(f[length].sum()) // scale)
        handed = used < (min(capacity, used.min() + 1) if certified else capacity)
        if certified:
            handed &= np.arange(len(used)) == np.flatnonzero(used == used.min())[-1]
        more = {"sequence_id": (turn << 56) + (g << 24) + bins, "offset": offset, "open": handed[bins], "head": offset == 0, "certified": np.full(len(bins), certified)}
        for name, values in more.items():
            t = t.append_column(name, pa.array(values))
        return t

    return run


def dealt(rows: DataFrame, groups: int, turn: int) -> DataFrame:
    """rows plus grp: each task deals its rows in order of length, so all groups get a like mixture of lengths."""
    place = rows.sortWithinPartitions(F.desc("length")).withColumn("place", F.monotonically_increasing_id())
    first = F.xxhash64(F.shiftright("place", 33), F.lit(turn))
    return place.withColumn("grp", F.pmod(F.col("place").bitwiseAND((1 << 33) - 1) + F.pmod(first, F.lit(groups)), F.lit(groups))).drop("place")


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """rows plus sequence_id, offset, certified: packed into as few sequences as the exchanges find.

    rows: columns doc_id, piece, start, length, ids_crc32, lengths from 1 to capacity; others are left out.
    certified: the piece's partition met its own lower bound when its sequence was closed. Equal rows, null
    ids and ties are dealt like others. An empty table gives no rows.
    """
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rows = materialise(rows, "pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    count = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        count[k] = n
    (bound, f, scale), left = best_bound(count, capacity), int(count.sum())
    todo, done, closed, parts, best = rows, [], 0, [], None
    for turn in range(max_rounds):
        groups = max(1, -(-left // group))
        packed = materialise(dealt(todo, groups, turn).groupBy("grp").applyInArrow(packer(turn, capacity, f, scale), fields + ", sequence_id long, offset long, open boolean, head boolean, certified boolean"), f"packed-{turn}")
        n = {r.open: (r.n, r.bins) for r in packed.groupBy("open").agg(F.count("*").alias("n"), F.count_if("head").alias("bins")).collect()}
        kept, (left, open_bins) = n.get(False, (0, 0))[1], n.get(True, (0, 0))
        total = closed + kept + open_bins
        if best is not None and total >= best:
            break  # the last exchange saved nothing: the packing before it stands
        best, parts = total, [*done, packed]
        closed += kept
        done.append(packed.where("not open"))
        if total <= bound or not left:
            break
        todo = packed.where("open").select("doc_id", "piece", "start", "length", "ids_crc32")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    out = parts[-1].select(names)
    for part in parts[:-1]:
        out = out.unionByName(part.select(names))
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces of all documents with their sequence and offset. A null text is empty: the end id alone.

    Only doc_id and text are read, so other columns cannot clash. Repeated rows are documents of their own.
    A text of any length is encoded whole, by one task. An empty table gives no rows.
    """
    return pack(pieces(docs, capacity), capacity, **options)
