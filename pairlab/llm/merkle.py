"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A paragraph is a line. Its leaves are pieces: runs of words that end where a word's hash says so, so an edit
changes the pieces around it alone. A section ends after a blank paragraph, or where a paragraph's hash says so.
The hash of a paragraph is BLAKE2b over its leaves and its line, those of sections and the root over what lies
below. Equal roots are equal texts. Two trees are compared from above: branches of equal hash are shared whole, the
others are entered down to the leaves; so come the share of common leaves and the paragraphs that differ.

The fingerprint is the root and a MinHash sketch of the leaves, both of fixed size; from it alone, without the
trees, the share of common leaves can be estimated (`likeness`).
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import chunks, multipliers, run_hash, spans, text_bytes

#: Slots of the sketch, a byte each.
SLOTS = 64
#: A piece ends after about every second word, a section after about every eighth paragraph.
PIECE_ENDS, SECTION_ENDS = 2, 8
WORD = np.array([b > 32 and b != 127 for b in range(256)])


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def leaves(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and line number in all texts of each piece."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    start, end, doc = spans(data, offsets, WORD)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = run_hash(data, start, end, seed=11)
    line = np.cumsum(data == 10)[start] + doc  # a text's end ends a line too
    closes = np.ones(len(words), bool)
    closes[:-1] = (words[:-1] % np.uint64(PIECE_ENDS) == 0) | (line[1:] != line[:-1])
    to = np.flatnonzero(closes) + 1
    return run_hash(words, np.append(0, to[:-1]), to, seed=13), doc[to - 1], line[to - 1]


def trees(texts: list[str], found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[dict]:
    """The tree of each text: {"root", "sections": [(hash, [paragraph hashes])], "leaves": [of each paragraph]}; hashes as hex."""
    leaf, _, line = found
    raw, number = leaf.astype("<u8").tobytes(), 0
    for text in texts:
        lines = text.split("\n")
        cut = (np.searchsorted(line, np.arange(number, number + len(lines) + 1)) * 8).tolist()
        number += len(lines)
        sections, held = [], []
        for k, one in enumerate(lines):
            held.append(digest(b"p", raw[cut[k] : cut[k + 1]], one.encode()))
            if not one.strip() or held[-1][0] % SECTION_ENDS == 0:
                sections.append(held)
                held = []
        if held:
            sections.append(held)
        named = [(digest(b"s", *s), s) for s in sections]
        yield {"root": digest(b"r", *[h for h, _ in named]).hex(), "sections": [(h.hex(), [p.hex() for p in s]) for h, s in named], "leaves": [leaf[a // 8 : b // 8] for a, b in zip(cut, cut[1:])]}


def tree(text: str | None) -> dict:
    """The tree of one text. A null text is an empty one."""
    return next(trees([text or ""], leaves([text or ""])))


def edits(before: str | None, after: str | None) -> list[tuple[str, tuple[int, int] | None, tuple[int, int] | None]]:
    """(kind, (section, paragraph) before, (section, paragraph) after) of each paragraph that differs.

    kind: replaced, added (nothing before), removed (nothing after) or moved. Branches of equal hash that
    follow in the same order are not entered. Equal texts, and only these, give no edit.
    """
    a, b = tree(before), tree(after)
    if a["root"] == b["root"]:
        return []
    out, gone, new = [], [], []
    sections = SequenceMatcher(None, [h for h, _ in a["sections"]], [h for h, _ in b["sections"]], autojunk=False)
    for kind, i, j, k, m in sections.get_opcodes():
        if kind == "equal":
            continue
        left = [(x, y, p) for x in range(i, j) for y, p in enumerate(a["sections"][x][1])]
        right = [(x, y, p) for x in range(k, m) for y, p in enumerate(b["sections"][x][1])]
        inner = SequenceMatcher(None, [p for *_, p in left], [p for *_, p in right], autojunk=False)
        for how, c, d, e, f in inner.get_opcodes():
            if how != "equal":
                gone.append(left[c:d])
                new.append(right[e:f])
    arrived: dict[str, deque] = defaultdict(deque)
    for x, y, p in chain(*new):
        arrived[p].append((x, y))
    moved = set()
    for x, y, p in chain(*gone):
        if arrived[p]:
            to = arrived[p].popleft()
            out.append(("moved", (x, y), to))
            moved |= {("a", x, y), ("b", *to)}
    for old, fresh in zip(gone, new):
        old, fresh = ([(x, y) for x, y, _ in rows if (side, x, y) not in moved] for side, rows in (("a", old), ("b", fresh)))
        for was, now in zip_longest(old, fresh):
            out.append(("replaced" if was and now else "removed" if was else "added", was, now))
    return out


def compare(a: dict, b: dict) -> tuple[float, int, int | None]:
    """Share of common leaves of two trees, number of paragraphs of b without an equal branch in a, first paragraph that differs.

    The share is that of common leaves, repeats counted, among all leaves of both: 1 for equal roots, else at most
    0.999; 0 if one has no leaf. Paragraphs count from 0; equal trees have no first one.
    """
    if a["root"] == b["root"]:
        return 1.0, 0, None
    firsts = [t["sections"] for t in (a, b)]
    same = next((k for k, (x, y) in enumerate(zip(*firsts)) if x[0] != y[0]), min(map(len, firsts)))
    skipped = sum(len(s) for _, s in firsts[0][:same])
    below = [[p for _, s in f[same:] for p in s] for f in firsts]
    first = skipped + next((k for k, (x, y) in enumerate(zip(*below)) if x != y), min(map(len, below)))
    shared = Counter(h for h, _ in firsts[0]) & Counter(h for h, _ in firsts[1])
    rest: list[list[tuple[str, np.ndarray]]] = []
    for t in (a, b):
        left, at, open_ = Counter(shared), 0, []
        for h, s in t["sections"]:
            if left[h] > 0:
                left[h] -= 1
            else:
                open_ += zip(s, t["leaves"][at : at + len(s)])
            at += len(s)
        rest.append(open_)
    shared = Counter(h for h, _ in rest[0]) & Counter(h for h, _ in rest[1])
    ends = []
    for open_ in rest:
        left, held = Counter(shared), [np.zeros(0, np.uint64)]
        for h, leaf in open_:
            if left[h] > 0:
                left[h] -= 1
            else:
                held.append(leaf)
        ends.append(np.concatenate(held))
    (x, n), (y, m) = (np.unique(e, return_counts=True) for e in ends)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    size = [sum(map(len, t["leaves"])) for t in (a, b)]
    common = size[0] - len(ends[0]) + int(np.minimum(n[i], m[j]).sum())
    return min(0.999, common / max(1, sum(size) - common)) if min(size) else 0.0, len(rest[1]) - sum(shared.values()), first


def sketches(n: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of SLOTS bytes for each of n texts: the lowest byte of the least of its leaves under each slot's order.

    Slots are filled by one permutation of the leaves; an empty one borrows from the next filled one.
    """
    leaf, owner, _ = found
    if not len(leaf):
        return np.zeros((n, SLOTS), np.uint8)
    slot = (leaf >> np.uint64(58)).astype(np.int64)
    cell = owner * SLOTS + slot
    least = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    order = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) > 0]))
    least[cell[order][first]] = np.minimum.reduceat(leaf[order], first)
    least = least.reshape(n, SLOTS)
    empty = np.iinfo(np.uint64).max
    salt = multipliers(SLOTS, 17)
    base = least.copy()
    for step in range(1, SLOTS):
        gap = (least == empty) & (least != empty).any(1)[:, None]
        if not gap.any():
            break
        source = np.roll(base, -step, axis=1)
        with np.errstate(over="ignore"):
            least = np.where(gap & (source != empty), source * salt[step], least)
    return np.where(least == empty, 0, least >> np.uint64(8)).astype(np.uint8)


def with_trees(texts: list[str]) -> tuple[list[dict], list[str]]:
    """Tree and fingerprint (root:sketch in hex) of each text."""
    found = leaves(texts)
    grown = list(trees(texts, found))
    return grown, [f"{t['root']}:{s.tobytes().hex()}" for t, s in zip(grown, sketches(len(texts), found))]


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text. Equal texts have equal fingerprints, different ones different roots."""
    return with_trees(texts)[1]


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Estimated share of common leaves of two fingerprints: 1 for equal roots, else below 1; 0 at chance."""
    if not a:
        return np.zeros(0)
    left, right = (np.array([np.frombuffer(bytes.fromhex(x.split(":")[1]), np.uint8) for x in side]) for side in (a, b))
    share = ((left == right).mean(1) - 1 / 256) / (1 - 1 / 256)
    blank = ~left.any(1) | ~right.any(1)
    share = np.clip(np.where(blank, 0.0, share), 0, 0.999)
    return np.where([x.split(":")[0] == y.split(":")[0] for x, y in zip(a, b)], 1.0, share)


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus fingerprint and sections: array of (hash, paragraph hashes). A null text counts as empty.

    Columns of those names are replaced, others pass through; repeated rows stay; an empty table gives no rows.
    A text of any length is read whole, by one task.
    """
    names = [c for c in docs.columns if c.lower() not in ("fingerprint", "sections")]
    source, at = docs.select(*[F.col(f"`{c}`") for c in names]), names.index(text_col)
    schema = source.withColumn("fingerprint", F.lit("")).withColumn("sections", F.lit(None).cast("array<struct<hash:string,paragraphs:array<string>>>")).schema
    kind = pa.list_(pa.struct([("hash", pa.string()), ("paragraphs", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            grown, prints = with_trees(texts)
            rows = [[{"hash": h, "paragraphs": p} for h, p in t["sections"]] for t in grown]
            yield pa.record_batch([*batch.columns, pa.array(prints, pa.string()), pa.array(rows, kind)], names=[*names, "fingerprint", "sections"])

    return source.mapInArrow(run, schema)


def id_ranges(ids: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ids that cut the ids into ranges of about equal size."""
    cuts = ids.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    return sorted(set(cuts or []))


def edited_pairs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_changed, first_changed): a row for each row.

    near_edited and near_next are the shares of common leaves of the trees, n_changed and first_changed the number of
    paragraphs of the edited text that the text's tree does not have, and the first place (from 0) where both differ.
    The next document follows in descending doc_id (rows of one id in the order of their texts, null ids
    last); after the last comes the first. An empty table gives no rows; null texts are empty; a long text is
    read whole, by one task. Rows are dealt by ranges of ids, so neighbours meet in a task; the
    first row of each range, known from the ids alone, also goes to the range before.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("at"))
    ids = rows.select("at")
    n = ranges or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = id_ranges(ids, "at", n)

    splits = [-float("inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    by_range = Bucketizer(splits=splits, inputCol="place", outputCol="range")

    def ranged(df: DataFrame) -> DataFrame:
        got = by_range.transform(df.withColumn("place", F.col("at").cast("double")))
        return got.withColumn("part", F.col("range").cast("int")).drop("range", "place")

    heads = {r.part: r.head for r in ranged(ids).groupBy("part").agg(F.max("at").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    if not order:
        heads, order = {0: 0}, [0]
    before = dict(zip(order, [order[-1], *order[:-1]]))
    known = range(len(splits) - 1)
    head = F.element_at(F.lit([heads.get(p) or 0 for p in known]).cast("array<long>"), F.col("part") + 1)
    ahead = F.element_at(F.lit([before.get(p, 0) for p in known]).cast("array<int>"), F.col("part") + 1)
    own, guest = F.struct("part", F.lit(False).alias("guest")), F.struct(ahead.alias("part"), F.lit(True).alias("guest"))
    placed = ranged(rows).select("doc_id", "at", "text", F.explode(F.when(F.col("at") == head, F.array(own, guest)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("doc_id", "at", "text", "p.part", "p.guest").repartition("part").sortWithinPartitions("part", "guest", F.desc("at"), "text")
    return placed.mapInArrow(_edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_changed long, first_changed long")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row of a range with the following one; the first guest follows the last row."""

    def result(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
        (grown, prints), (other, changed) = with_trees([*texts, following[-1]]), with_trees(edited)
        sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        near, places, first = zip(*map(compare, grown, other))
        near_next = [compare(x, y)[0] for x, y in zip(grown, grown[1:])]
        columns = {
            "doc_id": pa.array([i for i, _ in rows], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "edited_sha256": pa.array(sha),
            "fingerprint": pa.array(prints[:-1]), "edited_fingerprint": pa.array(changed), "near_edited": pa.array(near, pa.float64()), "near_next": pa.array(near_next, pa.float64()),
            "n_changed": pa.array(places, pa.int64()), "first_changed": pa.array(first, pa.int64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    held: list[tuple] = []
    part, guest_seen = None, False
    for batch in chunks(batches, "text", 2_000_000):
        for i, t, p, guest in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "part", "guest"))):
            if p != part:
                part, guest_seen = p, False
            if not guest:
                held.append((i, t))
            elif not guest_seen:
                guest_seen = True
                if held:
                    yield result(held, [*(x for _, x in held[1:]), t])
                    held = []
        if len(held) > 1:
            yield result(held[:-1], [x for _, x in held[1:]])
            held = held[-1:]
