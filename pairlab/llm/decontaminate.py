"""Benchmark decontamination with suffix arrays over the training text.

Documents are cut into shards of some million words. A task sorts the suffixes of its shard, then finds
every benchmark suffix in it by binary search: its place in the order, and all places of each ten-word window.
The longest match of a position is with one of the two benchmark suffixes next to it in that order, so each
document has its own longest match. Benchmark blocks have a bounded size; a larger benchmark is more blocks,
one pass each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import ASCII_LOWER, chunks, run_hash, spans, text_bytes

WINDOW = 10
#: Bytes of benchmark text sent to the executors at once, and bytes of training text in a shard.
BLOCK_BYTES, SHARD_BYTES = 16_000_000, 8_000_000
#: Bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
INSIDE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words start."""
    data, offsets = text_bytes(column)
    data = ASCII_LOWER[data]
    start, end, doc = spans(data, offsets, INSIDE)
    return run_hash(data, start, end), np.searchsorted(doc, np.arange(len(column) + 1))


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the words from there on, up to `depth` of them (ties beyond it in any order).

    ranks: word numbers from 1, 0 between texts. The first sort takes three words; each further one doubles
    the words compared and touches only what is still tied.
    """
    n = len(ranks)
    padded = np.concatenate([ranks, np.zeros(2, np.int64)])
    bits = int(padded.max()).bit_length()
    width = 3 if 3 * bits <= 63 else 2 if 2 * bits <= 63 else 1
    key = padded[:n].copy()
    for i in range(1, width):
        key = (key << bits) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    done, rank = width, np.zeros(n + 1, np.int64)
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = place + 1
    while done < depth:
        same = np.concatenate([place[1:] == place[:-1], [False]])
        tied = np.flatnonzero(same | np.concatenate([[False], same[:-1]]))
        tied = tied[ranks[order[tied]] > 0]
        if not len(tied):
            break
        at = order[tied]
        following = rank[np.minimum(at + done, n)]
        again = np.lexsort((following, place[tied]))
        order[tied] = at = at[again]
        following, groups = following[again], place[tied][again]
        fresh = np.concatenate([[True], (groups[1:] != groups[:-1]) | (following[1:] != following[:-1])])
        place[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        rank[at] = place[tied] + 1
        done *= 2
    return order


class TestSet:
    """Word hashes of a block of benchmark items, with all its suffixes and windows."""

    def __init__(self, items: list[str], texts: list[str | None], window: int):
        hashes, first = word_hashes(pa.array(texts, pa.string()))
        self.items, self.window = np.array(items, dtype=object), window
        self.words, inverse = np.unique(hashes, return_inverse=True)
        self.first = first
        count = np.diff(first)
        self.item_of = np.repeat(np.arange(len(items)), count)
        self.length = np.repeat(first[1:], count) - np.arange(len(hashes))
        self.ids = inverse.astype(np.int64)
        whole = np.repeat(count, count)
        self.span = np.where(self.length >= window, window, np.where((whole < window) & (self.length == whole), whole, 0))
        self.depth = int(self.length.max()) if len(hashes) else 0
        self.by_word = np.argsort(self.ids, kind="stable")
        self.word_at = np.searchsorted(self.ids[self.by_word], np.arange(len(self.words) + 1))

    def first_place(self, t: int, size: int) -> int:
        """The first place of the block, items in order, that has the same `size` words as place t."""
        word = self.ids[t]
        found = self.by_word[self.word_at[word] : self.word_at[word + 1]]
        found = found[self.length[found] >= size]
        for j in range(1, size):
            if len(found) == 1:
                break
            found = found[self.ids[found + j] == self.ids[t + j]]
        return int(found[0])

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Over one shard, by document: word ranges that windows hit, items whose windows occur, the longest match."""
        n_docs, n = len(first) - 1, len(hashes)
        joined = np.zeros(n + n_docs, np.int64)
        place = np.arange(n) + np.repeat(np.arange(n_docs), np.diff(first))
        shard_words, inverse = np.unique(hashes, return_inverse=True)
        joined[place] = inverse + 1
        found = np.searchsorted(shard_words, self.words)
        found = np.minimum(found, max(0, len(shard_words) - 1))
        known = np.where(shard_words[found] == self.words, found + 1, -1) if len(shard_words) else np.full(len(self.words), -1)
        wanted = np.concatenate([known[self.ids], np.full(self.depth + 1, -1)])
        order = suffix_array(joined, self.depth)
        order = order[joined[order] > 0]
        padded = np.concatenate([joined, np.zeros(self.depth + 1, np.int64)])
        ask = np.flatnonzero(wanted[: len(self.ids)] > 0)

        def common(suffix: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
            """Words that each suffix shares with the text at `at`, up to most."""
            got, going = np.zeros(len(at), np.int64), np.arange(len(at))
            while len(going):
                ok = (got[going] < most[going]) & (padded[at[going] + got[going]] == wanted[suffix[going] + got[going]])
                going = going[ok]
                got[going] += 1
            return got

        def bound(suffix: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
            """Binary search in the order for the first place not before (or after) the suffix's first `most` words."""
            low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(order))
            while (going := np.flatnonzero(low < high)).size:
                mid = (low[going] + high[going]) >> 1
                at = order[mid]
                same = common(suffix[going], at, most[going])
                whole = same == most[going]
                less = np.where(whole, after, padded[at + np.minimum(same, most[going])] < wanted[suffix[going] + np.minimum(same, most[going] - 1)])
                low[going] = np.where(less, mid + 1, low[going])
                high[going] = np.where(less, high[going], mid)
            return low

        most = self.length[ask]
        spot = bound(ask, most, False)
        after = np.where(spot < len(order), common(ask, order[np.minimum(spot, len(order) - 1)], most), 0) if len(order) else spot
        before = np.where(spot > 0, common(ask, order[np.maximum(spot - 1, 0)], most), 0) if len(order) else spot
        ends = first[1:] + np.arange(n_docs)

        # Windows: equal ones are one, with all their items.
        chosen = (self.span[ask] > 0) & (np.maximum(before, after) >= self.span[ask])
        win, low = ask[chosen], spot[chosen]
        low = bound(win, self.span[win], False)
        window, one, which = np.unique((low << 20) | self.span[win], return_index=True, return_inverse=True)
        low, rep = low[one], win[one]
        count = bound(rep, self.span[rep], True) - low
        at = order[np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)] if len(rep) else rep
        size = np.repeat(self.span[rep], count)
        cover = np.cumsum(np.bincount(at, minlength=len(joined) + 1) - np.bincount(at + size, minlength=len(joined) + 1)) > 0
        edge = np.flatnonzero(np.diff(cover, prepend=False))
        out = {"run_start": edge[::2], "run_end": edge[1::2]}
        out["run_doc"] = np.searchsorted(ends, out["run_start"], "left")
        pair = np.unique(np.searchsorted(ends, at, "left") * max(1, len(window)) + np.repeat(np.arange(len(window)), count))
        doc, w = pair // max(1, len(window)), pair % max(1, len(window))
        owned = np.unique(which * max(1, len(self.items)) + self.item_of[win])
        item_at = np.searchsorted(owned // max(1, len(self.items)), np.arange(len(window) + 1))
        many = np.diff(item_at)[w]
        item = owned[np.repeat(item_at[w], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)] % max(1, len(self.items))
        both = np.unique(np.repeat(doc, many) * max(1, len(self.items)) + item)
        out["item_doc"], out["item"] = both // max(1, len(self.items)), both % max(1, len(self.items))

        # Longest matches: the next benchmark suffix before and after each position in the order.
        best, where = np.zeros(n_docs, np.int64), np.full(n_docs, len(joined), np.int64)
        partner = np.zeros(n_docs, np.int64)
        if len(ask) and len(order):
            rank = np.arange(len(order))
            group = np.unique(spot)
            near = []
            for shared, step in ((after, 0), (before, 1)):
                by = np.lexsort((shared, spot))
                closest = ask[by[np.searchsorted(spot[by], group, "right") - 1]]  # of equal spots the one that shares most
                side = np.searchsorted(group, rank, "right") - 1 + step
                here = np.flatnonzero((side >= 0) & (side < len(group)))
                t = closest[side[here]]
                same = padded[order[here]] == wanted[t]
                near.append((order[here[same]], t[same]))
            p, t = (np.concatenate(x) for x in zip(*near))
            got = common(t, p, self.length[t])
            d = np.searchsorted(ends, p, "left")
            np.maximum.at(best, d, got)
            longest = (got == best[d]) & (got > 0)
            p, t, d = p[longest], t[longest], d[longest]
            np.minimum.at(where, d, p)
            firsts = p == where[d]
            partner[d[firsts]] = t[firsts]
        out["length"], out["word"] = best, where - (first[:-1] + np.arange(n_docs))
        out["place"] = np.array([self.first_place(int(t), int(n)) if n else -1 for t, n in zip(partner, best)], np.int64)
        return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[TestSet]:
    """Blocks of the benchmark, each of about block_bytes at most, collected one after another."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        got = sorted((r.item or "", r.text) for r in part.toLocalIterator())
        if got:
            yield TestSet([i for i, _ in got], [t for _, t in got], window)


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Gathers small batches until a shard is full."""
    held, size = [], 0
    for batch in chunks(batches, limit=limit):
        more = batch.column("text").nbytes
        if held and size + more > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def scan_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs plus decon: struct(n_words, hits array of (start, end) word ranges, items, longest match).

    A row stays a row, whatever repeats; other columns pass through, a column named decon is replaced. A
    null text has no words, a null benchmark text no windows; an empty benchmark hits nothing; an empty table
    gives no rows. A text of any length is searched whole, by one task. `longest` is the longest run of words that
    the document shares with any item: (length, word, item, item_word); of equal ones the first in the document,
    then the least item, then the first in it. It is null if no word is shared.
    """
    kind = "struct<n_words:bigint,hits:array<struct<start:bigint,end:bigint>>,items:array<string>,longest:struct<length:bigint,word:bigint,item:string,item_word:bigint>>"
    names = [c for c in docs.columns if c.lower() != "decon"]
    empty = F.lit(None).cast(kind)
    out = docs.select(*[F.col(f"`{c}`") for c in names], empty.alias("decon"))
    sc = docs.sparkSession.sparkContext
    sets = benchmark_blocks(benchmark, item_col, item_text, window, block_bytes)
    text_at = names.index(text_col)
    none = TestSet([], [], window)
    any_set = False
    for test in sets:
        any_set = True
        out = out.mapInArrow(_scan(sc.broadcast(test), text_at, shard_bytes), out.schema)
    return out if any_set else out.mapInArrow(_scan(sc.broadcast(none), text_at, shard_bytes), out.schema)


def _scan(sent, text_at: int, shard_bytes: int):
    hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    long_type = pa.struct([("length", pa.int64()), ("word", pa.int64()), ("item", pa.string()), ("item_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: TestSet = sent.value

        def renamed():
            for b in batches:
                yield pa.record_batch(b.columns, names=[f"c{i}" if i != text_at else "text" for i in range(b.num_columns)])

        for batch in shards(renamed(), shard_bytes):
            hashes, first = word_hashes(batch.column(text_at))
            n_docs = batch.num_rows
            hits, items, longest = [[] for _ in range(n_docs)], [set() for _ in range(n_docs)], [None] * n_docs
            if len(test.ids) and len(hashes):
                got = test.matches(hashes, first)
                lead = first[:-1] + np.arange(n_docs)
                for d, a, b in zip(got["run_doc"].tolist(), (got["run_start"] - lead[got["run_doc"]]).tolist(), (got["run_end"] - lead[got["run_doc"]]).tolist()):
                    hits[d].append((a, b))
                for d, item in zip(got["item_doc"].tolist(), got["item"].tolist()):
                    items[d].add(str(test.items[item]))
                for d, (size, word, at) in enumerate(zip(*(got[k].tolist() for k in ("length", "word", "place")))):
                    if size:
                        item = int(test.item_of[at])
                        longest[d] = (-size, word, str(test.items[item]), at - int(test.first[item]))
            old = batch.column(batch.num_columns - 1).to_pylist()
            rows_h, rows_i, rows_l = [], [], []
            for d in range(n_docs):
                before = old[d] or {"hits": [], "items": [], "longest": None}
                rows_h.append(merged([(x["start"], x["end"]) for x in before["hits"]] + hits[d]))
                rows_i.append(sorted({*before["items"], *items[d]}))
                other = before["longest"]
                found = [x for x in (longest[d], other and (-other["length"], other["word"], other["item"], other["item_word"])) if x]
                rows_l.append(dict(zip(("length", "word", "item", "item_word"), (-min(found)[0], *min(found)[1:]))) if found else None)
            column = pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in rows_h], hit_type), pa.array(rows_i, pa.list_(pa.string())), pa.array(rows_l, long_type)], names=["n_words", "hits", "items", "longest"])
            yield pa.record_batch([*batch.columns[:-1], column], names=[f"c{i}" for i in range(batch.num_columns)])

    return run


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match): a row for each document."""
    scanned = scan_overlaps(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("decon.hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return scanned.select(
        "doc_id", "decon.n_words", n_hit.alias("n_hit"), F.size("decon.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("decon.items", ","), 256).alias("items_sha256"), (F.size("decon.hits") > 0).alias("contaminated"),
        F.coalesce("decon.longest.length", F.lit(0).cast("long")).alias("longest_match"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a window, with their columns."""
    return scan_overlaps(docs, benchmark, **options).where(F.size("decon.hits") == 0).select(*[f"`{c}`" for c in docs.columns])
