"""Ranked lexical search: the best documents for each query, by whole-number term scores.

The index is a table with a row for each shard of some megabytes of text: its documents in order of their ids and,
for each term, the places and counts of the documents that have it. Statistics of the corpus are sums over that
table. A query meets a shard in two steps. Its short lists are summed term at a time into accumulators; these then
stand as one list, with a bound of its own, beside the long lists, and document-at-a-time evaluation goes through
the shard block by block: blocks whose bounds cannot reach the worst of the best so far are skipped, and within a
block lists that cannot lift a document that far on their own are only probed for documents that others bring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlab.llm.common import ASCII_LOWER, chunks, materialise, run_hash, spans, text_bytes
from pairlab.llm.decontaminate import INSIDE

#: Results of a query.
TOP = 50
#: Bytes of text of a shard, and of queries that are sent to the executors at once; a single longer text is one by itself.
SHARD_BYTES, QUERY_BYTES = 16_000_000, 16_000_000
#: Documents of a block, and the share of a shard's documents up to which a list is short.
BLOCK, SHORT = 512, 1 / 16
SHARD = "ids array<{kind}>, lengths array<long>, terms array<long>, starts array<long>, places array<int>, counts array<int>"


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each term, in order."""
    data, offsets = text_bytes(column)
    data = ASCII_LOWER[data]
    start, end, doc = spans(data, offsets, INSIDE)
    return doc, run_hash(data, start, end)


def counted(doc: np.ndarray, term: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (term, document) pairs in order, and how often each is there."""
    by = np.lexsort((doc, term))
    doc, term = doc[by], term[by]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(doc))) if count is None else np.add.reduceat(count[by], first) if len(first) else first
    return doc[first], term[first], many


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard: ids in ascending order (nulls last), terms of each document, and lists by term.

    The list of terms[k] is places[starts[k]:starts[k + 1]], with counts beside it. Each row of docs is a document,
    whatever repeats; a null text has no terms. An empty table has no shard.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = n = 0

        def shard() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc, term, count = counted(place[np.concatenate([h[1] for h in held])], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
            lengths = np.bincount(doc, count, minlength=len(ids)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            columns = [ids.take(pa.array(order)), pa.array(lengths), pa.array(term[first].view(np.int64)), pa.array(np.append(first, len(term))), pa.array(doc.astype(np.int32)), pa.array(count.astype(np.int32))]
            return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["ids", "lengths", "terms", "starts", "places", "counts"])

        for batch in chunks(batches, limit=min(shard_bytes, 4_000_000)):
            more = batch.column("text").nbytes
            if held and size + more > shard_bytes:
                yield shard()
                held, size, n = [], 0, 0
            doc, term, count = counted(*text_terms(batch.column("text")))
            held.append((batch.column("id"), doc + n, term, count))
            size, n = size + more, n + batch.num_rows
        if held:
            yield shard()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SHARD.format(kind=kind))


@dataclass
class Queries:
    """A block of queries: names, the terms of each, and for the block's different terms in order their weights."""

    names: list
    rows: list[int]
    terms: list[np.ndarray]
    known: np.ndarray
    weight: np.ndarray
    n_docs: int
    n_terms: int


def query_blocks(queries: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Names and different terms of the queries, in blocks of about block_bytes at most, collected one after another."""
    rows = queries.select(F.col(f"`{id_col}`").alias("name"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        got = [(r.name, r.text) for r in part.toLocalIterator()]
        doc, term = text_terms(pa.array([t for _, t in got], pa.string()))
        doc, term, _ = counted(doc, term)
        by = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[by], np.arange(len(got) + 1))
        if got:
            yield [name for name, _ in got], [term[by[a:b]] for a, b in zip(cut, cut[1:])]


def list_of(row: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return row.column(name)[k].values.to_numpy(zero_copy_only=False)


def document_frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many documents have each of the given terms; a sum over shards, one row a term."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = sent.value, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                have, starts = list_of(batch, "terms", k).view(np.uint64), list_of(batch, "starts", k)
                at = np.searchsorted(have, wanted)
                hit = np.flatnonzero(at < len(have))
                hit = hit[have[at[hit]] == wanted[hit]]
                total[hit] += np.diff(starts)[at[hit]]
        full = np.flatnonzero(total)
        yield pa.record_batch([pa.array(full), pa.array(total[full])], names=["term", "df"])

    found = index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in found.toLocalIterator()}


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """20 * m of each document, m = 100 - 50 + ((50 * n * N) div L); in Python's numbers where 64 bits might not do."""
    if int(lengths.max(initial=0)) * 50 * n_docs < 1 << 63:
        return 20 * (50 + 50 * lengths * n_docs // max(1, n_terms))
    return np.array([20 * (50 + 50 * int(n) * n_docs // n_terms) for n in lengths], np.int64)


class Best:
    """The top documents of a query so far; floor: the least score that still counts."""

    def __init__(self, top: int):
        self.top, self.floor = top, 1
        self.score, self.name = np.zeros(0, np.int64), []

    def offer(self, scores: np.ndarray, names: list) -> None:
        """names ascend; of equal scores the smaller name stays."""
        if not len(scores):
            return
        score, name = np.concatenate([self.score, scores]), self.name + names
        by = sorted(range(len(name)), key=lambda i: (-int(score[i]), name[i] is None, name[i] if name[i] is not None else 0))[: self.top]
        self.score, self.name = score[by], [name[i] for i in by]
        if len(by) == self.top:
            self.floor = max(1, int(self.score[-1]))


def evaluate(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, names, best: Best, block: int = BLOCK, short: float = SHORT) -> None:
    """Offers to best each document of a shard that may be among them. lists: places and scores of each of the query's terms."""
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: len(x[0]))
    n_short = sum(len(p) <= short * n_docs for p, _ in lists)
    if n_short > 1:  # term at a time: the short lists become one
        place, score = (np.concatenate(x) for x in zip(*lists[:n_short]))
        by = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.diff(place[by], prepend=-1))
        lists = [(place[by][first], np.add.reduceat(score[by], first)), *lists[n_short:]]
    if not lists:
        return
    edges = np.arange(0, n_docs + block, block)
    cuts = np.array([np.searchsorted(p, edges) for p, _ in lists])
    bound = np.zeros((len(lists), len(edges) - 1), np.int64)
    for i, (_, score) in enumerate(lists):
        full = np.flatnonzero(np.diff(cuts[i]))
        bound[i, full] = np.maximum.reduceat(score, cuts[i, full])
    total = bound.sum(0)
    for k in np.flatnonzero(total).tolist():
        if total[k] < best.floor:
            continue
        order = np.argsort(-bound[:, k], kind="stable")
        order = order[bound[order, k] > 0]
        rest = np.append(np.cumsum(bound[order, k][::-1])[::-1], 0)  # what the lists from here on can add
        lead = int(np.count_nonzero(rest[:-1] >= best.floor))  # the others cannot reach the floor by themselves
        acc, low = np.zeros(block, np.int64), int(edges[k])
        for i in order[:lead]:
            a, b = cuts[i, k], cuts[i, k + 1]
            acc[lists[i][0][a:b] - low] += lists[i][1][a:b]
        found = np.flatnonzero(acc)
        score = acc[found]
        for j, i in enumerate(order[lead:].tolist(), lead):
            alive = score + rest[j] >= best.floor
            found, score = found[alive], score[alive]
            if not len(found):
                break
            a, b = cuts[i, k], cuts[i, k + 1]
            place = lists[i][0][a:b]
            at = np.minimum(np.searchsorted(place, found + low), b - a - 1)
            score = score + np.where(place[at] == found + low, lists[i][1][a:b][at], 0)
        alive = score >= best.floor
        best.offer(score[alive], [names[p].as_py() for p in (found[alive] + low).tolist()])


def search_shards(batches: Iterator[pa.RecordBatch], q: Queries, top: int, id_type: pa.DataType, block: int, short: float) -> Iterator[pa.RecordBatch]:
    """(query, id, score): each query's best documents over all shards of a task; the floor goes from shard to shard."""
    best = [Best(top) for _ in q.terms]
    asked = [np.searchsorted(q.known, t) for t in q.terms]
    for batch in batches:
        for k in range(batch.num_rows):
            names, lengths = batch.column("ids")[k].values, list_of(batch, "lengths", k)
            have, starts = list_of(batch, "terms", k).view(np.uint64), list_of(batch, "starts", k)
            places, counts = list_of(batch, "places", k), list_of(batch, "counts", k).astype(np.int64)
            norm = norms(lengths, q.n_docs, q.n_terms)
            at = np.minimum(np.searchsorted(have, q.known), max(0, len(have) - 1))
            lists: dict[int, tuple] = {}
            for t in np.flatnonzero((have[at] == q.known) & (q.weight > 0)).tolist() if len(have) else []:
                a, b = starts[at[t]], starts[at[t] + 1]
                place, tf = places[a:b].astype(np.int64), counts[a:b]
                lists[t] = (place, int(q.weight[t]) * (1_000_000_000 * tf // (1000 * tf + norm[place])))
            for terms, one in zip(asked, best):
                evaluate([lists[t] for t in terms.tolist() if t in lists], len(names), names, one, block, short)
    rows = [(r, n, s) for r, b in zip(q.rows, best) for n, s in zip(b.name, b.score.tolist())]
    yield pa.record_batch([pa.array([r for r, _, _ in rows], pa.int64()), pa.array([n for _, n, _ in rows], id_type), pa.array([s for *_, s in rows], pa.int64())], names=["query", "id", "score"])


def rank_documents(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", top: int = TOP, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES, block: int = BLOCK, short: float = SHORT) -> DataFrame:
    """(query_id, rank, id_col, score): for each query its `top` documents of a score above 0, equal scores by ascending id.

    Terms are runs of letters and digits, A-Z in lower case, told apart by 64-bit hashes; a null text has none. Every
    row is a document or a query of its own, whatever repeats, and equal ones get ranks of their own; null ids come
    last among equal scores. A query without a known term, an empty table of documents or of queries give no rows.
    A text of any length is read whole, by one task; other columns are not read. Queries travel in blocks of bounded
    size; all statistics are over all documents.
    """
    index = materialise(build_index(docs, id_col, text_col, shard_bytes), "search-index", file_rows=1)
    used = F.filter("lengths", lambda x: x > 0)
    n_docs, n_terms = index.select(F.size(used).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    sc, kind = docs.sparkSession.sparkContext, docs.schema[id_col].dataType.simpleString()
    id_type = pa.schema(docs.select(F.col(f"`{id_col}`")).limit(0).toArrow().schema).field(0).type
    query_kind, out, row = queries.schema[query_id].dataType.simpleString(), None, 0
    for names, terms in query_blocks(queries, query_id, query_text, query_bytes):
        known = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]))
        df = document_frequencies(index, known)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(known))], np.int64)
        sent = sc.broadcast(Queries(names, list(range(row, row + len(names))), terms, known, weight, n_docs, n_terms))
        row += len(names)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return search_shards(batches, sent.value, top, id_type, block, short)

        found = index.mapInArrow(run, f"query long, id {kind}, score long")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        ranked = found.withColumn("rank", place).where(F.col("rank") <= top)
        called = docs.sparkSession.createDataFrame(list(zip(range(row - len(names), row), names)), f"query long, name {query_kind}")
        ranked = ranked.join(F.broadcast(called), "query").select(F.col("name").alias(query_id), "rank", F.col("id").alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"`{query_id}` {query_kind}, rank int, `{id_col}` {kind}, score long")
