"""Periodic runs of words: stretches that repeat themselves, found in an enhanced suffix array.

A square is a stretch of words that stands twice in a row. It branches if no word follows that would repeat once
more: its two halves then lie in different children of the LCP interval whose depth is their length. So for each
interval the suffixes of all children but the largest look up, in the inverse suffix array, whether the suffix
`depth` words on or back is in the interval too. Intervals come from the nearest smaller LCP values to either side;
no tree is built. A branching square ends its run; rotated to the left as far as words repeat it becomes the run,
and longer squares that are powers of it merge into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import chunks, run_hash, spans, text_bytes
from pairlab.llm.decontaminate import suffix_array

#: Bytes of words: all but blanks (0x20 and 0x09 to 0x0D).
WORD = np.array([b != 0x20 and not 9 <= b <= 13 for b in range(256)])
#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Suffixes, or words of compared pairs, that are looked at in one step.
STEP = 2_000_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def shared_words(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the text has alike from a and from b on; text ends in a 0, and a pair meets no two zeros at once."""
    got, going, width, last = np.zeros(len(a), np.int64), np.arange(len(a)), 4, len(text) - 1
    while len(going):
        following, wide = [], np.arange(width)
        for part in np.array_split(going, max(1, len(going) * width // STEP)):
            reach = got[part][:, None] + wide
            same = text[np.minimum(a[part][:, None] + reach, last)] == text[np.minimum(b[part][:, None] + reach, last)]
            whole = same.all(1)
            got[part] += np.where(whole, width, same.argmin(1))
            following.append(part[whole])
        going, width = np.concatenate(following), min(2 * width, 4096)
    return got


def lcp_array(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words that each suffix of the order shares with the one before; -1 at the start and behind the end.

    A suffix whose preceding word equals that of its predecessor shares one word less than the suffix that starts
    there; only the others are compared, which is n log n words in all.
    """
    n = len(order)
    out = np.full(n + 1, -1, np.int64)
    if n < 2:
        return out
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.sort(order)
    prior = before[at]
    own = (prior < 1) | (at < 1)
    own |= text[np.maximum(at - 1, 0)] != text[np.maximum(prior - 1, 0)]
    own |= text[np.maximum(at - 1, 0)] == 0
    shared = np.zeros(len(text), np.int64)
    heads = at[own & (prior >= 0)]
    shared[heads] = shared_words(text, heads, before[heads])
    anchor = np.zeros(len(text), np.int64)
    anchor[at[own]] = at[own]
    anchor = np.maximum.accumulate(anchor)
    out[1:n] = shared[anchor[order[1:]]] - (order[1:] - anchor[order[1:]])
    return out


def nearest_smaller(values: np.ndarray, step: int) -> np.ndarray:
    """For each positive value the place of the nearest smaller one in the direction of step; pointers jump over each other."""
    near = np.arange(len(values)) + step
    going = np.flatnonzero(values > 0)
    while len(going):
        going = going[values[near[going]] >= values[going]]
        near[going] = near[near[going]]
    return near


def branching_squares(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of every branching square."""
    lcp = lcp_array(text, order)
    at = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    rank = np.full(len(text) + 1, -1, np.int64)
    rank[order] = np.arange(len(order))
    left, right = nearest_smaller(lcp, -1)[at], nearest_smaller(lcp, 1)[at]
    by = np.lexsort((at, lcp[at], left))
    at, left, right, depth = at[by], left[by], right[by], lcp[at[by]]
    # An interval's children: from its left end to its first minimum, and from each minimum to the next or the right end.
    first = np.concatenate([[True], (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])])
    last = np.concatenate([first[1:], [True]])
    lead = np.flatnonzero(first)
    start = np.insert(at, lead, left[lead])
    end = np.insert(np.where(last, right, np.append(at[1:], 0)), lead, at[lead])
    spread = np.insert(np.arange(len(at)), lead, lead)
    left, right, depth = left[spread], right[spread], depth[spread]
    heads = lead + np.arange(len(lead))
    size = end - start
    most = np.repeat(np.maximum.reduceat(size, heads), np.diff(np.append(heads, len(size))))
    largest = np.flatnonzero(size == most)
    group = np.searchsorted(heads, largest, "right")
    small = np.ones(len(size), bool)
    small[largest[np.concatenate([[True], group[1:] != group[:-1]])]] = False
    start, end, left, right, depth = (x[small] for x in (start, end, left, right, depth))
    found_start, found_half, reach = [none], [none], np.cumsum(end - start)
    cuts = np.unique(np.searchsorted(reach, np.arange(STEP, int(reach[-1]) + STEP, STEP), "right"))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(start)]):
        if a == b:
            continue
        many = (end - start)[a:b]
        child = np.repeat(np.arange(a, b), many)
        suffix = order[start[child] + np.arange(len(child)) - np.repeat(np.cumsum(many) - many, many)]
        for way in (1, -1):
            other = suffix + way * depth[child]
            place = rank[np.clip(other, -1, len(text))]  # -1 and len(text) have no rank
            inside = (place >= left[child]) & (place < right[child]) & ((place < start[child]) | (place >= end[child]))
            found_start.append(np.minimum(suffix, other)[inside])
            found_half.append(depth[child][inside])
    both = np.unique(np.stack([np.concatenate(found_start), np.concatenate(found_half)]), axis=1)
    return both[0], both[1]


def runs_of(words: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Columns text number, start, length and period of the runs of several texts, by text, start and period.

    words: the words of all texts as numbers; first: where each text's words start, and the end.
    """
    n_texts, count = len(first) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_texts), count)
    if not len(words):
        return np.zeros((0, 4), np.int64)
    # A word's number is its own in each text, so that no suffix meets another text's.
    by = np.lexsort((words, doc))
    fresh = np.concatenate([[True], (words[by][1:] != words[by][:-1]) | (doc[by][1:] != doc[by][:-1])])
    text = np.zeros(len(words) + n_texts + 1, np.int64)
    text[by + doc[by]] = np.cumsum(fresh)
    order = suffix_array(text, int(count.max()))
    start, half = branching_squares(text, order[text[order] > 0])
    end, back = start + 2 * half, np.append(text[::-1], 0)
    found, n = [np.zeros((0, 4), np.int64)], len(text)
    by = np.lexsort((half, end))
    start, half, end = start[by], half[by], end[by]
    while len(end):
        one = np.concatenate([[True], end[1:] != end[:-1]])  # the shortest of each end is no power
        s, p, e = start[one], half[one], end[one]
        s = s - shared_words(back, n - s, n - s - p)
        whole = (e - s >= least_words) & (e - s >= least_periods * p)
        d = doc[s[whole] - np.searchsorted(first[1:-1] + np.arange(1, n_texts), s[whole], "right")]
        found.append(np.stack([d, s[whole] - (first[d] + d), (e - s)[whole], p[whole]], axis=1))
        which = np.cumsum(one) - 1
        rest = ~((half % p[which] == 0) & (start >= s[which]))
        start, half, end = start[rest], half[rest], end[rest]
    got = np.concatenate(found)
    return got[np.lexsort((got[:, 3], got[:, 1], got[:, 0]))]


def dropped(runs: np.ndarray, n_words: int) -> np.ndarray:
    """Which words of a text some run contains after its first period; runs: start, length, period."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def find_runs(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """docs plus runs (start, length, period; by start, then period) and collapsed, the text without repetitions.

    Words are what blanks part, numbered from 0. A run is a stretch of words with a least period, at least
    least_words and least_periods periods long, that no neighbouring word extends. collapsed has the words that no
    run contains after its first period, one blank between them. A null, empty or wordless text has no runs and an
    empty collapsed text. A row stays a row, whatever repeats; other columns pass through, columns named runs or
    collapsed are replaced; an empty table gives no rows. A text of any length is searched whole, by one task.
    """
    names = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    source = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def renamed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.record_batch(b.columns, names=[f"c{i}" if i != at else "text" for i in range(b.num_columns)])

        for batch in chunks(renamed()):
            data, offsets = text_bytes(batch.column(at))
            start, end, doc = spans(data, offsets, WORD)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            got = runs_of(run_hash(data, start, end), first, least_words, least_periods)
            cut = np.searchsorted(got[:, 0], np.arange(batch.num_rows + 1))
            texts, raw = [], data.tobytes()
            for d in range(batch.num_rows):
                words = raw[offsets[d] : offsets[d + 1]].split()
                mine = got[cut[d] : cut[d + 1], 1:]
                if len(mine):
                    words = [words[i] for i in np.flatnonzero(~dropped(mine, len(words))).tolist()]
                texts.append(b" ".join(words))
            parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in (1, 2, 3)], fields=list(kinds.value_type))
            runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), parts).cast(kinds)
            yield pa.record_batch([*batch.columns, runs, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "runs", "collapsed"])

    schema = source.withColumns({"runs": F.lit(None).cast(RUNS), "collapsed": F.lit("")}).schema
    return source.mapInArrow(run, schema)
