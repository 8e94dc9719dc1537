"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword; a binary logistic classifier predicts each bit from the n-grams of the letters.
Decoding takes the codeword of least summed logistic loss and flags a text whose runner-up is close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import ASCII_LOWER, chunks, mix, text_bytes

BITS = 15
#: Training rows of a language at most.
ROWS_A_LANGUAGE = 400
#: Two and three languages have so few splits that each is learned so many times, from other features each time.
REPEATS = {2: 5, 3: 3}
#: A text is ambiguous if the winner's probability is below this.
CLEAR = 0.6
#: Bytes other than ASCII letters and non-ASCII ones become blanks.
LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)[ASCII_LOWER]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 and 1
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    scale: float


def codewords(k: int) -> np.ndarray:
    """All different splits up to seven languages, for two and three more than once; beyond that 16 + 4 log2(k) hashed bits.

    Any two codewords differ in three bits at least, hashed ones in a quarter of their bits, so a wrong bit is corrected.
    """
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        splits = [(1, *x) for x in product((1, -1), repeat=k - 1)][1:]
        return np.tile(np.array(splits, float).T, (1, REPEATS.get(k, 1)))
    rng, length = np.random.default_rng(k), 16 + 4 * int(np.ceil(np.log2(k)))
    while True:
        code = np.zeros((0, length))
        while len(code) < k:
            row = rng.choice([-1.0, 1.0], length)
            if ((code != row).sum(1) >= length / 4).all():
                code = np.vstack([code, row])
        if (abs(code.sum(0)) < k).all():
            return code


def column_features(codes: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which features each bit's classifier uses: all, but where a split comes more than once each reads its own two thirds."""
    number = np.arange(1, codes.shape[1] + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mask = mix(names[:, None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number) % np.uint64(3) != 0
    return mask | (len(codes) not in REPEATS)


def grams(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed one- to three-byte grams of all texts: feature of each, and text number; runs of blanks count once."""
    data, offsets = text_bytes(column)
    data = LETTERS[data]
    doc = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(offsets))
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    data, doc = data[kept].astype(np.uint32), doc[kept]
    codes, docs = [], []
    key = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        key = data if n == 1 else (key[:-1] << np.uint32(8)) | data[n - 1 :]
        same = slice(None) if n == 1 else doc[n - 1 :] == doc[: len(doc) - n + 1]
        got = key[same] + np.uint32(n << 26)
        codes.append((got * np.uint32(2654435761)) >> np.uint32(32 - bits))
        docs.append(doc[: len(key)][same])
    return np.concatenate(codes), np.concatenate(docs)


def histogram(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each text; values have length 1."""
    code, doc = grams(column, bits)
    order = np.argsort(doc, kind="stable")
    code, cut = code[order], np.searchsorted(doc[order], np.arange(len(column) + 1))
    for a, b in zip(cut, cut[1:]):
        count = np.bincount(code[a:b], minlength=1)
        at = np.flatnonzero(count)
        value = np.sqrt(count[at])
        yield at, value / max(1e-9, np.sqrt((value**2).sum()))


def train(docs: DataFrame, train_rows: Column, rows: int = ROWS_A_LANGUAGE, bits: int = BITS, steps: int = 60, rate: float = 0.8, decay: float = 1e-5) -> Model:
    """Learns from text and lang of train_rows (a condition on doc_id) with a lang and a text with a letter.

    Each language gives at most about `rows` rows, by a hash of the id; they are weighted so that all
    languages count alike. Without rows the model has no language.
    """
    known = docs.select("doc_id", "text", "lang").where(train_rows).where("lang is not null and text is not null and doc_id is not null")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(1_000_003 * min(1, rows / n))))]) if counts else None
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((1 << bits, 1)), np.ones(1), 1.0)
    part = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) <= share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = list(histogram(batch.column("text"), bits))
            yield pa.record_batch([batch.column("id"), batch.column("lang"), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())], names=["id", "lang", "code", "value"])

    got = part.select(F.col("doc_id").cast("string").alias("id"), "lang", "text").mapInArrow(run, "id string, lang string, code binary, value binary").toArrow()
    got = got.sort_by([("lang", "ascending"), ("id", "ascending"), ("code", "ascending")])
    raw = got.column("code").to_pylist()
    row = np.repeat(np.arange(len(raw)), [len(c) // 4 for c in raw])
    code = np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
    value = np.frombuffer(b"".join(got.column("value").to_pylist()), "<f4").astype(np.float64)
    names, code = np.unique(code, return_inverse=True)
    label = np.array([languages.index(x) for x in got.column("lang").to_pylist()])
    weight = (1 / np.bincount(label, minlength=len(languages)))[label] / len(languages)
    target, n = codes[label], len(label)
    w, b = np.zeros((len(names), codes.shape[1])), np.zeros(codes.shape[1])
    cut = np.searchsorted(row, np.arange(n))
    by_code = np.argsort(code, kind="stable")
    code_cut = np.searchsorted(code[by_code], np.arange(len(names)))
    used = column_features(codes, names)
    m, v = np.zeros((len(names) + 1, codes.shape[1])), np.zeros((len(names) + 1, codes.shape[1]))
    full = np.diff(np.append(cut, len(row))) > 0
    for t in range(1, steps + 1):
        z = np.zeros((n, codes.shape[1]))
        for k in range(codes.shape[1]):
            z[full, k] = np.add.reduceat(value * w[code, k], cut[full])
        z += b
        g = -target * weight[:, None] / (1 + np.exp(np.clip(target * z, -35, 35)))
        grad = np.empty_like(m)
        for k in range(codes.shape[1]):
            grad[:-1, k] = np.add.reduceat((value * g[row, k])[by_code], code_cut) + decay * w[:, k]
        grad[:-1] *= used
        grad[-1] = g.sum(0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9) * (1 - t / (steps + 1))
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros((1 << bits, codes.shape[1]))
    weights[names] = w
    return Model(languages, codes, weights.astype(np.float32), b, 1.0)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss-weighted decoding: the language of least summed loss, and its share of exp(-loss)."""
    loss = np.stack([np.logaddexp(0, -model.codes[k] * margins).sum(1) for k in range(len(model.languages))], 1)
    close = np.exp(-(loss - loss.min(1, keepdims=True)))
    best = loss.argmin(1)
    return best, close[np.arange(len(best)), best] / close.sum(1)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred, lang_score (0 to 1) and lang_ambiguous, from the text alone.

    A text between several languages takes the first by name. A null text or one without a letter is `und` with score 0, as is every text if the model has no
    language. Columns of those names are replaced, others pass through; repeated rows stay.
    An empty table gives no rows; a text of any length is read whole, by one task.
    """
    added = {"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_ambiguous": F.lit(False)}
    names = [c for c in docs.columns if c.lower() not in added]
    source, at = docs.select(*[F.col(f"`{c}`") for c in names]), names.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = [*names, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        bits = len(m.weights).bit_length() - 1
        for batch in chunks(batches, "text", 2_000_000):
            column = batch.column(at)
            n = batch.num_rows
            ok = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            margins = np.zeros((n, m.codes.shape[1] if len(m.codes) else 1))
            for d, (code, value) in enumerate(histogram(column, bits)):
                margins[d] = value @ m.weights[code] + m.bias
            if m.languages:
                best, score = decode(m, margins)
            else:
                best, score, ok = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            pred = [m.languages[b] if k else "und" for b, k in zip(best.tolist(), ok)]
            score = np.where(ok, score, 0.0)
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ok & (score < CLEAR))], names=columns)

    return source.mapInArrow(run, source.withColumns(added).schema)
