"""Toxicity by non-negative positive-unlabelled learning on hashed words and word beginnings.

Confirmed toxic rows are the positives; everything else of the training rows is unlabelled, toxic texts
among it included. The risk of a linear classifier is  pi * Rp(+) + max(0, Ru(-) - pi * Rp(-)),  with pi the
class prior; a step that would take the second term below zero goes the other way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import ASCII_LOWER, chunks, hashed_share, id_crc, run_hash, spans, text_bytes

BITS = 20
#: Bytes of the word beginnings that are features beside the whole words.
PREFIXES = (4, 5, 6, 7)
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Rows that training reads at most: confirmed positives and unlabelled ones.
POSITIVES, UNLABELLED = 1000, 2000
#: A feature is used if it is in so many confirmed texts, and so many times as frequent there as in unlabelled ones
#: even if its frequencies are so many standard errors off. Which of the pairs (texts, errors) holds is chosen on held-back rows.
RULES, LEAST_LIFT = ((3, 0.0), (2, 1.5)), 3.0
#: Parts of the training rows that are held back in turn.
PARTS = 4
#: The bias of a model that calls nothing toxic.
NEVER = -35.0


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of all texts: text number, feature and value.

    The value is the share of the logarithmic count; values of a text have length 1.
    """
    data, offsets = text_bytes(column)
    data = ASCII_LOWER[data]
    start, end, doc = spans(data, offsets, LETTER)
    codes, docs = [run_hash(data, start, end)], [doc]
    for n in PREFIXES:
        longer = end - start > n
        codes.append(run_hash(data, start[longer], start[longer] + n, seed=100 + n))
        docs.append(doc[longer])
    code = (np.concatenate(codes) >> np.uint64(64 - bits)).astype(np.int64)
    pair = np.sort((np.concatenate(docs) << bits) | code)
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    count, pair = np.diff(np.append(first, len(pair))), pair[first]
    doc, code = pair >> bits, pair & ((1 << bits) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value**2, minlength=len(column)))
    return doc, code, value / norm[doc] if len(doc) else value


def sampled(df: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of a bounded number of rows, worked out on the executors; the last array is the y column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            doc, code, value = features(batch.column("text"), bits)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.record_batch([batch.column("id"), batch.column("y"), pa.array([code[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([value[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["id", "y", "code", "value"])

    got = df.mapInArrow(run, "id string, y int, code binary, value binary").toArrow().sort_by([("y", "ascending"), ("id", "ascending"), ("code", "ascending")])
    parts = {}
    for name, kind in (("code", "<i4"), ("value", "<f4")):
        raw = got.column(name)
        sizes = pc.binary_length(raw).to_numpy() // 4
        parts[name] = np.frombuffer(b"".join(x.as_py() for x in raw), kind)
    y = got.column("y").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    del got, raw
    pa.default_memory_pool().release_unused()
    return row, parts["code"], parts["value"], y


def risk(z: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """pi * Rp(+) and Ru(-) - pi * Rp(-) of the margins z with logistic loss; p, u: the positive and unlabelled rows."""
    return prior * np.logaddexp(0, -z[p]).mean(), np.logaddexp(0, z[u]).mean() - prior * np.logaddexp(0, z[p]).mean()


def risk_slopes(z: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Slopes by z of the risk while its second part is not negative, else of that part turned round."""
    s, g = 1 / (1 + np.exp(-np.clip(z, -35, 35))), np.zeros(len(z))
    if risk(z, p, u, prior)[1] >= 0:
        g[p], g[u] = -prior / p.sum(), s[u] / u.sum()
    else:
        g[p], g[u] = prior * s[p] / p.sum(), -s[u] / u.sum()
    return g


def fit_nnpu(row: np.ndarray, code: np.ndarray, value: np.ndarray, y: np.ndarray, prior: float, bits: int = BITS, steps: int = 150, rate: float = 0.6, decay: float = 2e-6, rule: tuple[int, float] = RULES[0], least_lift: float = LEAST_LIFT) -> Model:
    """Full-batch Adam on the non-negative risk with logistic loss. y: 1 for a confirmed positive, 0 for an unlabelled row."""
    size = 1 << bits
    if not len(y) or not y.any() or y.all():
        return Model(np.zeros(size), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), prior)
    in_p, in_u = np.bincount(code[y[row] == 1], minlength=size), np.bincount(code[y[row] == 0], minlength=size)
    errors = np.sqrt(1 / np.maximum(in_p, 1) + 1 / (in_u + 1))
    kept = (in_p >= rule[0]) & (in_p / y.sum() >= least_lift * np.exp(rule[1] * errors) * (in_u + (0.5 if rule[1] else 0)) / (len(y) - y.sum()))
    ok = kept[code]
    names, code = np.unique(code[ok], return_inverse=True)
    row, value = row[ok], value[ok]
    n, p, u = len(y), y == 1, y == 0
    w, b = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        g = risk_slopes(np.bincount(row, value * w[code], minlength=n) + b, p, u, prior)
        grad = np.append(np.bincount(code, value * g[row], minlength=len(names)) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - t / (steps + 1))
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(size)
    weights[names] = w
    return Model(weights, float(b), prior)


def chosen_rule(row: np.ndarray, code: np.ndarray, value: np.ndarray, y: np.ndarray, prior: float, bits: int = BITS, rules=RULES, parts: int = PARTS) -> tuple[int, float]:
    """The rule of least risk on rows that its models have not seen, each part of either kind held back in turn; of equal ones the last.

    The risk counts mistakes: prior * missed positives + max(0, unlabelled ones called toxic - prior * found positives).
    """
    parts = min(parts, int(y.sum()), int((1 - y).sum()))
    if parts < 2:
        return rules[0]
    part = np.zeros(len(y), np.int64)
    for kind in (0, 1):
        at = np.flatnonzero(y == kind)
        part[at] = np.arange(len(at)) % parts
    risks = []
    for rule in rules:
        toxic = np.zeros(len(y), bool)
        for k in range(parts):
            seen = part != k
            inside, place = seen[row], np.cumsum(seen) - 1
            m = fit_nnpu(place[row[inside]], code[inside], value[inside], y[seen], prior, bits, rule=rule)
            z = np.bincount(row[~inside], value[~inside] * m.weights[code[~inside]], minlength=len(y)) + m.bias
            toxic[~seen] = z[~seen] >= 0
        found = toxic[y == 1].mean()
        risks.append(prior * (1 - found) + max(0.0, toxic[y == 0].mean() - prior * found))
    return min(zip(rules, risks), key=lambda r: (round(r[1], 12), -rules.index(r[0])))[0]


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED, bits: int = BITS) -> Model:
    """Learns from the documents of train_rows (a condition on doc_id).

    Positives are rows whose label is toxic = 1 (a document with several labels: their maximum). Unlabelled
    rows are the others, with or without a label. The prior is the share of toxic ones among labelled rows.
    Labels count only if their document is one of these rows. Without a confirmed text there is nothing to
    learn from: the model scores every text 0. Both samples are bounded by a hash of the id; text is read whole.
    """
    rows = docs.select("doc_id", "text").where(train_rows).where("doc_id is not null and text is not null")
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(train_rows)
    labels = labels.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    n, toxic = labels.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Model(np.zeros(1 << bits), NEVER, 0.0)
    total = rows.count()
    prior = min(0.95, max(0.001, toxic / n))
    # At most 2 x positives ids, so their size is bounded whatever the tables hold, and the texts stay where they are.
    confirmed = F.broadcast(hashed_share(labels.where("toxic = 1"), "doc_id", positives, toxic).select("doc_id", F.lit(1).alias("y")).limit(2 * positives))
    others = hashed_share(rows, "doc_id", unlabelled, total)
    plain = others.join(labels.where("toxic = 1"), "doc_id", "left_anti").withColumn("y", F.lit(0))
    marked = rows.join(confirmed, "doc_id")
    both = marked.unionByName(plain).select(F.col("doc_id").cast("string").alias("id"), "y", "text")
    # The hidden toxic share of the unlabelled rows: toxic ones without a confirmed label.
    share_known = n / max(total, 1)
    row, code, value, y = sampled(both, bits)
    hidden = prior * max(0.0, 1 - share_known) / max(1e-9, 1 - prior * share_known)
    hidden = min(0.95, max(0.001, hidden))
    return fit_nnpu(row, code, value, y, hidden, bits, rule=chosen_rule(row, code, value, y, hidden, bits))


def score(docs: DataFrame, model: Model, column: str = "toxicity_score") -> DataFrame:
    """docs plus a double between 0 and 1, higher where toxic is likelier; from the text alone.

    A null, empty or wordless text gets the score of the bias. A column of that name is replaced; other
    columns and repeated rows stay as they are; an empty table gives no rows. A text of any length is scored whole, by one task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() != column.lower()]
    source = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        bits = len(m.weights).bit_length() - 1
        for batch in chunks(batches):
            doc, code, value = features(batch.column(at), bits)
            z = np.bincount(doc, value * m.weights[code], minlength=batch.num_rows) + m.bias
            yield pa.record_batch([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=[*names, column])

    return source.mapInArrow(run, source.withColumn(column, F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """docs plus toxicity_score and toxic_predicted (1 from the threshold on); see train and score for odd rows."""
    train_rows = id_crc() % 5 != 0 if train_rows is None else train_rows
    model = train(docs, labels, train_rows)
    return score(docs, model).withColumn("toxic_predicted", (F.col("toxicity_score") >= threshold).cast("int"))


def remove_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with their columns; all of them if no label confirms one of them."""
    return classify(docs, labels, **options).where("toxic_predicted = 0").select(*[f"`{c}`" for c in docs.columns])
