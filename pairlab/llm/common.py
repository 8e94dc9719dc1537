"""Shared helpers: scratch space on the cluster, bounded samples, and word spans over Arrow text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step turns into numpy arrays at once; a longer document is a chunk of its own.
CHUNK_BYTES = 4_000_000
#: Values that run_hash holds in wide form at one time.
SLICE = 1_000_000

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may have none; it then gets one of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and lost executors cost no rerun.

    file_rows: rows of a file at most, 0 for no bound. Writer and reader hold some hundred rows or all of a file at
    once, which is too much where a row has megabytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of the shared folder whose readers are done; what is not there is passed over."""
    inside = shared_dir(spark)
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(inside).toUri().getPath() + "/"):
            raise ValueError(f"{folder} is not within {inside}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_crc(column: str = "doc_id"):
    """crc32 of the id as text; the train and held-out rows come from it."""
    return F.crc32(F.col(column).cast("string"))


def hashed_share(df: DataFrame, column: str, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by a hash of the id; all of them where there are fewer."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(column), F.lit("sample")), F.lit(1_000_003)) < int(1_000_003 * rows / total))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about `limit` bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets of each; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes for which inside[byte] holds; no run crosses two texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    mask = inside[data]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over each other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each run; runs are in order, apart and not empty."""
    lengths = end - start
    out = np.zeros(len(lengths), np.uint64)
    if not len(lengths):
        return out
    factors, reach = multipliers(int(lengths.max()), seed), np.cumsum(lengths)
    cuts = np.unique(np.searchsorted(reach, np.arange(0, int(reach[-1]) + SLICE, SLICE)))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lengths)]):
        if a == b:
            continue
        size = lengths[a:b]
        at = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(at, size)
        got = values[within + np.repeat(start[a:b], size)].astype(np.uint64)
        with np.errstate(over="ignore"):
            got += np.uint64(1)
            got *= factors[within]
            out[a:b] = mix(np.add.reduceat(got, at) + size.astype(np.uint64))
    return out
