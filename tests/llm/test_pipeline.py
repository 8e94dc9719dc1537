"""The pipeline's stages against brute force, one after another."""

import collections
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from pairlab.llm.common import materialise
from tests.llm.test_operators import CLASH, ROWS, SCHEMA, brute_fingerprint, brute_overlaps

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    toxic, plain = ({r.doc_id for r in labels if r.toxic == k} for k in (1, 0))
    seen = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), name)
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        if name == "toxicity":
            gone = set(seen) - {r.doc_id for r in rows}
            assert len(gone & toxic) >= 0.7 * len(toxic & set(seen)) > 0 and not gone & plain
        elif name == "simhash_near_dedup":
            prints = {i: np.uint64(brute_fingerprint(r.text)) for i, r in seen.items()}
            group = {i: i for i in seen}
            for _ in range(8):
                for i in seen:
                    group[i] = min(group[j] for j in seen if np.bitwise_count(prints[i] ^ prints[j]) <= 4)
            assert sorted(r.doc_id for r in rows) == sorted(i for i in seen if group[i] == i)
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            ids = sorted(seen)
            hit = dict(zip(ids, brute_overlaps([seen[i].text for i in ids], items)))
            assert sorted(r.doc_id for r in rows) == [i for i in ids if not hit[i][4]]
        elif name == "secret_scans":
            assert sorted(r.doc_id for r in rows) == sorted(seen)
            assert not any(re.search(r'token = "[0-9a-f]{40}|AKIA[A-Z0-9]{16}', r.text or "") for r in rows)
        else:
            assert {r.doc_id for r in rows} == set(seen)
            used = collections.Counter()
            for r in rows:
                used[r.sequence_id] += r.length
            assert max(used.values()) <= 1024
        docs, seen = out, {r.doc_id: r for r in rows}


def test_run_returns_pieces(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_take_odd_rows(spark, tmp_path):
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASH:
        docs = docs.withColumn(name, F.lit("mine"))
    counts = []
    for df in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            df = materialise(stage(spark, df, str(tmp_path)), "odd")
            counts.append(df.count())
    assert counts[:4] == [len(ROWS), 7, 7, 7] and counts[4] > 7 and counts[5:] == [0] * 5
