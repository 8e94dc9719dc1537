"""The queries opN_<name> over the documents, pages, benchmark and labels tables.

Each reads its whole table and gives a row for each of its rows (op3: for each piece; op11: for each item and place).
Odd rows are the operators' matter and told there; a query adds that ids may repeat, be null or be missing altogether.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm import decontaminate, html_crf, jaccard, langid, lm, merkle, packing, pii, runs, search, secrets, simhash, toxicity
from pairlab.llm.common import chunks, id_crc, table


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_pairs(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    got = html_crf.extract(pages, html_crf.train(pages))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.classify(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    return got.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lm.word_score(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_grams", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, id_crc() % 4 != 2)
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(docs, pii.train(docs))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(docs, secrets.train(docs))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document, some of which get a repeated tail first; the digests are of the runs and of the words kept."""
    found = runs.find_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    denser = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    found = found.withColumn("best", denser)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the texts of one id in ten, chosen by crc32 of the id, the tail repeats its first words. A null id changes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
                if h % 10 == 0 and (words := (texts[k] or "").encode().split()):
                    g = h // 10
                    a = g % len(words)
                    p = 1 + (len(words) - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + i % p] for i in range(len(words) - a)]).decode()
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", "text").schema)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingle sets overlap by 0.8 or more."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


#: The words of a text as op6 takes them.
WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x20]+')"

#: The words of a text as op4 takes them.
PLAIN_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = {
    "op4_benchmark_decontamination": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {PLAIN_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item, {PLAIN_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i : i + 9], ' '))) AS gram
        FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS gram
      FROM d, sizes WHERE len(w) >= n),
found AS MATERIALIZED (SELECT p.r, p.i, win.n, win.item FROM p JOIN win ON win.n = p.n AND win.gram = p.gram),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM found) GROUP BY r),
one AS (SELECT DISTINCT unnest(w) AS word FROM b),
single AS (SELECT DISTINCT r FROM (SELECT r, unnest(w) AS word FROM d) SEMI JOIN one USING (word)),
pairs AS (SELECT x.r, y.k, x.i, x.i - y.j AS shift
          FROM (SELECT r, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS two FROM d WHERE len(w) > 1) x
          JOIN (SELECT k, unnest(range(1, len(w))) AS j, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS two FROM b WHERE len(w) > 1) y USING (two)),
isles AS (SELECT r, k, shift, i - row_number() OVER (PARTITION BY r, k, shift ORDER BY i) AS isle FROM pairs),
long AS (SELECT r, max(n) + 1 AS n FROM (SELECT r, count(*) AS n FROM isles GROUP BY r, k, shift, isle) GROUP BY r),
most AS (SELECT single.r, coalesce(long.n, 1) AS n FROM single LEFT JOIN long ON long.r = single.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       coalesce(it.items_sha256, sha256('')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated, CAST(coalesce(most.n, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN it ON it.r = d.r LEFT JOIN most ON most.r = d.r""",
    "op6_lm_scores": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, i, n, array_to_string(w[i - n + 1 : i], ' ') AS gram, array_to_string(w[i - n + 1 : i - 1], ' ') AS context
      FROM p, range(1, 5) AS s(n) WHERE i >= n),
own AS MATERIALIZED (SELECT r, n, gram, count(*) AS own FROM g GROUP BY r, n, gram),
c AS (SELECT n, gram, sum(own) AS c FROM own GROUP BY n, gram),
o AS MATERIALIZED (SELECT own.r, own.n, own.gram, CAST(c.c - own.own AS DOUBLE) AS o FROM own JOIN c ON c.n = own.n AND c.gram = own.gram WHERE c.c > own.own),
t AS (SELECT sum(len(w)) AS total FROM d),
f AS (SELECT g.r, g.i, g.n, o.o / (CASE WHEN g.n = 1 THEN t.total - len(d.w) ELSE b.o END) AS share
      FROM g JOIN o ON o.r = g.r AND o.n = g.n AND o.gram = g.gram JOIN d ON d.r = g.r CROSS JOIN t
      LEFT JOIN o AS b ON b.r = g.r AND b.n = g.n - 1 AND b.gram = g.context
      UNION ALL SELECT p.r, p.i, 0, 1.0 / t.total FROM p CROSS JOIN t),
s AS (SELECT r, i, max_by(ln(share) + (least(4, i) - n) * ln(0.4), n) AS points FROM f GROUP BY r, i),
q AS (SELECT r, sum(points) AS log_score FROM s GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_grams, round(coalesce(q.log_score, 0), 4) AS log_score,
       CASE WHEN len(d.w) > 0 THEN round(q.log_score / len(d.w), 6) END AS mean_log_score
FROM d LEFT JOIN q ON q.r = d.r""",
    "op11_ranked_search": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {PLAIN_WORDS} AS w FROM documents),
tot AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS MATERIALIZED (SELECT DISTINCT k, item_id, term FROM (SELECT row_number() OVER () AS k, item_id, unnest({PLAIN_WORDS}) AS term FROM benchmark)),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
       FROM (SELECT term, count(*) AS df FROM tf SEMI JOIN q USING (term) GROUP BY term), tot),
m AS (SELECT r, doc_id, 50 + (50 * CAST(len(w) AS BIGINT) * docs) // terms AS m FROM d, tot),
s AS (SELECT q.k, q.item_id, m.r, m.doc_id, CAST(sum(wt.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m ON m.r = tf.r GROUP BY q.k, q.item_id, m.r, m.doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50""",
    "op13_jaccard_join": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS gram FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
l AS MATERIALIZED (SELECT x.r AS a, y.r AS b FROM g x JOIN g y ON x.gram = y.gram AND x.r <> y.r JOIN n p ON p.r = x.r JOIN n q ON q.r = y.r
      GROUP BY x.r, y.r, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
c AS (SELECT r AS a, r AS b FROM n UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
k AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN k ON k.r = d.r""",
}


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
