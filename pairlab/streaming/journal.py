"""The audit journal as a stream: a table of the latest verdict of each pair, kept while the journal grows.

The table is cut into buckets by a hash of the pair. A batch is merged into the buckets that it touches: each is
written anew under the batch's number, and a manifest of that number then says under which number each bucket
stands. Readers take the manifest of one version and see the table as it was then, whatever is being written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.sources.files import JOURNAL

BUCKETS = 16
MANIFEST = "bucket int, written long, pairs long, corrected long"


def journal_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_batch).json(path)


def journal_latest(records: DataFrame) -> DataFrame:
    """(id1, id2, audited_label, original_target, mode, judged_at): one row a pair, whatever comes late or twice.

    Of records at one time the greatest stays, so the order of arrival does not matter. Works on streams too.
    """
    last = records.groupBy("id1", "id2").agg(F.max(F.struct("judged_at", "audited_label", "original_target", "mode")).alias("r"))
    return last.select("id1", "id2", "r.audited_label", "r.original_target", "r.mode", "r.judged_at")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id1", "id2"), F.lit(buckets)).cast("int")


def corrected() -> Column:
    """Whether the verdict says otherwise than the label did."""
    return (F.col("audited_label") >= 0) & (F.col("audited_label") != F.col("original_target"))


def manifests(spark: SparkSession, out: str) -> DataFrame | None:
    """(version, bucket, written, pairs, corrected) of all versions; None if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{MANIFEST}, version long").parquet(f"{out}/manifest")


def merge(batch: DataFrame, number: int, out: str, buckets: int = BUCKETS) -> None:
    """Merges the records of a batch into the table. A batch that comes again replaces what it wrote, and late records lose to newer ones."""
    spark = batch.sparkSession
    known = manifests(spark, out)
    before = {} if known is None else {r.bucket: r for r in known.where((F.col("version") == known.where(F.col("version") < number).agg(F.max("version")).first()[0])).collect()}
    fresh = journal_latest(batch).withColumn("bucket", bucket_of(buckets)).persist()
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # at most `buckets` numbers
    paths = [f"{out}/data/version={before[b].written}/bucket={b}" for b in touched if b in before]
    rows = fresh.drop("bucket")
    if paths:
        rows = journal_latest(rows.unionByName(spark.read.schema(JOURNAL).parquet(*paths).select(rows.columns)))
    rows = rows.withColumn("bucket", bucket_of(buckets)).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/data/version={number}")
    fresh.unpersist()
    written = spark.read.schema(f"{JOURNAL}, bucket int").parquet(f"{out}/data/version={number}")
    counts = {r.bucket: (number, r.n, r.c) for r in written.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(corrected()).alias("c")).collect()}
    whole = {b: (r.written, r.pairs, r.corrected) for b, r in before.items()} | counts
    spark.createDataFrame([(b, *v) for b, v in sorted(whole.items())], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/version={number}")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Processes what is there and ends; the table in `out` then has all of it."""
    query = stream.writeStream.foreachBatch(lambda batch, number: merge(batch, number, out, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_table(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """The latest verdict of each pair as of a version, the newest if none is given; reads the files of that version alone."""
    known = manifests(spark, out)
    if known is None:
        return spark.createDataFrame([], JOURNAL)
    version = known.agg(F.max("version")).first()[0] if version is None else version
    paths = [f"{out}/data/version={r.written}/bucket={r.bucket}" for r in known.where(F.col("version") == version).collect()]
    return spark.read.schema(JOURNAL).parquet(*paths)


def growth(spark: SparkSession, out: str) -> DataFrame:
    """(version, pairs, corrected): how many pairs have a verdict, and how many labels are corrected, after each batch."""
    known = manifests(spark, out)
    empty = spark.createDataFrame([], f"{MANIFEST}, version long")
    return (empty if known is None else known).groupBy("version").agg(F.sum("pairs").alias("pairs"), F.sum("corrected").alias("corrected"))
