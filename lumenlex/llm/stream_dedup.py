"""Exact deduplication as a stateful stream.

A stream reads the documents' files and keeps, for every digest of a normalised text, the smallest doc_id, its content
locator (file and row) and the number of rows. The state is Spark's keyed aggregation state in RocksDB: on the
executors' disks, with its change log in the shared folder, without a watermark, so that nothing ever expires. Partial
aggregation in each task comes before the shuffle, so a text that a third of all rows hold reaches its key as one row
per task. New files only cost their own rows; the digests seen before lie in the state.

A hit is a row whose digest holds more than one row. Hits are compared by their full bytes: the normalised texts of a
digest are grouped as they are (again after partial aggregation), so that equal digests with different texts, should
they occur, become groups of their own.

Defined results: null and empty texts are equal (the empty text); of equal rows the smallest doc_id stays, and a null
doc_id stays only if no row of its group has one; repeated rows with the same doc_id count each, get a row each, and
are all marked as kept if theirs is the smallest id; an empty table gives an empty table; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlex.llm.common import scratch_path

#: Rows of the source: nothing but the id and the text is read.
SOURCE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    # Files are not laid out ahead of their contents: a small partition takes kilobytes, not megabytes.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.metricsEnabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def locator() -> tuple[Column, Column]:
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")


def first_row() -> Column:
    """The row that stays: the smallest doc_id, a null one last, with its locator."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "file", "row"))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column, bits: int = 256) -> Column:
    """SHA-256 of the normalised text in hex; ``bits`` below 256 keep a prefix only (tests of colliding digests)."""
    whole = F.sha2(normalised(text), 256)
    return whole if bits == 256 else F.substring(whole, 1, bits // 4)


def ingest(spark: SparkSession, path: str, checkpoint: str, bits: int = 256) -> DataFrame:
    """Feed all files under ``path`` that are not yet in the state, then return the state: one row per digest.

    Columns: digest, doc_id (smallest), file and row (its locator), n (rows so far). Called again with the same
    ``checkpoint``, it reads new files only. ``path`` is a folder or one file; as a pattern, it may be either. The number of state partitions is that of the first call.
    """
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(SOURCE).parquet(f"{path[:-1]}[{path[-1]}]").select("doc_id", digest_of(F.col("text"), bits).alias("digest"), *locator())
        held = rows.groupBy("digest").agg(first_row().alias("first"), F.count(F.lit(1)).alias("n"))
        out = f"{checkpoint}/changes"

        def emit(changes: DataFrame, batch: int) -> None:
            """A batch that runs again replaces what it wrote."""
            changes.select("digest", "first.doc_id", "first.file", "first.row", "n").write.mode("overwrite").parquet(f"{out}/batch={batch}")

        query = held.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, doc_id bigint, file string, row bigint, n bigint, batch int"
    changes = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*") if _any(spark, out) else spark.createDataFrame([], schema)
    latest = F.max(F.struct("batch", "n", "doc_id", "file", "row")).alias("x")
    return changes.groupBy("digest").agg(latest).select("digest", "x.doc_id", "x.file", "x.row", "x.n")


def _any(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def exact_groups(spark: SparkSession, path: str, checkpoint: str | None = None, bits: int = 256) -> DataFrame:
    """One row per row under ``path``: doc_id, keep_id, group_size, kept, text_sha256, keep_file, keep_row."""
    state = ingest(spark, path, checkpoint or scratch_path(spark, "stream-dedup"), bits)
    rows = spark.read.schema(SOURCE).parquet(path).select("doc_id", "text", *locator())
    return decide(rows, state, bits)


def decide(rows: DataFrame, state: DataFrame, bits: int = 256) -> DataFrame:
    """Hold every row against the state; hits by their full bytes."""
    digest, sha = digest_of(F.col("text"), bits), F.sha2(normalised(F.col("text")), 256)
    hits = rows.select("doc_id", "file", "row", normalised(F.col("text")).alias("bytes"), digest.alias("digest"))
    hits = hits.join(state.filter("n > 1").select("digest"), "digest", "left_semi")
    equal = hits.groupBy("digest", "bytes").agg(first_row().alias("first"), F.count(F.lit(1)).alias("n"))
    groups = equal.select("digest", F.sha2("bytes", 256).alias("sha"), "first.doc_id", "first.file", "first.row", "n")
    single = state.filter("n = 1").select("digest", F.lit(None).cast("string").alias("sha"), "doc_id", "file", "row", "n")
    held = single.unionByName(groups).alias("g")
    each = rows.select("doc_id", digest.alias("digest"), sha.alias("sha")).alias("r")
    # A lone row needs no comparison; the rest find the group of their very bytes.
    found = each.join(held, (F.col("r.digest") == F.col("g.digest")) & (F.col("g.sha").isNull() | (F.col("g.sha") == F.col("r.sha"))))
    kept = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id"))
    return found.select(
        F.col("r.doc_id").alias("doc_id"),
        F.col("g.doc_id").alias("keep_id"),
        F.col("g.n").alias("group_size"),
        kept.alias("kept"),
        F.col("r.sha").alias("text_sha256"),
        F.col("g.file").alias("keep_file"),
        F.col("g.row").alias("keep_row"),
    )


def op3_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents: the row that stays for it."""
    return exact_groups(spark, f"{sf_dir}/documents.parquet").drop("keep_file", "keep_row")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
