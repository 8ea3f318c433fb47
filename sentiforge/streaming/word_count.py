"""Running word counts over a growing directory of JSON-lines tweet files.

A stateful streaming aggregation (``groupBy(token).count()`` in update mode):
the state lives in RocksDB on the executors' disks, state and progress log are
kept below a checkpoint folder, so a restarted query resumes where it stopped.

The sink is a table keyed by token, in ``BUCKETS`` buckets of the token's hash.  A
micro-batch rewrites the buckets it touches, old counts and new ones merged, as
files of its own version (the batch id), and then writes a manifest: which
version of every bucket is current.  The manifest is the commit; what no manifest
needs any more is deleted after it.  A batch that is run again after a failure
starts from the manifest before it and gives the same table; the table does not
grow with the number of batches.  Tweet time is never read, so there is no
watermark (the reference has no late-data handling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.functions.text import split_ws
from sentiforge.scratch import committed, hadoop_path, remove

BUCKETS = 64
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def token_stream(spark: SparkSession, src_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Whitespace tokens of texts holding more than one token."""
    reader = spark.readStream.schema("text string")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    s = reader.json(src_dir)
    toks = s.select(split_ws(F.col("text")).alias("t")).where(F.size("t") > 1)
    return toks.select(F.explode("t").alias("token"))


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Batch ids of the finished ``batch=<id>`` folders, ascending."""
    system, path = hadoop_path(spark, folder)
    if not system.exists(path):
        return []
    names = [f.getPath().getName() for f in system.listStatus(path)]
    ids = [int(n[6:]) for n in names if n.startswith("batch=")]
    return sorted(i for i in ids if committed(spark, f"{folder}/batch={i}"))


def manifest(spark: SparkSession, out_dir: str, before: int | None = None) -> dict[int, int]:
    """``bucket -> version`` of the last commit (of the last one before a batch); at most ``BUCKETS`` entries."""
    ids = [i for i in _batches(spark, f"{out_dir}/manifest") if before is None or i < before]
    if not ids:
        return {}
    rows = spark.read.schema("bucket int, version long").parquet(f"{out_dir}/manifest/batch={ids[-1]}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _read(spark: SparkSession, out_dir: str, parts: dict[int, int]) -> DataFrame:
    paths = [f"{out_dir}/data/batch={v}/bucket={b}" for b, v in sorted(parts.items())]
    schema = "token string, n long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_batch(spark: SparkSession, batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """Bring the new counts ``(token, n)`` of a batch into the table at ``out_dir``."""
    if committed(spark, f"{out_dir}/manifest/batch={batch_id}"):
        return
    now = manifest(spark, out_dir, batch_id)
    new = batch.select("token", "n", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket")).persist()
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]      # BUCKETS at most
    old = _read(spark, out_dir, {b: v for b, v in now.items() if b in touched})
    old = old.select("token", "n", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    merged = new.unionByName(old.join(new.select("token"), "token", "left_anti"))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out_dir}/data/batch={batch_id}")
    new.unpersist()
    now |= dict.fromkeys(touched, batch_id)
    rows = spark.createDataFrame(sorted(now.items()), "bucket int, version long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/manifest/batch={batch_id}")
    # one manifest back stays, for readers that have just opened it
    ids = _batches(spark, f"{out_dir}/manifest")
    needed = set(now.values()) | set(manifest(spark, out_dir, batch_id).values())
    for i in _batches(spark, f"{out_dir}/data"):
        if i not in needed:
            remove(spark, f"{out_dir}/data/batch={i}")
    for i in ids[:-2]:
        remove(spark, f"{out_dir}/manifest/batch={i}")


def run_word_counts(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str,
                    available_now: bool = True, processing_time: str | None = None, files_per_batch: int | None = None):
    """Start (and with ``available_now`` wait for) the counting query."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    counts = token_stream(spark, src_dir, files_per_batch).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch.sparkSession, batch, batch_id, out_dir)

    w = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def current_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """``(token, n)``: the table as of the last commit."""
    return _read(spark, out_dir, manifest(spark, out_dir))
