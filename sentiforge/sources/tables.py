"""Access to the input tables (one parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Text tables whose per-row work (regexes, tokenising, n-grams) dominates, and their keys.
TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    A text table stored as few large row groups scans in few tasks, and all
    its per-row text work would then run on a handful of cores.  When the
    planned scan has fewer partitions than the cluster runs tasks at once,
    the rows are hash-partitioned on the table key (deterministic on retry,
    and later per-document aggregations reuse that partitioning).  A big
    input already scans in more splits than that, so it is left alone and
    no shuffle is added."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = TEXT_KEYS.get(name)
    if key is None:
        return df
    try:
        slots = spark.sparkContext.defaultParallelism
        few = df.rdd.getNumPartitions() < slots
    except Exception:  # noqa: BLE001 - sessions without an RDD API (Spark Connect): leave the scan as is
        return df
    return df.repartition(2 * slots, key) if few else df
