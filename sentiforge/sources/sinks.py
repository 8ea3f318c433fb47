"""Writers for the reference's outputs.  All are distributed ``df.write``
calls; nothing is gathered on the driver.  Paths should be on shared
storage on a cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiforge.functions.arrays import argmax
from sentiforge.operators.labels import decode_fixed
from sentiforge.scratch import committed


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (the splittable form of a records array)."""
    df.write.mode(mode).json(path)


def write_predictions(df: DataFrame, path: str, classes: Sequence[str], full: bool = True,
                      mode: str = "overwrite") -> None:
    """Prediction file from ``(uid, clean_text, p array<double>)``: decoded arg-max
    label, and with ``full`` one ``proba_<class>`` column per class."""
    label = decode_fixed(argmax(F.col("p")), classes).alias("sentiment")
    cols = [F.col("uid"), label, F.col("clean_text")]
    if full:
        cols += [F.get(F.col("p"), j).alias(f"proba_{c}") for j, c in enumerate(classes)]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def write_submission(df: DataFrame, path: str, label_col: str = "sentiment", mode: str = "overwrite") -> None:
    """``uid,<label>`` with a header, sorted by uid (a distributed range sort)."""
    df.select("uid", label_col).orderBy("uid").write.mode(mode).option("header", True).csv(path)


def write_lines(df: DataFrame, text_col: str, path: str, mode: str = "overwrite") -> None:
    """One non-empty document per line."""
    df.select(F.col(text_col).alias("value")).where(F.length("value") > 0).write.mode(mode).text(path)


def write_records(df: DataFrame, path: str, line_break: str = "\n", mode: str = "overwrite") -> None:
    """Blank-line separated records of ``(uid, sentiment, tokens)``: the form ``annotated_records`` reads.

    Without a ``sentiment`` column the header has two fields.  Tokens must hold neither tabs nor line ends."""
    head = [F.lit("meta"), F.col("uid").cast("string")]
    if "sentiment" in df.columns:
        head.append(F.coalesce("sentiment", F.lit("")))
    lines = F.concat(F.array(F.concat_ws("\t", *head)), F.transform("tokens", lambda t: F.concat(t, F.lit("\tO"))))
    rec = F.concat(F.array_join(lines, line_break), F.lit(line_break))
    df.select(rec.alias("value")).write.mode(mode).option("lineSep", line_break).text(path)


def write_error_report(errors: DataFrame, path: str, classes: Sequence[str], mode: str = "overwrite") -> None:
    """Four-line records from ``(uid, pred, text)``."""
    names = F.array(*[F.lit(c) for c in classes])
    rec = F.format_string("Estimated Error in %d\npredicted %s\n sentence %s\n -----",
                          F.col("uid"), F.get(names, F.col("pred")), F.col("text"))
    errors.select(rec.alias("value")).write.mode(mode).text(path)


def append_metrics(spark: SparkSession, path: str, run: str, step: int, metrics: dict[str, float]) -> None:
    """Append ``(run, step, metric, value)`` rows to a Parquet metric log."""
    rows = [(run, int(step), k, float(v)) for k, v in sorted(metrics.items())]
    spark.createDataFrame(rows, "run string, step long, metric string, value double").write.mode(
        "append").parquet(path)


def metrics_from(df: DataFrame, run: str, step: int) -> DataFrame:
    """Long metric rows from a one-row metric table (no driver round trip)."""
    value_cols = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int")]
    packed = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                       for c in value_cols])
    return df.select(F.lit(run).alias("run"), F.lit(step).cast("long").alias("step"), F.inline(packed))


def write_result(metrics: DataFrame, path: str) -> None:
    """Lines ``name = value`` in order of the names from ``(metric, value)``, one file.

    Spark's commit marker stands beside the file; without it the result is not complete."""
    line = F.concat(F.col("metric"), F.lit(" = "), F.col("value").cast("string"))
    metrics.select("metric", line.alias("value")).coalesce(1).sortWithinPartitions("metric").select("value").write.mode("overwrite").text(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """``(metric, value)`` of a result file; raises where the write was not finished."""
    if not committed(spark, path):
        raise FileNotFoundError(f"no finished result at {path}")
    parts = F.regexp_extract_all("value", F.lit(r"\A(.*) = (.*)\z"), F.lit(0))
    raw = spark.read.text(path).where(F.size(parts) > 0)
    return raw.select(F.regexp_extract("value", r"\A(.*) = (.*)\z", 1).alias("metric"),
                      F.regexp_extract("value", r"\A(.*) = (.*)\z", 2).cast("double").alias("value"))


def cached(spark: SparkSession, df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Feature cache: write ``df`` as Parquet unless it is already there (or ``overwrite``),
    then read it back, which also cuts the lineage of the features.  A folder without a
    commit marker was left half-written: it is not used but written anew."""
    if overwrite or not committed(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cache_path(root: str, inputs: Sequence[str], settings: dict) -> str:
    """A folder below ``root`` that is the same for the same inputs and settings only."""
    import hashlib
    import json
    key = json.dumps([sorted(inputs), settings], sort_keys=True, default=str)
    return f"{root.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
