"""Readers for the corpus formats of the reference, each an ordinary
``spark.read`` with an explicit schema plus column expressions.

Splittable formats (JSON lines, CSV, text, blank-line separated records)
scale with the number of files and blocks.  The two whole-document JSON
layouts (a JSON array, a column-oriented object) are read as one record
per file, as their layout requires; write them back as JSON lines/Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentiforge.functions.text import SPACE
from sentiforge.operators.ordering import row_index
from sentiforge.sources.records import SPLIT_BYTES, read_records

RECORD_SCHEMA = "uid long, sentiment string, text string, clean_text string"


def annotated_records(spark: SparkSession, path, labelled: bool = True, parity: bool = False,
                      split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Blank-line separated records: header ``meta<TAB>uid[<TAB>sentiment]`` then one
    ``token<TAB>tag`` line per token; only the token column is kept.

    ``path`` is a file, a folder, a glob or a list of them; line ends may be LF, CRLF or
    CR, and a file is read in ranges of ``split_bytes``.  Output ``(uid, sentiment,
    tokens, text, _corrupt)``; a header that does not have the expected number of
    fields gives null fields and ``_corrupt`` set, not a failure.  Tokens are joined
    with one blank.  ``parity``: as the reference reads them, ``text`` has two trailing
    blanks and a last record without a blank line behind it is left out."""
    raw = read_records(spark, path, split_bytes)
    if parity:
        raw = raw.where("closed")
    # columns of their own, so that a record is split once whatever is read of it; empty lines go, so CR may stand for LF
    lines = F.filter(F.split(F.replace("value", F.lit("\r"), F.lit("\n")), "\n"), lambda x: x != F.lit(""))
    raw = raw.where(F.col("value").rlike("[^\r\n]")).select("value", lines.alias("_lines"))
    toks = F.transform(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))),
                       lambda ln: F.substring_index(ln, "\t", 1))
    raw = raw.select("value", F.split(F.get("_lines", 0), "\t").alias("_head"), toks.alias("tokens"))
    head, n_fields = F.col("_head"), 3 if labelled else 2
    ok = F.size(head) == n_fields
    text = F.array_join("tokens", " ")
    return raw.select(
        F.when(ok, F.get(head, 1).try_cast("long")).alias("uid"),
        (F.when(ok, F.get(head, 2)) if labelled else F.lit(None).cast("string")).alias("sentiment"),
        "tokens",
        (F.concat(text, F.lit("  ")) if parity else text).alias("text"),
        F.when(~ok, F.regexp_replace("value", "\r\n?", "\n")).alias("_corrupt"))


def input_files(spark: SparkSession, paths) -> DataFrame:
    """``(file, size, modified)`` of the files that a path, glob or list of them names (contents are not read)."""
    found = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def json_records(spark: SparkSession, path: str, schema: str | StructType = RECORD_SCHEMA,
                 array: bool = True) -> DataFrame:
    """A JSON array of objects (``array=True``, one record per file) or JSON lines."""
    r = spark.read.schema(schema)
    if array:
        r = r.option("multiLine", True)
    return r.json(path)


def json_columns(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Column-oriented JSON ``{"col": {"0": v, "1": v, ...}, ...}``.

    ``columns`` maps column name to its value type.  Rows are the keys of any
    column of a file (as ``row`` long); a column without the key gives null.
    Every column is exploded to (key, value) and the keys are grouped, so the
    work is linear in the number of values."""
    schema = ", ".join(f"`{c}` map<string, {t}>" for c, t in columns.items())
    doc = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    cells = None
    for c in columns:
        one = doc.select("_file", F.explode(F.col(f"`{c}`")).alias("_k", "_v")).select(
            "_file", "_k", *[(F.col("_v") if d == c else F.lit(None).cast(t)).alias(d) for d, t in columns.items()])
        cells = one if cells is None else cells.unionByName(one)
    rows = cells.groupBy("_file", "_k").agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in columns])
    return rows.select(F.col("_k").cast("long").alias("row"), *[F.col(f"`{c}`") for c in columns])


def json_strings(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings -> one row per string ``(pos, text)``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "text"))


def tweet_dir(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines tweet files; only ``text`` is read (nested fields are pruned by the
    schema).  Malformed lines land in ``_corrupt_record`` instead of failing the job
    (select it together with ``text``: Spark rejects plans reading only that column)."""
    return (spark.read.schema("text string, _corrupt_record string")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
            .withColumn("source_file", F.input_file_name()))


def csv_table(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True,
              infer: bool = True) -> DataFrame:
    """CSV with a header; blanks after separators ignored (``Uid, Sentiment``),
    quoted fields may hold separators and, with ``multi_line``, line breaks.

    ``multi_line=False`` lets Spark read a file in ranges; without a schema, ``infer=False`` saves
    the extra pass and gives strings."""
    r = (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
         .option("multiLine", multi_line).option("escape", '"'))
    r = r.schema(schema) if schema else r.option("inferSchema", infer)
    return r.csv(path)


def text_lines(spark: SparkSession, paths, nonblank: bool = False) -> DataFrame:
    """Plain text, one row per line over all files; optionally drop blank lines."""
    df = spark.read.text(paths).withColumnRenamed("value", "line")
    if nonblank:
        df = df.where(F.regexp_replace("line", SPACE, "") != "")
    return df


def piece_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Sub-word vocabulary TSV ``piece<TAB>score`` -> ``(id, piece, score)`` in file order.
    No quoting: a piece may be a bare quote character."""
    df = (spark.read.schema("piece string, score double").option("sep", "\t").option("quote", "")
          .csv(path).withColumn("_pos", F.monotonically_increasing_id()))
    ix = row_index(df, "_pos", bucket_width=1 << 33, name="id")  # one bucket per input split
    return ix.select(F.col("id").cast("int").alias("id"), "piece", "score")


def error_report(spark: SparkSession, path: str, rank: bool = False) -> DataFrame:
    """The 4-line label-error report back into ``(index, predicted, sentence)``; with ``rank`` also the
    record's place in file order, from 1."""
    raw = spark.read.option("lineSep", " -----\n").text(path).withColumn("_pos", F.monotonically_increasing_id())
    raw = raw.where(F.trim("value") != "")
    pat = r"(?s)Estimated Error in (\d+)\npredicted (\S+)\n sentence (.*?)\n?\z"
    cols = [F.regexp_extract("value", pat, 1).cast("long").alias("index"),
            F.regexp_extract("value", pat, 2).alias("predicted"), F.regexp_extract("value", pat, 3).alias("sentence")]
    if rank:
        raw = row_index(raw, "_pos", bucket_width=1 << 33, name="_rank")  # one bucket per input split
        cols.insert(0, (F.col("_rank") + 1).cast("int").alias("rank"))
    return raw.select(*cols)
