"""Line-delimited JSON logs with exact line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators.scan import ranked


def read_lines(spark: SparkSession, roots: dict[str, str], pattern: str = "*.jsonl") -> DataFrame:
    """``(source_id, source_kind, ordinal, line)`` for every log under the roots.

    ``roots`` maps a directory to its kind (active, archived, custom). Files are read in
    splits of any size: lines are numbered within their split, and the line counts of the
    splits before it are added. Blank lines count in the ordinal but give no row.
    """
    at = F.col("_metadata")
    frames = []
    for root, kind in roots.items():
        frames.append(
            spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, lineSep="\n")
            .select(at["file_path"].alias("source_id"), F.lit(kind).alias("source_kind"), at["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), "value")
        )
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    numbered = ranked(every, ["source_kind", "source_id"], F.col("split"), [F.col("at")], "ordinal")
    line = F.regexp_replace("value", "\r\\z", "")
    return numbered.select("source_id", "source_kind", "ordinal", line.alias("line")).filter(F.length("line") > 0)


def read_documents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``(path, json, modified_at)`` of small whole documents, e.g. sidecars of child logs."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"), F.col("_metadata.file_modification_time").alias("modified_at"))
    )


def _oversized(max_bytes: int | None) -> Column:
    return F.lit(False) if max_bytes is None else F.octet_length("line") > max_bytes


def raw_records(lines: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Lines that hold one JSON object, parsed once; lines of every length unless the caller sets a limit."""
    parsed = lines.filter(~_oversized(max_bytes)).withColumn("rec", F.try_parse_json("line"))
    return parsed.filter(is_object(F.col("rec"))).drop("line")


def scan_audit(lines: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Per log: lines over the caller's limit, and other lines that are no JSON object."""
    big = _oversized(max_bytes)
    bad = ~big & ~F.coalesce(is_object(F.try_parse_json("line")), F.lit(False))
    return lines.groupBy("source_id").agg(
        F.count(F.when(big, F.lit(1))).alias("oversized"), F.count(F.when(bad, F.lit(1))).alias("invalid_json")
    )


# Strict getters: a value of another JSON type reads as absent, never converted ---------


def kind_of(rec: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(rec, path, "variant"))


def is_object(rec: Column) -> Column:
    return F.schema_of_variant(rec).startswith("OBJECT")


def text_at(rec: Column, path: str) -> Column:
    return F.when(kind_of(rec, path) == "STRING", F.try_variant_get(rec, path, "string"))


def count_at(rec: Column, path: str) -> Column:
    """A whole JSON number from 0 to 2^53-1, else 0."""
    value = F.try_variant_get(rec, path, "double")
    numeric = F.coalesce(kind_of(rec, path).rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT|SMALLINT|TINYINT)"), F.lit(False))
    whole = numeric & (value >= 0) & (value <= 9007199254740991) & (value == F.floor(value))
    return F.when(whole, value.cast("long")).otherwise(F.lit(0)).cast("long")


def has_at(rec: Column, path: str) -> Column:
    return F.try_variant_get(rec, path, "variant").isNotNull()


def object_at(rec: Column, path: str) -> Column:
    return F.coalesce(kind_of(rec, path).startswith("OBJECT"), F.lit(False))


def time_at(rec: Column, path: str) -> Column:
    return F.try_to_timestamp(text_at(rec, path))


def flag_at(rec: Column, path: str) -> Column:
    return F.coalesce(F.when(kind_of(rec, path) == "BOOLEAN", F.try_variant_get(rec, path, "boolean")), F.lit(False))


def first_text(rec: Column, path: str) -> Column:
    """Text of a message: a string, or the first block of an array that has one."""
    blocks = F.try_variant_get(rec, path, "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: text_at(b, "$.text")), lambda t: F.length(t) > 0)
    plain = text_at(rec, path)
    return F.coalesce(F.when(F.length(plain) > 0, plain), F.get(texts, F.lit(0)))


def candidate_directories(files: DataFrame, root: str, directory: str = "dir") -> DataFrame:
    """Cheap, lossy pre-filter on the encoded working directory; it never decides scope."""
    prefix = F.lower(F.regexp_replace(F.lit(root), "[^A-Za-z0-9]", "-"))
    return files.filter(F.lower(F.col(directory)).startswith(prefix))
