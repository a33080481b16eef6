"""Readers and writers of the data sets in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators.lexicon import ranked

RULE_SCHEMA = "word string, segments array<string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``n, line``: lines numbered from 1 over all files in order of their names; one shuffle, no single task."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    return ranked(rows, [F.asc("f"), F.asc("b"), F.asc("m")], "n").select("n", F.col("value").alias("line"))


def read_ranked_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``word, frequency``: the rank is the line number; blank lines take one but are dropped; a limit counts all lines."""
    lines = read_lines(spark, path)
    lines = lines.where(F.col("n") <= limit) if limit is not None else lines
    return lines.select(F.trim("line").alias("word"), F.col("n").alias("frequency")).where("word != ''")


def read_affix_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct affixes of a list, one a line; blank lines, comments and totals are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("affix"))
    return rows.where((F.col("affix") != "") & ~F.col("affix").startswith("#") & ~F.col("affix").startswith("共")).distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit schema; lines that can't be read are dropped."""
    return spark.read.schema(RULE_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("word is not null")


def read_document(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON documents, one a file or one a line, absent keys null."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_split_columns(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``word, base, affix, affix_type, ord`` of a document that holds them as four parallel arrays."""
    doc = read_document(spark, path, "w array<string>, b array<string>, a array<string>, t array<string>", multi_line)
    zipped = doc.select(F.posexplode(F.arrays_zip("w", "b", "a", "t")).alias("ord", "x"))
    return zipped.select(F.col("x.w").alias("word"), F.col("x.b").alias("base"), F.col("x.a").alias("affix"), F.col("x.t").alias("affix_type"), "ord")


def reverse_projection(nested: DataFrame) -> DataFrame:
    """``word, base, affix, t`` of ``base, derives_to map<word, struct<affix, affix_type>>``."""
    rows = nested.select("base", F.explode("derives_to").alias("word", "x"))
    return rows.select("word", "base", F.col("x.affix").alias("affix"), F.when(F.col("x.affix_type") == "suffix", "s").otherwise("p").alias("t"))


def write_index(df: DataFrame, path: str) -> None:
    """The dictionary index sorted by folded key, so that lookups skip row groups; replaces what is there."""
    df.repartitionByRange("word_lower").sortWithinPartitions("word_lower").write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; related words joined as in a cell."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def log_tail(log: DataFrame, count: int) -> DataFrame:
    """The last lines of a log with ordinals (``n, line``); 0 means all."""
    return log if count == 0 else log.orderBy(F.desc("n")).limit(count)
