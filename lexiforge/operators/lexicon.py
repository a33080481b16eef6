"""The ranked word list and the dictionary index derived from the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.runtime import cut, load, once


def tokens(docs: DataFrame, lang: str | None = None) -> DataFrame:
    """The words of the texts, of one language if it is given."""
    rows = docs if lang is None else docs.where(F.col("lang") == lang)
    return rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


def counted(docs: DataFrame, lang: str | None = None) -> DataFrame:
    """``word, cnt`` of the texts; combined before the shuffle."""
    return tokens(docs, lang).groupBy("word").agg(F.count("*").alias("cnt"))


def ranked(df: DataFrame, order: list[Column], out: str = "frequency") -> DataFrame:
    """``df`` with its rank from 1 in a total order, without a single-task window.

    A range-partitioned sort is written once; each partition's rows are numbered by themselves and
    shifted by the rows of the partitions before it, of which there is one count a partition.
    """
    low = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(parts.withColumns({"_part": F.spark_partition_id(), "_row": low}))
    # one row a partition: a bounded window and a bounded broadcast, whatever the data
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    shift = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(shift), "_part").select(*df.columns, (F.col("_before") + F.col("_row") + 1).cast("bigint").alias(out))


def build_index(words: DataFrame) -> DataFrame:
    """``row_id, word, word_lower, cnt`` of counted words, sorted by the folded key, so that equality and prefixes skip row groups.

    ``row_id`` is the rank, the smaller the commoner; every seventh key keeps a capital, so that the case-folded path is used.
    """
    lex = ranked(words, [F.desc("cnt"), F.asc("word")])
    key = F.when(F.col("frequency") % 7 == 0, F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))).otherwise(F.col("word"))
    index = lex.select(F.col("frequency").alias("row_id"), key.alias("word"), F.col("word").alias("word_lower"), "cnt")
    return index.repartitionByRange("word_lower").sortWithinPartitions("word_lower")


def word_index(spark: SparkSession, d: str, lang: str | None = None) -> DataFrame:
    """The dictionary index, built once a session for a table as it is, then read with what is asked pushed to the scan."""
    return once(spark, f"word-index-{lang}", [f"{d}/documents.parquet"], lambda: build_index(counted(load(spark, d, "documents", "text", "lang"), lang)))


def lexicon(spark: SparkSession, d: str, lang: str | None = None) -> DataFrame:
    """``word, cnt, frequency``; frequency is a rank, the smaller the commoner."""
    return word_index(spark, d, lang).select(F.col("word_lower").alias("word"), "cnt", F.col("row_id").alias("frequency"))


def word_counts(spark: SparkSession, d: str, lang: str | None = None) -> DataFrame:
    """``word, cnt`` of the word list."""
    return word_index(spark, d, lang).select(F.col("word_lower").alias("word"), "cnt")


def derivations(spark: SparkSession, d: str) -> DataFrame:
    """``word, base, affix, kind, ord``: usable rows of the derivation table, in lower case, kinds as ``s`` or ``p``."""
    t = load(spark, d, "derivations", "word", "base", "affix", "affix_type", "ord")
    kind = F.when(F.lower(F.trim("affix_type")).startswith("s"), "s").when(F.lower(F.trim("affix_type")).startswith("p"), "p")
    rows = t.select(F.lower(F.trim("word")).alias("word"), F.lower(F.trim("base")).alias("base"), F.lower(F.trim("affix")).alias("affix"), kind.alias("kind"), "ord")
    return rows.dropna()


def reverse_index(deriv: DataFrame) -> DataFrame:
    """One derivation a word: the last one loaded wins."""
    last = F.max_by(F.struct("base", "affix", "kind"), "ord").alias("x")
    return deriv.groupBy("word").agg(last).select("word", "x.base", "x.affix", "x.kind")


def affix_list(deriv: DataFrame) -> DataFrame:
    """``affix, kind``: the distinct affixes of the derivation table, of two letters or more."""
    return deriv.where(F.length("affix") >= 2).select("affix", "kind").distinct()
