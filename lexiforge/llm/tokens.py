"""Encoding of a whole corpus with a byte-level BPE vocabulary.

The global distinct-word shuffle: texts are cut into pre-tokens with their positions, every
distinct pre-token is encoded exactly once, the ids are joined back and each text is put together
by position. Frequent pre-tokens, which would make the join uneven, form a side table of at most
``HEAVY_WORDS`` rows of at most ``HEAVY_CHARS`` characters; this bound holds for any corpus, as no
more than K words can each make up a K-th of it, so that table is broadcast. Frequent ones that are longer are told by as many
hashes and join in ``SALTS`` parts. All others go through a shuffled hash join built on the side that has one row a word.

Defined results: a null or empty text gives an empty list; a blank text is encoded like any other;
rows equal in id and text come out once, different texts under one id (or under a null id) each for
itself; an empty table gives none; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.runtime import cut

TOKENIZER_DIR = os.environ.get("LEXIFORGE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: Fixed value: the published pre-token pattern of this vocabulary, with White_Space spelled out for Java.
PRE_TOKEN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
#: The same for Python's engines.
PRE_TOKEN_PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

HEAVY_WORDS = 4096
HEAVY_CHARS = 64
SALTS = 16


def vocabulary_path(path: str | None = None) -> str:
    return path or f"{TOKENIZER_DIR}/{BYTE_BPE_50K}"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and their ids, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def make_encoding(raw: bytes):
    import tiktoken

    return tiktoken.Encoding("lexiforge", pat_str=PRE_TOKEN_PLAIN, mergeable_ranks=read_ranks(raw), special_tokens={})


def pre_tokens(text: Column) -> Column:
    """The text as an array of pre-tokens, in the JVM; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def explode_pre_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _h, pos, word``, one row for each pre-token; ``_h`` tells texts under one id apart."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("_id", F.xxhash64("text").alias("_h"), F.posexplode(pre_tokens(F.col("text"))).alias("pos", "word"))


def _bare(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ids of null and empty texts."""
    return docs.where(F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)) == 0).select(F.col(id_col).alias(id_col)).distinct()


def word_encoder(spark: SparkSession, path: str | None = None):
    """A vectorised function from words to their ids. The rank file (under 2 MB, whatever the corpus) is read once, by the driver."""
    with open(vocabulary_path(path), "rb") as f:
        raw = f.read()
    if len(raw) > 16 << 20:
        raise ValueError("not a rank file of the expected size")
    ranks = spark.sparkContext.broadcast(raw)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = make_encoding(ranks.value)
        piece = getattr(enc, "_encode_single_piece", enc.encode_ordinary)
        for words in batches:
            yield pd.Series([piece(w) for w in words])

    return encode_words


def word_table(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``word, cnt, ids``: every distinct pre-token of the corpus, encoded once, written to the shared folder."""
    encode_words = word_encoder(docs.sparkSession, path)
    words = docs.select(F.explode(pre_tokens(F.col(text_col).cast("string"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    return cut(words.select("word", "cnt", encode_words("word").alias("ids")))


def _with_ids(each: DataFrame, words: DataFrame, value: Column) -> DataFrame:
    """``_id, _h, pos, v`` for each pre-token, with ``value`` of its row of the word table."""
    total = words.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first()["n"]
    least = max(1, -(-total // HEAVY_WORDS))
    often, short = F.col("cnt") >= least, F.length("word") <= HEAVY_CHARS
    every = words.select("word", value.alias("v"), F.xxhash64("word").alias("k"), often.alias("often"), short.alias("short"))
    heavy = every.where("often and short").select("word", "v")
    long = every.where("often and not short").select("k")  # no more than HEAVY_WORDS hashes
    light = every.where("not (often and short)")
    out = ["_id", "_h", "pos", "v"]
    parts = each.join(F.broadcast(heavy), "word").select(*out)
    rest = each.join(F.broadcast(heavy.select("word")), "word", "left_anti")
    if long.isEmpty():
        return parts.unionByName(rest.join(light.select("word", "v").hint("shuffle_hash"), "word").select(*out))
    few = F.broadcast(long.distinct())
    # a word whose hash is one of those takes this way, whether it is frequent or not
    salted = light.join(few, "k", "left_semi").select("word", "v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = rest.withColumn("k", F.xxhash64("word"))
    hot = keyed.join(few, "k", "left_semi").withColumn("salt", F.pmod(F.xxhash64("_id", "pos"), F.lit(SALTS)).cast("int"))
    cold = keyed.join(few, "k", "left_anti").join(light.join(few, "k", "left_anti").select("word", "v").hint("shuffle_hash"), "word")
    return parts.unionByName(hot.join(salted.hint("shuffle_hash"), ["word", "salt"]).select(*out)).unionByName(cold.select(*out))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every document, without special tokens."""
    parts = _with_ids(explode_pre_tokens(docs, id_col, text_col), word_table(docs, text_col, path), F.col("ids"))
    whole = parts.groupBy("_id", "_h").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("parts"))
    once = F.filter("parts", lambda p, i: (i == 0) | (F.col("parts")[i - 1]["pos"] < p["pos"]))
    repeats = F.size("parts") > F.element_at("parts", -1)["pos"] + 1
    whole = whole.select("_id", F.when(repeats, once).otherwise(F.col("parts")).alias("parts"))
    whole = whole.select(F.col("_id").alias(id_col), F.flatten(F.transform("parts", lambda p: p["v"])).alias("ids"))
    return whole.unionByName(_bare(docs, id_col, text_col).withColumn("ids", F.array().cast("array<int>")))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens``: as ``size(encode(...).ids)``, but only numbers are moved and they are summed before the shuffle."""
    parts = _with_ids(explode_pre_tokens(docs, id_col, text_col), word_table(docs, text_col, path), F.size("ids"))
    counted = parts.groupBy("_id", "_h").agg(F.sum("v").alias("n"), F.sum((F.col("pos") == 0).cast("int")).alias("copies"))
    counted = counted.select(F.col("_id").alias(id_col), F.expr("n div copies").alias("n_tokens"))
    return counted.unionByName(_bare(docs, id_col, text_col).withColumn("n_tokens", F.lit(0).cast("bigint")))


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``token, bytes``: the vocabulary, about 50,000 rows whatever the corpus."""
    with open(vocabulary_path(path), "rb") as f:
        ranks = read_ranks(f.read())
    pdf = pd.DataFrame({"token": list(ranks.values()), "bytes": list(ranks.keys())})
    return spark.createDataFrame(pdf, "token int, bytes binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """``doc_id, text``: ids joined with the token-byte table and the bytes put together by position. An empty list gives ``''``."""
    table = F.broadcast(token_table(encoded.sparkSession, path))
    ids = encoded.select(F.col(id_col).alias("_id"), F.posexplode_outer("ids").alias("pos", "token"))
    parts = ids.join(table, "token", "left")
    whole = parts.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.coalesce(x["h"], F.lit(""))), "")), "UTF-8")
    return whole.select(F.col("_id").alias(id_col), text.alias("text"))
