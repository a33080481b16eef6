"""Block-compressed dictionary files: a block directory, a key index with offsets, and records cut out of blocks.

Each file holds its blocks in order; offsets count decompressed bytes from the start of the file. A block
begins with eight bytes: a type tag (0 stored, 1 LZO, 2 zlib) and the checksum of its content.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STORED, LZO, ZLIB = 0, 1, 2
BLOCK_BYTES = 1 << 16


def pack_block(content: bytes, kind: int = ZLIB) -> bytes:
    body = zlib.compress(content) if kind == ZLIB else content
    return struct.pack("<II", kind, zlib.adler32(content)) + body


def unpack_block(block: bytes) -> bytes:
    """The content of a block; LZO blocks come back as they are, an unknown tag is an error."""
    kind, body = block[0], block[8:]
    if kind == ZLIB:
        return zlib.decompress(body)
    if kind in (STORED, LZO):
        return bytes(body)
    raise ValueError(f"unknown block type {kind}")


def pack_entries(entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, idx, block, size, keys``: entries (``word, html``) packed into blocks; one file a partition, records never cross a block."""
    rows = entries.select("word", F.coalesce("html", F.lit("")).alias("html"), F.spark_partition_id().alias("file"))
    kinds = pa.schema([("file", pa.int32()), ("idx", pa.int64()), ("block", pa.binary()), ("size", pa.int64()), ("keys", pa.list_(pa.struct([("word", pa.string()), ("offset", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, idx, start, content, keys = None, 0, 0, bytearray(), []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": file, "idx": idx, "block": pack_block(bytes(content)), "size": len(content), "keys": keys}], schema=kinds)

        for batch in batches:
            for row in batch.to_pylist():
                file = row["file"]
                keys.append({"word": row["word"], "offset": start + len(content)})
                content += row["html"].encode() + b"\0"
                if len(content) >= block_bytes:
                    yield flush()
                    idx, start, content, keys = idx + 1, start + len(content), bytearray(), []
        if keys:
            yield flush()

    return rows.mapInArrow(run, "file int, idx bigint, block binary, size bigint, keys array<struct<word string, offset bigint>>")


def directory(blocks: DataFrame) -> DataFrame:
    """``file, idx, begin, size``: where each block begins, as the sum of the sizes before it."""
    before = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("file", "idx", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin"), "size")


def directory_from_meta(meta: DataFrame) -> DataFrame:
    """``file, idx, begin, size, packed``: the directory from a meta row a file, whose ``block_infos`` is a JSON array of compressed and decompressed sizes."""
    rows = meta.select("file", F.posexplode(F.from_json("block_infos", "array<array<bigint>>")).alias("idx", "x"))
    sizes = rows.select("file", F.col("idx").cast("bigint").alias("idx"), F.get("x", F.lit(1)).alias("size"), F.get("x", F.lit(0)).alias("packed"))
    return directory(sizes).join(sizes.select("file", "idx", "packed"), ["file", "idx"])


def stylesheet(meta: DataFrame) -> DataFrame:
    """``file, styles``: the style pairs of a meta row, from JSON; none where there is no sheet."""
    styles = F.from_json("stylesheet", "map<string, struct<open: string, close: string>>")
    return meta.select("file", F.coalesce(styles, F.create_map().cast("map<string, struct<open: string, close: string>>")).alias("styles"))


def key_index(blocks: DataFrame) -> DataFrame:
    """``file, word, word_lower, offset, length``: the length of a record reaches to the next one, of the last to the end of its file."""
    keys = blocks.select("file", F.explode("keys").alias("k")).select("file", F.trim("k.word").alias("word"), F.col("k.offset").alias("offset"))
    ends = blocks.groupBy("file").agg(F.sum("size").alias("end"))
    after = F.lead("offset").over(Window.partitionBy("file").orderBy("offset"))
    got = keys.withColumn("after", after).join(ends, "file")
    return got.select("file", "word", F.lower("word").alias("word_lower"), "offset", (F.coalesce("after", "end") - F.col("offset")).alias("length"))


def in_blocks(index: DataFrame, dirs: DataFrame) -> DataFrame:
    """The index with the block each record begins in: the last block that begins at or before it, in one ordered pass a file."""
    marks = dirs.select("file", F.col("begin").alias("offset"), F.struct("idx", "begin").alias("b"), F.lit(0).alias("o"), *[F.lit(None).cast("string").alias(c) for c in ("word", "word_lower")], F.lit(None).cast("bigint").alias("length"))
    rows = index.select("file", "offset", F.lit(None).cast("struct<idx:bigint,begin:bigint>").alias("b"), F.lit(1).alias("o"), "word", "word_lower", "length")
    upto = Window.partitionBy("file").orderBy("offset", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.unionByName(rows).withColumn("b", F.last("b", ignorenulls=True).over(upto)).where("o = 1").select("file", "word", "word_lower", "offset", "length", "b.idx", (F.col("offset") - F.col("b.begin")).alias("at"))


def records(blocks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``word, html`` of all records, or of the ``wanted`` words; each block is unpacked once for all records in it."""
    index = in_blocks(key_index(blocks), directory(blocks))
    if wanted is not None:
        index = index.join(wanted.select("word"), "word", "left_semi")
    of_block = index.groupBy("file", "idx").agg(F.collect_list(F.struct("word", "at", "length")).alias("r"))
    rows = of_block.join(blocks.select("file", "idx", "block"), ["file", "idx"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, texts = [], []
            for block, found in zip(pdf["block"], pdf["r"]):
                content = unpack_block(bytes(block))
                for x in found:
                    words.append(x["word"])
                    texts.append(content[x["at"] : x["at"] + x["length"]].decode(errors="ignore").rstrip("\0"))
            yield pd.DataFrame({"word": words, "html": texts})

    return rows.select("block", "r").mapInPandas(read, "word string, html string")
