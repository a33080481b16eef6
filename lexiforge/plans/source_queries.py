"""Sources, sinks and streams, as round trips through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import lexicon
from lexiforge.plans import sql
from lexiforge.plans.text_queries import parsed_segments
from lexiforge.runtime import cut, load, shared_dir
from lexiforge.sources import blocks, files
from lexiforge.streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return put


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


_ENTRIES = "SELECT lower(headword) AS word, arg_min(text, doc_id) AS html FROM documents WHERE starts_with(text, '<div class=\"gdc\">') AND headword IS NOT NULL GROUP BY 1"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents", "doc_id", "headword", "text").where(F.col("text").startswith('<div class="gdc">') & F.col("headword").isNotNull())
    entries = t.groupBy(F.lower("headword").alias("word")).agg(F.min_by("text", "doc_id").alias("html"))
    return cut(blocks.pack_entries(entries.sortWithinPartitions("word"), 1 << 12))


@query("block_records", _ENTRIES)
def block_records(spark: SparkSession, d: str) -> DataFrame:
    return blocks.records(_blocks(spark, d))


@query("block_record_lengths", f"SELECT word, word AS word_lower, strlen(html) + 1 AS length FROM ({_ENTRIES})")
def block_record_lengths(spark: SparkSession, d: str) -> DataFrame:
    return blocks.key_index(_blocks(spark, d)).select("word", "word_lower", "length")


@query("block_directory", f"SELECT sum(strlen(html) + 1)::BIGINT AS bytes FROM ({_ENTRIES})")
def block_directory(spark: SparkSession, d: str) -> DataFrame:
    dirs = blocks.directory(_blocks(spark, d))
    ends = dirs.groupBy("file").agg(F.max(F.col("begin") + F.col("size")).alias("end"))
    return ends.agg(F.sum("end").alias("bytes"))


@query("block_meta", f"SELECT sum(strlen(html) + 1)::BIGINT AS bytes, TRUE AS packed_smaller, 2 AS styles FROM ({_ENTRIES})")
def block_meta(spark: SparkSession, d: str) -> DataFrame:
    """The directory and the styles read from one JSON row a file."""
    packed = _blocks(spark, d).groupBy("file").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.length("block").cast("bigint").alias("c"), "size"))), lambda b: F.array(b["c"], b["size"]))).alias("block_infos"))
    meta = packed.withColumn("stylesheet", F.lit('{"1": {"open": "<b>", "close": "</b>"}, "2": {"open": "<i>", "close": "</i>"}}'))
    dirs = blocks.directory_from_meta(meta)
    ends = dirs.groupBy("file").agg(F.max(F.col("begin") + F.col("size")).alias("end"), F.sum("packed").alias("packed"))
    sheet = blocks.stylesheet(meta).agg(F.max(F.size("styles")).alias("styles"))
    return ends.agg(F.sum("end").alias("bytes"), (F.sum("packed") < F.sum("end")).alias("packed_smaller")).crossJoin(sheet)


@query("json_round_trip", "SELECT entry_id, base, meaning FROM roots")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    files.write_json(load(spark, d, "roots", "entry_id", "base", "meaning"), at)
    return files.read_document(spark, at, "entry_id bigint, base string, meaning string", multi_line=False)


@query("line_ranks_limit", f"WITH {sql.LEX} SELECT word, frequency + (frequency - 1) // 10 AS frequency FROM lex WHERE frequency + (frequency - 1) // 10 <= 100")
def line_ranks_limit(spark: SparkSession, d: str) -> DataFrame:
    """A list with a blank line after every ten words, read up to its hundredth line, blank ones counted."""
    at = _place(spark)
    lines = F.when(F.col("frequency") % 10 == 0, F.array("word", F.lit(""))).otherwise(F.array("word"))
    lexicon.lexicon(spark, d).orderBy("frequency").select(F.explode(lines).alias("value")).write.text(at)
    return files.read_ranked_list(spark, at, 100)


@query("json_lines", "SELECT word, string_split(split, '.') AS segments FROM (SELECT DISTINCT regexp_extract(line, '^(\\w+) = ([\\w.]+) \\[', 1) AS word, regexp_extract(line, '^(\\w+) = ([\\w.]+) \\[', 2) AS split FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE word <> ''")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines with unreadable lines among them, and read back."""
    at = _place(spark)
    good = parsed_segments(spark, d).select(F.to_json(F.struct("word", "segments")).alias("value"))
    bad = spark.createDataFrame([('{"word": "x", "segm',), ("not json",)], "value string")
    good.unionByName(bad).write.text(at)
    return files.read_rules(spark, at)


@query("line_ranks", f"WITH {sql.LEX} SELECT word, frequency FROM lex")
def line_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The ranked list written in order, one word a line, and imported again: the line number is the rank."""
    at = _place(spark)
    lexicon.lexicon(spark, d).orderBy("frequency").select(F.concat(F.col("word"), F.lit(" ")).alias("value")).write.text(at)
    return files.read_ranked_list(spark, at)


@query("affix_lines", f"WITH {sql.AFFIXES} SELECT DISTINCT affix FROM aff")
def affix_lines(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    rows = lexicon.affix_list(lexicon.derivations(spark, d)).select(F.col("affix").alias("value"))
    rows.unionByName(spark.createDataFrame([("# comment",), ("",), ("共 3 个",)], "value string")).write.text(at)
    return files.read_affix_list(spark, at)


@query("split_columns", f"WITH {sql.DERIV} SELECT word, base, affix, kind AS affix_type FROM deriv")
def split_columns(spark: SparkSession, d: str) -> DataFrame:
    """Derivations as documents of four parallel arrays of a thousand entries at most, read back as a table."""
    at = _place(spark)
    packed = lexicon.derivations(spark, d).groupBy("base", F.floor(F.col("ord") / 1000).alias("part")).agg(F.collect_list(F.struct("word", "affix", "kind")).alias("x"))
    packed.select(F.col("x.word").alias("w"), F.transform("x", lambda r: F.col("base")).alias("b"), F.col("x.affix").alias("a"), F.col("x.kind").alias("t")).write.json(at)
    return files.read_split_columns(spark, at, multi_line=False).drop("ord")


@query("reverse_projection", f"WITH {sql.DERIV} SELECT DISTINCT word, base, affix, kind AS t FROM deriv QUALIFY row_number() OVER (PARTITION BY base, word ORDER BY ord) = 1")
def reverse_projection(spark: SparkSession, d: str) -> DataFrame:
    """A base has several documents, of its words of one thousand entries each."""
    t = lexicon.derivations(spark, d)
    first = t.groupBy("base", "word").agg(F.min_by(F.struct("affix", F.when(F.col("kind") == "s", "suffix").otherwise("prefix").alias("affix_type")), "ord").alias("x"), F.floor(F.min("ord") / 1000).alias("part"))
    nested = first.groupBy("base", "part").agg(F.map_from_entries(F.collect_list(F.struct("word", "x"))).alias("derives_to"))
    return files.reverse_projection(nested)


@query("csv_round_trip", "SELECT entry_id::VARCHAR AS entry_id, base, meaning FROM roots WHERE meaning IS NOT NULL AND meaning <> '' AND NOT contains(meaning, chr(10)) AND trim(meaning) = meaning AND base IS NOT NULL")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    t = load(spark, d, "roots", "entry_id", "base", "meaning").where("meaning is not null and meaning != '' and not contains(meaning, '\n') and trim(meaning) = meaning and base is not null")
    files.write_csv(t, at)
    return spark.read.schema("entry_id string, base string, meaning string").option("header", True).option("escape", '"').csv(at)


@query("index_table", f"WITH {sql.INDEX} SELECT row_id, word, word_lower, cnt FROM idx WHERE word_lower = 'the'")
def index_table(spark: SparkSession, d: str) -> DataFrame:
    """The index as a table sorted by folded key; the equality reaches the scan."""
    at = _place(spark)
    files.write_index(lexicon.word_index(spark, d), at)
    return spark.read.parquet(at).where("word_lower = 'the'")


@query("log_tail", "SELECT '[info] ' || kind || ' | url=/' || source AS line FROM doc_sources QUALIFY row_number() OVER (ORDER BY source DESC) <= 3")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark)
    t = load(spark, d, "doc_sources").coalesce(1).sortWithinPartitions("source")
    events.append_log(t.select(F.lit("info").alias("level"), F.col("kind").alias("message"), F.concat(F.lit("/"), "source").alias("url")), at)
    return files.log_tail(files.read_lines(spark, at), 3).select("line")


@query(
    "stream_windows",
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    out = events.run_once(events.windowed_counts(events.event_stream(spark, d)))
    return out.withColumn("begin", F.col("begin").cast("timestamp_ntz"))
