"""Texts cut off by a field limit or a broken transfer.

Self-join by prefix, at three grains, over a narrow table made in one pass:

* *copy*: the whole text is a strict prefix of a longer one. Hashes of prefixes of fixed lengths (1, 2, 4, 8 ...
  characters) find the texts that may be one: a text gives the hash of its longest such prefix as its own, and those of
  all shorter ones as a candidate for others. Only what shares a key is fetched, never more of a longer text than the next
  fixed length, and sorted: a text is a prefix of another exactly if the next distinct value begins with it;
* *unit*: the last line or sentence of a text is joined with all units of the corpus by the hash of a fixed-length
  prefix, two tokens, backing off to coarser ones where it is rare. If the longer units that begin alike end in another
  way (``The ... .`` against ``The anvil was che``) it is only the beginning of one. A footer such as ``Tags: ...`` never
  goes on elsewhere, so it is none;
* *word*: the last word stands nowhere as a whole word before the end of a text, but is a strict prefix of words that do,
  in ``GOES_ON`` places or more.

What no other value continues shows otherwise, and comes out under names of its own:

* *limit*: a source whose unfinished texts pile up at a length, in characters or in bytes, has a field limit there, and
  it may have several; what is left over is pooled over the sources. A text that reaches a limit without a sentence end is cut;
* *markup*: the outermost element isn't closed, or a tag is not; *character*: the text ends in a replacement character.

Defined results: null, empty and blank texts are no case; a null source is a source of its own. A text that ends a sentence is
whole unless a longer copy of it exists; if its last unit also stands at another place of some text, it is a stock sentence, and
beginning alike is chance. Final dots are no sentence end: at a limit they stand for the rest, elsewhere the text without them must
begin a longer copy, which goes on in letters or digits, or an odd unit. Rows with equal ids come out once; extra columns are ignored;
nothing but counts by source and length is gathered, and those stay in tables.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.runtime import cut, written

#: A prefix of the corpus speaks if it begins at least so many other units, by level, the finest first; an ending is odd below this share of them.
SUPPORT, ODD = (5, 5, 8, 20, 20, 20, 20, 20), 0.15
#: A word is cut if words begin with it in so many other places, and it stands in none.
GOES_ON = 5
#: A limit is a length that at least so many unfinished texts have, far more than any of so many lengths on either side.
PILE, BESIDE = 5, 10
#: An ending that this share of the inner units of a source have is no sign there; a source with next to no inner units is judged by its last ones, from ``ODD`` on.
USUAL = 0.05
#: Where no inner unit has a prefix, an ending is usual if this share of the last units with it have it.
MOST = 0.5
#: Texts also trail off in dots on purpose, so only prefixes of two tokens, up to this level, speak about dots.
DOTTED = 1
#: Characters looked at for the way a text ends; runs of marks beyond that end in the same way.
TAIL = 64

#: What divides units; the blanks are looked at first, as the rarer thing, and full stops of their own width only where there are any.
_UNITS = r"[\r\n]+|[ \t]+(?=[\p{Lu}\p{Lo}\"“«„¿¡{'(])(?<=[.!?][\"”»'’)\]]?[ \t]{1,64})"
_WIDE = "(?<=[。！？])"
_TOKENS = r"\p{IsHan}|[\p{L}\p{M}]+|\p{N}+|[^\p{IsWhite_Space}\p{L}\p{N}]"
_DOTS = r"(?:\.{3,}|…)[.…]*$"
_BRACKETS = ("]", ")", "}", ">")


@lru_cache(None)
def _blanks() -> str:
    """White space and characters that show nothing."""
    every = map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000))
    return "".join(c for c in every if unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cf") or c in "\t\n\x0b\x0c\r\x85")


def _bare_end(text: Column) -> Column:
    """The text without blanks at its end; most end in a printable ASCII character and are left alone."""
    return F.when(F.substring(text, -1, 1).between("!", "~"), text).otherwise(F.rtrim(text, F.lit(_blanks())))


def _tail(text: Column) -> Column:
    """The last characters before the blanks at the end; ``''`` for a blank text."""
    near = F.rtrim(F.substring(text, -TAIL, TAIL), F.lit(_blanks()))
    return F.when(near != "", near).otherwise(F.substring(F.rtrim(text, F.lit(_blanks())), -TAIL, TAIL))


def _kind(token: Column) -> Column:
    return (
        F.when(token == "", "")
        .when(token.rlike(r"^\p{IsHan}"), "h")
        .when(token.rlike(r"^\p{Lu}"), "W")
        .when(token.rlike(r"^\p{L}"), "w")
        .when(token.rlike(r"^\p{N}"), "0")
        .otherwise(token)
    )


def _ending(tail: Column) -> Column:
    """How a text ends, by its last characters: ``…`` for final dots, ``.`` for any other sentence end, with closing quotes or brackets after it or not, else the kind of the last one."""
    last = F.substring(tail, -1, 1)
    return (
        F.when(tail.endswith("...") | (last == "…"), "…")
        .when(last.isin(list(".!?。！？")), ".")
        .when(last.isin(list("\"”»'’)]」』")) & tail.rlike(r"[.!?。！？][\"”»'’)\]」』]+$"), ".")
        .when(last.rlike(r"\p{IsHan}"), "h")
        .when(last.rlike(r"[\p{L}\p{M}]"), "a")
        .when(last.rlike(r"\p{N}"), "0")
        .when(last.rlike(r"\p{So}"), "s")
        .otherwise(last)
    )


def ending(text: Column) -> Column:
    return _ending(_tail(text))


_HEAD = rf"^\p{{IsWhite_Space}}*+({_TOKENS})\p{{IsWhite_Space}}*+({_TOKENS})?+"


def _first_tokens(head: Column) -> list[Column]:
    """The first two tokens of a unit from its beginning, numbers as ``0``."""
    both = [F.regexp_extract(head, _HEAD, i) for i in (1, 2)]
    return [F.when(t.rlike(r"^\p{N}"), "0").otherwise(t).alias(f"t{i}") for i, t in enumerate(both, 1)]


def _units(text: Column) -> Column:
    """The units of a text: beginning, ending and hash of each."""
    wide = text.contains("。") | text.contains("！") | text.contains("？")
    parts = F.when(wide, F.split(text, f"{_UNITS}|{_WIDE}", -1)).otherwise(F.split(text, _UNITS, -1))
    tails = F.transform(parts, lambda u: F.struct(u.alias("u"), F.substring(F.rtrim(u, F.lit(_blanks())), -TAIL, TAIL).alias("tail")))
    told = F.transform(tails, lambda x: F.struct(F.regexp_extract(x["u"], _HEAD, 0).alias("head"), _ending(x["tail"]).alias("end"), F.xxhash64(x["u"]).alias("u")))
    return F.filter(told, lambda x: x["end"] != "")


def _levels() -> Column:
    """The prefixes of a unit ``source, t1, t2``, the finest first."""
    t1, t2, s = F.col("t1"), F.col("t2"), F.col("source")
    c1, c2 = _kind(t1), _kind(t2)
    prefixes = [[s, t1, t2], [t1, t2], [s, c1, t2], [s, t1], [s, c1, c2], [c1, c2], [s, c1], [s]]
    keys = F.array(*[F.struct(F.lit(i).alias("level"), F.xxhash64(F.lit(i), *p).alias("key")) for i, p in enumerate(prefixes)])
    # a unit of one token begins all that begin with it
    return F.when((t2 == "") & t1.rlike(r"^[\p{L}\p{N}]"), F.filter(keys, lambda k: k["level"].isin(3, 6, 7))).otherwise(keys)


def _ladder(bare: Column, chars: Column) -> Column:
    """Hashes of the prefixes of 1, 2, 4 ... characters, the longest last."""
    steps = F.sequence(F.lit(0), F.floor(F.log2(chars)).cast("int"))
    return F.transform(steps, lambda i: F.xxhash64(i, F.substring(bare, F.lit(1), F.pow(F.lit(2), i).cast("int"))))


def _bare(text: Column, dotted: Column) -> Column:
    """The text without final dots, which are no part of a copy."""
    return F.when(dotted, _bare_end(F.regexp_replace(_bare_end(text), _DOTS, ""))).otherwise(text)


def _dotted(tail: Column) -> Column:
    return tail.endswith("...") | tail.endswith("…")


def _texts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"))
    return rows.withColumn("tail", _tail(F.col("text"))).where("tail != ''")


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow table, one row a text, written once to the shared folder; no text is in it but first tokens and last words."""
    rows = _texts(docs, id_col, text_col, source_col)
    text = F.col("text")
    starts = F.ltrim(text, F.lit(" \t\n\x0b\f\r")).startswith("<")
    rows = rows.withColumns({"dotted": _dotted(F.col("tail")), "markup": F.when(starts, F.regexp_extract(text, r"\A\s*<([A-Za-z][A-Za-z0-9]*)", 1)).otherwise("")})
    rows = rows.withColumn("bare", _bare(text, F.col("dotted")))
    opened = F.regexp_count(text, F.concat(F.lit("<"), "markup", F.lit("[ >/]")))
    closed = F.regexp_count(text, F.concat(F.lit("</"), "markup", F.lit(">")))
    open_tag = F.when(F.col("markup") != "", (opened > closed) | F.regexp_extract(text, "(<[^<>]*)$", 1).startswith("<")).otherwise(False)
    size = F.length("bare")
    return written(
        rows.select(
            "_id", "source", F.xxhash64("text").alias("h"), F.length("text").alias("chars"),
            F.octet_length(F.when(text.endswith("�"), F.rtrim(text, F.lit("�"))).otherwise(text)).alias("octets"),
            _ending(F.col("tail")).alias("end"),
            F.lower(F.regexp_extract("tail", r"([\p{L}\p{M}]+)$", 1)).alias("word"),
            (F.col("markup") != "").alias("markup"), open_tag.alias("open_tag"), F.col("tail").rlike(r"</[^<>]*>$").alias("closed"), text.endswith("�").alias("broken"),
            "dotted", F.xxhash64("bare").alias("bh"), size.alias("bare_chars"),
            F.when(size > 0, _ladder(F.col("bare"), size)).alias("ladder"), _units(text).alias("units"),
        )
    )


def odd_endings(rows: DataFrame) -> DataFrame:
    """``_id`` of texts whose last unit only begins what longer units with the same prefix go on to say.

    Inner units aren't cut, so they say what is usual, however many texts of the source are cut. Last units
    are heard only where they share a finer prefix than inner ones do (footers, cards), and then most of them must end alike.
    """
    every = rows.select("source", F.size("units").alias("of"), F.posexplode("units").alias("i", "x"))
    every = every.select("source", "x.head", "x.end", (F.col("i") + 1 == F.col("of")).alias("last")).groupBy("source", "head", "end").agg(F.count_if(~F.col("last")).alias("n"), F.count_if("last").alias("m"))
    every = every.select("source", *_first_tokens(F.col("head")), "end", "n", "m").groupBy("source", "t1", "t2", "end").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))  # equal beginnings as one, before they multiply
    ends = every.select("end", "n", "m", F.explode(_levels()).alias("k")).groupBy("k.level", "k.key", "end").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    by_key = ends.groupBy("level", "key").agg(F.sum("n").alias("inner"), F.sum("m").alias("final"), F.map_from_entries(F.collect_list(F.struct("end", F.struct("n", "m")))).alias("ends"))
    totals = cut(by_key.where((F.col("inner") >= min(SUPPORT)) | (F.col("final") > min(SUPPORT))))
    by_end = totals.where("level = 7").select("key", "inner", "final", F.explode("ends").alias("end", "own"))  # by source alone
    told = F.when(F.col("inner") >= SUPPORT[-1], F.col("own.n") >= USUAL * F.col("inner")).otherwise(F.col("own.m") >= ODD * F.col("final"))
    usual = by_end.where(told).select("key", "end")
    last = rows.where("not markup").select("_id", "source", F.try_element_at("units", F.lit(-1)).alias("x")).where("x.end != '.'")
    last = last.select("_id", "source", *_first_tokens(F.col("x.head")), "x.end").withColumn("key", F.xxhash64(F.lit(7), "source")).join(usual, ["key", "end"], "left_anti")
    # equal beginnings are asked once, so a prefix of a third of all rows is one row here
    asked = last.groupBy("source", "t1", "t2", "end").agg(F.count("*").alias("rows"))
    keyed = asked.select("source", "t1", "t2", "end", F.explode(_levels()).alias("k")).select("source", "t1", "t2", "end", "k.level", "k.key")
    keyed = keyed.where((F.col("end") != "…") | (F.col("level") <= DOTTED))
    least = F.element_at(F.array(*[F.lit(n) for n in SUPPORT]), F.col("level") + 1)
    own = F.col("ends")[F.col("end")]
    seen = keyed.join(totals, ["level", "key"])
    inner, final = F.col("inner") >= least, F.col("final") > least  # itself is one of the final ones and left out
    beginning = ["source", "t1", "t2", "end"]
    seen = seen.select(*beginning, "level", F.when(inner, F.coalesce(own["n"], F.lit(0)) / F.col("inner")).alias("inner"), F.when(final, (F.coalesce(own["m"], F.lit(1)) - 1) / (F.col("final") - 1)).alias("final"))
    at = lambda name: F.when(F.col(name).isNotNull(), F.col("level"))
    finest = seen.groupBy(*beginning).agg(F.min_by("inner", at("inner")).alias("inner"), F.min(at("inner")).alias("li"), F.min_by("final", at("final")).alias("final"), F.min(at("final")).alias("lf"))
    mostly = F.coalesce((F.col("lf") < F.col("li")) & (F.col("final") >= MOST), F.lit(False))
    return last.join(finest.where((F.col("inner") < ODD) & ~mostly), beginning, "left_semi").select("_id")


def begun_words(rows: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_id`` of texts whose last word only begins words that stand before the end of texts, and is none of them."""
    ends = rows.where("end = 'a' and word != ''").select("_id", "word")
    words = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    before_last = F.flatten(F.transform(F.array(words), lambda w: F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))))
    inner = docs.select(F.explode(before_last).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    begins = inner.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: F.struct(F.substring(F.col("v"), F.lit(1), i).alias("word"), (i == F.length("v")).alias("whole")))).alias("x"))
    told = begins.groupBy("x.word").agg(F.sum(F.when(F.col("x.whole"), F.col("n")).otherwise(0)).alias("here"), F.sum(F.when(F.col("x.whole"), 0).otherwise(F.col("n"))).alias("on"))
    return ends.join(told.where((F.col("here") == 0) & (F.col("on") >= GOES_ON)), "word", "left_semi").select("_id")


def _unfinished(rows: DataFrame) -> DataFrame:
    """Texts without a sentence end, but for markup whose outermost element is closed."""
    return rows.where((F.col("end") != ".") & (~F.col("markup") | ~F.col("closed")))


def _piles(sized: DataFrame) -> DataFrame:
    """``s, unit, size`` of the sizes that stand out against those beside them; ``h`` tells equal texts."""
    counts = sized.groupBy("s", "unit", "size").agg(F.count_distinct("h").alias("n"))
    by_size = Window.partitionBy("s", "unit").orderBy("size")  # one row a length
    # the bytes of a text that was cut within a character fall up to three short of the limit
    beside = F.greatest(*[F.coalesce(F.sum("n").over(by_size.rangeBetween(i, i + BESIDE - 1)), F.lit(0)) for i in (-3 - BESIDE, 1)]) / BESIDE
    return counts.withColumn("beside", beside).where(F.col("n") >= PILE - 1 + F.greatest(F.lit(1.0), F.col("beside") + 6 * F.sqrt("beside"))).select("s", "unit", "size")


def limits(rows: DataFrame) -> DataFrame:
    """``s, unit, size``: the field limits, in characters or in bytes of UTF-8, of each source, and of all (``*``) where those left over pile up.

    Only texts that end in no sentence end and no closing bracket are counted, and bytes only of texts with longer characters.
    A limit of any source is one of the rows without a source.
    """
    open_end = _unfinished(rows).where(~F.col("end").isin(*_BRACKETS))
    sizes = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("octets").alias("unit"), F.when(F.col("octets") > F.col("chars"), F.col("octets")).alias("size")))
    sized = cut(open_end.select(F.col("source").alias("s"), "h", F.explode(sizes).alias("m")).select("s", "h", "m.unit", "m.size").where("size is not null"))
    own = _piles(sized)
    told = sized.join(own, ["s", "unit", "size"], "left_semi").select("s", "h")  # texts of one length in characters crowd in bytes, too
    left = sized.join(told, ["s", "h"], "left_anti").withColumn("s", F.lit("*"))
    found = cut(own.unionByName(_piles(left)))
    return found.unionByName(found.withColumn("s", F.lit("\0"))).distinct()


def at_limits(rows: DataFrame) -> DataFrame:
    """``_id`` of texts that reach a limit of their source without ending a sentence, or one of all without ending in a closing bracket either."""
    reach = [("chars", F.col("chars"))] + [("octets", F.col("octets") + i) for i in range(4)]
    keys = [F.struct(s.alias("s"), F.lit(unit).alias("unit"), size.alias("size")) for s in (F.col("source"), F.lit("*")) for unit, size in reach]
    both = F.when(F.col("end").isin(*_BRACKETS), F.array(*keys[: len(reach)])).otherwise(F.array(*keys))
    known = _unfinished(rows).select("_id", F.explode(both).alias("k")).select("_id", "k.s", "k.unit", "k.size")
    return known.join(limits(rows), ["s", "unit", "size"], "left_semi").select("_id")


def begun_values(values: DataFrame) -> DataFrame:
    """``value``: those of the distinct values that are a strict prefix of another one which goes on in letters or digits.

    A row may be the beginning of something longer: ``more`` (if there) says that letters or digits come after it.

    Sorted, all values that begin with a value follow it at once. A partition looks at each value once, keeping those the present
    one begins with; what is still open at its end meets the first values of the partitions after it by a join on partition numbers.
    """
    more = F.col("more") if "more" in values.columns else F.lit(False)
    ordered = values.groupBy("value").agg(F.max(more).alias("more")).repartitionByRange(F.col("value")).sortWithinPartitions("value").select("value", "more", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, first_more, part, waiting = None, False, None, []
        schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("value", pa.string()), ("more", pa.bool_())])
        for batch in batches:
            hits = []
            for value, more, part in zip(batch["value"].to_pylist(), batch["more"].to_pylist(), batch["part"].to_pylist()):
                waiting = [w for w in waiting if value.startswith(w)]
                for w in [w for w in waiting if more or any(map(str.isalnum, value[len(w) :]))]:
                    waiting.remove(w)
                    hits.append({"kind": "hit", "part": part, "value": w, "more": False})
                first, first_more = (value, more) if first is None else (first, first_more)
                waiting.append(value)
            if hits:
                yield pa.RecordBatch.from_pylist(hits, schema=schema)
        if part is not None:
            ends = [{"kind": "first", "part": part, "value": first, "more": first_more}, *({"kind": "open", "part": part, "value": w, "more": False} for w in waiting)]
            yield pa.RecordBatch.from_pylist(ends, schema=schema)

    found = cut(ordered.mapInArrow(run, "kind string, part int, value string, more boolean"))
    # empty partitions leave gaps in the numbers: the k-th seam is between the k-th and the next partition that holds values
    firsts = found.where("kind = 'first'").select("part", F.col("value").alias("next"), F.col("more").alias("next_more"))
    following = firsts.select("part", F.lead("part").over(Window.orderBy("part")).alias("after")).where("after is not null")  # one row a partition
    seams = found.where("kind = 'open'").select("part", "value").join(following, "part").join(firsts.withColumnRenamed("part", "after"), "after").where(F.col("next").startswith(F.col("value")))
    seams = seams.where(F.col("next_more") | F.expr("substring(next, length(value) + 1)").rlike(r"[\p{L}\p{N}]"))
    return found.where("kind = 'hit'").select("value").unionByName(seams.select("value"))


def longer_copies(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``_id`` of texts a longer copy of which stands elsewhere."""
    keyed = rows.where("ladder is not null").select("h", "bare_chars", F.size("ladder").alias("of"), F.posexplode("ladder").alias("step", "key"))
    own = F.col("step") + 1 == F.col("of")
    shared = keyed.groupBy("step", "key").agg(F.min(F.when(own, F.col("bare_chars"))).alias("least"), F.max("bare_chars").alias("most")).where("least < most")
    wanted = cut(keyed.join(shared.select("step", "key"), ["step", "key"], "left_semi").groupBy("h").agg(F.collect_set("step").alias("steps")))  # at most 31 steps
    top = wanted.agg(F.max(F.array_max("steps")).alias("top")).first()["top"]
    if top is None:
        return rows.select("_id").limit(0)
    # a text of a step comes whole, of a longer one as much as it could be the beginning of; nothing beyond that is moved
    bare, most = _bare(F.col("text"), _dotted(F.col("tail"))), 2 ** (top + 1)
    texts = _texts(docs, id_col, text_col, source_col).select(F.xxhash64("text").alias("h"), F.substring(bare, 1, most).alias("bare"), F.substring(bare, F.lit(most + 1), F.length(bare)).rlike(r"[\p{L}\p{N}]").alias("beyond"))
    ends = F.transform("steps", lambda s: F.pow(F.lit(2), s + 1).cast("int"))
    pieces = texts.join(wanted, "h").select("bare", "beyond", F.explode(ends).alias("n"))
    pieces = pieces.select(F.expr("substring(bare, 1, n)").alias("value"), (F.col("beyond") | F.expr("substring(bare, n + 1)").rlike(r"[\p{L}\p{N}]")).alias("more"))
    begun = begun_values(pieces).select(F.xxhash64("value").alias("bh"), F.length("value").alias("bare_chars")).distinct()
    hits = rows.where("ladder is not null").join(begun, ["bh", "bare_chars"], "left_semi")
    hits = cut(hits.select("_id", "h", "end", F.size("units").alias("at"), F.try_element_at("units", F.lit(-1))["u"].alias("u")))
    finished = hits.where("end = '.'").select("h", "at", "u").distinct()
    places = rows.select(F.posexplode("units").alias("i", "x")).select((F.col("i") + 1).alias("place"), F.col("x.u").alias("u"))
    places = places.join(finished.select("u").distinct(), "u", "left_semi").groupBy("u").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    stock = finished.join(places, "u").where("low != at or high != at").select("h")
    return hits.join(stock, "h", "left_anti").select("_id")


def truncated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, why`` of every document that was cut; ``why`` is the first that holds of ``copy``, ``unit``, ``word``, ``limit``, ``markup`` and ``character``."""
    rows = prepare(docs, id_col, text_col, source_col)
    cases = [
        ("1 copy", longer_copies(rows, docs, id_col, text_col, source_col)),
        ("2 unit", odd_endings(rows)),
        ("3 word", begun_words(rows, docs, text_col)),
        ("4 limit", at_limits(rows)),
        ("5 markup", rows.where("open_tag")),
        ("6 character", rows.where("broken")),
    ]
    every = None
    for why, df in cases:
        one = df.select("_id", F.lit(why).alias("why"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("_id").agg(F.substring(F.min("why"), 3, 20).alias("why")).select(F.col("_id").alias(id_col), "why")


def rates(docs: DataFrame, cases: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``source, documents, cut, share``: how often each source truncates; all documents count, also null and blank ones."""
    marked = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source")).join(cases.select(F.col(id_col).alias("_id"), F.lit(1).alias("hit")), "_id", "left")
    got = marked.groupBy("source").agg(F.count("*").alias("documents"), F.count("hit").alias("cut"))
    return got.withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))
