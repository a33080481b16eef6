"""Several values packed in one field, one row each.

Quoted and bracketed spans are replaced by indexed placeholders, the remaining delimiters split the
field, the spans are put back by array lookup and the items exploded with their positions. The
placeholders are private-use characters; where a text holds these characters itself they count as
a span, so no text can collide with them. All of it is built-in expressions: one narrow stage, no
shuffle, whatever the field lengths.

Defined results: null, empty and blank fields have no items; an unclosed quote or bracket is an
ordinary character; empty items are dropped and not counted, repeats are kept; a null row id stays
null and equal rows are split each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "", ""
BLANK = r"\p{IsWhite_Space}"
BULLETS = "•‣◦▪·"

#: Spans never divided: quotes of several kinds, round brackets (one level nested) with the blanks before them, placeholders' own characters.
SPANS = (
    r'"[^"]*+(?:""[^"]*+)*+"|“[^“”]*+”|„[^„“”]*+[“”]|「[^「」]*+」|『[^『』]*+』|«[^«»]*+»'
    rf"|(?<![\p{{L}}\p{{N}}])'[^']*+(?:''[^']*+)*+'(?![\p{{L}}\p{{N}}])"
    rf"|{BLANK}*+\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)|{BLANK}*+（[^（）]*+）|[{OPEN}{CLOSE}]+"
)
#: Pairs that are taken off an item they enclose; in the first two a doubled mark stands for one.
DOUBLED = ('"', "'")
PAIRS = ("“”", "„“", "„”", "「」", "『』", "«»")


@dataclass(frozen=True)
class Dialect:
    """How a field packs its items: ``delimiters`` is a regular expression for what stands between two of them."""

    delimiters: str


PUNCTUATION = r"[,;/|、，；／｜•\t\n\r]"
#: Senses: punctuation divides, blanks do not.
SENSES = Dialect(PUNCTUATION)
#: Marked forms: blanks divide too, and a mark (``-``, ``=``, ``*``) begins an item even without anything between.
MARKED = Dialect(rf"(?:{PUNCTUATION}|{BLANK})+|(?<=[^{BLANK}\-=*])(?=[\-=*])")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def _unquote(item: Column) -> Column:
    for q in DOUBLED:
        whole = rf"^{q}([^{q}]*+(?:{q}{q}[^{q}]*+)*+){q}$"
        item = F.when(item.rlike(whole), F.replace(F.regexp_replace(item, whole, "$1"), F.lit(q + q), F.lit(q))).otherwise(item)
    for a, b in PAIRS:
        item = F.regexp_replace(item, rf"^{a}([^{a}{b}]*){b}$", "$1")
    return item


def _clean(item: Column) -> Column:
    bare = F.regexp_replace(_strip(item), rf"^[{BULLETS}{BLANK}]+", "")
    return _strip(_unquote(bare))


def masked(text: Column) -> Column:
    """The text with each protected span replaced by its indexed placeholder."""
    marked = F.transform(F.split(text, SPANS, -1), lambda p, i: F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(CLOSE)))
    return F.regexp_replace(F.array_join(marked, ""), f"{OPEN}[0-9]+{CLOSE}$", "")


def restored(item: Column, spans: Column) -> Column:
    """An item with its placeholders looked up in the spans."""
    numbers = F.regexp_extract_all(item, F.lit(f"{OPEN}([0-9]+){CLOSE}"), F.lit(1))
    parts = F.transform(
        F.split(item, f"{OPEN}[0-9]+{CLOSE}", -1),
        lambda p, i: F.when(i < F.size(numbers), F.concat(p, F.get(spans, F.get(numbers, i).cast("int")))).otherwise(p),
    )
    return F.array_join(parts, "")


def split_packed(df: DataFrame, id_col: str, text_col: str, dialect: Dialect, least: int = 1) -> DataFrame:
    """``row_id, item_no, item`` for each item of each field that holds at least ``least`` of them."""
    rows = df.select(F.col(id_col).alias("row_id"), _strip(F.col(text_col).cast("string")).alias("_t")).where(F.length("_t") > 0)
    rows = rows.select("row_id", F.regexp_replace("_t", r"(?s)^\[(.*)\]$", "$1").alias("_t"))
    # generated columns are values: the optimizer cannot put their expressions into the lambdas, to run once an item
    both = F.struct(masked(F.col("_t")).alias("_m"), F.regexp_extract_all("_t", F.lit(SPANS), F.lit(0)).alias("_s"))
    rows = rows.select("row_id", F.inline(F.array(both)))
    items = F.transform(F.split("_m", dialect.delimiters, -1), lambda x: _clean(restored(x, F.col("_s"))))
    rows = rows.select("row_id", F.filter(items, lambda x: x != "").alias("_items")).where(F.size("_items") >= least)
    rows = rows.select("row_id", F.posexplode("_items").alias("item_no", "item"))
    return rows.select("row_id", (F.col("item_no") + 1).cast("bigint").alias("item_no"), "item")
