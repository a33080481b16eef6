"""One request, answered whole: a word with its entry, parts and related words, a page of a pattern's hits, or suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import markup, patterns, strings
from lexiforge.operators import search, segment

RELATED = 30
#: kind, its number, word, word as marked, text, rank, score
COLUMNS = "kind string, n bigint, word string, shown string, text string, frequency bigint, score int"


def pattern_page(lex: DataFrame, entries: DataFrame, pattern: str, number: int = 1, size: int = search.PAGE_SIZE) -> DataFrame:
    """``word, frequency, n, page, pages, total, shown, ipa, summary, definition, has_full``: a page of hits, cut before it meets the entries."""
    hits = search.search(lex, pattern)
    total = hits.count()  # at most the cap of a search
    pages = max(1, -(-total // size))
    page = min(max(1, number), pages)
    rows = hits.orderBy("frequency", "word").limit(page * size)
    # at most a page of rows is gathered, to be numbered
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("frequency", "word"))).alias("x")).select(F.posexplode("x").alias("i", "h")).where(F.col("i") >= (page - 1) * size)
    joined = listed.select("h.word", "h.frequency", (F.col("i") - (page - 1) * size + 1).cast("bigint").alias("n")).join(entries, "word", "left")
    html, blank = F.col("html"), F.lit("")
    return joined.select(
        "word", "frequency", "n", F.lit(page).alias("page"), F.lit(pages).alias("pages"), F.lit(total).cast("bigint").alias("total"),
        strings.run_highlight(F.col("word"), patterns.literal_runs(pattern)).alias("shown"), F.coalesce(markup.ipa(html), blank).alias("ipa"), F.coalesce(markup.summary(html), blank).alias("summary"),
        markup.definition(html).alias("definition"), html.isNotNull().alias("has_full"),
    )


def _rows(df: DataFrame, kind: str, **columns) -> DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = dict(c.split() for c in COLUMNS.split(", "))
    given = {"kind": F.lit(kind)} | columns
    return df.select(*[given.get(n, F.lit(None)).cast(types[n]).alias(n) for n in names])


def word_request(entry: DataFrame, entries: DataFrame, lex: DataFrame, index: DataFrame, chains: DataFrame, affixes: DataFrame) -> DataFrame:
    """``entry(row_id, word)``, one row: its entry, its parts in order, and the words related to its stem, marked."""
    word = entry.select(F.lower("word").alias("word"))
    shown = entry.join(entries.withColumnRenamed("word", "key"), F.lower("word") == F.col("key"), "left")
    head = _rows(shown, "entry", n=F.lit(1), word=F.col("word"), text=F.col("html"), frequency=F.col("row_id"))
    cuts = segment.segment(word, index, chains)
    parts = cuts.select(F.posexplode("parts").alias("i", "p"))
    listed = _rows(parts, "part", n=F.col("i") + 1, word=F.col("p.text"), shown=F.col("p.source"), text=F.col("p.meaning"))
    told = cuts.select(segment.stem_of(F.col("parts")).alias("stem")).first()  # one word's stem
    if told is None or not told["stem"]:
        return head.unionByName(listed)
    near = search.related(lex, told["stem"], affixes, max_results=RELATED)
    best = near.agg(F.array_sort(F.collect_list(F.struct("score", "frequency", "word"))).alias("x")).select(F.posexplode("x").alias("i", "r"))  # at most as many as are shown
    marked = strings.stem_highlight(F.col("r.word"), F.lit(told["stem"]))
    return head.unionByName(listed).unionByName(_rows(best, "related", n=F.col("i") + 1, word=F.col("r.word"), shown=marked, text=F.lit(told["stem"]), frequency=F.col("r.frequency"), score=F.col("r.score")))


def pattern_request(lex: DataFrame, entries: DataFrame, pattern: str, page: int) -> DataFrame:
    return _rows(pattern_page(lex, entries, pattern, page), "hit", n=F.col("n"), word=F.col("word"), shown=F.col("shown"), text=F.col("summary"), frequency=F.col("frequency"))


def suggestions(index: DataFrame, text: str) -> DataFrame:
    near = search.prefix_search(index, text.strip(), search.SUGGESTIONS)
    listed = near.agg(F.array_sort(F.collect_list(F.struct("row_id", "word"))).alias("x")).select(F.posexplode("x").alias("i", "r"))  # at most ten
    return _rows(listed, "suggestion", n=F.col("i") + 1, word=F.col("r.word"), frequency=F.col("r.row_id"))
