"""Ranked wildcard search, dictionary lookup, paging and related words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import strings
from lexiforge.functions.patterns import compile_pattern, has_wildcard, like_pattern, star_regex
from lexiforge.operators import lexicon

MAX_RESULTS, PAGE_SIZE, SUGGESTIONS = 50, 10, 10


def matches(word: Column, pattern: str, **options) -> Column:
    """A whole-word match; a leading literal also goes to the scan as a prefix, and a pattern without wildcards as equality."""
    got = compile_pattern(pattern, **options)
    if got.literal is not None:
        return word == got.literal
    found = word.rlike(got.java)
    return word.startswith(got.prefix) & found if got.prefix else found


def search(lex: DataFrame, pattern: str, max_results: int | None = MAX_RESULTS, **options) -> DataFrame:
    """``word, frequency`` of the best ranked distinct words that match; ties by word. An empty pattern finds nothing."""
    word = F.lower("word")
    rows = lex.where(matches(word, pattern, **options) if pattern.strip() else F.lit(False))
    best = rows.groupBy(word.alias("word")).agg(F.min("frequency").alias("frequency"))
    return best.orderBy("frequency", "word").limit(max_results) if max_results else best


def search_total(lex: DataFrame, pattern: str, cap: int = MAX_RESULTS) -> DataFrame:
    """The number of hits, exact and as capped for display."""
    n = search(lex, pattern, None).agg(F.count("*").alias("total_exact"))
    return n.select("total_exact", F.least("total_exact", F.lit(cap).cast("bigint")).alias("total_capped"))


def search_any(lex: DataFrame, patterns: list[str], max_results: int = MAX_RESULTS) -> DataFrame:
    """Words that match any of several patterns: one scan with one alternation."""
    body = "|".join(f"(?:{compile_pattern(p).body})" for p in patterns)
    rows = lex.where(F.lower("word").rlike(rf"(?s)\A(?:{body})\z"))
    return rows.groupBy(F.lower("word").alias("word")).agg(F.min("frequency").alias("frequency")).orderBy("frequency", "word").limit(max_results)


def like_search(index: DataFrame, pattern: str, max_results: int = MAX_RESULTS, legacy: bool = False) -> DataFrame:
    return index.where(F.col("word_lower").like(like_pattern(pattern.lower(), legacy))).orderBy("row_id").limit(max_results)


def prefix_search(index: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """By ``startswith`` on the folded key, which reaches the scan."""
    return index.where(F.col("word_lower").startswith(prefix.lower())).orderBy("row_id").limit(limit)


def star_search(forms: DataFrame, column: str, pattern: str) -> DataFrame:
    return forms.where(F.col(column).rlike("(?is)" + star_regex(pattern)))


def lookup(index: DataFrame, word: str) -> DataFrame:
    """The entry of a word: as written, else folded; of several the first. ``exact`` tells which."""
    text = word.strip()
    rows = index.where((F.col("word") == text) | (F.col("word_lower") == text.lower()))
    exact = F.col("word") == text
    best = F.min_by(F.struct("row_id", "word", exact.alias("exact")), F.struct((~exact).alias("folded"), "row_id")).alias("e")
    return rows.agg(best).where("e is not null").select("e.*")


def lookup_many(index: DataFrame, words: DataFrame) -> DataFrame:
    """``query, row_id, word, exact`` for each query with an entry; one join for all of them."""
    asked = words.select(F.trim("query").alias("query")).where("query != ''").distinct()
    rows = asked.join(index, F.lower("query") == F.col("word_lower"))
    exact = F.col("word") == F.col("query")
    best = F.min_by(F.struct("row_id", "word", exact.alias("exact")), F.struct((~exact).alias("folded"), "row_id")).alias("e")
    return rows.groupBy("query").agg(best).select("query", "e.*")


def dispatch(index: DataFrame, lex: DataFrame, query: str, literal: bool = False) -> DataFrame:
    """``kind, word, row_id``: a pattern's ranked hits, else the entry, else up to ten words that begin alike."""
    if not literal and has_wildcard(query):
        return search(lex, query).select(F.lit("pattern").alias("kind"), "word", F.col("frequency").alias("row_id"))
    hit = lookup(index, query).select(F.lit("entry").alias("kind"), "word", "row_id")
    near = prefix_search(index.where(F.col("word_lower") != query.strip().lower()), query.strip(), SUGGESTIONS)
    near = near.join(hit.select(F.lit(True).alias("_hit")), F.lit(True), "left_anti").select(F.lit("suggestion").alias("kind"), "word", "row_id")
    return hit.unionByName(near)


def page(hits: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a capped, ranked result; a number beyond the last page means the last."""
    n = hits.count()
    pages = max(1, -(-n // size))
    start = (min(max(1, number), pages) - 1) * size
    return hits.orderBy("frequency", "word").offset(start).limit(size).withColumn("pages", F.lit(pages))


def rank_of(lex: DataFrame, words: DataFrame) -> DataFrame:
    """``query, frequency`` with null for unknown words."""
    best = lex.groupBy(F.lower("word").alias("word")).agg(F.min("frequency").alias("frequency"))
    asked = words.select("query", F.lower(F.trim("query")).alias("word"))
    return asked.join(best, "word", "left").select("query", "frequency")


def known_words(words: DataFrame, lex: DataFrame) -> DataFrame:
    """Words of two letters or more that the list has."""
    return words.where(F.length("word") >= 2).join(lex.select("word"), "word", "left_semi")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side, word``: words of one result only."""
    first = a.select("word").exceptAll(b.select("word")).select(F.lit("first").alias("side"), "word")
    return first.unionByName(b.select("word").exceptAll(a.select("word")).select(F.lit("second").alias("side"), "word"))


def morpheme_report(forms: DataFrame | None, frequent: DataFrame, pattern: str) -> DataFrame:
    """``n, src, form, base, pos, meaning, example, total, forms``: root forms (of a form index) and frequent affixes that match, roots first, in order.

    A report of what one pattern finds, numbered as it is shown; frequent affixes are shown as written.
    """
    none = F.lit(None).cast("string")
    form = F.lower(strings.strip_dashes(F.col("affix")))
    pos = F.when(F.col("affix_type") != "", F.col("affix_type")).otherwise("-")
    found = frequent.select(F.lit(1).alias("o"), F.lit("affix").alias("src"), form.alias("form"), F.col("affix").alias("base"), pos.alias("pos"), "meaning", "example", F.col("hf_id").alias("id")).where("form != ''")
    if forms is not None:
        each = forms.select("form", F.posexplode("interps").alias("id", "x"))
        roots = each.select(F.lit(0).alias("o"), F.col("x.src").alias("src"), "form", "form", F.col("id").cast("bigint").alias("id"), "x.meaning", "x.pos").toDF("o", "src", "form", "base", "id", "meaning", "p")
        found = roots.select("o", "src", "form", "base", strings.positions_shown(F.col("p")).alias("pos"), "meaning", none.alias("example"), "id").unionByName(found)
    hits = star_search(found, "form", pattern)
    totals = hits.agg(F.count("*").alias("total"), F.count_distinct("form").alias("forms"))
    numbered = lexicon.ranked(hits, [F.asc("o"), F.asc("form"), F.asc("base"), F.asc("src"), F.asc("id")], "n")
    return numbered.crossJoin(F.broadcast(totals)).select("n", "src", "form", "base", "pos", "meaning", "example", "total", "forms")


def longest_of_each(rows: DataFrame, kinds: list[str], k: int) -> DataFrame:
    """``kind, form, n``: the ``k`` longest forms of each kind (``kind, form, id``), kinds as listed; each task passes on ``k`` rows a kind."""
    parts = None
    for kind in kinds:
        top = rows.where(F.col("kind") == kind).orderBy(F.desc(F.length("form")), "form", "id").limit(k)
        # at most k rows
        one = top.agg(F.array_sort(F.collect_list(F.struct((-F.length("form")).alias("l"), "form", "id", "kind"))).alias("x")).select(F.posexplode("x").alias("i", "r"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.select("r.kind", "r.form", (F.col("i") + 1).cast("bigint").alias("n"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """``form, meaning``: the new entry of each form (``form, meaning, id``), the last one with a meaning, else the old one."""
    last = lambda t: t.where("form is not null and meaning is not null").groupBy("form").agg(F.max_by("meaning", "id").alias("meaning"))
    news = last(new)
    return news.unionByName(last(old).join(news, "form", "left_anti"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def explained(part: str, combos: list[re.Pattern]) -> Column:
    """Whether a remainder is empty, a known affix (joined as ``k_<part>``) or matched by a combination."""
    by_combo = F.lit(False)
    for c in combos:
        by_combo = by_combo | F.col(part).rlike(f"(?i)(?:{c.pattern})")
    return (F.col(part) == "") | F.col(f"k_{part}").isNotNull() | by_combo


def related(lex: DataFrame, stem: str, affixes: DataFrame, combos: list[str] | None = None, max_results: int = MAX_RESULTS) -> DataFrame:
    """``word, score, frequency``: of the best ranked words around the stem, three times as many as wanted, those with the fewest odd remainders.

    A remainder before or after the stem costs one unless it is an affix (``affixes``, one column, joined) or a combination explains it;
    what is no regular expression is skipped.
    """
    from lexiforge.operators.wordforms import compile_combos

    stem, found = stem.lower(), compile_combos(combos or [])
    near = lex.where(F.col("word").contains(stem) & (F.col("word") != stem)).orderBy("frequency", "word").limit(3 * max_results)
    at = F.instr("word", F.lit(stem))
    parts = near.select("word", "frequency", F.substring(F.col("word"), F.lit(1), at - 1).alias("before"), F.substring(F.col("word"), at + len(stem), F.length("word")).alias("after"))
    known = affixes.select(F.lower(affixes.columns[0]).alias("affix")).distinct()
    for part in ("before", "after"):
        parts = parts.join(known.select(F.col("affix").alias(part), F.lit(True).alias(f"k_{part}")), part, "left")
    odd = [F.when(explained(p, found), 0).otherwise(1) for p in ("before", "after")]
    scored = parts.select("word", (odd[0] + odd[1]).alias("score"), "frequency")
    return scored.orderBy("score", F.asc_nulls_last("frequency"), "word").limit(max_results)
