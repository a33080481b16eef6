"""Offline builds: segment statistics, merged roots, affix tables, the small dictionary and its repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import markup, strings


def segment_positions(splits: DataFrame, keep_single: bool = True) -> DataFrame:
    """``word, seg, place`` for each part of each split; each word counts once for a part, at its first place.

    ``splits(word, segments)``; a split of one part is ``first`` or, without ``keep_single``, left out.
    """
    rows = splits.where(F.size("segments") > (0 if keep_single else 1))
    at = rows.select("word", F.size("segments").alias("n"), F.posexplode("segments").alias("i", "seg")).where("seg is not null and seg != ''")
    first = at.groupBy("word", "seg").agg(F.min(F.struct("i", "n")).alias("x"))
    place = F.when(F.col("x.i") == 0, "first").when(F.col("x.i") == F.col("x.n") - 1, "last").otherwise("middle")
    return first.select("word", "seg", place.alias("place"))


def segment_frequencies(cards: DataFrame, rules: DataFrame, least: int = 1) -> DataFrame:
    """``seg, cnt, first, last, middle``: words a part occurs in, the cards' splits before the rules'.

    Rules of words that the cards split, and rules of one part, are left out.
    """
    own = rules.join(cards.select("word"), "word", "left_anti")
    every = segment_positions(cards).unionByName(segment_positions(own, keep_single=False))
    counts = [F.count_if(F.col("place") == p).alias(p) for p in ("first", "last", "middle")]
    return every.groupBy("seg").agg(F.count_distinct("word").alias("cnt"), *counts).where(F.col("cnt") >= least)


def ety_forms(etym: DataFrame) -> DataFrame:
    """``base, form, opt``: forms of packed etymology fields; ``=x`` is fixed, ``-x`` and ``*x`` are optional, a bare item is a form of its own."""
    items = strings.ety_root_items(F.col("roots"))
    rows = etym.select(items.alias("items")).where(F.size("items") > 0)
    rows = rows.withColumn("base", F.regexp_extract(F.lower(F.regexp_replace(F.get("items", F.lit(0)), r"^[-*=]+", "")), "^([a-z]+)", 1)).where("base != ''")
    each = rows.select("base", F.posexplode("items").alias("i", "item"))
    tail = F.lower(F.regexp_extract("item", r"^[-*=]([A-Za-z]+)", 1))
    bare = F.lower(F.regexp_extract("item", r"^([A-Za-z]+)", 1))
    form = F.when(F.col("i") == 0, F.col("base")).when(tail != "", F.concat("base", tail)).when(bare != "", bare)
    opt = F.when(F.col("i") == 0, False).otherwise(F.col("item").rlike(r"^[-*]"))
    found = each.select("base", form.alias("form"), opt.alias("opt")).where("form is not null")
    return found.groupBy("base", "form").agg(F.bool_or("opt").alias("opt"))


def affix_table(affixes: DataFrame) -> DataFrame:
    """``form, pos, meaning, langs``: affixes by bare form, meanings and languages joined in order."""
    form = F.lower(strings.strip_dashes(F.trim("roots")))
    rows = affixes.select(form.alias("form"), strings.affix_position(F.trim("roots")).alias("pos"), "meaning", "lang_code").where("form != ''")
    joined = F.array_join(F.array_sort(F.collect_set(F.when(F.col("meaning") != "", F.col("meaning")))), "; ")
    return rows.groupBy("form").agg(F.array_sort(F.collect_set("pos")).alias("pos"), joined.alias("meaning"), strings.join_langs(F.collect_set("lang_code")).alias("langs"))


def merged_roots(etym: DataFrame, affixes: DataFrame) -> DataFrame:
    """``base, form, opt, pos, meaning``: forms of the etymologies with the positions of equal affixes, then affixes no etymology has."""
    forms, table = ety_forms(etym), affix_table(affixes)
    with_pos = forms.join(table.select("form", "pos", "meaning"), "form", "left")
    none = F.array().cast("array<string>")
    own = with_pos.select("base", "form", "opt", F.coalesce("pos", none).alias("pos"), F.coalesce("meaning", F.lit("")).alias("meaning"))
    alone = table.join(forms.select("form"), "form", "left_anti")
    return own.unionByName(alone.select(F.col("form").alias("base"), "form", F.lit(False).alias("opt"), "pos", "meaning"))


def small_dictionary(entries: DataFrame, ranks: DataFrame) -> DataFrame:
    """``word, frequency, definition, inflections`` of ranked words that have an entry; verb forms before noun forms, repeats kept."""
    html = F.col("html")
    rows = ranks.join(entries, "word", "left")
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(markup.verb_forms(html), none), F.coalesce(markup.noun_forms(html), none))
    return rows.select("word", "frequency", markup.definition(html).alias("definition"), both.alias("inflections"))


def flattened(small: DataFrame) -> DataFrame:
    """``word, definition, frequency``: head words and their inflections, the first by rank wins; rows without word or definition are skipped."""
    rows = small.where("word != '' and definition is not null")
    every = rows.select("word", "definition", "frequency", F.lit(0).alias("o")).unionByName(rows.select(F.explode("inflections").alias("word"), "definition", "frequency", F.lit(1).alias("o"))).where("word != ''")
    best = every.groupBy("word").agg(F.min_by(F.struct("definition", "frequency"), F.struct("frequency", "o", "definition")).alias("b"))
    return best.select("word", "b.definition", "b.frequency")


def head_before_inflection(small: DataFrame) -> DataFrame:
    """``word, definition``: the last head word if a word is one, else the first inflection; the order is the rank."""
    rows = small.where("word != '' and definition is not null")
    head = rows.groupBy("word").agg(F.max_by("definition", F.struct("frequency", "definition")).alias("h"))
    infl = rows.select(F.explode("inflections").alias("word"), "definition", "frequency").groupBy("word").agg(F.min_by("definition", F.struct("frequency", "definition")).alias("i"))
    return head.join(infl, "word", "full").select("word", F.coalesce("h", "i").alias("definition")).where("word != ''")


def repaired(small: DataFrame, entries: DataFrame) -> DataFrame:
    """Missing definitions filled from the entry: the short gloss, then the fallback; ``fixed`` tells which rows changed."""
    joined = small.join(entries.select("word", "html"), "word", "left")
    found = F.coalesce(markup.definition(F.col("html")), markup.definition_fallback(F.col("html")))
    fixed = F.col("definition").isNull() & found.isNotNull()
    return joined.select("word", "frequency", F.coalesce("definition", found).alias("definition"), fixed.alias("fixed"))


def updated(rows: DataFrame, news: DataFrame, key: str, value: str, only_missing: bool = True) -> DataFrame:
    """``rows`` with values of ``news`` of the same key; ``only_missing`` leaves values that are there."""
    new = news.groupBy(key).agg(F.max(value).alias("_new"))
    joined = rows.join(new, key, "left")
    pick: Column = F.coalesce(value, "_new") if only_missing else F.coalesce("_new", value)
    return joined.withColumn(value, pick).drop("_new")


def restored(rows: DataFrame, snapshot: DataFrame, key: str, value: str) -> DataFrame:
    """Values of the keys of a snapshot set back to null."""
    marked = rows.join(snapshot.select(key).distinct().withColumn("_was_null", F.lit(True)), key, "left")
    return marked.withColumn(value, F.when(F.col("_was_null").isNull(), F.col(value))).drop("_was_null")


def mismatch_classes(want: DataFrame, got: DataFrame) -> DataFrame:
    """``word, cls``: how a segmentation (``word, stage1, parts``, as shown) differs from the wanted one: EXACT, PARTS, STAGE1 or BOTH; a missing stage is equal to a missing one."""
    j = want.select("word", F.col("stage1").alias("s"), F.col("parts").alias("p")).join(got.select("word", "stage1", "parts"), "word")
    same1, same2 = F.col("s").eqNullSafe(F.col("stage1")), F.col("p").eqNullSafe(F.col("parts"))
    cls = F.when(same1 & same2, "EXACT").when(same1, "PARTS").when(same2, "STAGE1").otherwise("BOTH")
    return j.select("word", cls.alias("cls"))


def score_lines(classes: DataFrame) -> DataFrame:
    """``line``: the report of a scoring, of fixed width: one line a class, the share of exact ones on the last."""
    n = classes.groupBy("cls").agg(F.count("*").alias("n"))
    each = n.select(F.format_string("%-10s%8d", "cls", "n").alias("line"))
    total = classes.agg(F.count("*").alias("n"), F.count_if(F.col("cls") == "EXACT").alias("e")).where("n > 0")
    return each.unionByName(total.select(F.format_string("%-10s%7.1f%%", F.lit("score"), 100.0 * F.col("e") / F.col("n")).alias("line")))
