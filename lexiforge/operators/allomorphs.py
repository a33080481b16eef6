"""The graph of forms that are one morpheme: nodes, candidate edges, the merge gate, groups.

Edges are found by equi-joins on generated keys (one deletion; one masked boundary letter), never by
comparing all pairs of forms. Components are min labels spread by alternating stars, cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import strings
from lexiforge.operators.components import labels

VOWELS = "aeiouy"
MIN_OVERLAP = 0.5


def nodes(manual: DataFrame, roots: DataFrame, corpus: DataFrame) -> DataFrame:
    """``form, pos, lines, rank, cnt``: a node for each form and position.

    ``manual(form, pos, gloss, cnt)`` rank 0, ``roots(form, pos, gloss)`` rank 1, ``corpus(seg, first, last,
    middle)`` rank 2 as prefix, suffix or root. A manual gloss suppresses that of the roots; a node
    without gloss takes those of the same form elsewhere, and has rank 3 if there are none.
    """
    a = manual.select("form", "pos", "gloss", F.lit(0).alias("rank"), F.col("cnt").cast("bigint").alias("cnt"))
    b = roots.select("form", "pos", "gloss", F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("cnt"))
    places = F.stack(F.lit(3), F.lit("prefix"), F.col("first"), F.lit("suffix"), F.col("last"), F.lit("root"), F.col("middle"))
    c = corpus.select(F.col("seg").alias("form"), places.alias("pos", "cnt")).where("cnt > 0").select("form", "pos", F.lit(None).cast("string").alias("gloss"), F.lit(2).alias("rank"), F.col("cnt").cast("bigint").alias("cnt"))
    every = a.unionByName(b).unionByName(c).where("form rlike '^[a-z]+$' and pos is not null")
    gloss = F.when(F.trim("gloss") != "", F.trim("gloss"))
    lines = lambda r: F.array_sort(F.collect_set(F.when(F.col("rank") == r, gloss)))
    got = every.groupBy("form", "pos").agg(lines(0).alias("l0"), lines(1).alias("l1"), F.min("rank").alias("rank"), F.sum("cnt").alias("cnt"))
    got = got.select("form", "pos", F.when(F.size("l0") > 0, F.col("l0")).otherwise(F.col("l1")).alias("own"), "rank", "cnt")
    other = got.select("form", F.explode("own").alias("l")).groupBy("form").agg(F.array_sort(F.collect_set("l")).alias("any"))
    none = F.array().cast("array<string>")
    full = got.join(other, "form", "left")
    return full.select("form", "pos", F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("any", none)).alias("lines"), F.when((F.size("own") > 0) | (F.col("rank") < 2), F.col("rank")).otherwise(F.lit(3)).alias("rank"), "cnt")


def pad_edges(forms: DataFrame) -> DataFrame:
    """``a, b, pos, kind``: ``b`` is ``a`` with one letter more; ``elide`` if it doubles the letter before it, else ``pad``. Roots only grow at the right end."""
    at = F.when(F.col("pos") == "root", F.array(F.length("form"))).otherwise(F.sequence(F.lit(1), F.length("form")))
    gone = forms.where("length(form) >= 2").select("pos", F.col("form").alias("b"), F.explode(at).alias("i"))
    gone = gone.select("pos", "b", F.expr("concat(substring(b, 1, i - 1), substring(b, i + 1))").alias("a")).distinct()
    pairs = gone.join(forms.select("pos", F.col("form").alias("a")), ["pos", "a"])
    # the place of the insertion: right after the longest common beginning
    same = F.expr("aggregate(sequence(1, length(a)), 0, (k, i) -> case when k = i - 1 and substring(a, i, 1) = substring(b, i, 1) then i else k end)")
    pairs = pairs.withColumn("k", same)
    doubled = (F.col("k") > 0) & (F.expr("substring(b, k, 1)") == F.expr("substring(b, k + 1, 1)"))
    return pairs.select("a", "b", "pos", F.when(doubled, "elide").otherwise("pad").alias("kind"))


def assimilation_edges(forms: DataFrame) -> DataFrame:
    """Forms of one length that differ in one consonant at an end (roots: at the right end only)."""
    rows = forms.where("length(form) >= 1")
    right = rows.select("pos", "form", F.expr("concat(substring(form, 1, length(form) - 1), '_')").alias("key"), F.expr("right(form, 1)").alias("c"))
    left = rows.where("pos != 'root' and length(form) > 1").select("pos", "form", F.expr("concat('_', substring(form, 2))").alias("key"), F.expr("left(form, 1)").alias("c"))
    keyed = right.unionByName(left).where(~F.col("c").isin(list(VOWELS)))
    other = keyed.select("pos", "key", F.col("form").alias("b"), F.col("c").alias("c2"))
    pairs = keyed.join(other, ["pos", "key"]).where("form < b and c != c2")
    return pairs.select(F.col("form").alias("a"), "b", "pos", F.lit("assimilation").alias("kind")).distinct()


def rule_edges(node_table: DataFrame) -> DataFrame:
    forms = node_table.select("form", "pos").distinct()
    return pad_edges(forms).unionByName(assimilation_edges(forms))


def gate(edges: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges with ``merge``: true if a comparable pair of gloss lines overlaps by half (assimilation: and in two tokens), false if none does or a side has no lines, null if no pair compares."""
    lines = F.transform("lines", strings.line_tokens)
    n = node_table.select("form", "pos", lines.alias("t"), "rank")
    both = edges.join(n.select(F.col("form").alias("a"), "pos", F.col("t").alias("ta"), F.col("rank").alias("ra")), ["a", "pos"])
    both = both.join(n.select(F.col("form").alias("b"), "pos", F.col("t").alias("tb"), F.col("rank").alias("rb")), ["b", "pos"])

    def any_pair(f) -> Column:
        return F.exists("ta", lambda x: F.exists("tb", lambda y: F.coalesce(f(x, y), F.lit(False))))

    comparable = any_pair(lambda x, y: strings.line_overlap(x, y).isNotNull())
    enough = any_pair(lambda x, y: (strings.line_overlap(x, y) >= MIN_OVERLAP) & ((F.col("kind") != "assimilation") | (F.size(F.array_intersect(x["tokens"], y["tokens"])) >= 2)))
    unglossed = (F.size("ta") == 0) | (F.size("tb") == 0)
    merge = F.when(unglossed, False).when(enough, True).when(comparable, False)
    reason = F.when(unglossed, "no_gloss").when(enough, "overlap").when(comparable, "differs").otherwise("other_language")
    return both.select("a", "b", "pos", "kind", merge.alias("merge"), reason.alias("reason"), F.least("ra", "rb").alias("rank"))


def review(gated: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Edges held back that touch a trusted node, for reasons other than a missing gloss; with ``examples`` (``form, pos, word, n``) those of each side in order."""
    held = gated.where("not coalesce(merge, false) and rank <= 1 and reason != 'no_gloss'")
    if examples is None:
        return held
    listed = examples.groupBy("form", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("ex"))
    none = F.array().cast("array<string>")
    for side in ("a", "b"):
        held = held.join(listed.select(F.col("form").alias(side), "pos", F.col("ex").alias(f"examples_{side}")), [side, "pos"], "left")
        held = held.withColumn(f"examples_{side}", F.coalesce(f"examples_{side}", none))
    return held


def groups(node_table: DataFrame, gated: DataFrame) -> DataFrame:
    """``canonical, pos, variants, cnt, rank, edge_types``: merged nodes; the head is the one of least rank, then greatest count, length, and first by letters."""
    merged = gated.where("merge")
    key = lambda form: F.concat_ws("@", form, "pos")
    of = labels(merged.select(key("a").alias("a"), key("b").alias("b")))
    n = node_table.withColumn("v", key("form")).join(of, "v", "left").withColumn("label", F.coalesce("label", "v"))
    kinds = merged.select(key("a").alias("v"), "kind").join(of, "v").groupBy("label").agg(F.array_sort(F.collect_set("kind")).alias("edge_types"))
    head = F.min_by("form", F.struct("rank", (-F.col("cnt")).alias("c"), (-F.length("form")).alias("l"), "form"))
    got = n.groupBy("label", "pos").agg(head.alias("canonical"), F.array_sort(F.collect_set("form")).alias("variants"), F.sum("cnt").alias("cnt"), F.min("rank").alias("rank"))
    none = F.array().cast("array<string>")
    return got.join(kinds, "label", "left").select("canonical", "pos", "variants", "cnt", "rank", F.coalesce("edge_types", none).alias("edge_types"))


def lookup_table(group_table: DataFrame) -> DataFrame:
    """``key, canonical``: ``form@pos`` of each variant."""
    return group_table.select(F.explode("variants").alias("v"), "pos", "canonical").select(F.concat_ws("@", "v", "pos").alias("key"), "canonical")


def confirmed(group_table: DataFrame, manual: DataFrame, root_forms: DataFrame, corpus: DataFrame) -> DataFrame:
    """``affix, kind, example, cnt, merged_count, canonical``: variants of groups that a manual affix or a root form confirms, best count first."""
    known = manual.select("form").unionByName(root_forms.select("form")).distinct()
    v = group_table.where("cnt >= 1").select("canonical", "pos", F.col("cnt").alias("merged_count"), "variants", F.explode("variants").alias("form"))
    good = v.join(known, "form", "left_semi").select("canonical", "pos").distinct()
    each = v.join(good, ["canonical", "pos"], "left_semi").where("length(form) >= 2")
    places = F.stack(F.lit(3), F.lit("prefix"), F.col("first"), F.lit("suffix"), F.col("last"), F.lit("root"), F.col("middle"))
    counted = corpus.select(F.col("seg").alias("form"), places.alias("pos", "cnt"))
    examples = manual.groupBy("form").agg(F.min("example").alias("example"))
    rows = each.join(counted, ["form", "pos"], "left").join(examples, "form", "left")
    best = rows.groupBy("form", "pos").agg(F.max_by(F.struct("example", F.coalesce("cnt", F.lit(0)).alias("cnt"), "merged_count", "canonical"), F.struct("merged_count", "canonical")).alias("b"))
    return best.select(F.col("form").alias("affix"), F.col("pos").alias("kind"), "b.*")


def top_examples(words: DataFrame, k: int = 4) -> DataFrame:
    """``form, pos, word, n``: at most ``k`` words of each form by trust, then letters; each task passes on at most ``k`` of a form."""
    order = Window.partitionBy("form", "pos").orderBy("trust", "word")
    once = words.groupBy("form", "pos", "word").agg(F.min("trust").alias("trust"))
    return once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("form", "pos", "word", "n")
