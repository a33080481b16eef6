"""Relational affix analysis: candidates come from equi-joins on generated keys, never from testing every affix against every word.

``left(word, n)`` and ``right(word, n)`` for each length the list has are exploded and joined
with the affix list; what is left joins the word list. Scores decide with explicit ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.runtime import cut

# Endings an etymological root may be followed by.
COMMON_ENDINGS = ["y", "a", "o", "i", "e", "s", "n", "m", "us", "um", "on", "is", "os", "es", "as", "ae", "en", "in", "ly"]


def with_sizes(rows: DataFrame, forms: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the lengths that the forms of a list have: one row is broadcast, as many numbers as there are lengths."""
    sizes = forms.agg(F.array_sort(F.collect_set(F.length(column))).alias(out))
    return rows.crossJoin(F.broadcast(sizes))


def prefix_splits(words: DataFrame, affixes: DataFrame, leave: int = 2) -> DataFrame:
    """``word, pre, rest`` for each prefix of the list that leaves at least ``leave`` letters."""
    pre = affixes.where("kind = 'p'").select(F.col("affix").alias("pre"))
    keys = with_sizes(words.select("word"), pre, "pre", "sizes").select("word", F.explode(F.filter("sizes", lambda n: n <= F.length("word") - leave)).alias("n"))
    keys = keys.select("word", F.substring(F.col("word"), F.lit(1), F.col("n")).alias("pre"), F.expr("substring(word, n + 1)").alias("rest"))
    return keys.join(pre, "pre").select("word", "pre", "rest")


def suffix_splits(words: DataFrame, affixes: DataFrame, leave: int = 2) -> DataFrame:
    """``word, rest, suf`` for each suffix of the list that leaves at least ``leave`` letters."""
    suf = affixes.where("kind = 's'").select(F.col("affix").alias("suf"))
    keys = with_sizes(words.select("word"), suf, "suf", "sizes").select("word", F.explode(F.filter("sizes", lambda n: n <= F.length("word") - leave)).alias("n"))
    keys = keys.select("word", F.expr("substring(word, 1, length(word) - n)").alias("rest"), F.expr("right(word, n)").alias("suf"))
    return keys.join(suf, "suf").select("word", "rest", "suf")


def strip_affixes(words: DataFrame, affixes: DataFrame, lexicon: DataFrame, min_stem: int = 2) -> DataFrame:
    """``word, prefix, stem, suffix``: the longest prefix that leaves a known word, then the longest suffix of the rest that does.

    A suffix of one letter is not taken off what is a known word itself.
    """
    known = lexicon.select(F.col("word").alias("rest")).distinct()
    pre = prefix_splits(words, affixes, min_stem).join(known, "rest", "left_semi").groupBy("word").agg(F.max_by(F.struct("pre", "rest"), F.length("pre")).alias("p"))
    base = words.select("word").join(pre, "word", "left").select("word", F.col("p.pre").alias("prefix"), F.coalesce(F.col("p.rest"), F.col("word")).alias("mid"))
    mids = base.select(F.col("mid").alias("word")).distinct()
    suf = suffix_splits(mids, affixes, min_stem).join(known, "rest", "left_semi")
    whole = mids.join(known.select(F.col("rest").alias("word"), F.lit(True).alias("whole")), "word", "left")
    suf = suf.join(whole, "word").where((F.length("suf") > 1) | F.col("whole").isNull())
    best = suf.groupBy(F.col("word").alias("mid")).agg(F.max_by(F.struct("rest", "suf"), F.length("suf")).alias("s"))
    return base.join(best, "mid", "left").select("word", "prefix", F.coalesce(F.col("s.rest"), F.col("mid")).alias("stem"), F.col("s.suf").alias("suffix"))


def rule_candidates(words: DataFrame, affixes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word, prefix, stem, suffix, score, tier`` of all rule-based splits with a known stem."""
    known = lexicon.select(F.col("word").alias("stem")).distinct()
    none = F.lit(None).cast("string")
    two = affixes.where(F.length("affix") >= 2)
    pre, suf = prefix_splits(words, two, 3), suffix_splits(words, two, 3)
    one = pre.select("word", F.col("pre").alias("prefix"), F.col("rest").alias("stem"), none.alias("suffix")).unionByName(
        suf.select("word", none.alias("prefix"), F.col("rest").alias("stem"), F.col("suf").alias("suffix"))
    )
    outer = pre.where(F.length("rest") >= 5).select("word", F.col("pre").alias("prefix"), F.col("rest"))
    inner = suffix_splits(outer.select(F.col("rest").alias("word")).distinct(), two, 3).select(F.col("word").alias("rest"), F.col("rest").alias("stem"), F.col("suf").alias("suffix"))
    both = outer.join(inner, "rest").select("word", "prefix", "stem", "suffix")
    first = one.unionByName(both).join(known, "stem", "left_semi")
    lp, ls = F.coalesce(F.length("prefix"), F.lit(0)), F.coalesce(F.length("suffix"), F.lit(0))
    by_both = F.col("prefix").isNotNull() & F.col("suffix").isNotNull()
    return first.select("word", "prefix", "stem", "suffix", (2.0 * (lp + ls) + F.when(by_both, 0.5).otherwise(0.2) * F.length("stem")).alias("score"), F.lit(1).alias("tier"))


def weak_candidates(words: DataFrame, affixes: DataFrame) -> DataFrame:
    """Where no stem is known: a suffix of three letters or more, not longer than the four or more before it."""
    found = suffix_splits(words, affixes.where(F.length("affix") >= 3), 4).where(F.length("suf") <= F.length("rest"))
    none = F.lit(None).cast("string")
    return found.select("word", none.alias("prefix"), F.col("rest").alias("stem"), F.col("suf").alias("suffix"), (1.5 * F.length("suf")).alias("score"), F.lit(2).alias("tier"))


def rule_analysis(words: DataFrame, affixes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The best split of each word: tier one before tier two, then the score, then the longer prefix, suffix and their letters."""
    every = rule_candidates(words, affixes, lexicon).unionByName(weak_candidates(words, affixes))
    key = F.struct((-F.col("tier")).alias("t"), "score", F.coalesce("prefix", F.lit("")).alias("p"), F.coalesce("suffix", F.lit("")).alias("s"))
    best = every.groupBy("word").agg(F.max_by(F.struct("prefix", "stem", "suffix", "score", "tier"), key).alias("b"))
    return best.select("word", "b.*")


def one_hop(words: DataFrame, affixes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``word, base, affix, kind``: the longest suffix with a known stem, else the longest such prefix."""
    known = lexicon.select(F.col("word").alias("rest")).distinct()
    s = suffix_splits(words, affixes, 3).select("word", "rest", F.col("suf").alias("affix"), F.lit("s").alias("kind"))
    p = prefix_splits(words, affixes, 3).select("word", "rest", F.col("pre").alias("affix"), F.lit("p").alias("kind"))
    found = s.unionByName(p).join(known, "rest", "left_semi")
    best = found.groupBy("word").agg(F.max_by(F.struct("rest", "affix", "kind"), F.struct("kind", F.length("affix").alias("n"))).alias("b"))
    return best.select("word", F.col("b.rest").alias("base"), "b.affix", "b.kind")


def etym_variants(etym: DataFrame) -> DataFrame:
    """``root``: the forms an etymology field stands for. Its first item is the base; ``=x`` and ``-x`` are put after it, other items are forms of their own; forms of one letter are left out."""
    items = etym.where("roots != ''").select(F.transform(F.split("roots", ","), lambda x: F.trim(x)).alias("x"))
    based = items.select(F.slice("x", F.lit(2), F.size("x")).alias("more"), F.regexp_replace(F.get("x", F.lit(0)), "^[=-]", "").alias("base"))
    grown = F.transform(F.filter("more", lambda p: p != ""), lambda p: F.when(p.rlike("^[=-]"), F.concat("base", F.regexp_replace(p, "^[=-]", ""))).otherwise(p))
    each = based.select(F.explode(F.concat(F.array("base"), grown)).alias("v")).select(F.lower(F.regexp_replace("v", "^[-=]+", "")).alias("root"))
    return each.where("length(root) >= 2").distinct()


def etym_candidates(words: DataFrame, roots: DataFrame, affixes: DataFrame) -> DataFrame:
    """``word, prefix, root, root2, suffix, score, tier``: splits around known roots (``roots(root)``).

    In the first tier a prefix of two letters or more with a root, or any prefix or none with a root and a suffix
    (``2lp + 3lr + 2ls + 10``, roots of two letters or more), and two roots of three or more with or without a suffix (``2r1 + 3r2 + 2ls + 15``).
    In the second, where there is nothing else, a prefix of one letter with a root of three or more (``2 + 3lr``). A word that is
    itself a root is not divided by it.
    """
    session = words.sparkSession
    r = roots.where(F.length("root") >= 2).select("root").distinct()
    tails = affixes.where("kind = 's'").select(F.col("affix").alias("suffix"))
    suffixes = tails.unionByName(session.createDataFrame([(e,) for e in ["", *COMMON_ENDINGS]], "suffix string")).distinct()
    prefixes = affixes.where("kind = 'p'").select(F.col("affix").alias("prefix")).distinct()
    base = with_sizes(with_sizes(words.select("word").distinct(), prefixes, "prefix", "ps"), r, "root", "rs")
    headed = base.select("word", "rs", F.explode(F.filter("ps", lambda n: n <= F.length("word") - 2)).alias("i"))
    headed = headed.select("word", "rs", "i", F.expr("substring(word, 1, i)").alias("prefix")).join(prefixes, "prefix").select("word", "rs", "i")
    opened = base.select("word", "rs", F.lit(0).alias("i")).unionByName(headed)
    spans = opened.select("word", "rs", "i", F.explode(F.filter("rs", lambda n: n <= F.length("word") - F.col("i"))).alias("n"))
    rooted = spans.select("word", "rs", "i", (F.col("i") + F.col("n")).alias("j"), F.expr("substring(word, i + 1, n)").alias("root")).join(r, "root")
    ended = rooted.select("word", "i", "root", F.expr("substring(word, j + 1)").alias("suffix")).join(suffixes, "suffix")
    lr, ls = F.length("root"), F.length("suffix")
    bare, weak = F.col("suffix") == "", (F.col("suffix") == "") & (F.col("i") == 1)
    score = F.when(weak, 2.0 + 3 * lr).otherwise(2.0 * F.col("i") + 3 * lr + 2 * ls + 10)
    simple = ended.where(~(bare & (F.col("i") == 0)) & ~(weak & (lr < 3)))
    simple = simple.select("word", F.expr("substring(word, 1, i)").alias("prefix"), "root", F.lit("").alias("root2"), "suffix", score.alias("score"), F.when(weak, 2).otherwise(1).alias("tier"))
    first = rooted.where("i = 0 and length(root) >= 3")
    pairs = first.select("word", F.col("root").alias("root1"), "j", F.explode(F.filter("rs", lambda n: (n >= 3) & (n <= F.length("word") - F.col("j")))).alias("n"))
    second = pairs.select("word", "root1", F.expr("substring(word, j + 1, n)").alias("root"), F.expr("substring(word, j + n + 1)").alias("suffix")).join(r, "root").join(suffixes, "suffix")
    double = second.select("word", F.lit("").alias("prefix"), F.col("root1").alias("root"), F.col("root").alias("root2"), "suffix", (2.0 * F.length("root1") + 3 * F.length("root") + 2 * F.length("suffix") + 15).alias("score"), F.lit(1).alias("tier"))
    return simple.unionByName(double)


def etym_analysis(words: DataFrame, roots: DataFrame, affixes: DataFrame) -> DataFrame:
    every = etym_candidates(words, roots, affixes)
    key = F.struct((-F.col("tier")).alias("t"), "score", "prefix", "root", "root2", "suffix")
    best = every.groupBy("word").agg(F.max_by(F.struct("prefix", "root", "root2", "suffix", "score"), key).alias("b"))
    return best.select("word", "b.*")


def derivation_strategy(deriv: DataFrame) -> DataFrame:
    """``word, base, affix, kind, score``: the derivation with the longest affix, scored ``max(3, len / 2 + 2)``."""
    best = deriv.groupBy("word").agg(F.max_by(F.struct("base", "affix", "kind"), F.struct(F.length("affix").alias("n"), "affix", "base", "kind")).alias("b"))
    return best.select("word", "b.*", F.greatest(F.lit(3.0), 0.5 * F.length("b.affix") + 2).alias("score"))


def inflections(rows: DataFrame) -> DataFrame:
    """``form, lemma, suffix``: one entry a form, of ``form, lemma, suffix, ord``.

    The first entry with a suffix is kept. Of a form without any, later entries replace an earlier one as long as their lemma is another word.
    """
    full = F.col("suffix") != ""
    first = F.min_by(F.struct("lemma", "suffix"), F.when(full, F.col("ord")))
    other = F.max_by(F.struct("lemma", "suffix"), F.when(F.col("lemma") != F.col("form"), F.col("ord")))
    any_one = F.min_by(F.struct("lemma", "suffix"), "ord")
    best = rows.withColumn("suffix", F.coalesce("suffix", F.lit(""))).groupBy("form").agg(F.coalesce(first, other, any_one).alias("b"))
    return best.select("form", "b.lemma", "b.suffix")


def one_step(words: DataFrame, deriv: DataFrame, affixes: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    """``word, base, affix, kind``: the derivation with the longest affix, else, with a ``lexicon``, one layer taken off by rule."""
    told = derivation_strategy(deriv.join(words, "word", "left_semi")).drop("score")
    if lexicon is None:
        return told
    return told.unionByName(one_hop(words.join(told, "word", "left_anti"), affixes.where(F.length("affix") >= 2), lexicon))


def analyze(words: DataFrame, deriv: DataFrame, roots: DataFrame, affixes: DataFrame, lexicon: DataFrame, inflected: DataFrame) -> DataFrame:
    """``word, strategy, parts, score, strategies``: the primary analysis of each word and all that were found, the primary's first.

    A derivation whose base has a further layer (derived or by rule) is ``combined`` if prefix and suffix come together; else the
    derivation itself; else an inflection; else the better of rule and etymology, the latter only if it scores more and
    the word is no base or it scores 30 or more; else ``none``. ``inflected`` is ``form, lemma, suffix``; words without a suffix are no inflections.
    """
    words = words.select("word").distinct()
    outer = cut(one_step(words, deriv, affixes, None))
    inner = one_step(outer.select(F.col("base").alias("word")).distinct(), deriv, affixes, lexicon).toDF("base", "base2", "affix2", "kind2")
    points = lambda c: F.greatest(F.lit(3.0), 0.5 * F.length(c) + 2)
    joined = outer.join(inner, "base", "left")
    two = F.col("base2").isNotNull() & (F.col("kind") != F.col("kind2"))
    pre, suf = F.when(F.col("kind") == "p", F.col("affix")).otherwise(F.col("affix2")), F.when(F.col("kind") == "s", F.col("affix")).otherwise(F.col("affix2"))
    entry = lambda scheme, parts, score: F.struct(F.lit(scheme).alias("scheme"), parts.alias("parts"), score.cast("double").alias("score"))
    step1 = entry("derivation", F.when(F.col("kind") == "s", F.array("base", "affix")).otherwise(F.array("affix", "base")), points("affix"))
    step2 = entry("derivation", F.when(F.col("kind2") == "s", F.array("base2", "affix2")).otherwise(F.array("affix2", "base2")), points("affix2"))
    whole = entry("combined", F.array(pre, "base2", suf), points("affix") + points("affix2"))
    derived = joined.select("word", F.when(two, whole).otherwise(step1).alias("primary"), F.when(F.col("base2").isNotNull(), F.array(step1, step2)).otherwise(F.array(step1)).alias("strategies"))
    rest = words.join(derived, "word", "left_anti")
    flex = inflected.where("suffix != '' and suffix != lemma").withColumnRenamed("form", "word").join(rest, "word", "left_semi")
    bent = flex.select("word", entry("inflection", F.array("lemma", "suffix"), F.lit(3.0)).alias("primary"))
    bent = bent.select("word", "primary", F.array("primary").alias("strategies"))
    rest = cut(rest.join(bent, "word", "left_anti"))
    known_bases = deriv.select(F.col("base").alias("word")).unionByName(inflected.select(F.col("lemma").alias("word"))).distinct().withColumn("is_base", F.lit(True))
    filled = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != ""))
    rule = rule_analysis(rest, affixes, lexicon).select("word", entry("rule", filled("prefix", "stem", "suffix"), F.col("score")).alias("r"))
    etym = etym_analysis(rest, roots, affixes).select("word", entry("etym", filled("prefix", "root", "root2", "suffix"), F.col("score")).alias("e"))
    either = rest.join(rule, "word", "left").join(etym, "word", "left").join(known_bases, "word", "left")
    strong = F.col("is_base").isNull() | (F.col("e.score") >= 30)
    none = entry("none", F.array("word"), F.lit(0.0))
    wins = F.col("e").isNotNull() & (F.col("e.score") > F.coalesce(F.col("r.score"), F.lit(-1.0))) & strong
    chosen = F.when(wins, F.array_compact(F.array("e", "r"))).when(F.col("r").isNotNull(), F.array_compact(F.array("r", "e"))).otherwise(F.array(none))
    last = either.select("word", chosen.alias("strategies")).select("word", F.get("strategies", F.lit(0)).alias("primary"), "strategies")
    every = derived.unionByName(bent).unionByName(last)
    return every.select("word", F.col("primary.scheme").alias("strategy"), "primary.parts", "primary.score", "strategies")


def chains(reverse: DataFrame, hops: int = 10, words: DataFrame | None = None) -> DataFrame:
    """``word, base, parts, depth``: derivations followed for at most ``hops`` steps, of all words or of those given.

    ``reverse(word, base, affix, kind)`` has one row a word. Parts are the affixes in their places around
    the last base reached. A ring stops at the bound. Only words that have a step to go are moved in a round; finished ones are kept apart.
    """
    none = F.array().cast("array<string>")
    side = lambda kind: F.when(F.col("kind") == kind, F.array("affix")).otherwise(none)
    goes = reverse.select(F.col("word").alias("base"), F.lit(True).alias("more"))
    step = reverse.select("word", "base", side("p").alias("pre"), side("s").alias("suf")).join(goes, "base", "left")
    step = cut(step.select("word", "base", "pre", "suf", F.coalesce("more", F.lit(False)).alias("more")))
    nxt = step.select(F.col("word").alias("base"), F.col("base").alias("b2"), F.col("pre").alias("p2"), F.col("suf").alias("s2"), F.col("more").alias("m2"))
    state = (step if words is None else step.join(words.select("word").distinct(), "word", "left_semi")).withColumn("depth", F.lit(1))
    done = [state.where("not more")]
    state = state.where("more")
    for depth in range(2, hops + 1):
        moved = state.join(nxt, "base").select("word", F.col("b2").alias("base"), F.concat("pre", "p2").alias("pre"), F.concat("s2", "suf").alias("suf"), F.col("m2").alias("more"), F.lit(depth).alias("depth"))
        moved = cut(moved)
        done.append(moved.where("not more"))
        state = moved.where("more")
        if state.isEmpty():
            break
    every = state
    for part in done:
        every = every.unionByName(part)
    return every.select("word", "base", F.concat("pre", F.array("base"), "suf").alias("parts"), "depth")
