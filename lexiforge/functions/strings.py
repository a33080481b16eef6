"""Scalar functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4E00}-\x{9FFF}]"


def count_syllables(word: Column) -> Column:
    """Number of runs of vowels; ``y`` is one except at the start."""
    return F.size(F.regexp_extract_all(F.regexp_replace(F.lower(word), "^y", "_"), F.lit("[aeiouy]+"), F.lit(0)))


def strip_dashes(form: Column) -> Column:
    return F.btrim(F.btrim(form, F.lit("-")))


def bare_form(form: Column) -> Column:
    """A form without outer dashes and blanks of any kind and without case."""
    return F.lower(F.regexp_replace(form, r"^[\p{IsWhite_Space}\p{Pd}]+|[\p{IsWhite_Space}\p{Pd}]+$", ""))


def affix_position(dashed: Column) -> Column:
    """``-x-`` root, ``-x`` suffix, ``x-`` prefix, else null."""
    return F.when(dashed.startswith("-") & dashed.endswith("-"), "root").when(dashed.startswith("-"), "suffix").when(dashed.endswith("-"), "prefix")


def dashed(form: Column, kind: Column) -> Column:
    """``-x-`` for a root, ``x-`` for a prefix, ``-x`` for a suffix, else as it is; null for an empty form."""
    marked = F.when(kind == "root", F.concat(F.lit("-"), form, F.lit("-"))).when(kind == "prefix", F.concat(form, F.lit("-"))).when(kind == "suffix", F.concat(F.lit("-"), form)).otherwise(form)
    return F.when(form != "", marked)


def positions_shown(kinds: Column) -> Column:
    """Positions in order, joined by strokes; ``-`` for none."""
    return F.when(F.size(kinds) > 0, F.array_join(F.array_sort(kinds), "/")).otherwise("-")


def secondary_score(freq: Column, merged: Column, optional: Column) -> Column:
    """Bonus of a form by its frequency, or by that of its group; optional forms lose half a point."""
    score = (
        F.when(freq >= 3, 0.5 + 0.25 * F.log2(freq / 3))
        .when(freq.isNotNull() & (merged >= 3), 0.25 + 0.125 * F.log2(merged / 3))
        .otherwise(0.0)
    )
    return score - F.when(optional, 0.5).otherwise(0.0)


def position_allowed(kinds: Column, start: Column, length: Column, word_length: Column) -> Column:
    """A pure prefix may not end the word, a pure suffix may not start it; no kinds, no limit."""
    only = lambda k: (F.size(kinds) == 1) & F.array_contains(kinds, k)
    return F.coalesce(~(only("prefix") & (start + length == word_length)) & ~(only("suffix") & (start == 0)), F.lit(True))


def stem_highlight(word: Column, stem: Column, css: str = "stem") -> Column:
    """The first occurrence of the stem, whatever its case, in a span."""
    at = F.instr(F.lower(word), F.lower(stem))
    n = F.length(stem)
    marked = F.concat(F.substring(word, F.lit(1), at - 1), F.lit(f'<span class="{css}">'), F.substring(word, at, n), F.lit("</span>"), F.substring(word, at + n, F.length(word)))
    return F.when((at > 0) & (n > 0), marked).otherwise(word)


def run_highlight(word: Column, runs: list[str], css: str = "hit") -> Column:
    """Each literal run, leftmost after the one before, in a span; the word as it is if any is missing."""
    out, rest, all_found = F.lit(""), word, F.lit(True)
    for run in runs:
        at = F.instr(F.lower(rest), F.lit(run.lower()))
        all_found = all_found & (at > 0)
        end = at + len(run)
        out = F.concat(out, F.substring(rest, F.lit(1), at - 1), F.lit(f'<span class="{css}">'), F.substring(rest, at, F.lit(len(run))), F.lit("</span>"))
        rest = F.substring(rest, end, F.length(word))
    return F.when(all_found, F.concat(out, rest)).otherwise(word)


def collapse_han(text: Column) -> Column:
    return F.regexp_replace(text, f"{HAN}+", ".")


def strip_phonetic(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[^\]]*\]", "")


def strip_separators(text: Column) -> Column:
    return F.translate(text, ".+", "")


def join_langs(langs: Column) -> Column:
    """Distinct languages, sorted; ``?`` only if there is nothing better."""
    real = F.array_sort(F.array_distinct(F.filter(langs, lambda x: x.isNotNull() & (x != "") & (x != "?"))))
    return F.when(F.size(real) > 0, F.array_join(real, "; ")).when(F.coalesce(F.array_contains(langs, "?"), F.lit(False)), "?").otherwise("")


def chosen_meaning(ety: Column, shown: Column) -> Column:
    """The etymological meaning unless it only refers elsewhere, then the shown one."""
    good = (ety != "") & ~F.lower(ety).contains("see also") & ~ety.contains(";;")
    return F.coalesce(F.when(good, ety), F.when(shown != "", shown), F.when(ety != "", ety))


# Words that carry no sense of their own.
EN_STOP = ["a", "an", "and", "by", "for", "in", "of", "on", "or", "the", "to", "with"]


def cn_tokens(gloss: Column) -> Column:
    return F.filter(F.split(gloss, r"[；;，,。、/·.…\s\d()（）_\-]+"), lambda t: t.rlike(HAN))


def en_tokens(gloss: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(gloss), F.lit("[a-z]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(EN_STOP))


def line_tokens(line: Column) -> Column:
    """``lang`` and distinct tokens of one gloss line."""
    cn = line.rlike(HAN)
    return F.struct(F.when(cn, "cn").otherwise("en").alias("lang"), F.array_distinct(F.when(cn, cn_tokens(line)).otherwise(en_tokens(line))).alias("tokens"))


def line_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller line; null across languages or with an empty side."""
    least = F.least(F.size(a["tokens"]), F.size(b["tokens"]))
    return F.when((a["lang"] == b["lang"]) & (least > 0), F.size(F.array_intersect(a["tokens"], b["tokens"])) / least)


def inserted(a: Column, b: Column) -> Column:
    """``longer, place, letter`` if one form is the other with one letter put in, after ``place`` letters that both begin with; else null."""
    longer, shorter = F.when(F.length(a) > F.length(b), a).otherwise(b), F.when(F.length(a) > F.length(b), b).otherwise(a)
    sides = F.transform(F.array(F.struct(longer.alias("l"), shorter.alias("s"))), lambda x: F.struct(x["l"].alias("l"), x["s"].alias("s"), F.size(F.filter(F.sequence(F.lit(0), F.length(x["s"])), lambda i: x["l"].startswith(F.substring(x["s"], F.lit(1), i)))).alias("n")))
    one = F.get(sides, F.lit(0))
    place = one["n"] - 1
    fits = (F.abs(F.length(a) - F.length(b)) == 1) & (F.substring(one["l"], place + 2, F.length(one["l"])) == F.substring(one["s"], place + 1, F.length(one["l"])))
    return F.when(fits, F.struct(one["l"].alias("longer"), place.alias("place"), F.substring(one["l"], place + 1, F.lit(1)).alias("letter")))


def derivation_fits(word: Column, base: Column, affix: Column, kind: Column) -> Column:
    """The affix stands on its side and what is left is about as long as the base."""
    side = F.when(kind == "s", F.endswith(word, affix)).otherwise(F.startswith(word, affix))
    return side & (F.abs(F.length(word) - F.length(affix) - F.length(base)) <= 2)


def format_parts(parts: Column, with_source: bool = False) -> Column:
    """Known parts as they are, unknown ones in brackets, joined by dots."""
    def one(p: Column) -> Column:
        shown = F.when(p["meaning"].isNotNull() | (p["source"] != ""), p["text"]).otherwise(F.concat(F.lit("["), p["text"], F.lit("]")))
        return F.concat(shown, F.lit("{"), p["source"], F.lit("}")) if with_source else shown

    return F.array_join(F.transform(parts, one), ".")


def parse_segments(text: Column) -> Column:
    """The parts of a shown segmentation; dots in brackets don't divide, the brackets are dropped."""
    return F.transform(F.split(text, r"\.(?![^\[]*\])"), lambda p: F.regexp_replace(p, r"^\[|\]$", ""))


def ety_root_items(roots: Column) -> Column:
    """The items of a packed root field, without leading bullets."""
    return F.filter(F.transform(F.split(F.regexp_replace(roots, "•", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
