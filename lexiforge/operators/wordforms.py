"""Comparison of words with a stem: differences, tilings by known affixes, highlighted forms."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.segment import substrings


def edit_difference(stem: str, word: str) -> list[str]:
    """Letters not shared along a shortest edit, from the end: match before substitution (both letters), deletion, insertion."""
    # what each beginning of the word costs, with the letters so far, for one beginning of the stem after the other
    line = [(j, [*word[:j]][::-1]) for j in range(len(word) + 1)]
    for i, a in enumerate(stem, 1):
        above, line = line, [(i, [*stem[:i]][::-1])]
        for j, b in enumerate(word, 1):
            (cost, letters), new = min(((above[j - 1], [a, b]), (above[j], [a]), (line[j - 1], [b])), key=lambda x: x[0][0])
            line.append(above[j - 1] if a == b else (cost + 1, new + letters))
    return line[-1][1]


def difference(stem: str, word: str) -> list[str]:
    """What one has around the other, else the letters of a shortest edit."""
    for inner, outer in ((stem, word), (word, stem)):
        at = outer.find(inner)
        if at >= 0:
            return [x for x in (outer[:at], outer[at + len(inner) :]) if x]
    return edit_difference(stem, word)


def score(stem: str, word: str, known: set[str], combos: Sequence[re.Pattern] = ()) -> float:
    """One a difference that no known affix or combination explains; 0 for the stem itself, infinite if nothing compares."""
    if stem == word:
        return 0.0
    parts = difference(stem, word)
    return float(sum(not (p in known or any(c.search(p) for c in combos)) for p in parts)) if parts else float("inf")


def tile(text: str, affixes: set[str], from_end: bool = False) -> list[tuple[str, bool]]:
    """The text as known blocks and the stretches between them, nothing lost; longest block first, from one end to the other."""
    sizes = sorted({len(a) for a in affixes if a}, reverse=True)
    out: list[tuple[str, bool]] = []
    loose = ""
    while text:
        cutter = (lambda n: (text[-n:], text[:-n])) if from_end else (lambda n: (text[:n], text[n:]))
        for n in sizes:
            if n <= len(text) and cutter(n)[0] in affixes:
                block, text = cutter(n)
                if loose:
                    out.append((loose, False))
                    loose = ""
                out.append((block, True))
                break
        else:
            letter, text = cutter(1)
            loose = letter + loose if from_end else loose + letter
    if loose:
        out.append((loose, False))
    return out[::-1] if from_end else out


def highlight(stem: str, word: str, prefixes: set[str], suffixes: set[str], css: str = "stem-highlight") -> str:
    """The word with its stem in a span and a dot between known blocks, and between the stem and a known block beside it."""
    at = word.lower().find(stem.lower())
    if at < 0 or not stem:
        return word
    low, end = word.lower(), at + len(stem)
    left, right = tile(low[:at], prefixes), tile(low[end:], suffixes, True)
    out = ""
    for block, known in left:
        out += block + ("." if known else "")
    out += f'<span class="{css}">{word[at:end]}</span>'
    before_known = True
    for block, known in right:
        out += ("." if known and before_known else "") + block
        before_known = known
    return out


def highlighted(words: DataFrame, stem: str, affixes: DataFrame) -> DataFrame:
    """``word, shown``: each word with the affixes (``affix, kind``) that occur in it, found by a join on its substrings."""

    def run(ws: pd.Series, ps: pd.Series, ss: pd.Series) -> pd.Series:
        return pd.Series([highlight(stem, w, set(p), set(s)) for w, p, s in zip(ws, ps, ss)], dtype=object)

    inside = substrings(words, affixes.select(F.col("affix").alias("form"))).select("word", F.col("form").alias("affix")).distinct().join(affixes.select("affix", "kind").distinct(), "affix")
    of = lambda kind: F.coalesce(F.collect_list(F.when(F.col("kind") == kind, F.col("affix"))), F.array().cast("array<string>")).alias(kind)
    sides = inside.groupBy("word").agg(of("p"), of("s"))
    none = F.array().cast("array<string>")
    rows = words.join(sides, "word", "left").select("word", F.coalesce("p", none).alias("p"), F.coalesce("s", none).alias("s"))
    return rows.select("word", F.pandas_udf(run, "string")("word", "p", "s").alias("shown"))


def compile_combos(combos: Sequence[str]) -> list[re.Pattern]:
    """The combinations that are regular expressions, without regard to case; what can't be compiled is skipped."""
    out = []
    for c in combos:
        try:
            out += [re.compile(c, re.IGNORECASE)] if c else []
        except re.error:
            continue
    return out


def differences(pairs: DataFrame) -> DataFrame:
    """``stem, word, parts`` for pairs of words."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difference(x, y) for x, y in zip(a, b)])

    return pairs.select("stem", "word", F.pandas_udf(run, "array<string>")("stem", "word").alias("parts"))
