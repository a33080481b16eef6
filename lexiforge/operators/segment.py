"""Segmentation of words into known forms.

The forms that occur in a word come from an equi-join on its substrings, so no table of forms is ever
broadcast; the order-dependent search then runs on each distinct word with just its own hits, in Arrow
batches. Of the interpretations of one form only the first of each kind that the search can tell
apart (position tags, optional or not, source) is kept, which bounds the hits of a word by its length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions import strings
from lexiforge.operators import nested_records as nested
from lexiforge.operators.affixes import with_sizes
from lexiforge.runtime import cut, written

# What a letter without a form and a segment cost.
GAP_COST, SEG_COST = 1.0, 2.0
VOWELS = frozenset("aeiou")

#: A part as the search leaves it: the form and the number of its interpretation stand for meaning and language.
FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("form", T.StringType()), T.StructField("k", T.IntegerType())])
RESULT = T.StructType([T.StructField("stage1", T.StringType()), T.StructField("parts", T.ArrayType(FOUND))])


def shown_meaning(ety: Column, ety_lang: Column, meaning: Column, lang: Column) -> Column:
    """``src, meaning, lang`` of an entry: ``dict`` with the etymology, unless that only refers elsewhere, and ``affix`` where there is none."""
    blank = F.lit("")
    told = F.coalesce(ety != "", F.lit(False))
    refers = F.lower(ety).contains("see also") | ety.contains(";;")
    own = told & ~refers
    either = F.when(ety_lang != "", ety_lang).otherwise(F.coalesce(lang, blank))
    return F.struct(
        F.when(told, "dict").otherwise("affix").alias("src"),
        F.when(own, ety).otherwise(F.coalesce(meaning, blank)).alias("meaning"),
        F.when(own, either).otherwise(F.coalesce(lang, blank)).alias("lang"),
    )


def root_forms(roots: DataFrame, affixes: DataFrame) -> DataFrame:
    """``form, base, opt, pos, meaning, lang, src, ord``: forms nested in root entries and forms of the affix list, of two letters or more; a missing meaning is ``''``."""
    links = nested.linked(cut(nested.nodes(roots.select("entry_id", "forms")).where("kind in ('form', 'pos')")))
    pos = nested.positions_table(links).groupBy("rid", F.col("form_pre").alias("pre")).agg(F.array_sort(F.collect_set("pos")).alias("pos"))
    found = nested.forms_table(links).join(pos, ["rid", "pre"], "left").select("entry_id", F.lower("form").alias("form"), (F.col("opt") == 1).alias("opt"), "pos")
    info = roots.select("entry_id", F.lower("base").alias("base"), shown_meaning(F.col("ety_meaning"), F.col("ety_lang"), F.col("meaning"), F.col("lang")).alias("m"))
    none = F.array().cast("array<string>")
    a = found.join(info, "entry_id").select("form", "base", "opt", F.coalesce("pos", none).alias("pos"), "m.meaning", "m.lang", "m.src", F.col("entry_id").alias("ord"))
    form = strings.strip_dashes(F.lower("roots"))
    kind = F.when(strings.affix_position(F.trim("roots")).isNotNull(), F.array(strings.affix_position(F.trim("roots")))).otherwise(none)
    shown = [F.coalesce(c, F.lit("")).alias(n) for c, n in (("meaning", "meaning"), ("lang_code", "lang"))]
    b = affixes.select(form.alias("form"), form.alias("base"), F.lit(False).alias("opt"), kind.alias("pos"), *shown, F.lit("affix").alias("src"), F.col("affix_id").alias("ord"))
    return a.unionByName(b).where("length(form) >= 2")


def frequent_forms(frequent: DataFrame) -> DataFrame:
    """``form, freq, merged, canonical, variants, kinds`` of the frequent affixes of two letters or more.

    ``merged`` is that of the largest group, or the own count where the group has none; ``canonical`` and ``variants`` are that group's.
    """
    n = F.coalesce("cnt", F.lit(0))
    merged = F.when(F.col("merged_count") > 0, F.col("merged_count")).otherwise(n)
    form = strings.strip_dashes(F.lower("affix"))
    rows = frequent.select(form.alias("form"), n.alias("n"), merged.alias("merged"), "affix_type", F.coalesce("canonical", form).alias("canonical"), F.coalesce("variants", F.array(form)).alias("variants")).where("length(form) >= 2")
    group = F.max_by(F.struct("canonical", "variants"), F.struct("merged", "canonical")).alias("g")
    kinds = F.array_sort(F.collect_set(F.when(F.col("affix_type") != "", F.col("affix_type")))).alias("kinds")
    return rows.groupBy("form").agg(F.max("n").alias("freq"), F.max("merged").alias("merged"), group, kinds).select("form", "freq", "merged", "g.canonical", "g.variants", "kinds")


def form_index(forms: DataFrame, frequent: DataFrame) -> DataFrame:
    """``form, interps, freq, merged, kinds``: the distinguishable interpretations of each form, the one whose base is the form first."""
    order = F.struct((F.col("form") != F.col("base")).alias("other"), "ord")
    one = forms.groupBy("form", "pos", "opt", "src").agg(F.min_by(F.struct("meaning", "lang"), order).alias("m"), F.min(order).alias("o"))
    interps = one.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("o", "pos", "opt", "src", "m.meaning", "m.lang"))).alias("interps"))
    return interps.join(frequent_forms(frequent).select("form", "freq", "merged", "kinds"), "form", "left")


def substrings(words: DataFrame, forms: DataFrame) -> DataFrame:
    """``word, start, form``: where forms of a list occur in words. Only lengths the list has are cut out."""
    known = forms.select("form").distinct()
    at = with_sizes(words.select("word"), known, "form", "sizes").where("length(word) >= 2").select("word", "sizes", F.explode(F.expr("sequence(1, length(word) - 1)")).alias("i"))
    sub = at.select("word", "i", F.explode(F.filter("sizes", lambda n: (n >= 2) & (n <= F.length("word") - F.col("i") + 1))).alias("n"))
    return sub.select("word", (F.col("i") - 1).alias("start"), F.expr("substring(word, i, n)").alias("form")).join(known, "form", "left_semi")


def hits(words: DataFrame, index: DataFrame, meanings: bool = True) -> DataFrame:
    """``word, hits``: where each known form occurs in each word. Without ``meanings`` interpretations are numbered (``k``) in their place."""
    index = index if meanings else index.withColumn("interps", F.transform("interps", lambda x, k: F.struct(x["pos"].alias("pos"), x["opt"].alias("opt"), x["src"].alias("src"), k.alias("k"))))
    found = substrings(words, index).join(index, "form").select("word", F.struct("start", "form", "interps", "freq", "merged", "kinds").alias("h"))
    got = found.groupBy("word").agg(F.collect_list("h").alias("hits"))
    return words.join(got, "word", "left")


def syllables(word: str) -> int:
    return len(re.findall("[aeiouy]+", re.sub("^y", "_", word.lower())))


def allowed(kinds: Iterable[str] | None, start: int, n: int, whole: int) -> bool:
    only = set(kinds if kinds is not None else ())
    return not (only == {"prefix"} and start + n == whole or only == {"suffix"} and start == 0)


def bonus(freq: float | None, merged: float | None, optional: bool) -> float:
    score = 0.0
    if freq is not None and freq >= 3:
        score = 0.5 + 0.25 * math.log2(freq / 3)
    elif freq is not None and merged is not None and merged >= 3:
        score = 0.25 + 0.125 * math.log2(merged / 3)
    return score - 0.5 * optional


def pieces(word: str, parts: list[str]) -> list[tuple[int, int]]:
    """The word divided at the parts found in it; overlapping parts are one piece, what lies between is one too."""
    spans: list[list[int]] = []
    for a, b in sorted((word.find(p), word.find(p) + len(p)) for p in parts if p and p in word):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    edges = sorted({0, len(word), *(x for s in spans for x in s)})
    return list(zip(edges, edges[1:]))


class Choice:
    """The best continuation from one state: its value, the parts it sets, the state it leads to."""

    __slots__ = ("value", "parts", "to", "rival")

    def __init__(self, value=(0.0, 0.0, 0, 0, 0), parts=(), to=None):
        self.value, self.parts, self.to, self.rival = value, parts, to, False


def best_path(word: str, start: int, stop: int, usable: dict[int, list[tuple]]) -> list[tuple[int, int, tuple | None]]:
    """``(from, to, interpretation)`` along the best way through ``word[start:stop]``.

    ``usable[i]`` lists ``(length, interpretation, bonus)`` of the forms that begin at ``i``, shorter ones first.
    Values compare by coverage, bonus, fewer segments, fewer two-letter edges, length of the first; of equal ones the first found stays.
    """
    plan = {(stop, after): Choice() for after in (False, True)}
    vowel = lambda i: word[i] in VOWELS

    def moves(i: int, after: bool):
        yield i + 1, False, -GAP_COST, 0.0, 0, 0, 0, ((i, i + 1, None),)
        for n, hit, extra in usable.get(i, ()):
            end = i + n
            if end > stop or n <= 2 and not (i == start or after):
                continue
            short = int(n == 2 and (i == start or end == stop))
            yield end, True, n - SEG_COST, extra, 1, short, n, ((i, end, hit),)
            if end < stop and vowel(end) and not vowel(end - 1):
                yield end + 1, True, n - SEG_COST, extra, 1, 0, n + 1, ((i, end + 1, hit),)
            if vowel(end - 1):
                for m, other, more in usable.get(end - 1, ()):
                    last = end - 1 + m
                    if last <= stop:
                        short = int(n == 2 and i == start) + int(m == 2 and last == stop)
                        yield last, True, n + m - 1 - 2 * SEG_COST, extra + more, 2, short, m, ((i, end, hit), (end - 1, last, other))
        if i + 1 < stop and not vowel(i) and vowel(i + 1):
            for m, other, more in usable.get(i + 1, ()):
                if i + 1 + m <= stop:
                    yield i + 1 + m, True, m - SEG_COST, more, 1, 0, m + 1, ((i, i + 1 + m, other),)

    for i in range(stop - 1, start - 1, -1):
        for after in (False, True):
            won, tied = None, 0
            for to, matched, cover, extra, count, short, first, parts in moves(i, after):
                rest = plan[(to, matched)].value
                value = (rest[0] + cover, rest[1] + extra, rest[2] - count, rest[3] - short, first)
                if won is None or value > won.value:
                    won, tied = Choice(value, parts, (to, matched)), int(matched)
                elif value == won.value:
                    tied += int(matched)
            won.rival = tied >= 2
            plan[(i, after)] = won

    out, state = [], (start, False)
    while state[0] < stop:
        step = plan[state]
        head = step.parts[0]
        if head[2] is not None and step.rival and head[2][2] == "affix":
            head = (head[0], head[1], (*head[2][:2], "h", *head[2][3:]))
        out += [head, *step.parts[1:]]
        state = step.to
    return out


LABEL = {"dict": "d", "affix": "a", "h": "h"}


def segment_word(word: str, stage1: list[str] | None, found: list[dict] | None) -> dict:
    """The two-stage segmentation of one lower-case word. ``k`` of a hit's interpretation is what it is known by; a part without one is unknown."""
    whole, parts = len(word), []
    if syllables(word) <= 1:
        return {"stage1": None, "parts": [{"text": word, "source": "", "form": None, "k": None}]}
    usable: dict[int, list[tuple]] = {}
    exact: dict[tuple[int, int], tuple] = {}
    for h in found or ():
        n = len(h["form"])
        for x in h["interps"]:
            pos = tuple(x["pos"]) if x["pos"] is not None else ()
            seen = (pos, x["opt"], x["src"], h["form"], x["k"])
            exact.setdefault((h["start"], n), seen)
            if allowed(pos, h["start"], n, whole) and allowed(h["kinds"], h["start"], n, whole):
                usable.setdefault(h["start"], []).append((n, seen, bonus(h["freq"], h["merged"], bool(x["opt"]))))
    for at in usable.values():
        at.sort(key=lambda u: u[0])
    for a, b in pieces(word, stage1 or []):
        text = word[a:b]
        if syllables(text) <= 1:
            path = [(a, b, exact.get((a, b - a)))]
        else:
            path = best_path(word, a, b, usable)
        fresh = True
        for s, e, hit in path:
            if hit is None and parts and not fresh and parts[-1]["k"] is None:
                parts[-1]["text"] += word[s:e]
            else:
                parts.append({"text": word[s:e], "source": LABEL[hit[2]] if hit else "", "form": hit[3] if hit else None, "k": hit[4] if hit else None})
            fresh = False
    return {"stage1": ".".join(stage1) if stage1 else None, "parts": parts}


def _segment(words: pd.Series, stage1: pd.Series, found: pd.Series) -> pd.DataFrame:
    as_list = lambda x: list(x) if x is not None else None
    out = [segment_word(w, as_list(s), as_list(h)) for w, s, h in zip(words, stage1, found)]
    return pd.DataFrame({"stage1": pd.Series([x["stage1"] for x in out], dtype=object), "parts": [x["parts"] for x in out]})


def segment(words: DataFrame, index: DataFrame, chains: DataFrame) -> DataFrame:
    """``word, stage1, parts`` of each distinct word; ``chains(word, parts)`` are its derivations.

    The search moves numbers of interpretations; meanings are joined to the few that were chosen.
    """
    udf = F.pandas_udf(_segment, RESULT)
    rows = hits(words.select("word").distinct(), index, meanings=False).join(chains.select("word", F.col("parts").alias("chain")), "word", "left")
    cuts = written(rows.select("word", udf("word", "chain", "hits").alias("r")).select("word", "r.stage1", "r.parts"))
    told = index.select("form", F.posexplode("interps").alias("k", "x")).select("form", "k", "x.meaning", "x.lang")
    each = cuts.select("word", F.posexplode("parts").alias("i", "p")).select("word", "i", "p.text", "p.source", "p.form", "p.k")
    named = each.where("k is not null").join(told, ["form", "k"]).unionByName(each.where("k is null").withColumns({"meaning": F.lit(None).cast("string"), "lang": F.lit("")}))
    part = F.struct("text", "source", "meaning", F.coalesce("lang", F.lit("")).alias("lang"))
    whole = named.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))).alias("ps")).select("word", F.transform("ps", lambda x: x["p"]).alias("parts"))
    return cuts.select("word", "stage1").join(whole, "word")


def stem_of(parts):
    """The longest part with meaning and source, the first of equal ones."""
    known = F.filter(parts, lambda p: (p["meaning"] != "") & (p["source"] != ""))
    ranked = F.transform(known, lambda p, i: F.struct((-F.length(p["text"])).alias("n"), i.alias("i"), p["text"].alias("text")))
    return F.array_min(ranked)["text"]


def greedy(word: str, found: list[dict] | None) -> list[str]:
    """Longest match from the left; forms of two letters only at the start or right after a match; unknown letters in brackets."""
    by_start: dict[int, list[str]] = {}
    for h in found or ():
        by_start.setdefault(h["start"], []).append(h["form"])
    out, i, after = [], 0, True
    while i < len(word):
        fit = [f for f in by_start.get(i, ()) if len(f) > 2 or after]
        if fit:
            out.append(max(fit, key=len))
            i, after = i + len(out[-1]), True
        else:
            if out and out[-1][0] == "[":
                out[-1] = out[-1][:-1] + word[i] + "]"
            else:
                out.append(f"[{word[i]}]")
            i, after = i + 1, False
    return out


def two_strategies(word: str, prefixes: set[str], suffixes: set[str], roots: list[str]) -> tuple[str, list[str], float]:
    """Root first against suffix first: one point an affix, two a root, less a tenth a letter left over; root first on ties."""

    def longest(text: str, options: Iterable[str], fits: Callable[[str, str], bool]) -> str:
        return max((o for o in options if fits(text, o)), key=lambda o: (len(o), o), default="")

    def around(text: str) -> list[tuple[str, str]]:
        root = longest(text, roots, lambda t, o: o in t)
        at = text.find(root) if root else 0
        before, after = (text[:at], text[at + len(root) :]) if root else (text, "")
        pre = longest(before, prefixes, str.startswith)
        suf = longest(after, suffixes, str.endswith)
        left = before[len(pre) :]
        right = after[: len(after) - len(suf)] if suf else after
        return [x for x in (("p", pre), ("", left), ("r", root), ("", right), ("s", suf)) if x[1]]

    suf = longest(word, suffixes, lambda t, o: t.endswith(o) and len(o) < len(t))
    second = around(word[: len(word) - len(suf)]) + ([("s", suf)] if suf else [])

    def score(parts: list[tuple[str, str]]) -> float:
        return sum({"p": 1.0, "s": 1.0, "r": 2.0, "": -0.1 * len(t)}[k] for k, t in parts)

    first = around(word)
    name, parts = ("root", first) if score(first) >= score(second) else ("suffix", second)
    return name, [t for _, t in parts], round(score(parts), 6)


def affix_layers(word: str, prefixes: set[str], suffixes: set[str], roots: list[str]) -> tuple[list[tuple[str, str]], float]:
    """The best way to peel prefixes and suffixes, longest first on each side, off a stem of three letters or more.

    The longest root inside the stem is set apart; stems at the edges that are affixes count as such.
    Value: 2 + 0.3 a letter for each affix and root, 5 for a stem that is known itself, -1 for a stem of
    one letter, -3 for each part beyond the known ones, -5 for an undivided word. Ties keep the fewer layers.
    """
    limit = min(len(word) // 2, 15)

    def peel(text: str, pool: set[str], front: bool) -> list[str]:
        out: list[str] = []
        while len(out) < limit:
            fit = max((a for a in pool if len(a) >= 2 and (text.startswith(a) if front else text.endswith(a))), key=lambda a: (len(a), a), default=None)
            if fit is None:
                break
            out.append(fit)
            text = text[len(fit) :] if front else text[: len(text) - len(fit)]
        return out

    known = prefixes | suffixes | set(roots)

    def value(parts: list[tuple[str, str]]) -> float:
        marked = [t for k, t in parts if k != "stem"]
        stems = [t for k, t in parts if k == "stem"]
        total = sum(2 + 0.3 * len(t) for t in marked) + sum(5.0 for t in stems if t in known) - sum(1.0 for t in stems if len(t) == 1)
        if marked:
            total -= 3.0 * (len(parts) - len(marked))
        return total - (5.0 if len(parts) == 1 and stems else 0.0)

    best, top = [("stem", word)], value([("stem", word)])
    found_any = False
    front = peel(word, prefixes, True)
    for p in range(len(front) + 1):
        mid = word[sum(map(len, front[:p])) :]
        back = peel(mid, suffixes, False)
        for s in range(len(back) + 1):
            stem = mid[: len(mid) - sum(map(len, back[:s]))]
            if len(stem) < 3:
                continue
            root = max((r for r in roots if len(r) >= 3 and r in stem), key=lambda r: (len(r), r), default=None)
            inner = [("stem", stem)]
            if root:
                at = stem.find(root)
                inner = [x for x in (("stem", stem[:at]), ("root", root), ("stem", stem[at + len(root) :])) if x[1]]
            parts = [("prefix", x) for x in front[:p]] + inner + [("suffix", x) for x in reversed(back[:s])]
            if parts[-1][0] == "stem" and len(parts[-1][1]) >= 2 and parts[-1][1] in suffixes:
                parts[-1] = ("suffix", parts[-1][1])
            if parts[0][0] == "stem" and len(parts[0][1]) >= 2 and parts[0][1] in prefixes:
                parts[0] = ("prefix", parts[0][1])
            kinds = {k for k, _ in parts}
            if not ("root" in kinds or any(k == "stem" and t not in known for k, t in parts) or {"prefix", "suffix"} <= kinds):
                continue
            if not found_any or value(parts) > top:
                best, top, found_any = parts, value(parts), True
    return best, round(top, 6)


def cut_by_scores(word: str, scores: list[float], least: float = 0.44) -> list[str]:
    """The word cut after each letter whose score reaches ``least``; what is no plain word, or one letter, stays whole."""
    if len(word) < 2 or not word.isalpha():
        return [word]
    out, at = [], 0
    for i, s in enumerate(scores[: len(word) - 1]):
        if s >= least:
            out.append(word[at : i + 1])
            at = i + 1
    return [*out, word[at:]]


def boundary_scores(deriv: DataFrame) -> DataFrame:
    """``pair, p``: how often a pair of letters has the seam of a derivation between them; at most as many rows as there are pairs of letters."""
    seam = F.when(F.col("kind") == "s", F.length("word") - F.length("affix")).otherwise(F.length("affix"))
    clean = deriv.where("word rlike '^[a-z]{2,}$'").select("word", seam.alias("seam"))
    at = clean.select("word", "seam", F.explode(F.expr("sequence(1, length(word) - 1)")).alias("i"))
    return at.groupBy(F.expr("substring(word, i, 2)").alias("pair")).agg(F.avg((F.col("i") == F.col("seam")).cast("double")).alias("p"))


def scored_cut(words: DataFrame, score: Callable[[pd.Series], pd.Series] | DataFrame, least: float = 0.44) -> DataFrame:
    """``word, parts``: words cut after each letter whose score reaches ``least``.

    ``score`` is a function from a batch of words to the scores of their letters, such as a model's, or a table
    ``pair, p`` of pairs of letters, which is joined.
    """
    cut_all = lambda ws, ss: pd.Series([cut_by_scores(w, list(s) if s is not None else [], least) for w, s in zip(ws, ss)])
    if not isinstance(score, DataFrame):

        def with_model(ws: pd.Series) -> pd.Series:
            return cut_all(ws, score(ws))

        return words.select("word", F.pandas_udf(with_model, "array<string>")("word").alias("parts"))
    at = words.where("length(word) >= 2").select("word", F.posexplode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("i", "pair"))
    seen = at.join(score, "pair", "left").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("p", F.lit(0.0)).alias("p")))).alias("s"))

    def run(ws: pd.Series, ss: pd.Series) -> pd.Series:
        return cut_all(ws, ss)

    udf = F.pandas_udf(run, "array<string>")
    return words.join(seen, "word", "left").select("word", udf("word", F.transform("s", lambda x: x["p"])).alias("parts"))
