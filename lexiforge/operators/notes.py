"""Cleaning of flash-card notes: the split of the head word and the words related to it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions import markup, strings

_DOTTED = re.compile(r"[A-Za-z]+(?:\.[A-Za-z]+)+")
_JOINED = re.compile(r"[A-Za-z]+(?:[.+][A-Za-z]+)+")

# Words of the notes' own language about words.
NOISE = frozenset(
    [
        "vulgar", "latin", "greek", "french", "german", "spanish", "italian", "russian", "arabic", "hebrew", "sanskrit",
        "prefix", "suffix", "synonym", "antonym", "plural", "singular", "literally", "figurative", "ultimately",
    ]
)


def split_of(note: str, word: str) -> tuple[str, str]:
    """The dotted split of the word and the text after it; ``''`` and the note if it has none.

    First a dotted token that spells the word; else the letters of the note are read on until they
    contain the word, and what stands between its letters becomes a dot.
    """
    want = word.strip().lower()
    if not want:
        return "", note
    for m in _DOTTED.finditer(note):
        if m.group().replace(".", "").lower() == want:
            return m.group(), note[note.index(m.group()) + len(m.group()) :]
    where = [i for i, c in enumerate(note) if c.isascii() and c.isalpha()]
    at = "".join(note[i] for i in where).lower().find(want)
    if at < 0:
        return "", note
    begin, end = where[at], where[at + len(want) - 1] + 1
    split = re.sub(r"[^A-Za-z]+", ".", note[begin:end])
    return (split, note[end:]) if "." in split else ("", note)


def related_words(text: str, word: str) -> list[str]:
    """Related words in order, once each: first those written in parts, then plain words of four letters or more.

    Parts of a split of three or more pieces, and of the head word's own split, are no words; neither
    are letters of a phonetic transcription, noise words and what a split already covers.
    """
    want = word.strip().lower()
    splits = [(re.split("[.+]", m.group()), m.group()) for m in _JOINED.finditer(text) if text[max(0, m.start() - 1) : m.start()] not in (".", "-")]
    letters = ["".join(pieces).lower() for pieces, _ in splits]
    shown = {x.replace("+", "."): w for (_, x), w in zip(splits, letters) if w != want and len(w) >= 4}
    parts = {p.lower() for (pieces, _), w in zip(splits, letters) if w == want or len(pieces) > 2 for p in pieces}
    loose: dict[str, str] = {}
    for x in re.findall(r"[A-Za-z]{4,}", re.sub(r"\[[^\]]*\]", "", text)):
        loose.setdefault(x.lower(), x)
    for known in ({want}, parts, NOISE, shown.values()):
        for w in known:
            loose.pop(w, None)
    return [*shown, *loose.values()]


RESULT = T.StructType([T.StructField("segmentation", T.StringType()), T.StructField("related", T.ArrayType(T.StringType()))])


def _clean(words: pd.Series, notes: pd.Series) -> pd.DataFrame:
    splits, related = [], []
    for w, n in zip(words, notes):
        split, rest = split_of(n or "", w or "")
        found = related_words(n or "", w or "") + related_words(rest, w or "")  # the whole note first, then what follows the split
        splits.append(split)
        related.append(list(dict.fromkeys(found)))
    return pd.DataFrame({"segmentation": splits, "related": related})


def read_notes(df: DataFrame, fields: str = "flds") -> DataFrame:
    """``id, word, note`` of notes whose fields are packed with unit separators; rows of fewer than four are skipped."""
    parts = F.split(F.col(fields), "\x1f")
    return df.select("id", parts.alias("p")).where(F.size("p") >= 4).select("id", F.col("p")[0].alias("word"), F.col("p")[3].alias("note"))


def clean_notes(notes: DataFrame) -> DataFrame:
    """``id, word, segmentation, related`` of each note: markup read, ideographs made dots, then the two extractions."""
    text = strings.collapse_han(markup.clean_html(F.col("note")))
    udf = F.pandas_udf(_clean, RESULT)
    rows = notes.select("id", F.trim(markup.clean_html(F.col("word"))).alias("word"), text.alias("text"))
    return rows.select("id", "word", udf("word", "text").alias("r")).select("id", "word", "r.segmentation", "r.related")


def report(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(
        F.count("*").alias("notes"), F.count_if(F.col("segmentation") != "").alias("with_split"),
        F.count_if(F.size("related") > 0).alias("with_related"), F.sum(F.size("related")).alias("related_words"),
    )
