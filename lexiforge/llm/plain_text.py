"""Text that looks the same brought to one plain form.

Normalization quick checks isolate the unstable stretches of a text: characters whose compatibility
composition differs (``NFKC_QC=No``), that may combine with what stands before (``Maybe`` or a
combining class), that are invisible or blank, or that are letters borrowed from another script.
Only those stretches, with the one character before them as boundary context, are normalized; the
results are spliced into the otherwise untouched text. Pure printable ASCII never leaves the JVM.

Plain form: composed letters; half-width letters, digits and punctuation and ordinary characters in
place of variants; each blank an ordinary space (tab and line feed stay); nothing invisible; within
a word, letters borrowed from another script put back to Latin. A word keeps its own script if it
has a letter there without a Latin look-alike, or is made of look-alikes only but stands between
words of that script. Case, quotation marks, ideographic commas, bullets and runs of spaces stay.

Defined results: null stays null, ``''`` stays ``''``, a text of invisible characters only gives ``''``;
the form of a text does not depend on its row, and is stable (the plain form of a plain form is itself).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter (a choice from Unicode's confusables).
CYRILLIC = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l"}
CYRILLIC |= {"А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y"}
CYRILLIC |= {"Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I"}
GREEK = {"ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "υ": "u", "ϳ": "j", "ϲ": "c"}
GREEK |= {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n"}
COPTIC = {"Ⲃ": "B", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "Ꮒ": "h", "Ꮟ": "b"}
PHONETIC = {"ɡ": "g", "ɑ": "a", "ı": "i"}
LOOK_ALIKES = CYRILLIC | GREEK | ARMENIAN | COPTIC | CHEROKEE | PHONETIC
SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "COPTIC", "CHEROKEE")

# Characters that show nothing, or a blank, though their category does not say so.
HIDDEN = {chr(c) for c in [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]}
BLANKS = {chr(c) for c in [0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x2800]}


@lru_cache(None)
def _classes() -> tuple[str, str]:
    """Character classes, from the properties of each code point: what may need work, and what goes together as one stretch."""
    second = set()  # characters that compose with the one before: quick check Maybe
    for c in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
            second.add(int(d.split()[1], 16))
    second |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    unstable = []
    for c in range(128, sys.maxunicode + 1):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        kind = unicodedata.category(ch)
        if kind in ("Cf", "Zs", "Zl", "Zp", "Cc") or ch in HIDDEN or ch in BLANKS or c in second or unicodedata.combining(ch):
            unstable.append(c)
        elif not unicodedata.is_normalized("NFKC", ch) and not unicodedata.normalize("NFKC", ch).startswith(" "):
            unstable.append(c)
    unstable += [ord(b) for b in BLANKS if ord(b) < 128] + [c for c in (*range(0, 9), *range(14, 28), 127)]
    ranges: list[list[int]] = []
    for c in sorted(set(unstable)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    body = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return body, "".join(map(re.escape, LOOK_ALIKES))


@lru_cache(None)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    unstable, borrowed = _classes()
    stretch = re.compile(f"[^{unstable}]?[{unstable}]+", re.S)
    return stretch, re.compile(f"[{borrowed}]"), re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")


def _settle(m: re.Match) -> str:
    """One stretch, with its boundary character, in normal form."""
    kept = []
    for ch in m.group():
        if ch in "\t\n":
            kept.append(ch)
        elif ch in BLANKS or unicodedata.category(ch) in ("Zs", "Zl", "Zp"):
            kept.append(" ")
        elif ch not in HIDDEN and unicodedata.category(ch) not in ("Cf", "Cc"):
            kept.append(ch)
    return unicodedata.normalize("NFKC", "".join(kept))


@lru_cache(1 << 16)
def _script(letter: str) -> str:
    return unicodedata.name(letter, "").split(" ", 1)[0]


def _letters(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _kind(word: str) -> str:
    """latin, foreign, mixed (to be put back), alike (look-alikes only) or none."""
    letters = _letters(word)
    own = {_script(c) for c in letters if c not in LOOK_ALIKES}
    if any(c in LOOK_ALIKES for c in letters):
        return "mixed" if "LATIN" in own else "foreign" if own & set(SCRIPTS) else "alike"
    return "latin" if "LATIN" in own else "foreign" if own & set(SCRIPTS) else "none"


def _put_back(word: str) -> str:
    back = "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", word))
    return unicodedata.normalize("NFC", back)


def _unborrow(text: str, words: re.Pattern) -> str:
    found = list(words.finditer(text))
    kinds = [_kind(m.group()) for m in found]
    out, at = [], 0
    for i, (m, kind) in enumerate(zip(found, kinds)):
        beside = {*kinds[max(0, i - 1) : i], *kinds[i + 1 : i + 2]}
        if kind == "mixed" or kind == "alike" and not ("foreign" in beside and not beside & {"latin", "mixed"}):
            out += [text[at : m.start()], _put_back(m.group())]
            at = m.end()
    return "".join(out) + text[at:] if at else text


def plain(text: str | None) -> str | None:
    """The plain form of one text."""
    if not text:
        return text
    stretch, borrowed, words = _patterns()
    text = stretch.sub(_settle, text)
    if borrowed.search(text) or not text.isascii() and borrowed.search(unicodedata.normalize("NFD", text)):
        text = _unborrow(text, words)
    return text


@F.pandas_udf(T.StringType())
def plain_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([plain(t) for t in texts], dtype=object)


def may_change(text: Column) -> Column:
    """The quick check of the JVM: false for null and for printable ASCII, which is stable."""
    return F.coalesce(text.rlike(r"[^\t\n\x20-\x7e]"), F.lit(False))


def plain_column(df: DataFrame, text_col: str, out_col: str = "plain") -> DataFrame:
    """``df`` with the plain form of a column; rows that pass the quick check do not go through Python's loop."""
    unsure = F.when(may_change(F.col(text_col)), F.col(text_col))
    return df.withColumn(out_col, F.when(may_change(F.col(text_col)), plain_udf(unsure)).otherwise(F.col(text_col)))


def changed(df: DataFrame, tbl: str, id_col: str, text_col: str) -> DataFrame:
    """``tbl, row_id, plain`` of the rows whose text differs from its plain form. Only suspect rows reach Python, each once."""
    rows = df.select(F.lit(tbl).alias("tbl"), F.col(id_col).alias("row_id"), F.col(text_col).alias("_text"))
    # a generated column is a value, so the filter after it does not run the function again
    rows = rows.where(may_change(F.col("_text"))).select("tbl", "row_id", "_text", F.explode(F.array(plain_udf("_text"))).alias("plain"))
    return rows.where(F.col("plain") != F.col("_text")).select("tbl", "row_id", "plain")
