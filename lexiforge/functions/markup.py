"""Fields of dictionary HTML, with regular expressions in the JVM."""

from __future__ import annotations

import html as html_text

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The class names and tags below are fixed values: those of the entries' markup.


def _some(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, F.trim(text))


def drop_tags(html: Column, by: str = "") -> Column:
    return F.regexp_replace(html, "<[^>]*>", by)


def ipa(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r'<span class="ipa">([^<]*)</span>', 1))


def summary(html: Column) -> Column:
    """The short gloss, else what a dictionary block holds up to its second closing tag, else ``''``."""
    short = _some(drop_tags(F.regexp_extract(html, r'<div class="coca2">([^\n]*?)</div>', 1)))
    block = _some(drop_tags(F.regexp_extract(html, r'(?s)<div class="gdc">(.*?)</div>.*?</div>', 1)))
    return F.coalesce(short, block, F.lit(""))


def _first_sense(inner: Column, delimiters: str) -> Column:
    first = F.get(F.split(drop_tags(inner), delimiters), F.lit(0))
    return _some(F.regexp_replace(first, r"[(（][^)）]*[)）]", ""))


def definition(html: Column, nested: bool = True) -> Column:
    """The first sense of the short gloss; ``nested`` allows tags inside."""
    inner = F.regexp_extract(html, r'(?s)<div class="coca2">(.*?)</div>' if nested else r'<div class="coca2">([^<]*)</div>', 1)
    return _first_sense(inner, "[,，]")


def definition_fallback(html: Column) -> Column:
    return _some(F.get(F.split(drop_tags(F.regexp_extract(html, r'(?s)<span class="dcn">(.*?)</span>', 1)), "[,，;；]"), F.lit(0)))


def verb_forms(html: Column) -> Column:
    inner = drop_tags(F.regexp_extract(html, r'(?s)<span class="frm">(.*?)</span>', 1))
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")


def noun_forms(html: Column) -> Column:
    inner = drop_tags(F.regexp_extract(html, r'(?s)<div class="lemmas">(.*?)</div>', 1), " ")
    return F.filter(F.transform(F.split(inner, r"\s+"), lambda x: F.substring_index(x, "[", 1)), lambda x: x != "")


def extract_all(html: Column) -> Column:
    return F.struct(definition(html).alias("definition"), verb_forms(html).alias("verb_forms"), noun_forms(html).alias("noun_forms"))


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html_text.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Character references read, named ones by the full list of HTML 5 and numeric ones by number; only texts with an ampersand leave the JVM."""
    return F.when(text.contains("&"), _unescaped(F.when(text.contains("&"), text))).otherwise(text)


def clean_html(html: Column) -> Column:
    """Entities read, tags and runs of blanks made one blank, trimmed."""
    return F.trim(F.regexp_replace(drop_tags(unescape(html), " "), r"[\s\x{A0}]+", " "))


def fix_resource_paths(html: Column, root: str = "/static/") -> Column:
    """Relative style sheets, images and scripts put under ``root``; quotes become double."""
    keep = rf"(?!{root}|https?:|data:)"
    text = F.regexp_replace(html, rf"(<link\b[^>]*?\bhref=)[\"']{keep}([^\"']*\.css[^\"']*)[\"']", rf'$1"{root}$2"')
    return F.regexp_replace(text, rf"(<(?:img|script)\b[^>]*?\bsrc=)[\"']{keep}([^\"']*)[\"']", rf'$1"{root}$2"')


def substitute_styles(text: Column, styles: Column) -> Column:
    """Backquoted style numbers replaced: the chunk after each is wrapped in that style's pair, a closing line end kept outside.

    ``styles`` maps the number, as a string, to ``struct<open, close>``; unknown numbers wrap in nothing.
    """
    chunks = F.split(text, r"`\d+`", -1)
    marks = F.regexp_extract_all(text, F.lit(r"`(\d+)`"), F.lit(1))

    def wrap(chunk: Column, i: Column) -> Column:
        style = F.try_element_at(styles, F.get(marks, i - 1))
        before, after = F.coalesce(style["open"], F.lit("")), F.coalesce(style["close"], F.lit(""))
        lined = F.concat(before, F.regexp_replace(chunk, r"\s+$", ""), after, F.lit("\r\n"))
        return F.when(i == 0, chunk).when(chunk.endswith("\n"), lined).otherwise(F.concat(before, chunk, after))

    return F.array_join(F.transform(chunks, wrap), "")
