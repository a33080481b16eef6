"""Scalar functions over strings, markup and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import markup, patterns, strings
from lexiforge.operators import lexicon
from lexiforge.plans import sql
from lexiforge.runtime import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return put


@query("syllables", f"WITH {sql.COUNTS} SELECT word, len(regexp_extract_all(regexp_replace(word, '^y', '_'), '[aeiouy]+'))::INT AS n FROM lexc")
def syllables(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.word_counts(spark, d).select("word", strings.count_syllables(F.col("word")).alias("n"))


@query(
    "secondary_scores",
    "SELECT anki_id, (CASE WHEN cnt >= 3 THEN 0.5 + 0.25 * log2(cnt / 3) WHEN cnt IS NOT NULL AND merged_count >= 3 THEN 0.25 + 0.125 * log2(merged_count / 3) ELSE 0.0 END "
    "- CASE WHEN affix_type = 'suffix' THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM anki_highfreq",
)
def secondary_scores(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "anki_highfreq", "anki_id", "affix_type", "cnt", "merged_count")
    return t.select("anki_id", strings.secondary_score(F.col("cnt"), F.col("merged_count"), F.col("affix_type") == "suffix").alias("score"))


@query(
    "positions_allowed",
    f"WITH {sql.DERIV} SELECT ord, CASE WHEN kind = 'p' THEN NOT ends_with(word, affix) ELSE NOT starts_with(word, affix) END AS ok FROM deriv",
)
def positions_allowed(spark: SparkSession, d: str) -> DataFrame:
    t = lexicon.derivations(spark, d)
    kinds = F.array(F.when(F.col("kind") == "p", "prefix").otherwise("suffix"))
    n, w = F.length("affix"), F.length("word")
    starts, ends = F.col("word").startswith(F.col("affix")), F.col("word").endswith(F.col("affix"))
    at_end = strings.position_allowed(kinds, w - n, n, w)
    at_start = strings.position_allowed(kinds, F.lit(0), n, w)
    return t.select("ord", F.when(F.col("kind") == "p", F.when(ends, at_end).otherwise(True)).otherwise(F.when(starts, at_start).otherwise(True)).alias("ok"))


@query(
    "stem_highlights",
    "SELECT doc_id, CASE WHEN i > 0 AND length(headword) > 0 THEN substr(t, 1, i - 1) || '<span class=\"stem\">' || substr(t, i, length(headword)) || '</span>' || substr(t, i + length(headword)) ELSE t END AS shown "
    "FROM (SELECT doc_id, headword, text AS t, instr(lower(text), lower(headword)) AS i FROM documents WHERE headword IS NOT NULL AND text IS NOT NULL AND length(text) = length(lower(text)))",
)
def stem_highlights(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents", "doc_id", "text", "headword").where("length(text) = length(lower(text)) and headword is not null")
    return t.select("doc_id", strings.stem_highlight(F.col("text"), F.col("headword")).alias("shown"))


def _run_sql(runs: list[str]) -> str:
    """The same chain of cuts, unrolled."""
    steps, prev = [], "r0 AS (SELECT word, '' AS done, word AS rest, TRUE AS ok FROM lexc)"
    steps.append(prev)
    for i, run in enumerate(runs, 1):
        at = f"instr(lower(rest), '{run}')"
        steps.append(
            f"r{i} AS (SELECT word, done || substr(rest, 1, greatest(0, {at} - 1)) || '<span class=\"hit\">' || substr(rest, {at}, {len(run)}) || '</span>' AS done, "
            f"substr(rest, {at} + {len(run)}) AS rest, ok AND {at} > 0 AS ok FROM r{i - 1})"
        )
    return f"WITH {sql.COUNTS}, {', '.join(steps)} SELECT word, CASE WHEN ok THEN done || rest ELSE word END AS shown FROM r{len(runs)}"


@query("pattern_highlights", _run_sql(["r", "el"]))
def pattern_highlights(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.word_counts(spark, d).select("word", strings.run_highlight(F.col("word"), patterns.literal_runs("*r*el[A]*")).alias("shown"))


_ENTRIES = "FROM documents WHERE starts_with(text, '<div class=\"gdc\">')"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").where(F.col("text").startswith('<div class="gdc">'))


@query("entry_ipa", f"SELECT doc_id, trim(regexp_extract(text, '<span class=\"ipa\">([^<]*)</span>', 1)) AS ipa {_ENTRIES}")
def entry_ipa(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("doc_id", markup.ipa(F.col("text")).alias("ipa"))


@query(
    "entry_summary",
    "SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_extract(text, '<div class=\"coca2\">([^\\n]*?)</div>', 1), '<[^>]*>', '', 'g')), ''), "
    f"nullif(trim(regexp_replace(regexp_extract(text, '(?s)<div class=\"gdc\">(.*?)</div>.*?</div>', 1), '<[^>]*>', '', 'g')), ''), '') AS summary {_ENTRIES}",
)
def entry_summary(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("doc_id", markup.summary(F.col("text")).alias("summary"))


def _sense(inner: str, delimiters: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_split_to_array(regexp_replace({inner}, '<[^>]*>', '', 'g'), '{delimiters}')[1], '[(（][^)）]*[)）]', '', 'g')), '')"


@query("entry_definition", f"""SELECT doc_id, {_sense("regexp_extract(text, '(?s)<div class=\"coca2\">(.*?)</div>', 1)", '[,，]')} AS definition {_ENTRIES}""")
def entry_definition(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("doc_id", markup.definition(F.col("text")).alias("definition"))


@query("entry_definition_flat", f"""SELECT doc_id, {_sense("regexp_extract(text, '<div class=\"coca2\">([^<]*)</div>', 1)", '[,，]')} AS definition {_ENTRIES}""")
def entry_definition_flat(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("doc_id", markup.definition(F.col("text"), nested=False).alias("definition"))


_FALLBACK = "nullif(trim(regexp_split_to_array(regexp_replace(regexp_extract(text, '(?s)<span class=\"dcn\">(.*?)</span>', 1), '<[^>]*>', '', 'g'), '[,，;；]')[1]), '')"


@query("entry_fallback", f"SELECT doc_id, {_FALLBACK} AS definition {_ENTRIES}")
def entry_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("doc_id", markup.definition_fallback(F.col("text")).alias("definition"))


_VERBS = "list_filter(list_transform(string_split(regexp_replace(regexp_extract(text, '(?s)<span class=\"frm\">(.*?)</span>', 1), '<[^>]*>', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')"
_NOUNS = (
    "list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_extract(html, '(?s)<div class=\"lemmas\">(.*?)</div>', 1), '<[^>]*>', ' ', 'g'), '\\s+'), lambda x: string_split(x, '[')[1]), lambda x: x <> '')"
)
_WITH_LEMMAS = f"SELECT doc_id, '<div class=\"lemmas\">' || lower(headword) || '[n] <b>' || lower(headword) || 's[pl]</b></div>' || text AS html {_ENTRIES} AND headword IS NOT NULL"


@query("entry_verb_forms", f"SELECT doc_id, {_VERBS} AS forms {_ENTRIES}")
def entry_verb_forms(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("doc_id", markup.verb_forms(F.col("text")).alias("forms"))


@query("entry_noun_forms", f"SELECT doc_id, {_NOUNS} AS forms FROM ({_WITH_LEMMAS})")
def entry_noun_forms(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents", "doc_id", "text", "headword").where(F.col("text").startswith('<div class="gdc">') & F.col("headword").isNotNull())
    w = F.lower("headword")
    html = F.concat(F.lit('<div class="lemmas">'), w, F.lit("[n] <b>"), w, F.lit("s[pl]</b></div>"), "text")
    return t.select("doc_id", markup.noun_forms(html).alias("forms"))


@query(
    "entry_fields",
    f"""SELECT doc_id, {_sense("regexp_extract(text, '(?s)<div class=\"coca2\">(.*?)</div>', 1)", '[,，]')} AS definition, len({_VERBS})::INT AS n_verb_forms, 0 AS n_noun_forms {_ENTRIES}""",
)
def entry_fields(spark: SparkSession, d: str) -> DataFrame:
    t = _entries(spark, d).select("doc_id", markup.extract_all(F.col("text")).alias("e"))
    return t.select("doc_id", "e.definition", F.size("e.verb_forms").alias("n_verb_forms"), F.size("e.noun_forms").alias("n_noun_forms"))


#: The entities that the texts of ``plain_entries`` are given, on the SQL side one by one.
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&quot;": '"', "&#39;": "'", "&#x2014;": "—", "&eacute;": "é", "&mdash;": "—", "&#233;": "é", "&hearts;": "♥"}


def _entities_sql(x: str) -> str:
    for name, char in _ENTITIES.items():
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


@query("plain_entries", f"SELECT doc_id, trim(regexp_replace(regexp_replace({_entities_sql(f"text || '{''.join(_ENTITIES)}'")}, '<[^>]*>', ' ', 'g'), '[\\s\\x{{A0}}]+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL")
def plain_entries(spark: SparkSession, d: str) -> DataFrame:
    """The texts, with some entities put after each."""
    t = load(spark, d, "documents", "doc_id", "text").where("text is not null")
    return t.select("doc_id", markup.clean_html(F.concat("text", F.lit("".join(_ENTITIES)))).alias("plain"))


@query("collapsed_han", "SELECT doc_id, regexp_replace(text, '[\\x{4E00}-\\x{9FFF}]+', '.', 'g') AS text FROM documents WHERE text IS NOT NULL")
def collapsed_han(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", strings.collapse_han(F.col("text")).alias("text"))


@query("without_phonetics", "SELECT doc_id, translate(regexp_replace(text, '\\[[^\\]]*\\]', '', 'g'), '.+', '') AS text FROM documents WHERE text IS NOT NULL")
def without_phonetics(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents", "doc_id", "text").where("text is not null")
    return t.select("doc_id", strings.strip_separators(strings.strip_phonetic(F.col("text"))).alias("text"))


@query("affix_positions", "SELECT affix_id, CASE WHEN roots LIKE '-%' AND roots LIKE '%-' THEN 'root' WHEN roots LIKE '-%' THEN 'suffix' WHEN roots LIKE '%-' THEN 'prefix' END AS pos, trim(trim(roots, '-')) AS form FROM affixes")
def affix_positions(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "affixes", "affix_id", "roots")
    return t.select("affix_id", strings.affix_position(F.col("roots")).alias("pos"), strings.strip_dashes(F.col("roots")).alias("form"))


_GOOD_ETY = "ety_meaning <> '' AND NOT contains(lower(ety_meaning), 'see also') AND NOT contains(ety_meaning, ';;')"


@query(
    "chosen_meanings",
    f"SELECT entry_id, coalesce(CASE WHEN {_GOOD_ETY} THEN ety_meaning END, CASE WHEN meaning <> '' THEN meaning END, CASE WHEN ety_meaning <> '' THEN ety_meaning END) AS meaning FROM roots",
)
def chosen_meanings(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "roots", "entry_id", "meaning", "ety_meaning")
    return t.select("entry_id", strings.chosen_meaning(F.col("ety_meaning"), F.col("meaning")).alias("meaning"))


@query(
    "joined_langs",
    "SELECT lower(base) AS base, coalesce(nullif(array_to_string(list_sort(list(DISTINCT lang) FILTER (WHERE lang NOT IN ('', '?'))), '; '), ''), CASE WHEN bool_or(lang = '?') THEN '?' ELSE '' END) AS langs "
    "FROM roots WHERE base IS NOT NULL GROUP BY 1",
)
def joined_langs(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "roots", "base", "lang").where("base is not null")
    return t.groupBy(F.lower("base").alias("base")).agg(strings.join_langs(F.collect_set("lang")).alias("langs"))


_EN = "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda t: length(t) > 1 AND t NOT IN (" + ", ".join(f"'{w}'" for w in strings.EN_STOP) + "))"
_CN = "list_filter(regexp_split_to_array({0}, '[；;，,。、/·.…\\s\\d()（）_\\-]+'), lambda t: regexp_matches(t, '[\\x{{4E00}}-\\x{{9FFF}}]'))"


@query(
    "gloss_tokens",
    f"SELECT group_id, CASE WHEN regexp_matches(gloss, '[\\x{{4E00}}-\\x{{9FFF}}]') THEN {_CN.format('gloss')} ELSE {_EN.format('gloss')} END AS tokens FROM allomorph_groups WHERE gloss IS NOT NULL",
)
def gloss_tokens(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("gloss")
    t = load(spark, d, "allomorph_groups", "group_id", "gloss").where("gloss is not null")
    return t.select("group_id", F.when(g.rlike(strings.HAN), strings.cn_tokens(g)).otherwise(strings.en_tokens(g)).alias("tokens"))


@query(
    "line_overlaps",
    f"WITH t AS (SELECT entry_id, list_distinct({_EN.format('meaning')}) AS a, list_distinct({_EN.format('ety_meaning')}) AS b FROM roots WHERE NOT regexp_matches(meaning || ety_meaning, '[\\x{{4E00}}-\\x{{9FFF}}]')) "
    "SELECT entry_id, CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) END AS overlap FROM t",
)
def line_overlaps(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "roots", "entry_id", "meaning", "ety_meaning").where(~F.concat("meaning", "ety_meaning").rlike(strings.HAN))
    return t.select("entry_id", strings.line_overlap(strings.line_tokens(F.col("meaning")), strings.line_tokens(F.col("ety_meaning"))).alias("overlap"))


@query("derivations_fit", f"WITH {sql.DERIV} SELECT ord, (CASE WHEN kind = 's' THEN ends_with(word, affix) ELSE starts_with(word, affix) END) AND abs(length(word) - length(affix) - length(base)) <= 2 AS ok FROM deriv")
def derivations_fit(spark: SparkSession, d: str) -> DataFrame:
    t = lexicon.derivations(spark, d)
    return t.select("ord", strings.derivation_fits(F.col("word"), F.col("base"), F.col("affix"), F.col("kind")).alias("ok"))


@query(
    "one_letter_apart",
    "WITH f AS (SELECT lower(trim(trim(canonical, '-'))) AS base, unnest(list_transform(variants, lambda v: lower(trim(trim(v, '-'))))) AS word FROM allomorph_groups), p AS (SELECT DISTINCT word, base, length(word) > length(base) AS w FROM f WHERE abs(length(word) - length(base)) = 1), q AS (SELECT word, base, CASE WHEN w THEN word ELSE base END AS longer, CASE WHEN w THEN base ELSE word END AS shorter FROM p), "
    "k AS (SELECT *, unnest(generate_series(0, length(shorter))) AS i FROM q) SELECT word, base, longer, max(i)::INT AS place, substr(longer, max(i)::INT + 1, 1) AS letter FROM k "
    "WHERE substr(longer, 1, i) = substr(shorter, 1, i) AND substr(longer, i + 2) = substr(shorter, i + 1) GROUP BY word, base, longer",
)
def one_letter_apart(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda x: F.lower(strings.strip_dashes(x))
    t = load(spark, d, "allomorph_groups", "canonical", "variants").select(clean(F.col("canonical")).alias("base"), F.explode("variants").alias("v"))
    t = t.select("base", clean(F.col("v")).alias("word")).distinct()
    return t.select("word", "base", strings.inserted(F.col("word"), F.col("base")).alias("x")).where("x is not null").select("word", "base", "x.*")


@query(
    "short_words",
    f"WITH {sql.COUNTS} SELECT word FROM lexc WHERE length(word) BETWEEN 3 AND 5 ORDER BY word",
)
def short_words(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.word_counts(spark, d).where(F.length("word").between(3, 5)).select("word").orderBy("word")


@query(
    "parsed_segments",
    "WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), "
    "parts AS (SELECT trim(regexp_extract(line, '^(\\w+) = ([\\w.]+) \\[', 1)) AS word, regexp_extract(line, '^(\\w+) = ([\\w.]+) \\[', 2) AS split FROM lines) "
    "SELECT DISTINCT word, string_split(split, '.') AS segments FROM parts WHERE word <> ''",
)
def parsed_segments(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents", "text").select(F.explode(F.split("text", "\n")).alias("line"))
    at = r"^(\w+) = ([\w.]+) \["
    parts = lines.select(F.regexp_extract("line", at, 1).alias("word"), F.regexp_extract("line", at, 2).alias("split")).where("word != ''")
    return parts.select("word", strings.parse_segments(F.col("split")).alias("segments")).distinct()


@query(
    "formatted_parts",
    "WITH r AS (SELECT DISTINCT lower(base) AS base FROM roots WHERE base IS NOT NULL), p AS (SELECT group_id, list_filter(variants, lambda v: v IS NOT NULL) AS vs FROM allomorph_groups), "
    "x AS (SELECT group_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS i FROM p) "
    "SELECT group_id, string_agg(CASE WHEN base IS NOT NULL THEN v ELSE '[' || v || ']' END, '.' ORDER BY i) AS shown FROM x LEFT JOIN r ON r.base = lower(v) GROUP BY group_id",
)
def formatted_parts(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "roots", "base").where("base is not null").select(F.lower("base").alias("k"), F.lower("base").alias("meaning")).distinct()
    v = load(spark, d, "allomorph_groups", "group_id", "variants").select("group_id", F.posexplode("variants").alias("i", "v")).where("v is not null")
    part = F.struct("i", F.struct(F.col("v").alias("text"), F.lit("").alias("source"), "meaning").alias("p"))
    joined = v.join(known, F.lower("v") == F.col("k"), "left").groupBy("group_id").agg(F.array_sort(F.collect_list(part)).alias("ps"))
    return joined.select("group_id", strings.format_parts(F.transform("ps", lambda x: x["p"])).alias("shown"))


@query("resource_paths", f"""SELECT doc_id, '<link rel=''stylesheet'' href="/static/x.css"><img src="/static/p/' || lower(headword) || '.png"><script src=''/static/a.js''></script>' || text AS html {_ENTRIES}""")
def resource_paths(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit("<link rel='stylesheet' href='x.css'><img src=\"p/"), F.lower("headword"), F.lit(".png\"><script src='/static/a.js'></script>"), "text")
    t = load(spark, d, "documents", "doc_id", "headword", "text").where(F.col("text").startswith('<div class="gdc">'))
    return t.select("doc_id", markup.fix_resource_paths(html).alias("html"))


@query(
    "styled_text",
    "SELECT entry_id, '<b>' || rtrim(base, ' ' || chr(9) || chr(10) || chr(13)) || '</b>' || chr(13) || chr(10) || '<i>' || CASE WHEN ends_with(meaning, chr(10)) THEN regexp_replace(meaning, '\\s+$', '') || '</i>' || chr(13) || chr(10) ELSE meaning || '</i>' END AS text "
    "FROM roots WHERE base IS NOT NULL AND meaning IS NOT NULL",
)
def styled_text(spark: SparkSession, d: str) -> DataFrame:
    styles = F.create_map(F.lit("1"), F.struct(F.lit("<b>").alias("open"), F.lit("</b>").alias("close")), F.lit("2"), F.struct(F.lit("<i>").alias("open"), F.lit("</i>").alias("close")))
    t = load(spark, d, "roots", "entry_id", "base", "meaning").dropna()
    return t.select("entry_id", markup.substitute_styles(F.concat(F.lit("`1`"), "base", F.lit("\n`2`"), "meaning"), styles).alias("text"))
