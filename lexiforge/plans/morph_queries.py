"""Affix analysis, derivation chains and segmentation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import strings
from lexiforge.operators import affixes, lexicon, notes, segment, wordforms
from lexiforge.plans import core_queries, sql
from lexiforge.runtime import load, once

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return put


_KNOWN = "known AS (SELECT DISTINCT lower(base) AS word FROM roots WHERE base IS NOT NULL UNION SELECT DISTINCT word FROM deriv)"


def _words(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.word_counts(spark, d).select("word")


def _known(spark: SparkSession, d: str) -> DataFrame:
    roots = load(spark, d, "roots", "base").where("base is not null").select(F.lower("base").alias("word"))
    return roots.unionByName(lexicon.derivations(spark, d).select("word")).distinct()


def _affixes(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.affix_list(lexicon.derivations(spark, d))


_BASE = f"{sql.COUNTS}, {sql.AFFIXES}, {_KNOWN}, w AS (SELECT word FROM lexc)"
_PRE = "SELECT w.word, affix AS pre, substr(w.word, length(affix) + 1) AS rest FROM {0} w JOIN aff ON kind = 'p' AND starts_with(w.word, affix) AND length(w.word) - length(affix) >= {1}"
_SUF = "SELECT w.word, substr(w.word, 1, length(w.word) - length(affix)) AS rest, affix AS suf FROM {0} w JOIN aff ON kind = 's' AND ends_with(w.word, affix) AND length(w.word) - length(affix) >= {1}"


@query("prefix_splits", f"WITH {_BASE} {_PRE.format('w', 2)}")
def prefix_splits(spark: SparkSession, d: str) -> DataFrame:
    return affixes.prefix_splits(_words(spark, d), _affixes(spark, d))


@query("suffix_splits", f"WITH {_BASE} {_SUF.format('w', 2)}")
def suffix_splits(spark: SparkSession, d: str) -> DataFrame:
    return affixes.suffix_splits(_words(spark, d), _affixes(spark, d))


@query(
    "stripped_affixes",
    f"WITH {_BASE}, p AS (SELECT word, arg_max(pre, length(pre)) AS prefix, arg_max(rest, length(pre)) AS rest FROM ({_PRE.format('w', 2)}) WHERE rest IN (SELECT word FROM known) GROUP BY word), "
    "m AS (SELECT w.word, prefix, coalesce(rest, w.word) AS mid FROM w LEFT JOIN p USING (word)), mm AS (SELECT DISTINCT mid AS word FROM m), "
    f"s AS (SELECT word AS mid, arg_max(suf, length(suf)) AS suffix, arg_max(rest, length(suf)) AS stem FROM ({_SUF.format('mm', 2)}) WHERE rest IN (SELECT word FROM known) AND (length(suf) > 1 OR word NOT IN (SELECT word FROM known)) GROUP BY word) "
    "SELECT word, prefix, coalesce(stem, mid) AS stem, suffix FROM m LEFT JOIN s USING (mid)",
)
def stripped_affixes(spark: SparkSession, d: str) -> DataFrame:
    return affixes.strip_affixes(_words(spark, d), _affixes(spark, d), _known(spark, d))


_RULES = (
    f"pre AS ({_PRE.format('w', 3)}), suf AS ({_SUF.format('w', 3)}), outr AS (SELECT word, pre AS prefix, rest FROM pre WHERE length(rest) >= 5), ow AS (SELECT DISTINCT rest AS word FROM outr), "
    f"inr AS (SELECT word AS rest, rest AS stem, suf AS suffix FROM ({_SUF.format('ow', 3)})), "
    "c AS (SELECT word, pre AS prefix, rest AS stem, NULL AS suffix FROM pre UNION ALL SELECT word, NULL, rest, suf FROM suf UNION ALL SELECT word, prefix, stem, suffix FROM outr JOIN inr USING (rest)), "
    "t1 AS (SELECT word, prefix, stem, suffix, 2.0::DOUBLE * (coalesce(length(prefix), 0) + coalesce(length(suffix), 0)) + CASE WHEN prefix IS NOT NULL AND suffix IS NOT NULL THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END * length(stem) AS score, 1 AS tier FROM c WHERE stem IN (SELECT word FROM known)), "
    f"t2 AS (SELECT word, NULL AS prefix, rest AS stem, suf AS suffix, 1.5::DOUBLE * length(suf) AS score, 2 AS tier FROM ({_SUF.format('w', 4)}) WHERE length(suf) >= 3 AND length(suf) <= length(rest))"
)


@query("rule_candidates", f"WITH {_BASE}, {_RULES} SELECT * FROM t1 UNION ALL SELECT * FROM t2")
def rule_candidates(spark: SparkSession, d: str) -> DataFrame:
    w, a = _words(spark, d), _affixes(spark, d)
    return affixes.rule_candidates(w, a, _known(spark, d)).unionByName(affixes.weak_candidates(w, a))


@query(
    "rule_analysis",
    f"WITH {_BASE}, {_RULES} SELECT word, prefix, stem, suffix, score, tier FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tier, score DESC, coalesce(prefix, '') DESC, coalesce(suffix, '') DESC) AS n FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)) WHERE n = 1",
)
def rule_analysis(spark: SparkSession, d: str) -> DataFrame:
    return affixes.rule_analysis(_words(spark, d), _affixes(spark, d), _known(spark, d))


@query(
    "one_hop",
    f"WITH {_BASE}, x AS (SELECT word, rest AS base, suf AS affix, 's' AS kind FROM ({_SUF.format('w', 3)}) UNION ALL SELECT word, rest, pre, 'p' FROM ({_PRE.format('w', 3)})) "
    "SELECT word, base, affix, kind FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY kind DESC, length(affix) DESC) AS n FROM x WHERE base IN (SELECT word FROM known)) WHERE n = 1",
)
def one_hop(spark: SparkSession, d: str) -> DataFrame:
    return affixes.one_hop(_words(spark, d), _affixes(spark, d), _known(spark, d))


_ENDS = " UNION ALL ".join(f"SELECT '{e}'" for e in [*affixes.COMMON_ENDINGS, ""])
_VARIANTS = (
    "ei AS (SELECT list_transform(string_split(roots, ','), lambda x: trim(x)) AS x FROM etym_dictionary WHERE roots <> ''), eb AS (SELECT regexp_replace(x[1], '^[=-]', '') AS base, unnest(list_filter(x[2:], lambda p: p <> '')) AS p FROM ei), "
    "ev AS (SELECT CASE WHEN p LIKE '=%' OR p LIKE '-%' THEN base || substr(p, 2) ELSE p END AS v FROM eb UNION ALL SELECT regexp_replace(x[1], '^[=-]', '') FROM ei), "
    "r AS (SELECT DISTINCT lower(ltrim(v, '-=')) AS root FROM ev WHERE length(ltrim(v, '-=')) >= 2)"
)
_ETYM = (
    _VARIANTS + ", sfx AS (SELECT DISTINCT affix AS suffix FROM aff WHERE kind = 's' UNION "
    + _ENDS
    + "), pfx AS (SELECT DISTINCT affix AS prefix FROM aff WHERE kind = 'p'), "
    # every place where a root stands in a word, by containment
    "occ AS (SELECT word, root, unnest(list_filter(generate_series(0, length(word) - length(root)), lambda i: substr(word, i + 1, length(root)) = root)) AS i FROM w JOIN r ON contains(word, root)), "
    "cutup AS (SELECT word, substr(word, 1, i) AS prefix, root, substr(word, i + length(root) + 1) AS suffix, i FROM occ), "
    "fit AS (SELECT * FROM cutup WHERE (prefix = '' OR prefix IN (SELECT prefix FROM pfx) AND length(word) - length(prefix) >= 2) AND suffix IN (SELECT suffix FROM sfx)), "
    "one AS (SELECT word, prefix, root, '' AS root2, suffix, 2.0::DOUBLE * length(prefix) + 3 * length(root) + 2 * length(suffix) + 10 AS score, 1 AS tier FROM fit WHERE suffix <> '' OR length(prefix) >= 2), "
    "two AS (SELECT a.word, '' AS prefix, a.root, b.root AS root2, b.suffix, 2.0::DOUBLE * length(a.root) + 3 * length(b.root) + 2 * length(b.suffix) + 15 AS score, 1 AS tier FROM cutup a JOIN cutup b ON a.word = b.word AND a.i = 0 AND b.i = length(a.root) "
    "WHERE length(a.root) >= 3 AND length(b.root) >= 3 AND b.suffix IN (SELECT suffix FROM sfx)), "
    "last AS (SELECT word, prefix, root, '' AS root2, '' AS suffix, 2.0::DOUBLE + 3 * length(root) AS score, 2 AS tier FROM fit WHERE suffix = '' AND length(prefix) = 1 AND length(root) >= 3), "
    "ety AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM last)"
)
_BEST_ETYM = "be AS (SELECT word, prefix, root, root2, suffix, score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tier, score DESC, prefix DESC, root DESC, root2 DESC, suffix DESC) AS n FROM ety) WHERE n = 1)"


def _etym_roots(spark: SparkSession, d: str) -> DataFrame:
    return affixes.etym_variants(load(spark, d, "etym_dictionary", "roots"))


@query("etym_roots", f"WITH {_VARIANTS} SELECT root FROM r")
def etym_roots(spark: SparkSession, d: str) -> DataFrame:
    return _etym_roots(spark, d)


@query("etym_analysis", f"WITH {_BASE}, {_ETYM}, {_BEST_ETYM} SELECT * FROM be")
def etym_analysis(spark: SparkSession, d: str) -> DataFrame:
    return affixes.etym_analysis(_words(spark, d), _etym_roots(spark, d), _affixes(spark, d))


@query(
    "derivation_strategy",
    f"WITH {sql.DERIV} SELECT word, base, affix, kind, greatest(3.0::DOUBLE, 0.5::DOUBLE * length(affix) + 2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(affix) DESC, affix DESC, base DESC, kind DESC) AS n FROM deriv) WHERE n = 1",
)
def derivation_strategy(spark: SparkSession, d: str) -> DataFrame:
    return affixes.derivation_strategy(lexicon.derivations(spark, d))


def _inflected(spark: SparkSession, d: str) -> DataFrame:
    """The suffix derivations as entries of forms: their base is the lemma."""
    rows = lexicon.derivations(spark, d).where("kind = 's'")
    return affixes.inflections(rows.select(F.col("word").alias("form"), F.col("base").alias("lemma"), F.col("affix").alias("suffix"), "ord"))


_INFL = (
    "fe AS (SELECT word AS form, base AS lemma, affix AS suffix, ord FROM deriv WHERE kind = 's'), fp AS (SELECT form, coalesce(arg_min({'l': lemma, 's': suffix}, ord) FILTER (WHERE suffix <> ''), "
    "arg_max({'l': lemma, 's': suffix}, ord) FILTER (WHERE lemma <> form), arg_min({'l': lemma, 's': suffix}, ord)) AS b FROM fe GROUP BY form), infl AS (SELECT form, b.l AS lemma, b.s AS suffix FROM fp)"
)


@query("inflections", f"WITH {sql.DERIV}, {_INFL} SELECT * FROM infl")
def inflections(spark: SparkSession, d: str) -> DataFrame:
    return _inflected(spark, d)


_FITS = (
    "fits AS (SELECT * FROM deriv WHERE (kind = 's' AND ends_with(word, affix) OR kind = 'p' AND starts_with(word, affix)) AND abs(length(word) - length(affix) - length(base)) <= 2), "
    "told AS (SELECT word, base, affix, kind FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(affix) DESC, affix DESC, base DESC, kind DESC) AS n FROM fits) WHERE n = 1)"
)
#: One analysis a word, as a display string ``scheme: part.part``, with the number of those found.
_ANALYSES = (
    f"{_FITS}, {_INFL}, {_RULES}, {_ETYM}, {_BEST_ETYM}, br AS (SELECT word, prefix, stem, suffix, score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY tier, score DESC, coalesce(prefix, '') DESC, coalesce(suffix, '') DESC) AS n FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)) WHERE n = 1), "
    "o AS (SELECT * FROM told WHERE word IN (SELECT word FROM w)), ob AS (SELECT DISTINCT base AS word FROM o), "
    f"h AS (SELECT word, rest AS base, suf AS affix, 's' AS kind FROM ({_SUF.format('ob', 3)}) UNION ALL SELECT word, rest, pre, 'p' FROM ({_PRE.format('ob', 3)})), "
    "hop AS (SELECT word, base, affix, kind FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY kind DESC, length(affix) DESC) AS n FROM h WHERE base IN (SELECT word FROM known)) WHERE n = 1), "
    "i AS (SELECT * FROM told WHERE word IN (SELECT word FROM ob) UNION ALL SELECT * FROM hop WHERE word NOT IN (SELECT word FROM told)), "
    "pt AS (SELECT affix, greatest(3.0::DOUBLE, 0.5::DOUBLE * length(affix) + 2) AS p FROM (SELECT affix FROM o UNION SELECT affix FROM i)), "
    "d AS (SELECT o.word, CASE WHEN i.base IS NOT NULL AND i.kind <> o.kind THEN 'combined' ELSE 'derivation' END AS strategy, "
    "CASE WHEN i.base IS NOT NULL AND i.kind <> o.kind THEN CASE WHEN o.kind = 'p' THEN [o.affix, i.base, i.affix] ELSE [i.affix, i.base, o.affix] END WHEN o.kind = 's' THEN [o.base, o.affix] ELSE [o.affix, o.base] END AS parts, "
    "CASE WHEN i.base IS NOT NULL AND i.kind <> o.kind THEN po.p + pi.p ELSE po.p END AS score, CASE WHEN i.base IS NULL THEN 1 ELSE 2 END AS found "
    "FROM o JOIN pt po ON o.affix = po.affix LEFT JOIN i ON o.base = i.word LEFT JOIN pt pi ON i.affix = pi.affix), "
    "f AS (SELECT form AS word, 'inflection' AS strategy, [lemma, suffix] AS parts, 3.0::DOUBLE AS score, 1 AS found FROM infl WHERE suffix <> '' AND suffix <> lemma AND form IN (SELECT word FROM w) AND form NOT IN (SELECT word FROM d)), "
    "lw AS (SELECT word FROM w WHERE word NOT IN (SELECT word FROM d) AND word NOT IN (SELECT word FROM f)), isb AS (SELECT base AS word FROM deriv UNION SELECT lemma FROM infl), "
    "l0 AS (SELECT lw.word, list_filter([br.prefix, br.stem, br.suffix], lambda x: x <> '') AS rp, br.score AS rs, list_filter([be.prefix, be.root, be.root2, be.suffix], lambda x: x <> '') AS ep, be.score AS es, "
    "be.score IS NOT NULL AND be.score > coalesce(br.score, -1) AND (be.score >= 30 OR lw.word NOT IN (SELECT word FROM isb)) AS wins FROM lw LEFT JOIN br ON lw.word = br.word LEFT JOIN be ON lw.word = be.word), "
    "l AS (SELECT word, CASE WHEN wins THEN 'etym' WHEN rs IS NOT NULL THEN 'rule' ELSE 'none' END AS strategy, CASE WHEN wins THEN ep WHEN rs IS NOT NULL THEN rp ELSE [word] END AS parts, "
    "CASE WHEN wins THEN es WHEN rs IS NOT NULL THEN rs ELSE 0.0 END::DOUBLE AS score, CASE WHEN (wins OR rs IS NOT NULL) AND es IS NOT NULL AND rs IS NOT NULL THEN 2 ELSE 1 END AS found FROM l0)"
)


def analysis_of(spark: SparkSession, d: str, words: DataFrame) -> DataFrame:
    deriv = lexicon.derivations(spark, d)
    fits = deriv.where(strings.derivation_fits(F.col("word"), F.col("base"), F.col("affix"), F.col("kind")))
    return affixes.analyze(words, fits, _etym_roots(spark, d), lexicon.affix_list(deriv), _known(spark, d), _inflected(spark, d))


@query("affix_analysis", f"WITH {_BASE}, {_ANALYSES} SELECT * FROM d UNION ALL SELECT * FROM f UNION ALL SELECT * FROM l")
def affix_analysis(spark: SparkSession, d: str) -> DataFrame:
    return analysis_of(spark, d, _words(spark, d)).select("word", "strategy", "parts", "score", F.size("strategies").alias("found"))


@query("reverse_index", f"WITH {sql.REVERSE} SELECT word, base, affix, kind FROM rev")
def reverse_index(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.reverse_index(lexicon.derivations(spark, d))


@query(
    "derivation_chains",
    f"WITH RECURSIVE {sql.REVERSE}, ch AS (SELECT word, base, CASE WHEN kind = 'p' THEN [affix] ELSE [] END AS pre, CASE WHEN kind = 's' THEN [affix] ELSE [] END AS suf, 1 AS depth FROM rev "
    "UNION ALL SELECT ch.word, rev.base, CASE WHEN kind = 'p' THEN list_append(pre, affix) ELSE pre END, CASE WHEN kind = 's' THEN list_prepend(affix, suf) ELSE suf END, depth + 1 FROM ch JOIN rev ON ch.base = rev.word WHERE depth < 10) "
    "SELECT word, base, list_concat(list_concat(pre, [base]), suf) AS parts, depth FROM ch QUALIFY row_number() OVER (PARTITION BY word ORDER BY depth DESC) = 1",
)
def derivation_chains(spark: SparkSession, d: str) -> DataFrame:
    return affixes.chains(lexicon.reverse_index(lexicon.derivations(spark, d)))


def form_index_of(spark: SparkSession, d: str) -> DataFrame:
    """The forms of the roots and affixes with their interpretations, built once for tables as they are."""

    def make() -> DataFrame:
        roots = load(spark, d, "roots", "entry_id", "base", "meaning", "lang", "ety_meaning", "ety_lang", "forms")
        forms = segment.root_forms(roots, load(spark, d, "affixes", "affix_id", "roots", "lang_code", "meaning"))
        return segment.form_index(forms, load(spark, d, "anki_highfreq", "affix", "affix_type", "cnt", "merged_count", "canonical", "variants"))

    return once(spark, "form-index", [f"{d}/{t}.parquet" for t in ("roots", "affixes", "anki_highfreq")], make)


_FREQUENT = (
    "fa AS (SELECT trim(trim(lower(affix), '-')) AS form, coalesce(cnt, 0) AS n, CASE WHEN merged_count > 0 THEN merged_count ELSE coalesce(cnt, 0) END AS m, affix_type FROM anki_highfreq), "
    "ff AS (SELECT form, max(n)::BIGINT AS freq, max(m)::BIGINT AS merged, coalesce(list_sort(list(DISTINCT affix_type) FILTER (WHERE affix_type <> '')), []) AS kinds FROM fa WHERE length(form) >= 2 GROUP BY form)"
)


_INDEXED = (
    f"{core_queries.FORMS_SQL}, rf AS (SELECT lower(form) AS form, list_sort(list_distinct(ps)) AS pos, opt = 1 AS opt, CASE WHEN ety_meaning <> '' THEN 'dict' ELSE 'affix' END AS src FROM nd JOIN roots ON nd.entry_id = roots.entry_id "
    "UNION ALL SELECT trim(trim(lower(roots), '-')), CASE WHEN trim(roots) LIKE '-%' AND trim(roots) LIKE '%-' THEN ['root'] WHEN trim(roots) LIKE '-%' THEN ['suffix'] WHEN trim(roots) LIKE '%-' THEN ['prefix'] ELSE [] END, FALSE, 'affix' FROM affixes)"
)


@query(
    "root_form_index",
    f"{_INDEXED}, {_FREQUENT} SELECT form, n, freq, merged, kinds FROM (SELECT form, count(*)::INT AS n FROM (SELECT DISTINCT form, pos, opt, src FROM rf WHERE length(form) >= 2) GROUP BY form) LEFT JOIN ff USING (form)",
)
def root_form_index(spark: SparkSession, d: str) -> DataFrame:
    return form_index_of(spark, d).select("form", F.size("interps").alias("n"), "freq", "merged", "kinds")


@query(
    "frequent_forms",
    "WITH a AS (SELECT trim(trim(lower(affix), '-')) AS form, coalesce(cnt, 0) AS n, CASE WHEN merged_count > 0 THEN merged_count ELSE coalesce(cnt, 0) END AS m, coalesce(canonical, trim(trim(lower(affix), '-'))) AS c, affix_type FROM anki_highfreq) "
    "SELECT form, max(n)::BIGINT AS freq, max(m)::BIGINT AS merged, arg_max(c, {'m': m, 'c': c}) AS canonical, coalesce(list_sort(list(DISTINCT affix_type) FILTER (WHERE affix_type <> '')), []) AS kinds FROM a WHERE length(form) >= 2 GROUP BY form",
)
def frequent_forms(spark: SparkSession, d: str) -> DataFrame:
    return segment.frequent_forms(load(spark, d, "anki_highfreq", "affix", "affix_type", "cnt", "merged_count", "canonical", "variants")).drop("variants")


@query(
    "shown_meanings",
    "SELECT entry_id, CASE WHEN ety_meaning <> '' THEN 'dict' ELSE 'affix' END AS src, CASE WHEN ety_meaning <> '' AND NOT contains(lower(ety_meaning), 'see also') AND NOT contains(ety_meaning, ';;') THEN ety_meaning ELSE coalesce(meaning, '') END AS meaning, "
    "CASE WHEN ety_meaning <> '' AND NOT contains(lower(ety_meaning), 'see also') AND NOT contains(ety_meaning, ';;') AND ety_lang <> '' THEN ety_lang ELSE coalesce(lang, '') END AS lang FROM roots",
)
def shown_meanings(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "roots", "entry_id", "meaning", "lang", "ety_meaning", "ety_lang")
    return t.select("entry_id", segment.shown_meaning(F.col("ety_meaning"), F.col("ety_lang"), F.col("meaning"), F.col("lang")).alias("m")).select("entry_id", "m.*")


@query("segmented_words")
def segmented_words(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    return segment.segment(words, form_index_of(spark, d), affixes.chains(lexicon.reverse_index(lexicon.derivations(spark, d)), words=words))


@query("stems_of_words")
def stems_of_words(spark: SparkSession, d: str) -> DataFrame:
    return segmented_words(spark, d).select("word", segment.stem_of(F.col("parts")).alias("stem"))


def _per_word(spark: SparkSession, d: str, f, schema: str) -> DataFrame:
    """A segmenter run on each word with the affixes and roots that occur in it, found by joins."""
    words, aff = _words(spark, d), _affixes(spark, d)
    roots = load(spark, d, "roots", "base").where("base is not null").select(F.lower("base").alias("form"), F.lit("r").alias("kind")).distinct()
    every = aff.select(F.col("affix").alias("form"), "kind").unionByName(roots)
    sub = segment.substrings(words, every).select("word", "form").distinct()
    inside = sub.join(every, "form").groupBy("word").agg(F.collect_set(F.struct("kind", "form")).alias("k"))
    of = lambda kind: F.transform(F.filter("k", lambda x: x["kind"] == kind), lambda x: x["form"])
    none = F.array().cast("array<string>")
    rows = words.join(inside, "word", "left").select("word", *[F.coalesce(of(k), none).alias(k) for k in "psr"])
    return rows.select("word", F.pandas_udf(f, schema)("word", "p", "s", "r").alias("x")).select("word", "x.*")


@query("layered_words")
def layered_words(spark: SparkSession, d: str) -> DataFrame:
    def run(w: pd.Series, p: pd.Series, s: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = [segment.affix_layers(a, set(b), set(c), list(e)) for a, b, c, e in zip(w, p, s, r)]
        return pd.DataFrame({"parts": [[t for _, t in x[0]] for x in out], "kinds": [[k for k, _ in x[0]] for x in out], "score": [x[1] for x in out]})

    return _per_word(spark, d, run, "parts array<string>, kinds array<string>, score double")


@query("two_strategy_words")
def two_strategy_words(spark: SparkSession, d: str) -> DataFrame:
    def run(w: pd.Series, p: pd.Series, s: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = [segment.two_strategies(a, set(b), set(c), list(e)) for a, b, c, e in zip(w, p, s, r)]
        return pd.DataFrame({"strategy": [x[0] for x in out], "parts": [x[1] for x in out], "score": [x[2] for x in out]})

    return _per_word(spark, d, run, "strategy string, parts array<string>, score double")


@query(
    "greedy_words",
    f"{_INDEXED}, {sql.COUNTS}, kf AS (SELECT DISTINCT form FROM rf WHERE length(form) >= 2), "
    "oc AS (SELECT word, form, unnest(list_filter(generate_series(1, length(word) - length(form) + 1), lambda i: substr(word, i, length(form)) = form)) AS i FROM lexc JOIN kf ON contains(word, form)), "
    "hb AS (SELECT word, i, arg_max(form, length(form)) AS f, arg_max(form, length(form)) FILTER (WHERE length(form) > 2) AS g FROM oc GROUP BY word, i), "
    "gw(word, i, after, parts) AS (SELECT word, 1, TRUE, []::VARCHAR[] FROM lexc UNION ALL SELECT w.word, CASE WHEN h IS NULL THEN i + 1 ELSE i + length(h) END, h IS NOT NULL, "
    "CASE WHEN h IS NOT NULL THEN list_append(parts, h) WHEN len(parts) > 0 AND parts[len(parts)][1] = '[' THEN list_append(parts[:len(parts) - 1], parts[len(parts)][:-2] || substr(w.word, i, 1) || ']') ELSE list_append(parts, '[' || substr(w.word, i, 1) || ']') END "
    "FROM (SELECT gw.*, CASE WHEN after THEN f ELSE g END AS h FROM gw LEFT JOIN hb ON gw.word = hb.word AND gw.i = hb.i WHERE gw.i <= length(gw.word)) w) SELECT word, parts FROM gw WHERE i > length(word)",
)
def greedy_words(spark: SparkSession, d: str) -> DataFrame:
    def run(words: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([segment.greedy(w, list(h) if h is not None else None) for w, h in zip(words, found)])

    rows = segment.hits(_words(spark, d), form_index_of(spark, d))
    return rows.select("word", F.pandas_udf(run, "array<string>")("word", F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["form"].alias("form")))).alias("parts"))


@query(
    "boundary_scores",
    f"WITH {sql.DERIV}, c AS (SELECT word, CASE WHEN kind = 's' THEN length(word) - length(affix) ELSE length(affix) END AS seam FROM deriv WHERE regexp_full_match(word, '[a-z]{{2,}}')), "
    "a AS (SELECT word, seam, unnest(generate_series(1, length(word) - 1)) AS i FROM c) SELECT substr(word, i, 2) AS pair, avg((i = seam)::INT::DOUBLE) AS p FROM a GROUP BY 1",
)
def boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    return segment.boundary_scores(lexicon.derivations(spark, d))


@query(
    "scored_cuts",
    f"WITH {sql.COUNTS}, {sql.DERIV}, c AS (SELECT word, CASE WHEN kind = 's' THEN length(word) - length(affix) ELSE length(affix) END AS seam FROM deriv WHERE regexp_full_match(word, '[a-z]{{2,}}')), "
    "a AS (SELECT word, seam, unnest(generate_series(1, length(word) - 1)) AS i FROM c), sc AS (SELECT substr(word, i, 2) AS pair, avg((i = seam)::INT::DOUBLE) AS p FROM a GROUP BY 1), "
    "l AS (SELECT word, unnest(generate_series(1, length(word))) AS i FROM lexc), m AS (SELECT word, i, substr(word, i, 1) || CASE WHEN p >= 0.44 THEN '.' ELSE '' END AS t FROM l LEFT JOIN sc ON pair = substr(word, i, 2) AND i < length(word)) "
    "SELECT word, string_split(string_agg(t, '' ORDER BY i), '.') AS parts FROM m GROUP BY word",
)
def scored_cuts(spark: SparkSession, d: str) -> DataFrame:
    return segment.scored_cut(_words(spark, d), segment.boundary_scores(lexicon.derivations(spark, d)))


@query("word_differences")
def word_differences(spark: SparkSession, d: str) -> DataFrame:
    return wordforms.differences(lexicon.derivations(spark, d).select(F.col("base").alias("stem"), "word").distinct())


@query("highlighted_words")
def highlighted_words(spark: SparkSession, d: str) -> DataFrame:
    return wordforms.highlighted(_words(spark, d).where(F.col("word").contains("or")), "or", _affixes(spark, d))


@query("cleaned_notes")
def cleaned_notes(spark: SparkSession, d: str) -> DataFrame:
    """Every text as the note of its head word."""
    t = load(spark, d, "documents", "doc_id", "headword", "text").where("text is not null")
    packed = t.select(F.col("doc_id").alias("id"), F.concat_ws("\x1f", F.coalesce("headword", F.lit("")), F.lit(""), F.lit(""), "text").alias("flds"))
    return notes.clean_notes(notes.read_notes(packed))


@query("notes_report")
def notes_report(spark: SparkSession, d: str) -> DataFrame:
    return notes.report(cleaned_notes(spark, d))
