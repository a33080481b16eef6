"""Offline builds and the allomorph graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import strings
from lexiforge.operators import allomorphs, etl, lexicon
from lexiforge.plans import sql
from lexiforge.plans.text_queries import parsed_segments
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


_RULES = (
    "lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), "
    "pl AS (SELECT regexp_extract(line, '^(\\w+) = ([\\w.]+) \\[', 1) AS word, regexp_extract(line, '^(\\w+) = ([\\w.]+) \\[', 2) AS split FROM lines), "
    "rules AS (SELECT word, string_split(min(split), '.') AS segments FROM pl WHERE word <> '' GROUP BY word)"
)
_CARDS = "cards AS (SELECT word, CASE WHEN kind = 's' THEN [base, affix] ELSE [affix, base] END AS segments FROM rev)"
_SPLITS = f"{sql.REVERSE}, {_CARDS}, {_RULES}, own AS (SELECT * FROM rules WHERE word NOT IN (SELECT word FROM cards) AND len(segments) > 1)"
_FREQ = (
    f"{_SPLITS}, allsplits AS (SELECT * FROM cards WHERE len(segments) > 0 UNION ALL SELECT * FROM own), "
    "pos_at AS (SELECT word, len(segments) AS n, unnest(segments) AS seg, generate_subscripts(segments, 1) AS i FROM allsplits), "
    "one AS (SELECT word, seg, min(i) AS i, arg_min(n, i) AS n FROM pos_at WHERE seg <> '' GROUP BY word, seg), "
    "freq AS (SELECT seg, count(DISTINCT word) AS cnt, count_if(i = 1)::BIGINT AS first, count_if(i > 1 AND i = n)::BIGINT AS last, count_if(i > 1 AND i < n)::BIGINT AS middle FROM one GROUP BY seg)"
)


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return parsed_segments(spark, d).groupBy("word").agg(F.split(F.min(F.array_join("segments", ".")), r"\.").alias("segments"))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    rev = lexicon.reverse_index(lexicon.derivations(spark, d))
    return rev.select("word", F.when(F.col("kind") == "s", F.array("base", "affix")).otherwise(F.array("affix", "base")).alias("segments"))


def _freq(spark: SparkSession, d: str) -> DataFrame:
    return etl.segment_frequencies(_cards(spark, d), _rules(spark, d))


@query("segment_frequencies", f"WITH {_FREQ} SELECT * FROM freq")
def segment_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _freq(spark, d)


@query("frequent_segments", f"WITH {_FREQ} SELECT count_if(cnt >= 3)::BIGINT AS frequent, count(*) AS n FROM freq")
def frequent_segments(spark: SparkSession, d: str) -> DataFrame:
    return _freq(spark, d).agg(F.count_if(F.col("cnt") >= 3).alias("frequent"), F.count("*").alias("n"))


@query("rules_without_cards", f"WITH {_SPLITS} SELECT word FROM own")
def rules_without_cards(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).where("size(segments) > 1").join(_cards(spark, d).select("word"), "word", "left_anti").select("word")


_ETY = (
    "it AS (SELECT etym_id, list_filter(list_transform(string_split(replace(roots, '•', ''), ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM etym_dictionary WHERE roots IS NOT NULL), "
    "bs AS (SELECT items, regexp_extract(lower(regexp_replace(items[1], '^[-*=]+', '')), '^([a-z]+)', 1) AS base FROM it WHERE len(items) > 0), "
    "ea AS (SELECT base, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM bs WHERE base <> ''), "
    "ef AS (SELECT base, CASE WHEN i = 1 THEN base WHEN regexp_extract(item, '^[-*=]([A-Za-z]+)', 1) <> '' THEN base || lower(regexp_extract(item, '^[-*=]([A-Za-z]+)', 1)) "
    "WHEN regexp_extract(item, '^([A-Za-z]+)', 1) <> '' THEN lower(regexp_extract(item, '^([A-Za-z]+)', 1)) END AS form, CASE WHEN i = 1 THEN FALSE ELSE regexp_matches(item, '^[-*]') END AS opt FROM ea), "
    "ety AS (SELECT base, form, bool_or(opt) AS opt FROM ef WHERE form IS NOT NULL GROUP BY base, form)"
)
_AFF_POS = "CASE WHEN trim(roots) LIKE '-%' AND trim(roots) LIKE '%-' THEN 'root' WHEN trim(roots) LIKE '-%' THEN 'suffix' WHEN trim(roots) LIKE '%-' THEN 'prefix' END"
_AFF = (
    f"at0 AS (SELECT lower(trim(trim(trim(roots), '-'))) AS form, {_AFF_POS} AS pos, meaning, lang_code FROM affixes), "
    "afft AS (SELECT form, coalesce(list_sort(list(DISTINCT pos) FILTER (WHERE pos IS NOT NULL)), []) AS pos, coalesce(array_to_string(list_sort(list(DISTINCT meaning) FILTER (WHERE meaning <> '')), '; '), '') AS meaning, "
    "coalesce(nullif(array_to_string(list_sort(list(DISTINCT lang_code) FILTER (WHERE lang_code NOT IN ('', '?'))), '; '), ''), CASE WHEN bool_or(lang_code = '?') THEN '?' ELSE '' END) AS langs FROM at0 WHERE form <> '' GROUP BY form)"
)


@query("ety_forms", f"WITH {_ETY} SELECT * FROM ety")
def ety_forms(spark: SparkSession, d: str) -> DataFrame:
    return etl.ety_forms(load(spark, d, "etym_dictionary", "roots"))


@query("affix_table", f"WITH {_AFF} SELECT * FROM afft")
def affix_table(spark: SparkSession, d: str) -> DataFrame:
    return etl.affix_table(load(spark, d, "affixes", "roots", "meaning", "lang_code"))


@query(
    "merged_roots",
    f"WITH {_ETY}, {_AFF} SELECT base, ety.form, opt, coalesce(pos, []) AS pos, coalesce(meaning, '') AS meaning FROM ety LEFT JOIN afft ON ety.form = afft.form "
    "UNION ALL SELECT form, form, FALSE, pos, meaning FROM afft WHERE form NOT IN (SELECT form FROM ety)",
)
def merged_roots(spark: SparkSession, d: str) -> DataFrame:
    return etl.merged_roots(load(spark, d, "etym_dictionary", "roots"), load(spark, d, "affixes", "roots", "meaning", "lang_code"))


_HTML = "html AS (SELECT lower(headword) AS word, arg_min(text, doc_id) AS html FROM documents WHERE starts_with(text, '<div class=\"gdc\">') AND headword IS NOT NULL GROUP BY 1)"
_DEF = "nullif(trim(regexp_replace(regexp_split_to_array(regexp_replace(regexp_extract(html, '(?s)<div class=\"coca2\">(.*?)</div>', 1), '<[^>]*>', '', 'g'), '[,，]')[1], '[(（][^)）]*[)）]', '', 'g')), '')"
_DCN = "nullif(trim(regexp_split_to_array(regexp_replace(regexp_extract(html, '(?s)<span class=\"dcn\">(.*?)</span>', 1), '<[^>]*>', '', 'g'), '[,，;；]')[1]), '')"
_INF = "list_filter(list_transform(string_split(regexp_replace(regexp_extract(html, '(?s)<span class=\"frm\">(.*?)</span>', 1), '<[^>]*>', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')"
_SMALL = f"{sql.LEX}, {_HTML}, small AS (SELECT word, frequency, {_DEF} AS definition, coalesce({_INF}, []) AS inflections FROM lex LEFT JOIN html USING (word))"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents", "doc_id", "headword", "text").where(F.col("text").startswith('<div class="gdc">') & F.col("headword").isNotNull())
    return t.groupBy(F.lower("headword").alias("word")).agg(F.min_by("text", "doc_id").alias("html"))


def _small(spark: SparkSession, d: str) -> DataFrame:
    return etl.small_dictionary(_entries(spark, d), lexicon.lexicon(spark, d).select("word", "frequency"))


@query("small_dictionary", f"WITH {_SMALL} SELECT * FROM small")
def small_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _small(spark, d)


_FLAT = "sm AS (SELECT * FROM small WHERE definition IS NOT NULL), ev AS (SELECT word, definition, frequency, 0 AS o FROM sm UNION ALL SELECT unnest(inflections), definition, frequency, 1 FROM sm)"


@query("flattened_dictionary", f"WITH {_SMALL}, {_FLAT} SELECT word, definition, frequency FROM ev WHERE word <> '' QUALIFY row_number() OVER (PARTITION BY word ORDER BY frequency, o, definition) = 1")
def flattened_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return etl.flattened(_small(spark, d))


@query(
    "head_before_inflection",
    f"WITH {_SMALL}, {_FLAT}, h AS (SELECT word, definition FROM ev WHERE o = 0 QUALIFY row_number() OVER (PARTITION BY word ORDER BY frequency DESC, definition DESC) = 1), "
    "i AS (SELECT word, definition FROM ev WHERE o = 1 QUALIFY row_number() OVER (PARTITION BY word ORDER BY frequency, definition) = 1) "
    "SELECT word, coalesce(h.definition, i.definition) AS definition FROM h FULL JOIN i USING (word) WHERE word <> ''",
)
def head_before_inflection(spark: SparkSession, d: str) -> DataFrame:
    return etl.head_before_inflection(_small(spark, d))


_NULLED = "nulled AS (SELECT word, frequency, CASE WHEN frequency % 3 <> 0 THEN definition END AS definition FROM small)"


@query(
    "repaired_dictionary",
    f"WITH {_SMALL}, {_NULLED} SELECT n.word, n.frequency, coalesce(n.definition, {_DEF}, {_DCN}) AS definition, n.definition IS NULL AND coalesce({_DEF}, {_DCN}) IS NOT NULL AS fixed FROM nulled n LEFT JOIN html USING (word)",
)
def repaired_dictionary(spark: SparkSession, d: str) -> DataFrame:
    small = _small(spark, d).select("word", "frequency", F.when(F.col("frequency") % 3 != 0, F.col("definition")).alias("definition"))
    return etl.repaired(small, _entries(spark, d))


@query(
    "updated_glosses",
    "WITH new AS (SELECT lower(trim(trim(affix, '-'))) AS k, max(meaning) AS m FROM high_freq_affixes WHERE affix IS NOT NULL GROUP BY 1) "
    "SELECT entry_id, lower(base) AS k, coalesce(meaning, m) AS meaning FROM roots LEFT JOIN new ON lower(base) = k",
)
def updated_glosses(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "roots", "entry_id", "base", "meaning").select("entry_id", F.lower("base").alias("k"), "meaning")
    news = load(spark, d, "high_freq_affixes", "affix", "meaning").where("affix is not null").select(F.lower(strings.strip_dashes(F.col("affix"))).alias("k"), "meaning")
    return etl.updated(rows, news, "k", "meaning")


@query("restored_nulls", "SELECT entry_id, CASE WHEN entry_id NOT IN (SELECT entry_id FROM roots WHERE meaning = '' OR meaning IS NULL) THEN meaning END AS meaning FROM roots")
def restored_nulls(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "roots", "entry_id", "meaning")
    return etl.restored(rows, rows.where("meaning = '' or meaning is null"), "entry_id", "meaning")


@query("unmatched_updates", "SELECT DISTINCT lower(trim(trim(affix, '-'))) AS k FROM high_freq_affixes WHERE affix IS NOT NULL AND lower(trim(trim(affix, '-'))) NOT IN (SELECT lower(base) FROM roots WHERE base IS NOT NULL)")
def unmatched_updates(spark: SparkSession, d: str) -> DataFrame:
    news = load(spark, d, "high_freq_affixes", "affix").where("affix is not null").select(F.lower(strings.strip_dashes(F.col("affix"))).alias("k")).distinct()
    return news.join(load(spark, d, "roots", "base").select(F.lower("base").alias("k")), "k", "left_anti")


@query(
    "split_accuracy",
    f"WITH {_SPLITS}, g AS (SELECT word, array_to_string(segments, '.') AS want FROM rules), p AS (SELECT word, array_to_string(segments, '.') AS got, base FROM cards JOIN rev USING (word)), "
    "j AS (SELECT want, got, string_split(want, '.')[1] = string_split(got, '.')[1] AS head FROM g JOIN p USING (word)) "
    "SELECT count(*) AS total, count_if(want = got)::BIGINT AS exact, count_if(want <> got AND head)::BIGINT AS tail_differs, count_if(want <> got AND NOT head)::BIGINT AS head_differs, round(100.0 * count_if(want = got) / count(*), 1) AS percent FROM j",
)
def split_accuracy(spark: SparkSession, d: str) -> DataFrame:
    want = _rules(spark, d).select("word", F.array_join("segments", ".").alias("want"))
    got = _cards(spark, d).select("word", F.array_join("segments", ".").alias("got"))
    j = want.join(got, "word")
    same, head = F.col("want") == F.col("got"), F.split("want", r"\.")[0] == F.split("got", r"\.")[0]
    r = j.agg(F.count("*").alias("total"), F.count_if(same).alias("exact"), F.count_if(~same & head).alias("tail_differs"), F.count_if(~same & ~head).alias("head_differs"))
    return r.withColumn("percent", F.round(100.0 * F.col("exact") / F.col("total"), 1))


@query(
    "coverage",
    f"WITH {_SMALL} SELECT count(*) AS words, count(definition) AS defined, round(100.0 * count(definition) / count(*), 2) AS percent, sum(len(inflections))::BIGINT AS inflections, min(frequency) AS least, max(frequency) AS most FROM small",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    s = _small(spark, d)
    return s.agg(
        F.count("*").alias("words"), F.count("definition").alias("defined"), F.round(100.0 * F.count("definition") / F.count("*"), 2).alias("percent"),
        F.sum(F.size("inflections")).alias("inflections"), F.min("frequency").alias("least"), F.max("frequency").alias("most"),
    )


@query(
    "fill_report",
    "SELECT coalesce(gloss_src, '(none)') AS src, count(*) AS n, count(gloss) AS filled, round(100.0 * count(gloss) / count(*), 2) AS percent, count_if(regexp_matches(gloss, '[\\x{4E00}-\\x{9FFF}]'))::BIGINT AS cn FROM allomorph_groups GROUP BY 1",
)
def fill_report(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "allomorph_groups", "gloss", "gloss_src")
    return t.groupBy(F.coalesce("gloss_src", F.lit("(none)")).alias("src")).agg(
        F.count("*").alias("n"), F.count("gloss").alias("filled"), F.round(100.0 * F.count("gloss") / F.count("*"), 2).alias("percent"), F.count_if(F.col("gloss").rlike(strings.HAN)).alias("cn")
    )


_MANUAL = "man AS (SELECT lower(trim(trim(affix, '-'))) AS form, CASE WHEN affix_type IN ('prefix', 'suffix') THEN affix_type ELSE 'root' END AS pos, meaning AS gloss, cnt, example FROM high_freq_affixes WHERE affix IS NOT NULL)"
_NODES = (
    f"{_FREQ}, {_MANUAL}, rt AS (SELECT lower(base) AS form, 'root' AS pos, meaning AS gloss FROM roots WHERE base IS NOT NULL), "
    "co AS (SELECT seg AS form, 'prefix' AS pos, first AS cnt FROM freq UNION ALL SELECT seg, 'suffix', last FROM freq UNION ALL SELECT seg, 'root', middle FROM freq), "
    "al AS (SELECT form, pos, gloss, 0 AS rank, cnt FROM man UNION ALL SELECT form, pos, gloss, 1, 0 FROM rt UNION ALL SELECT form, pos, NULL, 2, cnt FROM co WHERE cnt > 0), "
    "gg AS (SELECT form, pos, coalesce(list_sort(list(DISTINCT trim(gloss)) FILTER (WHERE rank = 0 AND trim(gloss) <> '')), []) AS l0, coalesce(list_sort(list(DISTINCT trim(gloss)) FILTER (WHERE rank = 1 AND trim(gloss) <> '')), []) AS l1, "
    "min(rank) AS rank, sum(cnt)::BIGINT AS cnt FROM al WHERE regexp_full_match(form, '[a-z]+') GROUP BY form, pos), "
    "ow AS (SELECT form, pos, CASE WHEN len(l0) > 0 THEN l0 ELSE l1 END AS own, rank, cnt FROM gg), an AS (SELECT form, list_sort(list(DISTINCT l)) AS a FROM (SELECT form, unnest(own) AS l FROM ow) GROUP BY form), "
    "nd AS (SELECT ow.form, pos, CASE WHEN len(own) > 0 THEN own ELSE coalesce(a, []) END AS lines, CASE WHEN len(own) > 0 OR rank < 2 THEN rank ELSE 3 END AS rank, cnt FROM ow LEFT JOIN an ON ow.form = an.form)"
)


def _manual(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "high_freq_affixes", "affix", "affix_type", "meaning", "cnt", "example").where("affix is not null")
    pos = F.when(F.col("affix_type").isin("prefix", "suffix"), F.col("affix_type")).otherwise("root")
    return t.select(F.lower(strings.strip_dashes(F.col("affix"))).alias("form"), pos.alias("pos"), F.col("meaning").alias("gloss"), "cnt", "example")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    roots = load(spark, d, "roots", "base", "meaning").where("base is not null").select(F.lower("base").alias("form"), F.lit("root").alias("pos"), F.col("meaning").alias("gloss"))
    return allomorphs.nodes(_manual(spark, d), roots, _freq(spark, d))


@query("graph_nodes", f"WITH {_NODES} SELECT * FROM nd")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d)


#: All pairs, as the slow definition the generated keys must equal; on the SQL side only.
_LEGACY_PADS = (
    "SELECT a, b, pos, CASE WHEN k > 0 AND substr(b, k, 1) = substr(b, k + 1, 1) THEN 'elide' ELSE 'pad' END AS kind FROM (SELECT x.form AS a, y.form AS b, x.pos, list_max(list_filter(generate_series(0, length(x.form)), lambda i: substr(x.form, 1, i) = substr(y.form, 1, i))) AS k "
    "FROM nd x JOIN nd y ON x.pos = y.pos AND length(y.form) = length(x.form) + 1 AND (x.pos <> 'root' AND levenshtein(x.form, y.form) = 1 OR x.pos = 'root' AND starts_with(y.form, x.form)))"
)


@query("graph_pads", f"WITH {_NODES} {_LEGACY_PADS}")
def graph_pads(spark: SparkSession, d: str) -> DataFrame:
    return allomorphs.pad_edges(_nodes(spark, d).select("form", "pos")).select("a", "b", "pos", "kind")


_CONS = "[^aeiouy]"


_LEGACY_ASSIMILATIONS = (
    "SELECT DISTINCT x.form AS a, y.form AS b, x.pos FROM nd x JOIN nd y ON x.pos = y.pos AND length(x.form) = length(y.form) AND x.form < y.form AND "
    f"(substr(x.form, 1, length(x.form) - 1) = substr(y.form, 1, length(y.form) - 1) AND regexp_matches(right(x.form, 1), '{_CONS}') AND regexp_matches(right(y.form, 1), '{_CONS}') "
    f"OR x.pos <> 'root' AND substr(x.form, 2) = substr(y.form, 2) AND regexp_matches(left(x.form, 1), '{_CONS}') AND regexp_matches(left(y.form, 1), '{_CONS}'))"
)


@query("graph_assimilations", f"WITH {_NODES} {_LEGACY_ASSIMILATIONS}")
def graph_assimilations(spark: SparkSession, d: str) -> DataFrame:
    return allomorphs.assimilation_edges(_nodes(spark, d).select("form", "pos")).select("a", "b", "pos")


def _gated(spark: SparkSession, d: str, n: DataFrame) -> DataFrame:
    return allomorphs.gate(allomorphs.rule_edges(n), n)


_STOP = ", ".join(f"'{w}'" for w in strings.EN_STOP)
_TOKENS = (
    "CASE WHEN regexp_matches(l, '[\\x{4E00}-\\x{9FFF}]') THEN list_filter(regexp_split_to_array(l, '[；;，,。、/·.…\\s\\d()（）_\\-]+'), lambda t: regexp_matches(t, '[\\x{4E00}-\\x{9FFF}]')) "
    f"ELSE list_filter(regexp_extract_all(lower(l), '[a-z]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})) END"
)
_GATE = (
    f"{_NODES}, eg AS ({_LEGACY_PADS} UNION ALL SELECT *, 'assimilation' AS kind FROM ({_LEGACY_ASSIMILATIONS})), ln AS (SELECT form, pos, unnest(lines) AS l FROM nd), "
    f"lt AS (SELECT form, pos, regexp_matches(l, '[\\x{{4E00}}-\\x{{9FFF}}]') AS cn, list_distinct({_TOKENS}) AS t FROM ln), "
    "lp AS (SELECT a, b, eg.pos, kind, x.cn = y.cn AND least(len(x.t), len(y.t)) > 0 AS fit, len(list_intersect(x.t, y.t)) AS inter, least(len(x.t), len(y.t)) AS small FROM eg JOIN lt x ON x.form = a AND x.pos = eg.pos JOIN lt y ON y.form = b AND y.pos = eg.pos), "
    "lv AS (SELECT a, b, pos, kind, bool_or(fit) AS comparable, bool_or(fit AND inter / small >= 0.5 AND (kind <> 'assimilation' OR inter >= 2)) AS enough FROM lp GROUP BY ALL), "
    "gt AS (SELECT eg.a, eg.b, eg.pos, eg.kind, CASE WHEN comparable IS NULL THEN FALSE WHEN enough THEN TRUE WHEN comparable THEN FALSE END AS merge, "
    "CASE WHEN comparable IS NULL THEN 'no_gloss' WHEN enough THEN 'overlap' WHEN comparable THEN 'differs' ELSE 'other_language' END AS reason, least(p.rank, q.rank) AS rank "
    "FROM eg LEFT JOIN lv ON eg.a = lv.a AND eg.b = lv.b AND eg.pos = lv.pos AND eg.kind = lv.kind JOIN nd p ON p.form = eg.a AND p.pos = eg.pos JOIN nd q ON q.form = eg.b AND q.pos = eg.pos)"
)
_EXAMPLES = (
    "tw AS (SELECT affix AS form, CASE WHEN kind = 'p' THEN 'prefix' ELSE 'suffix' END AS pos, word, min(length(word)) AS trust FROM deriv GROUP BY ALL), "
    "te AS (SELECT form, pos, word, n FROM (SELECT form, pos, word, row_number() OVER (PARTITION BY form, pos ORDER BY trust, word)::INT AS n FROM tw) WHERE n <= 4)"
)
_GROUPED = (
    f"{_GATE}, me AS (SELECT a || '@' || pos AS a, b || '@' || pos AS b, kind FROM gt WHERE merge), bo AS (SELECT a, b FROM me UNION SELECT b, a FROM me), "
    "re(v, u) AS (SELECT a, a FROM bo UNION SELECT v, b FROM re JOIN bo ON u = a), lb AS (SELECT v, min(u) AS label FROM re GROUP BY v), "
    "nl AS (SELECT nd.*, coalesce(label, form || '@' || pos) AS label FROM nd LEFT JOIN lb ON v = form || '@' || pos), ke AS (SELECT label, list_sort(list(DISTINCT kind)) AS edge_types FROM me JOIN lb ON v = a GROUP BY label), "
    "gr AS (SELECT arg_min(form, {'r': rank, 'c': -cnt, 'l': -length(form), 'f': form}) AS canonical, pos, list_sort(list(DISTINCT form)) AS variants, sum(cnt)::BIGINT AS cnt, min(rank) AS rank, label FROM nl GROUP BY label, pos), "
    "gs AS (SELECT canonical, pos, variants, cnt, rank, coalesce(edge_types, []) AS edge_types FROM gr LEFT JOIN ke USING (label))"
)


@query("graph_gate", f"WITH {_GATE} SELECT * FROM gt")
def graph_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d, _nodes(spark, d))


@query(
    "graph_review",
    f"WITH {_GATE}, {_EXAMPLES} SELECT gt.*, coalesce((SELECT list(word ORDER BY n) FROM te WHERE te.form = a AND te.pos = gt.pos), []) AS examples_a, coalesce((SELECT list(word ORDER BY n) FROM te WHERE te.form = b AND te.pos = gt.pos), []) AS examples_b "
    "FROM gt WHERE merge IS NOT TRUE AND rank <= 1 AND reason <> 'no_gloss'",
)
def graph_review(spark: SparkSession, d: str) -> DataFrame:
    return allomorphs.review(_gated(spark, d, _nodes(spark, d)), top_examples(spark, d))


@query("graph_groups", f"WITH RECURSIVE {_GROUPED} SELECT * FROM gs")
def graph_groups(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return allomorphs.groups(n, _gated(spark, d, n))


@query("graph_lookup", f"WITH RECURSIVE {_GROUPED} SELECT v || '@' || pos AS key, canonical FROM (SELECT unnest(variants) AS v, pos, canonical FROM gs)")
def graph_lookup(spark: SparkSession, d: str) -> DataFrame:
    return allomorphs.lookup_table(graph_groups(spark, d))


_GROUPS = (
    "ag AS (SELECT group_id, lower(trim(trim(canonical, '-'))) AS canonical, pos, cnt AS merged_count, unnest(list_distinct(list_transform(variants, lambda v: lower(trim(trim(v, '-')))))) AS form FROM allomorph_groups WHERE canonical IS NOT NULL AND pos IS NOT NULL AND cnt >= 1)"
)


@query(
    "confirmed_affixes",
    f"WITH {_FREQ}, man AS (SELECT lower(trim(trim(affix, '-'))) AS form, example FROM anki_highfreq WHERE affix IS NOT NULL AND gloss_src = 'manual'), {_GROUPS}, kn AS (SELECT form FROM man UNION SELECT lower(base) FROM roots WHERE base IS NOT NULL), "
    "good AS (SELECT DISTINCT canonical, pos FROM ag WHERE form IN (SELECT form FROM kn)), ex AS (SELECT form, min(example) AS example FROM man GROUP BY form), "
    "co AS (SELECT seg AS form, 'prefix' AS pos, first AS cnt FROM freq UNION ALL SELECT seg, 'suffix', last FROM freq UNION ALL SELECT seg, 'root', middle FROM freq) "
    "SELECT form AS affix, pos AS kind, example, coalesce(cnt, 0)::BIGINT AS cnt, merged_count, canonical FROM ag JOIN good USING (canonical, pos) LEFT JOIN co USING (form, pos) LEFT JOIN ex USING (form) WHERE length(form) >= 2 "
    "QUALIFY row_number() OVER (PARTITION BY form, pos ORDER BY merged_count DESC, canonical DESC) = 1",
)
def confirmed_affixes(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "allomorph_groups", "canonical", "pos", "variants", "cnt").where("canonical is not null and pos is not null")
    clean = lambda x: F.lower(strings.strip_dashes(x))
    g = t.select(clean(F.col("canonical")).alias("canonical"), "pos", "cnt", F.array_distinct(F.transform("variants", clean)).alias("variants"))
    roots = load(spark, d, "roots", "base").where("base is not null").select(F.lower("base").alias("form"))
    cards = load(spark, d, "anki_highfreq", "affix", "example", "gloss_src").where("affix is not null and gloss_src = 'manual'")
    return allomorphs.confirmed(g, cards.select(clean(F.col("affix")).alias("form"), "example"), roots, _freq(spark, d))


@query(
    "top_examples",
    f"WITH {sql.DERIV}, w AS (SELECT affix AS form, CASE WHEN kind = 'p' THEN 'prefix' ELSE 'suffix' END AS pos, word, min(length(word)) AS trust FROM deriv GROUP BY ALL) "
    "SELECT form, pos, word, n FROM (SELECT form, pos, word, row_number() OVER (PARTITION BY form, pos ORDER BY trust, word)::INT AS n FROM w) WHERE n <= 4",
)
def top_examples(spark: SparkSession, d: str) -> DataFrame:
    t = lexicon.derivations(spark, d)
    pos = F.when(F.col("kind") == "p", "prefix").otherwise("suffix")
    return allomorphs.top_examples(t.select(F.col("affix").alias("form"), pos.alias("pos"), "word", F.length("word").alias("trust")))


@query(
    "related_report",
    f"WITH {sql.DERIV} SELECT base, count(*) AS n, list_sort(list(DISTINCT affix))[1:5] AS affixes FROM deriv GROUP BY base ORDER BY n DESC, base LIMIT 20",
)
def related_report(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the twenty bases with the most derivations, and affixes of those only."""
    t = lexicon.derivations(spark, d)
    top = t.groupBy("base").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "base").limit(20)
    few = t.join(top, "base").groupBy("base", "n").agg(F.slice(F.array_sort(F.collect_set("affix")), 1, 5).alias("affixes"))
    return few.select("base", "n", "affixes")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """The splits of the rules, as wanted, against those of the cards; the first stage is the derivation as the table has it first and last."""
    t = lexicon.derivations(spark, d)
    step = lambda best: t.groupBy("word").agg(best(F.concat_ws(".", "base", "affix"), "ord").alias("stage1"))
    shown = lambda df: df.select("word", F.array_join("segments", ".").alias("parts"))
    return etl.mismatch_classes(shown(_rules(spark, d)).join(step(F.min_by), "word", "left"), shown(_cards(spark, d)).join(step(F.max_by), "word", "left"))


_CLASSES = (
    f"{_SPLITS}, st AS (SELECT word, arg_min(base || '.' || affix, ord) AS s1, arg_max(base || '.' || affix, ord) AS s2 FROM deriv GROUP BY word), "
    "cl AS (SELECT r.word, CASE WHEN s1 = s2 AND r.segments = c.segments THEN 'EXACT' WHEN s1 = s2 THEN 'PARTS' WHEN r.segments = c.segments THEN 'STAGE1' ELSE 'BOTH' END AS cls FROM rules r JOIN cards c ON r.word = c.word JOIN st ON st.word = r.word)"
)


@query("mismatch_classes", f"WITH {_CLASSES} SELECT * FROM cl")
def mismatch_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d)


@query(
    "score_report",
    f"WITH {_CLASSES} SELECT rpad(cls, 10, ' ') || lpad(count(*)::VARCHAR, 8, ' ') AS line FROM cl GROUP BY cls UNION ALL SELECT 'score     ' || lpad(format('{{:.1f}}', 100.0 * count_if(cls = 'EXACT') / count(*)), 7, ' ') || '%' FROM cl HAVING count(*) > 0",
)
def score_report(spark: SparkSession, d: str) -> DataFrame:
    """The report as lines of fixed width."""
    return etl.score_lines(_classes(spark, d))


@query(
    "validity_report",
    f"WITH {sql.DERIV}, c AS (SELECT word, base, CASE WHEN kind = 's' AND NOT ends_with(word, affix) OR kind = 'p' AND NOT starts_with(word, affix) THEN 'other_side' WHEN abs(length(word) - length(affix) - length(base)) > 2 THEN 'other_length' ELSE 'valid' END AS cls FROM deriv) "
    "SELECT cls, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 2) AS percent, count(DISTINCT base) AS bases, list_sort(list(DISTINCT word))[1:3] AS examples FROM c GROUP BY cls",
)
def validity_report(spark: SparkSession, d: str) -> DataFrame:
    """The derivations by what is wrong with them, with three words of each class."""
    t = lexicon.derivations(spark, d)
    side = F.when(F.col("kind") == "s", F.endswith("word", "affix")).otherwise(F.startswith("word", "affix"))
    fits = F.abs(F.length("word") - F.length("affix") - F.length("base")) <= 2
    c = t.select("word", "base", F.when(~side, "other_side").when(~fits, "other_length").otherwise("valid").alias("cls"))
    each = c.groupBy("cls").agg(F.count("*").alias("n"), F.count_distinct("base").alias("bases"))
    order = Window.partitionBy("cls").orderBy("word")
    # a rank limit: each task passes on three words of a class
    few = c.select("cls", "word").distinct().withColumn("i", F.row_number().over(order)).where("i <= 3").groupBy("cls").agg(F.array_sort(F.collect_list("word")).alias("examples"))
    total = c.agg(F.count("*").alias("all"))
    return each.join(few, "cls").crossJoin(F.broadcast(total)).select("cls", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("percent"), "bases", "examples")
