"""Pattern search, lookup, paging, ranks and related words over the list of words derived from the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import strings
from lexiforge.operators import lexicon, request, search
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


def _any_pair(end: str, pairs: str) -> str:
    return f"len(list_filter([{pairs}], lambda p: {end})) > 0"


# What the placeholders stand for, written out once more for the SQL side.
_PAIRS = "'ai', 'ay', 'ee', 'ea', 'oa', 'oo', 'ie', 'ei', 'ey', 'au', 'aw', 'ow', 'ou', 'oi', 'oy', 'ue', 'ui', 'eu', 'ew', 'oe'"
_TWO = (
    "'sp', 'st', 'tr', 'cr', 'gr', 'fr', 'pr', 'br', 'dr', 'pl', 'bl', 'cl', 'fl', 'gl', 'sl', 'sc', 'sk', 'sm', 'sn', 'sw', "
    "'tw', 'dw', 'qu', 'kn', 'wr', 'wh', 'th', 'ch', 'sh', 'ph', 'gn', 'rh'"
)
_THREE = "'str', 'spr', 'scr', 'spl', 'thr', 'shr', 'squ', 'sph', 'sch'"

#: name -> pattern, and what it means in SQL; each is searched with a cap of 50.
PATTERNS = {
    "suffix": ("*ing", "word GLOB '*ing'"),
    "leading": ("pre*", "starts_with(word, 'pre')"),
    "middle": ("*tic*", "contains(word, 'tic')"),
    "single": ("c.t*", "word LIKE 'c_t%'"),
    "vowel": ("cAn*", "word GLOB 'c[aeiou]n*'"),
    "vowel_pair": ("*AAt*", _any_pair("contains(word, p || 't')", _PAIRS)),
    "consonants": ("TT*ing", _any_pair("starts_with(word, p) AND ends_with(word, 'ing') AND length(word) >= 5", _TWO)),
    "cluster3": ("TTT*", _any_pair("starts_with(word, p)", _THREE)),
    "class": ("[a-c]*[^x]t", "substr(word, 1, 1) IN ('a', 'b', 'c') AND length(word) >= 3 AND right(word, 1) = 't' AND substr(right(word, 2), 1, 1) <> 'x'"),
    "range": ("p[a-o]*l*", "substr(word, 1, 1) = 'p' AND substr(word, 2, 1) BETWEEN 'a' AND 'o' AND instr(substr(word, 3), 'l') > 0"),
    "negated": ("re^i*", "starts_with(word, 're') AND length(word) >= 3 AND substr(word, 3, 1) <> 'i'"),
    "product": ("TTAA*", _any_pair(f"starts_with(word, p) AND substr(word, 3, 2) IN ({_PAIRS})", _TWO)),
    "literal": ("the", "word = 'the'"),
    "none": ("zzzzz*", "starts_with(word, 'zzzzz')"),
}


def _search_sql(condition: str, limit: str = "LIMIT 50") -> str:
    return f"WITH {sql.LEX} SELECT word, min(frequency) AS frequency FROM lex WHERE {condition} GROUP BY word ORDER BY frequency, word {limit}"


for _name, (_pattern, _condition) in PATTERNS.items():
    query(f"search_{_name}", _search_sql(_condition))(lambda spark, d, p=_pattern: search.search(lexicon.lexicon(spark, d), p))


@query("search_symmetric", f"WITH {sql.LEX} SELECT CASE WHEN starts_with(word, 'tr') THEN 'first' ELSE 'second' END AS side, word FROM lex WHERE (starts_with(word, 'tr') AND NOT ends_with(word, 't')) OR (NOT starts_with(word, 'tr') AND ends_with(word, 't'))")
def search_symmetric(spark: SparkSession, d: str) -> DataFrame:
    """What one of two patterns finds and the other doesn't."""
    lex = lexicon.lexicon(spark, d)
    return search.symmetric_difference(search.search(lex, "tr*", None), search.search(lex, "*t", None))


@query("search_bare", f"WITH {sql.LEX} SELECT 'first' AS side, word FROM lex WHERE FALSE")
def search_bare(spark: SparkSession, d: str) -> DataFrame:
    """A pattern without brackets and the same with them find the same words."""
    lex = lexicon.lexicon(spark, d)
    return search.symmetric_difference(search.search(lex, "cAn*"), search.search(lex, "c[A]n*"))


@query("ranked_list", f"WITH {sql.LEX} SELECT word, cnt, frequency FROM lex")
def ranked_list(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.lexicon(spark, d)


@query("word_min_rank", f"WITH {sql.INDEX} SELECT lower(word) AS word, min(row_id) AS frequency FROM idx GROUP BY lower(word)")
def word_min_rank(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.word_index(spark, d).groupBy(F.lower("word").alias("word")).agg(F.min("row_id").alias("frequency"))


@query("search_all_patterns", _search_sql("contains(word, 'pig') OR contains(word, 'ing') OR contains(word, 'qu')"))
def search_all_patterns(spark: SparkSession, d: str) -> DataFrame:
    return search.search_any(lexicon.lexicon(spark, d), ["*pig*", "*ing*", "*qu*"])


@query("search_total", f"WITH {sql.COUNTS} SELECT count(*) AS total_exact, least(count(*), 50) AS total_capped FROM lexc WHERE word LIKE '%or%'")
def search_total(spark: SparkSession, d: str) -> DataFrame:
    return search.search_total(lexicon.word_counts(spark, d).withColumn("frequency", F.lit(0)), "*or*")


@query("search_like", f"WITH {sql.INDEX} SELECT row_id, word, word_lower, cnt FROM idx WHERE word_lower LIKE 'c_m%' ORDER BY row_id LIMIT 50")
def search_like(spark: SparkSession, d: str) -> DataFrame:
    return search.like_search(lexicon.word_index(spark, d), "c.m*")


@query("search_prefix", f"WITH {sql.INDEX} SELECT row_id, word, word_lower, cnt FROM idx WHERE starts_with(word_lower, 'co') ORDER BY row_id LIMIT 20")
def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.prefix_search(lexicon.word_index(spark, d), "Co")


@query("search_roots_star", "SELECT entry_id, base FROM roots WHERE regexp_full_match(lower(base), 'b.*t')")
def search_roots_star(spark: SparkSession, d: str) -> DataFrame:
    return search.star_search(load(spark, d, "roots", "entry_id", "base"), "base", "B*t")


_HF = "hf AS (SELECT trim(trim(lower(affix), '-')) AS form, affix, affix_type, meaning, example, hf_id FROM high_freq_affixes WHERE trim(trim(affix, '-')) <> '')"


@query(
    "search_morphemes",
    f"WITH {_HF}, m AS (SELECT * FROM hf WHERE regexp_full_match(form, '.*ar.*')) SELECT 'affix' AS src, form, affix AS base, CASE affix_type WHEN 'prefix' THEN 'prefix' WHEN 'suffix' THEN 'suffix' ELSE coalesce(nullif(affix_type, ''), '-') END AS pos, meaning, example, "
    "(SELECT count(*) FROM m) AS total, (SELECT count(DISTINCT form) FROM m) AS forms, row_number() OVER (ORDER BY form, affix, hf_id) AS n FROM m",
)
def search_morphemes(spark: SparkSession, d: str) -> DataFrame:
    """The report of a star search over the frequent affixes: sorted, with the totals."""
    return search.morpheme_report(None, load(spark, d, "high_freq_affixes", "hf_id", "affix", "affix_type", "meaning", "example"), "*ar*")


@query("search_root_report")
def search_root_report(spark: SparkSession, d: str) -> DataFrame:
    """The same over the root forms and the frequent affixes."""
    from lexiforge.plans.morph_queries import form_index_of

    return search.morpheme_report(form_index_of(spark, d), load(spark, d, "high_freq_affixes", "hf_id", "affix", "affix_type", "meaning", "example"), "*ar*t*")


@query(
    "search_keyword",
    "SELECT entry_id, base FROM roots WHERE contains(lower(base), 'gl') OR len(list_filter(string_split(lower(meaning), ';'), lambda x: contains(x, 'gold'))) > 0",
)
def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "roots", "entry_id", "base", "meaning")
    return r.where(F.lower("base").contains("gl") | F.exists(F.split(F.lower("meaning"), ";"), lambda x: x.contains("gold"))).select("entry_id", "base")


def _asked(spark: SparkSession) -> DataFrame:
    words = ["the", " The ", "word", "Word", "qqqq", "prefix", "PREFIX", "list", "gloss", "", "Entry", "zzz"]
    return spark.createDataFrame([(w,) for w in words], "query string")


_ASKED = "asked AS (SELECT DISTINCT trim(q) AS query FROM (VALUES ('the'), (' The '), ('word'), ('Word'), ('qqqq'), ('prefix'), ('PREFIX'), ('list'), ('gloss'), (''), ('Entry'), ('zzz')) v(q) WHERE trim(q) <> '')"


@query(
    "lookup_many",
    f"WITH {sql.INDEX}, {_ASKED}, hits AS (SELECT query, row_id, word, word = query AS exact, row_number() OVER (PARTITION BY query ORDER BY word <> query, row_id) AS n "
    "FROM asked JOIN idx ON lower(query) = word_lower) SELECT query, row_id, word, exact FROM hits WHERE n = 1",
)
def lookup_many(spark: SparkSession, d: str) -> DataFrame:
    return search.lookup_many(lexicon.word_index(spark, d), _asked(spark))


@query("lookup_one", f"WITH {sql.INDEX} SELECT row_id, word, word = 'Prefix' AS exact FROM idx WHERE word_lower = 'prefix' ORDER BY word <> 'Prefix', row_id LIMIT 1")
def lookup_one(spark: SparkSession, d: str) -> DataFrame:
    return search.lookup(lexicon.word_index(spark, d), " Prefix ")


@query("lookup_suggest", f"WITH {sql.INDEX} SELECT 'suggestion' AS kind, word, row_id FROM idx WHERE starts_with(word_lower, 'comp') AND word_lower <> 'comp' ORDER BY row_id LIMIT 10")
def lookup_suggest(spark: SparkSession, d: str) -> DataFrame:
    return search.dispatch(lexicon.word_index(spark, d), lexicon.lexicon(spark, d), "comp")


@query("lookup_pattern", f"WITH {sql.LEX} SELECT 'pattern' AS kind, word, frequency AS row_id FROM lex WHERE word LIKE 'com%' ORDER BY frequency, word LIMIT 50")
def lookup_pattern(spark: SparkSession, d: str) -> DataFrame:
    return search.dispatch(lexicon.word_index(spark, d), lexicon.lexicon(spark, d), "com*")


@query("lookup_by_row", f"WITH {sql.INDEX} SELECT row_id, word, word_lower, cnt FROM idx WHERE row_id = 77")
def lookup_by_row(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.word_index(spark, d).where("row_id = 77")


@query("original_case", f"WITH {sql.INDEX} SELECT word_lower, arg_min(word, row_id) AS word FROM idx GROUP BY word_lower")
def original_case(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.word_index(spark, d).groupBy("word_lower").agg(F.min_by("word", "row_id").alias("word"))


@query("rank_of_words", f"WITH {sql.LEX}, {_ASKED.replace('DISTINCT trim(q)', 'q').replace(' WHERE trim(q) <> ' + chr(39) * 2, '')} SELECT query, frequency FROM asked LEFT JOIN lex ON lower(trim(query)) = word")
def rank_of_words(spark: SparkSession, d: str) -> DataFrame:
    return search.rank_of(lexicon.lexicon(spark, d), _asked(spark))


@query(
    "known_words",
    f"WITH {sql.COUNTS} SELECT DISTINCT lower(headword) AS word FROM documents WHERE length(headword) >= 2 AND lower(headword) IN (SELECT word FROM lexc)",
)
def known_words(spark: SparkSession, d: str) -> DataFrame:
    words = load(spark, d, "documents", "headword").select(F.lower("headword").alias("word")).distinct()
    return search.known_words(words, lexicon.word_counts(spark, d))


@query(
    "page_of_hits",
    f"WITH {sql.LEX}, hits AS (SELECT word, frequency FROM lex WHERE word LIKE '%ing%' ORDER BY frequency, word LIMIT 50), n AS (SELECT greatest(1, ceil(count(*) / 10.0))::INT AS pages FROM hits), "
    "r AS (SELECT *, row_number() OVER (ORDER BY frequency, word) - 1 AS i FROM hits) SELECT word, frequency, pages FROM r, n WHERE i // 10 = least(2, pages) - 1",
)
def page_of_hits(spark: SparkSession, d: str) -> DataFrame:
    return search.page(search.search(lexicon.lexicon(spark, d), "*ing*"), 2)


@query(
    "page_numbers",
    f"WITH {sql.LEX} SELECT word, frequency, (frequency - 1) // 10 + 1 AS page, (frequency - 1) % 10 + 1 AS row_in_page, greatest(0, least(10, 2000 - (frequency - 1) // 10 * 10)) AS ranked_on_page FROM lex",
)
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("frequency") - 1
    start = F.floor(at / 10)
    on_page = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(10).cast("bigint"), 2000 - start * 10))
    return lexicon.lexicon(spark, d).select("word", "frequency", (start + 1).alias("page"), (at % 10 + 1).alias("row_in_page"), on_page.alias("ranked_on_page"))


_ENTRY = "html AS (SELECT lower(headword) AS word, arg_min(text, doc_id) AS html FROM documents WHERE text LIKE '<div class=\"gdc\">%' AND headword IS NOT NULL GROUP BY 1)"
_SHORT = "regexp_replace(regexp_extract(html, '<div class=\"coca2\">([^\\n]*?)</div>', 1), '<[^>]*>', '', 'g')"
_BLOCK = "regexp_replace(regexp_extract(html, '(?s)<div class=\"gdc\">(.*?)</div>.*?</div>', 1), '<[^>]*>', '', 'g')"
_PAGE = (
    f"WITH {sql.LEX}, hits AS (SELECT word, frequency FROM lex WHERE contains(word, 'orin') ORDER BY frequency, word LIMIT 50), total AS (SELECT count(*) AS total, greatest(1, ceil(count(*) / 10.0))::INT AS pages FROM hits), "
    "pg AS (SELECT *, row_number() OVER (ORDER BY frequency, word) AS n FROM hits), one AS (SELECT pg.*, total, pages FROM pg, total WHERE (n - 1) // 10 = least(2, pages) - 1), "
    f"{_ENTRY}, pe AS (SELECT one.*, html, instr(one.word, 'orin') AS i FROM one LEFT JOIN html USING (word)) "
    "SELECT word, frequency, (n - 1) % 10 + 1 AS n, least(2, pages) AS page, pages, total, substr(word, 1, i - 1) || '<span class=\"hit\">orin</span>' || substr(word, i + 4) AS shown, "
    f"coalesce(trim(regexp_extract(html, '<span class=\"ipa\">([^<]*)</span>', 1)), '') AS ipa, coalesce(nullif(trim({_SHORT}), ''), nullif(trim({_BLOCK}), ''), '') AS summary, "
    "nullif(trim(regexp_replace(regexp_split_to_array(regexp_replace(regexp_extract(html, '(?s)<div class=\"coca2\">(.*?)</div>', 1), '<[^>]*>', '', 'g'), '[,，]')[1], '[(（][^)）]*[)）]', '', 'g')), '') AS definition, html IS NOT NULL AS has_full FROM pe"
)


def entries_of(spark: SparkSession, d: str) -> DataFrame:
    """``word, html``: the first dictionary entry of each head word."""
    docs = load(spark, d, "documents", "doc_id", "headword", "text").where(F.col("text").startswith('<div class="gdc">') & F.col("headword").isNotNull())
    return docs.groupBy(F.lower("headword").alias("word")).agg(F.min_by("text", "doc_id").alias("html"))


@query("enriched_page", _PAGE)
def enriched_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a pattern's hits with what is shown of each."""
    return request.pattern_page(lexicon.lexicon(spark, d), entries_of(spark, d), "*orin*", 2)


def _engine(spark: SparkSession, d: str):
    from lexiforge.engine import Engine

    return Engine(spark, d)


@query(
    "request_suggestions",
    f"WITH {sql.INDEX} SELECT 'suggestion' AS kind, row_number() OVER (ORDER BY row_id) AS n, word, NULL AS shown, NULL AS text, row_id AS frequency, NULL::INT AS score FROM idx WHERE starts_with(word_lower, 'qua') ORDER BY row_id LIMIT 10",
)
def request_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """A request for what is no word: words that begin alike."""
    return _engine(spark, d).request("Qua")


@query("request_word")
def request_word(spark: SparkSession, d: str) -> DataFrame:
    """A request for a word, here the longest head word: its entry, its parts, and words related to the stem, marked."""
    top = load(spark, d, "documents", "headword").where("headword is not null").select(F.lower("headword").alias("w")).orderBy(F.desc(F.length("w")), "w").first()
    return _engine(spark, d).request(top["w"] if top else "a")


@query("request_pattern", "SELECT 'hit' AS kind, n, word, shown, summary AS text, frequency, NULL::INT AS score FROM (" + _PAGE + ")")
def request_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).request("*orin*", 2)


def _related_sql(stem: str) -> str:
    return (
        f"WITH {sql.LEX}, {sql.AFFIXES}, near AS (SELECT word, frequency, instr(word, '{stem}') AS i FROM lex WHERE contains(word, '{stem}') AND word <> '{stem}' ORDER BY frequency, word LIMIT 90), "
        f"parts AS (SELECT word, frequency, substr(word, 1, i - 1) AS b, substr(word, i + {len(stem)}) AS a FROM near) SELECT word, "
        "(CASE WHEN b = '' OR b IN (SELECT affix FROM aff) THEN 0 ELSE 1 END + CASE WHEN a = '' OR a IN (SELECT affix FROM aff) THEN 0 ELSE 1 END)::INT AS score, frequency "
        "FROM parts ORDER BY score, frequency, word LIMIT 30"
    )


for _stem in ("ravelod", "lead", "or"):

    @query(f"related_{_stem}", _related_sql(_stem))
    def related(spark: SparkSession, d: str, stem=_stem) -> DataFrame:
        affixes = lexicon.affix_list(lexicon.derivations(spark, d)).select("affix")
        return search.related(lexicon.lexicon(spark, d), stem, affixes, max_results=30)


@query(
    "related_combos",
    _related_sql("or").replace("b = '' OR b IN (SELECT affix FROM aff)", "b = '' OR b IN (SELECT affix FROM aff) OR b LIKE '%qu%' OR b LIKE '%in'").replace("a = '' OR a IN (SELECT affix FROM aff)", "a = '' OR a IN (SELECT affix FROM aff) OR a LIKE '%qu%' OR a LIKE '%in'"),
)
def related_combos(spark: SparkSession, d: str) -> DataFrame:
    """Remainders are also explained by combinations given as regular expressions; those that are none are skipped."""
    affixes = lexicon.affix_list(lexicon.derivations(spark, d)).select("affix")
    return search.related(lexicon.lexicon(spark, d), "or", affixes, combos=["qu", "in$", "(unclosed", ""], max_results=30)


@query("derived_words", f"WITH {sql.DERIV}, d AS (SELECT DISTINCT base, word FROM deriv) SELECT base, word FROM d WHERE base IN (SELECT base FROM d GROUP BY base HAVING count(*) > 1)")
def derived_words(spark: SparkSession, d: str) -> DataFrame:
    """The forward adjacency of the bases with several words, one row a word."""
    each = lexicon.derivations(spark, d).select("base", "word").distinct()
    several = each.groupBy("base").agg(F.count("*").alias("n")).where("n > 1")
    return each.join(several.select("base"), "base", "left_semi")


@query("duplicate_forms", "SELECT trim(trim(lower(affix), '-')) AS form, count(*) AS n FROM high_freq_affixes WHERE affix IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_forms(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "high_freq_affixes", "affix").where("affix is not null")
    return a.groupBy(strings.strip_dashes(F.lower("affix")).alias("form")).agg(F.count("*").alias("n")).where("n > 1")


@query(
    "morphemes_by_type",
    "WITH m AS (SELECT affix_type AS kind, trim(trim(affix, '-')) AS form, hf_id AS id FROM high_freq_affixes WHERE affix_type IN ('prefix', 'suffix') AND affix IS NOT NULL UNION ALL SELECT 'root', trim(base), entry_id FROM roots WHERE base IS NOT NULL) "
    "SELECT * FROM (SELECT kind, form, row_number() OVER (PARTITION BY kind ORDER BY length(form) DESC, form, id) AS n FROM m) WHERE n <= 20",
)
def morphemes_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The longest forms of each type."""
    t = load(spark, d, "high_freq_affixes", "hf_id", "affix", "affix_type").where("affix is not null")
    roots = load(spark, d, "roots", "entry_id", "base").where("base is not null")
    rows = t.where(F.col("affix_type").isin("prefix", "suffix")).select(F.col("affix_type").alias("kind"), strings.strip_dashes(F.col("affix")).alias("form"), F.col("hf_id").alias("id"))
    return search.longest_of_each(rows.unionByName(roots.select(F.lit("root").alias("kind"), F.trim("base").alias("form"), F.col("entry_id").alias("id"))), ["prefix", "suffix", "root"], 20)


@query(
    "upsert_affixes",
    "WITH new AS (SELECT affix_id AS id, trim(trim(lower(roots), '-')) AS bare, CASE WHEN trim(roots) LIKE '-%-' THEN 'root' WHEN trim(roots) LIKE '-%' THEN 'suffix' WHEN trim(roots) LIKE '%-' THEN 'prefix' END AS kind, meaning FROM affixes WHERE roots IS NOT NULL), "
    "nd AS (SELECT CASE kind WHEN 'root' THEN '-' || bare || '-' WHEN 'prefix' THEN bare || '-' WHEN 'suffix' THEN '-' || bare ELSE bare END AS form, id, meaning FROM new WHERE bare <> ''), n1 AS (SELECT form, arg_max(meaning, id) AS meaning FROM nd WHERE meaning IS NOT NULL GROUP BY form), "
    "od AS (SELECT CASE affix_type WHEN 'root' THEN '-' || trim(trim(lower(affix), '-')) || '-' WHEN 'prefix' THEN trim(trim(lower(affix), '-')) || '-' WHEN 'suffix' THEN '-' || trim(trim(lower(affix), '-')) ELSE trim(trim(lower(affix), '-')) END AS form, hf_id, meaning FROM high_freq_affixes WHERE trim(trim(affix, '-')) <> ''), "
    "old AS (SELECT form, arg_max(meaning, hf_id) AS meaning FROM od WHERE meaning IS NOT NULL GROUP BY 1) SELECT form, meaning FROM n1 UNION ALL SELECT form, meaning FROM old WHERE form NOT IN (SELECT form FROM n1)",
)
def upsert_affixes(spark: SparkSession, d: str) -> DataFrame:
    """New entries replace old ones of the same dashed form (``-x-``, ``x-``, ``-x`` by type); the old ones without a new entry stay."""
    kind = strings.affix_position(F.trim("roots"))
    new = load(spark, d, "affixes", "affix_id", "roots", "meaning").select(strings.dashed(strings.strip_dashes(F.lower("roots")), kind).alias("form"), "meaning", F.col("affix_id").alias("id"))
    old = load(spark, d, "high_freq_affixes", "hf_id", "affix", "affix_type", "meaning").select(strings.dashed(strings.strip_dashes(F.lower("affix")), F.col("affix_type")).alias("form"), "meaning", F.col("hf_id").alias("id"))
    return search.upserted(old, new)


@query(
    "quality_filters",
    "SELECT count(*) AS n, count_if(meaning IS NULL)::BIGINT AS nulls, count_if(meaning = '')::BIGINT AS empties, count_if(trim(coalesce(meaning, '')) <> '')::BIGINT AS filled FROM roots",
)
def quality_filters(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "roots", "meaning")
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("meaning").isNull()).alias("nulls"), F.count_if(F.col("meaning") == "").alias("empties"), F.count_if(F.trim(F.coalesce("meaning", F.lit(""))) != "").alias("filled"))


@query("sample_rows", "SELECT count(*) AS n, count(*) AS known FROM (SELECT entry_id FROM roots LIMIT 20)")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rows drawn by a seeded hash, the same ones on any cluster; how many there are, and how many of them are in the table."""
    t = load(spark, d, "roots", "entry_id", "base")
    drawn = search.sampled(t, "entry_id", 20)
    return drawn.agg(F.count("*").alias("n")).crossJoin(drawn.join(t.select("entry_id"), "entry_id", "left_semi").agg(F.count("*").alias("known")))
