"""The engine as one object over a folder of tables; every method gives a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.patterns import has_wildcard
from lexiforge.operators import affixes, lexicon, request, search, segment
from lexiforge.plans import etl_queries, lookup_queries, morph_queries


class Engine:
    """``tables`` is a folder of Parquet tables (``documents``, ``roots``, ``affixes``, ``derivations`` ...).

    The word list, of all texts or of one language, and the index of forms are built at first use and read again as long as the
    tables don't change.
    """

    def __init__(self, spark: SparkSession, tables: str, lang: str | None = None):
        self.spark, self.tables, self.lang = spark, tables, lang

    def _words(self, words: Iterable[str] | DataFrame, column: str = "word") -> DataFrame:
        if isinstance(words, DataFrame):
            return words
        return self.spark.createDataFrame([(w,) for w in words], f"{column} string")

    # the word list and the dictionary

    def index(self) -> DataFrame:
        return lexicon.word_index(self.spark, self.tables, self.lang)

    def words(self) -> DataFrame:
        return lexicon.lexicon(self.spark, self.tables, self.lang)

    def entries(self) -> DataFrame:
        return lookup_queries.entries_of(self.spark, self.tables)

    def lookup(self, words: str | Iterable[str] | DataFrame) -> DataFrame:
        """The entry of a word, or of each of many in one join (``query`` names them)."""
        if isinstance(words, str):
            return search.lookup(self.index(), words)
        return search.lookup_many(self.index(), self._words(words, "query"))

    def pattern_search(self, pattern: str, max_results: int | None = search.MAX_RESULTS, **options) -> DataFrame:
        return search.search(self.words(), pattern, max_results, **options)

    def suggest(self, prefix: str, limit: int = search.SUGGESTIONS) -> DataFrame:
        return search.prefix_search(self.index(), prefix, limit)

    def rank(self, words: Iterable[str] | DataFrame) -> DataFrame:
        return search.rank_of(self.words(), self._words(words, "query"))

    def page(self, pattern: str, number: int = 1) -> DataFrame:
        return request.pattern_page(self.words(), self.entries(), pattern, number)

    # morphology

    def derivations(self) -> DataFrame:
        return lexicon.derivations(self.spark, self.tables)

    def affixes(self) -> DataFrame:
        return lexicon.affix_list(self.derivations())

    def forms(self) -> DataFrame:
        return morph_queries.form_index_of(self.spark, self.tables)

    def segment(self, words: Iterable[str] | DataFrame) -> DataFrame:
        asked = self._words(words).select(F.lower(F.trim("word")).alias("word")).where("word != ''").distinct()
        return segment.segment(asked, self.forms(), affixes.chains(lexicon.reverse_index(self.derivations()), words=asked))

    def analyze_affixes(self, words: Iterable[str] | DataFrame) -> DataFrame:
        return morph_queries.analysis_of(self.spark, self.tables, self._words(words).select(F.lower(F.trim("word")).alias("word")).where("word != ''"))

    def related_words(self, stem: str, combos: list[str] | None = None, max_results: int = search.MAX_RESULTS) -> DataFrame:
        return search.related(self.words(), stem, self.affixes().select("affix"), combos, max_results)

    def request(self, text: str, page: int = 1, literal: bool = False) -> DataFrame:
        """What is shown for a query: the word with its parts and related words, a page of hits of a pattern, or suggestions."""
        if not literal and has_wildcard(text):
            return request.pattern_request(self.words(), self.entries(), text, page)
        entry = search.lookup(self.index(), text).select("row_id", "word")
        if entry.isEmpty():
            return request.suggestions(self.index(), text)
        asked = entry.select(F.lower("word").alias("word"))
        chains = affixes.chains(lexicon.reverse_index(self.derivations()), words=asked)
        return request.word_request(entry, self.entries(), self.words(), self.forms(), chains, self.affixes().select("affix"))

    # builds

    def build_segment_frequencies(self) -> DataFrame:
        return etl_queries.segment_frequencies(self.spark, self.tables)

    def build_affix_table(self) -> DataFrame:
        return etl_queries.affix_table(self.spark, self.tables)

    def build_merged_roots(self) -> DataFrame:
        return etl_queries.merged_roots(self.spark, self.tables)

    def build_small_dictionary(self) -> DataFrame:
        return etl_queries.small_dictionary(self.spark, self.tables)

    def build_allomorph_groups(self) -> DataFrame:
        return etl_queries.graph_groups(self.spark, self.tables)

    def build_confirmed_affixes(self) -> DataFrame:
        return etl_queries.confirmed_affixes(self.spark, self.tables)
