"""Queries of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import strings
from lexiforge.llm import families, fusion, matching, packing, plain_text, tokens, truncation
from lexiforge.runtime import cut, load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    roots = plain_text.changed(load(spark, d, "roots", "entry_id", "meaning"), "roots", "entry_id", "meaning")
    affixes = plain_text.changed(load(spark, d, "high_freq_affixes", "hf_id", "meaning"), "high_freq_affixes", "hf_id", "meaning")
    return roots.unionByName(affixes)


def _fused(spark: SparkSession, d: str, of: Callable[..., DataFrame]) -> list[tuple[str, DataFrame]]:
    groups = load(spark, d, "allomorph_groups", "group_id", "canonical", "pos", "gloss", "gloss_src", "updated_at")
    cards = load(spark, d, "anki_highfreq", "anki_id", "affix", "affix_type", "meaning", "gloss_src", "updated_at")
    return [
        ("allomorph_groups", of(groups, [strings.bare_form(F.col("canonical")), F.col("pos")], "group_id", "gloss", "gloss_src", "updated_at")),
        ("anki_highfreq", of(cards, [strings.bare_form(F.col("affix")), F.col("affix_type")], "anki_id", "meaning", "gloss_src", "updated_at")),
    ]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    (t1, a), (t2, b) = _fused(spark, d, fusion.survivors)
    return a.select(F.lit(t1).alias("tbl"), "row_id").unionByName(b.select(F.lit(t2).alias("tbl"), "row_id"))


def p2_fused(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, field by field, with the posterior of its text, beside the text the votes find likeliest."""
    parts = [
        f.select(F.lit(t).alias("tbl"), F.col("k.k0").alias("form"), F.col("k.k1").alias("kind"), "n", "row_id", "text", "src", F.round("p", 6).alias("p"), "map_text", F.round("map_p", 6).alias("map_p"))
        for t, f in _fused(spark, d, fusion.fuse)
    ]
    return parts[0].unionByName(parts[1])


def _tables(spark: SparkSession, d: str) -> list[DataFrame]:
    roots = load(spark, d, "roots", "entry_id", "base", "meaning", "ety_meaning", "forms")
    return [roots, load(spark, d, "high_freq_affixes", "hf_id", "affix", "affix_type", "meaning"), load(spark, d, "affixes", "affix_id", "roots", "meaning")]


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal records, each named by its least id; ``p5_members`` has all records of a class."""
    return matching.matched_classes(*matching.match_classes(*_tables(spark, d)))


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    roots, frequent, affixes = _tables(spark, d)
    return matching.class_members(matching.classes(matching.all_records(roots, frequent, affixes))[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(*_tables(spark, d)).select("id_a", "id_b")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return families.families(load(spark, d, "allomorph_groups", "group_id", "canonical", "pos", "variants", "edge_types"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(load(spark, d, "documents", "doc_id", "text"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokens.token_counts(load(spark, d, "documents", "doc_id", "text")))
    return packing.pack(sizes, "doc_id", "n_tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, what they hold, and the share of their room that is used."""
    got = packing.fill(p8_packed(spark, d))
    return got.select("bins", "units", "fullest", F.round("fill", 6).alias("fill"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(load(spark, d, "documents", "doc_id", "text", "source")).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", "doc_id", "text", "source")
    return truncation.rates(docs, truncation.truncated(docs))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_fused": p2_fused, "p5_found": p5_found, "p5_matches": p5_matches, "p5_members": p5_members, "p6_found": p6_found, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_found": p9_found, "p9_rates": p9_rates}

_FORM = "regexp_replace(lower({0}), '^[\\s\\p{{Z}}\\p{{Pd}}]+|[\\s\\p{{Z}}\\p{{Pd}}]+$', '', 'g')"
_BARE = "lower(regexp_replace({0}, '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g'))"
_NOTHING = ", ".join(f"'{x}'" for x in fusion.PLACEHOLDERS)


def _survivors(tbl: str, row_id: str, form: str, kind: str, text: str) -> str:
    said = f"CASE WHEN regexp_matches({_BARE.format(text)}, '[\\p{{L}}\\p{{N}}]') AND {_BARE.format(text)} NOT IN ({_NOTHING}) THEN 0 ELSE 1 END"
    tier = f"CASE {_BARE.format('gloss_src')} WHEN 'manual' THEN 0 WHEN 'roots' THEN 1 WHEN 'corpus' THEN 2 ELSE 3 END"
    return (
        f"SELECT '{tbl}' AS tbl, {row_id} AS row_id FROM (SELECT {row_id}, count(*) OVER g AS n, row_number() OVER (PARTITION BY {_FORM.format(form)}, {kind} "
        f"ORDER BY {said}, {tier}, updated_at DESC NULLS LAST, {row_id}) AS i FROM {tbl} WINDOW g AS (PARTITION BY {_FORM.format(form)}, {kind})) WHERE n >= 2 AND i = 1"
    )


_HELD = "len(edge_types) > 0 AND len(list_filter(edge_types, lambda k: coalesce(trim(lower(k)) NOT IN ('gate', 'cross_lang'), TRUE))) = 0"
SQL: dict[str, str] = {
    "p2_found": _survivors("allomorph_groups", "group_id", "canonical", "pos", "gloss") + " UNION ALL " + _survivors("anki_highfreq", "anki_id", "affix", "affix_type", "meaning"),
    "p6_found": (
        f"WITH RECURSIVE f0 AS (SELECT group_id, coalesce(pos, chr(0)) AS pos, unnest(list_append(CASE WHEN coalesce({_HELD}, FALSE) THEN [] ELSE coalesce(variants, []) END, canonical)) AS form FROM allomorph_groups), "
        f"f AS (SELECT DISTINCT group_id, pos, {_FORM.format('form')} AS form FROM f0 WHERE form IS NOT NULL), k AS (SELECT *, min(group_id) OVER w AS least, count(*) OVER w AS n FROM f WHERE form <> '' WINDOW w AS (PARTITION BY pos, form)), "
        "e AS (SELECT DISTINCT group_id AS a, least AS b FROM k WHERE n > 1), bo AS (SELECT a, b FROM e UNION SELECT b, a FROM e), re(v, u) AS (SELECT a, a FROM bo UNION SELECT v, b FROM re JOIN bo ON u = a), "
        "lb AS (SELECT v AS group_id, min(u) AS cluster_id FROM re GROUP BY v) SELECT * FROM lb"
    ),
}
