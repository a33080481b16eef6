"""Queries of the core operators and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import nested_records as nested
from lexiforge.operators import packed_fields as packed
from lexiforge.runtime import load


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    fields = [("roots", "entry_id", "ext", packed.MARKED), ("roots", "entry_id", "meaning", packed.SENSES), ("etym_dictionary", "etym_id", "roots", packed.MARKED)]
    parts = [
        packed.split_packed(load(spark, d, t, i, c), i, c, dialect, least=2).select(F.lit(f"{t}.{c}").alias("field"), "row_id", "item_no", "item")
        for t, i, c, dialect in fields
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.form_positions(load(spark, d, "roots", "entry_id", "forms"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return nested.linked(nested.nodes(load(spark, d, "roots", "entry_id", "forms")))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return nested.forms_table(_links(spark, d)).drop("rid")


def p4_attestations(spark: SparkSession, d: str) -> DataFrame:
    return nested.attestations_table(_links(spark, d)).drop("rid")


def p4_examples(spark: SparkSession, d: str) -> DataFrame:
    return nested.examples_table(_links(spark, d)).drop("rid")


QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p4_attestations": p4_attestations,
    "p4_examples": p4_examples,
}

# The forms of a container of any of the accepted shapes, as a list of names and bodies; and the containers within, by recursion.
_NAMED = "{{'f': coalesce(CASE WHEN json_type({0}->'form') IN ('OBJECT', 'ARRAY') THEN '' ELSE {0}->>'form' END, ''), 'b': {0}}}"
_ITEMS = (
    "CASE WHEN arr IS NOT NULL THEN list_transform(list_filter(CAST(arr AS JSON[]), lambda e: json_type(e) = 'OBJECT' AND len(json_keys(e)) > 0), lambda e: " + _NAMED.format("e") + ") "
    "WHEN json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'form') AND json_type(j->'form') NOT IN ('OBJECT', 'ARRAY') THEN [" + _NAMED.format("j") + "] "
    "WHEN json_type(j) = 'OBJECT' THEN list_transform(json_keys(j), lambda k: {'f': k, 'b': CASE WHEN json_type(j->k) = 'OBJECT' THEN j->k ELSE '{}'::JSON END}) ELSE [] END"
)
_ARR = "CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) = 1 AND json_keys(j)[1] IN ('list', 'forms') AND json_type(j->(json_keys(j)[1])) = 'ARRAY' THEN j->(json_keys(j)[1]) END"
_BODIES = f"SELECT rid, entry_id, parent, unnest({_ITEMS}) AS x FROM (SELECT *, {_ARR} AS arr FROM "
_SUB = "(SELECT rid, entry_id, form AS parent, b->'sub' AS j FROM lv WHERE json_type(b->'sub') IN ('OBJECT', 'ARRAY'))"
_OPT = (
    "CASE json_type(b->'opt') WHEN 'BOOLEAN' THEN (b->>'opt' = 'true')::BIGINT WHEN 'VARCHAR' THEN (lower(trim(b->>'opt')) IN ('true', '1', 'yes', 'y', 't'))::BIGINT "
    "ELSE coalesce((TRY_CAST(b->>'opt' AS DOUBLE) = 1)::BIGINT, 0) END"
)
_POS = (
    "list_filter(CASE json_type(b->'pos') WHEN 'VARCHAR' THEN [trim(b->>'pos')] WHEN 'ARRAY' THEN list_transform(list_filter(CAST(b->'pos' AS JSON[]), lambda e: json_type(e) = 'VARCHAR'), lambda e: trim(e->>'$')) ELSE [] END, lambda t: t <> '')"
)
FORMS_SQL = (
    "WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, entry_id, '' AS parent, forms::JSON AS j FROM roots WHERE json_valid(forms)), "
    f"lv AS (SELECT rid, entry_id, parent, x.f AS form, x.b AS b FROM ({_BODIES} src)) UNION ALL SELECT rid, entry_id, parent, x.f, x.b FROM ({_BODIES} {_SUB}))), "
    f"nd AS (SELECT entry_id, parent, form, {_OPT} AS opt, {_POS} AS ps FROM lv)"
)
SQL: dict[str, str] = {
    "p4_found": FORMS_SQL + " SELECT entry_id, parent AS parent_form, form, opt, unnest(CASE WHEN len(ps) = 0 THEN [''] ELSE ps END) AS pos FROM nd",
}
