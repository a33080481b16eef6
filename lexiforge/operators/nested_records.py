"""Deeply nested form records turned into flat tables.

A depth-first traversal with an explicit stack gives every node of a record an interval ``pre, post``
from one clock: a node lies inside another exactly if its interval does. Nodes are emitted as one
table a type (forms, positions, attestations, examples); the enclosing form of a node is the last
form one level up that opened before it in the same record, whose interval contains it. That is a
sort within a record, not a join of all its pairs of nodes.

Accepted shapes: an object from form to body, an array of bodies that name their ``form``, or one of
these under ``list``; ``pos`` a string, an array or missing; ``opt`` a boolean, number, string or
missing; ``sub`` any of the shapes again, to any depth; ``attest`` an array of ``{src, ex: [{w, n}]}``.

Records of any depth are read: where the library's parser would run out of stack, one with a stack of its own goes on.

Defined results: null, empty and unreadable records have no nodes; a body that is not an object counts as an empty one under its
form, and as nothing in an array; blank positions are none; a null form name is ``''``; half surrogate pairs become a replacement character; equal rows
and rows that share an id are each a record of their own, told apart by ``rid``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.runtime import cut

NODE_SCHEMA = "rid bigint, entry_id {id_type}, kind string, pre bigint, post bigint, level int, name string, opt bigint, n bigint"


def as_flag(value) -> int:
    """1 for what says optional, 0 for anything else."""
    if isinstance(value, str):
        return int(value.strip().lower() in ("true", "1", "yes", "y", "t"))
    return int(isinstance(value, (bool, int, float)) and value == 1)


def _bodies(value, named: bool = False) -> list[tuple[str, dict]]:
    """The forms of one container, in order; ``named`` if this is already the content of ``list``."""
    if isinstance(value, list) and value and isinstance(value[0], tuple):  # an object, as pairs
        keys = [k for k, _ in value]
        if not named and len(keys) == 1 and keys[0] in ("list", "forms") and _is_array(value[0][1]):
            return _bodies(value[0][1], True)
        if "form" in keys and not _is_container(dict(value)["form"]):
            return [_named(value)]
        return [(k, dict(v) if _is_object(v) else {}) for k, v in value]
    if isinstance(value, list):
        return [_named(v) for v in value if _is_object(v)]
    return []


def _named(pairs: list) -> tuple[str, dict]:
    body = dict(pairs)
    name = body.get("form")
    return ("" if name is None or _is_container(name) else str(name), body)


def _is_object(value) -> bool:
    return isinstance(value, list) and bool(value) and isinstance(value[0], tuple)


def _is_array(value) -> bool:
    return isinstance(value, list) and not _is_object(value)


def _is_container(value) -> bool:
    return isinstance(value, list)


_TOKEN = re.compile(r"[ \t\n\r]*([{}\[\],:\"]|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_CLOSES = {"{": "}", "[": "]"}


def _parse(text: str):
    """As ``json.loads`` below, for any depth: open containers wait on a list."""
    waiting: list[list] = []  # kind, content, key
    at, want = 0, "value"
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError("no JSON")
        token, at = m.group(1), m.end()
        mark, value = token, None
        if mark == '"':
            value, at = scanstring(text, at, False)
        if want == "colon":
            if mark != ":":
                raise ValueError("no colon")
            want = "value"
            continue
        if want == "comma" and mark == ",":
            want = "key" if waiting[-1][0] == "{" else "value"
            continue
        if want in ("key", "first key") and mark == '"':
            waiting[-1][2], want = value, "colon"
            continue
        if want in ("value", "first value") and mark in _CLOSES:
            waiting.append([mark, [], None])
            want = "first key" if mark == "{" else "first value"
            continue
        if want in ("comma", "first key", "first value") and waiting and mark == _CLOSES[waiting[-1][0]]:
            kind, value, _ = waiting.pop()
            value = value or None if kind == "{" else value
        elif want not in ("value", "first value") or mark in "}],:":
            raise ValueError("a mark out of place")
        elif mark in _WORDS:
            value = _WORDS[mark]
        elif mark != '"':
            value = float(mark) if set(mark) & set(".eE") else int(mark)
        if not waiting:
            if text[at:].strip(" \t\n\r"):
                raise ValueError("something after the record")
            return value
        kind, content, key = waiting[-1]
        content.append((key, value) if kind == "{" else value)
        want = "comma"


def _read(text: str | None):
    """The record with objects as lists of pairs, so that repeated keys stay; None if it can't be read."""
    if not text or not text.strip():
        return None
    try:
        try:
            return json.loads(text, object_pairs_hook=lambda p: p or None, strict=False)
        except RecursionError:
            return _parse(text)
    except ValueError:
        return None


def _strings(value) -> list[str]:
    found = value if _is_array(value) else [value]
    return [x.strip() for x in found if isinstance(x, str) and x.strip()]


def label(text: str | None) -> list[tuple]:
    """``kind, pre, post, level, name, opt, n`` of every node of one record, in order of ``pre``."""
    nodes: list[list] = []
    clock = 0
    stack = [("open", "form", name, body, 0) for name, body in reversed(_bodies(_read(text)))]
    while stack:
        step, kind, name, body, level = stack.pop()
        clock += 1
        if step == "close":
            nodes[name][2] = clock
            continue
        nodes.append([kind, clock, None, level, name, None, None])
        stack.append(("close", kind, len(nodes) - 1, None, level))
        inner: list[tuple] = []
        if kind == "form":
            nodes[-1][5] = as_flag(body.get("opt"))
            inner = [("open", "pos", p, None, level + 1) for p in _strings(body.get("pos"))]
            inner += [("open", "form", n, b, level + 1) for n, b in _bodies(body.get("sub"))]
            attest = body.get("attest")
            inner += [("open", "attest", a.get("src"), a, level + 1) for a in map(dict, filter(_is_object, attest if _is_array(attest) else []))]
        elif kind == "attest":
            ex = body.get("ex")
            inner = [("open", "example", e.get("w"), e, level) for e in map(dict, filter(_is_object, ex if _is_array(ex) else []))]
        elif kind == "example":
            n = body.get("n")
            nodes[-1][6] = n if isinstance(n, int) and not isinstance(n, bool) and abs(n) < 1 << 63 else None
        if kind != "form":
            nodes[-1][4] = name if isinstance(name, str) else None
        stack.extend(reversed(inner))
    for x in nodes:
        if x[4] is not None and not x[4].isascii():
            x[4] = x[4].encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return [tuple(x) for x in nodes]


def nodes(df: DataFrame, id_col: str = "entry_id", json_col: str = "forms") -> DataFrame:
    """All nodes of all records with their interval labels."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("entry_id"), F.col(json_col).cast("string").alias("doc"))
    rows = rows.where(F.length(F.trim("doc")) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        names = ["rid", "entry_id", "kind", "pre", "post", "level", "name", "opt", "n"]
        for batch in batches:
            of, out = [], []
            for row, doc in enumerate(batch["doc"].to_pylist()):
                found = label(doc)
                of += [row] * len(found)
                out += found
            if out:
                at = pa.array(of, pa.int64())
                columns = [batch["rid"].take(at), batch["entry_id"].take(at)]
                columns += [pa.array(x, k) for x, k in zip((list(x) for x in zip(*out)), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, NODE_SCHEMA.format(id_type=id_type))


def linked(all_nodes: DataFrame) -> DataFrame:
    """Every node with its enclosing form: ``in_pre``, ``in_form`` and ``in_opt``, null at the top."""
    as_marker = F.when(F.col("kind") == "form", F.struct("pre", "post", "name", "opt"))
    entry = F.explode(
        F.when(
            F.col("kind") == "form",
            F.array(F.struct(F.col("level").alias("at"), F.lit(False).alias("marks")), F.struct((F.col("level") + 1).alias("at"), F.lit(True).alias("marks"))),
        ).otherwise(F.array(F.struct(F.col("level").alias("at"), F.lit(False).alias("marks"))))
    )
    rows = all_nodes.withColumn("_e", entry).withColumn("_m", F.when(F.col("_e.marks"), as_marker))
    before = Window.partitionBy("rid", "_e.at").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_f", F.last("_m", ignorenulls=True).over(before)).where(~F.col("_e.marks"))
    inside = (F.col("_f.pre") < F.col("pre")) & (F.col("post") < F.col("_f.post"))
    return rows.select(
        *all_nodes.columns,
        F.when(inside, F.col("_f.pre")).alias("in_pre"),
        F.when(inside, F.col("_f.name")).alias("in_form"),
        F.when(inside, F.col("_f.opt")).alias("in_opt"),
    )


def forms_table(links: DataFrame) -> DataFrame:
    f = links.where(F.col("kind") == "form")
    return f.select("rid", "entry_id", "pre", "post", "level", F.col("name").alias("form"), "opt", F.col("in_pre").alias("parent_pre"), F.coalesce("in_form", F.lit("")).alias("parent_form"))


def positions_table(links: DataFrame) -> DataFrame:
    p = links.where(F.col("kind") == "pos")
    return p.select("rid", "entry_id", "pre", "post", F.col("in_pre").alias("form_pre"), F.col("in_form").alias("form"), F.col("name").alias("pos"))


def attestations_table(links: DataFrame) -> DataFrame:
    a = links.where(F.col("kind") == "attest")
    return a.select("rid", "entry_id", "pre", "post", F.col("in_pre").alias("form_pre"), F.col("in_form").alias("form"), F.col("name").alias("src"))


def examples_table(links: DataFrame) -> DataFrame:
    """Examples with the attestation they lie in; the form is the enclosing one of both."""
    e = links.where(F.col("kind").isin("example", "attest"))
    before = Window.partitionBy("rid", "in_pre").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.last(F.when(F.col("kind") == "attest", F.struct("pre", "post", "name")), ignorenulls=True).over(before)
    e = e.withColumn("_a", at).where(F.col("kind") == "example")
    return e.select("rid", "entry_id", "pre", "post", F.col("_a.pre").alias("attest_pre"), F.col("in_form").alias("form"), F.col("_a.name").alias("src"), F.col("name").alias("word"), "n")


def form_positions(df: DataFrame, id_col: str = "entry_id", json_col: str = "forms") -> DataFrame:
    """``entry_id, parent_form, form, opt, pos``: each position of each form; ``pos`` is ``''`` for a form with none."""
    # written once, as both tables below must see the same numbers of records
    links = linked(cut(nodes(df, id_col, json_col).where(F.col("kind").isin("form", "pos"))))
    forms = forms_table(links).select("rid", "entry_id", "pre", "parent_form", "form", "opt")
    positions = positions_table(links).select("rid", F.col("form_pre").alias("pre"), "pos")
    joined = forms.join(positions, ["rid", "pre"], "left")
    return joined.select("entry_id", "parent_form", "form", "opt", F.coalesce("pos", F.lit("")).alias("pos"))
