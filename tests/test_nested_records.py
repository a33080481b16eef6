import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.operators import nested_records as N


def rows(spark, docs, f=N.form_positions):
    df = spark.createDataFrame([(i, d, "clash", 1) for i, d in enumerate(docs)], "entry_id bigint, forms string, kind string, pre bigint")
    return sorted(tuple(r) for r in f(df).collect())


def test_shapes(spark):
    docs = [
        '{"a": {"opt": "true", "pos": "root", "sub": [{"form": "ab", "opt": 1, "pos": ["suffix", "root"], "sub": {"abc": {}}}]}}',
        '{"list": [{"form": "x", "pos": null}, {"form": "y", "pos": [""]}]}',
        "[]", "{}", "null", "", None, '{"cut": {"po', '{"a": null, "b": {"opt": false}}', '["a", 3]',
    ]
    assert rows(spark, docs) == [
        (0, "", "a", 1, "root"), (0, "a", "ab", 1, "root"), (0, "a", "ab", 1, "suffix"), (0, "ab", "abc", 0, ""),
        (1, "", "x", 0, ""), (1, "", "y", 0, ""), (8, "", "a", 0, ""), (8, "", "b", 0, ""),
    ]


def test_repeated_rows_and_ids_stay_apart(spark):
    df = spark.createDataFrame([(1, '{"a": {"sub": {"b": {}}}}'), (1, '{"a": {"sub": {"b": {}}}}'), (1, '{"c": {"sub": {"b": {}}}}')], "entry_id bigint, forms string")
    got = sorted(tuple(r)[1:3] for r in N.form_positions(df).collect())
    assert got == [("", "a"), ("", "a"), ("", "c"), ("a", "b"), ("a", "b"), ("c", "b")]


def test_deep_and_wide(spark):
    deep = "{}"
    for i in range(150):
        deep = '{"f%d": {"sub": %s}}' % (i, deep)
    wide = json.dumps({f"w{i}": {"pos": ["root"]} for i in range(3000)})
    nest = lambda n: '{"a":{"sub":' * n + '{"b": {}}' + "}}" * n
    got = rows(spark, [deep, wide, nest(950), nest(2000), nest(60_000), nest(60_000)[:-1]])
    count = lambda i: sum(r[0] == i for r in got)
    assert [count(i) for i in range(6)] == [150, 3000, 951, 2001, 60_001, 0]
    assert ("f149", "f148") in {(r[1], r[2]) for r in got if r[0] == 0}


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(-1e6, 1e6) | st.text("ab\\\"\n\u00e9,:]}", max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("ab", max_size=2), inner, max_size=3), max_leaves=10,
)


@settings(max_examples=150, deadline=None)
@given(json_values, st.integers(0, 6), st.sampled_from(["", "]", "}", ",", ":", " 1", '"', "tru"]))
def test_own_parser_equals_the_library(value, cut, more):
    text = json.dumps(value, indent=1 if cut % 2 else None)
    for t in (text, text[: len(text) - cut] + more, more + text):
        try:
            want = json.loads(t, object_pairs_hook=lambda p: p or None, strict=False)
        except ValueError:
            want = ValueError
        try:
            got = N._parse(t)
        except ValueError:
            got = ValueError
        assert got == want


def test_half_surrogates(spark):
    assert rows(spark, ['{"a\\ud800": {}, "\\ud83d\\ude00": {}}']) == [(0, "", "a\ufffd", 0, ""), (0, "", "\U0001f600", 0, "")]


def test_tables_are_linked(spark):
    doc = '{"a": {"attest": [{"src": "deck", "ex": [{"w": "x", "n": 3}, {"w": null, "n": "4"}]}], "sub": {"b": {"attest": [{"src": "cards"}]}}}}'
    df = spark.createDataFrame([(7, doc)], "entry_id bigint, forms string")
    links = N.linked(N.nodes(df))
    assert sorted((r.form, r.src) for r in N.attestations_table(links).collect()) == [("a", "deck"), ("b", "cards")]
    assert sorted(((r.src, r.word, r.n) for r in N.examples_table(links).collect()), key=str) == sorted([("deck", "x", 3), ("deck", None, None)], key=str)
    f = {r.form: r for r in N.forms_table(links).collect()}
    assert f["b"].parent_pre == f["a"].pre and f["a"].pre < f["b"].pre < f["b"].post < f["a"].post


tree = st.recursive(st.just({}), lambda inner: st.dictionaries(st.sampled_from("abcd"), inner.map(lambda x: {"sub": x, "pos": ["root"]}), max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(tree)
def test_intervals_contain_exactly_the_descendants(doc):
    found = [x for x in N.label(json.dumps(doc)) if x[0] == "form"]

    def count(t):
        return sum(1 + count(b["sub"]) for b in t.values())

    assert len(found) == count(doc)
    for a in found:
        for b in found:
            assert (a[1] < b[1] and b[2] < a[2]) or (b[1] < a[1] and a[2] < b[2]) or a[2] < b[1] or b[2] < a[1] or a is b


def test_empty_table(spark):
    df = spark.createDataFrame([], "entry_id bigint, forms string")
    assert N.form_positions(df).count() == 0
