import itertools
import random

from pyspark.sql import functions as F

from lexiforge.operators import allomorphs as A
from lexiforge.operators import affixes as X
from lexiforge.operators import etl


def brute(forms):
    pads, assim = set(), set()
    for (a, p), (b, q) in itertools.permutations(forms, 2):
        if p != q:
            continue
        if len(b) == len(a) + 1:
            cuts = [len(a)] if p == "root" else range(len(b))
            if any(b[:i] + b[i + 1 :] == a for i in cuts):
                assert a != b
                pads.add((a, b, p))
        if len(a) == len(b) and a < b:
            diff = [i for i in range(len(a)) if a[i] != b[i]]
            ends = {len(a) - 1} if p == "root" else {0, len(a) - 1}
            if len(diff) == 1 and diff[0] in ends and a[diff[0]] not in A.VOWELS and b[diff[0]] not in A.VOWELS:
                assim.add((a, b, p))
    return pads, assim


def test_edges_equal_all_pairs(spark):
    rng = random.Random(5)
    forms = sorted({("".join(rng.choice("abst") for _ in range(rng.randint(1, 4))), rng.choice(["prefix", "suffix", "root"])) for _ in range(160)})
    df = spark.createDataFrame(forms, "form string, pos string")
    pads, assim = brute(forms)
    got = A.pad_edges(df).collect()
    assert len(got) == len({tuple(r)[:3] for r in got}) and {(r.a, r.b, r.pos) for r in got} == pads
    got = A.assimilation_edges(df).collect()
    assert len(got) == len({tuple(r) for r in got}) and {(r.a, r.b, r.pos) for r in got} == assim


def test_elide_and_pad(spark):
    df = spark.createDataFrame([("ab", "prefix"), ("abb", "prefix"), ("abc", "prefix")], "form string, pos string")
    assert {(r.b, r.kind) for r in A.pad_edges(df).collect()} == {("abb", "elide"), ("abc", "pad")}


def test_gate_and_groups(spark):
    nodes = spark.createDataFrame(
        [("ab", "prefix", ["to go, away"], 0, 5), ("abs", "prefix", ["away"], 1, 9), ("as", "prefix", ["away, go"], 1, 1), ("ax", "prefix", ["near"], 2, 1), ("abb", "prefix", [], 3, 1), ("abt", "prefix", ["离开"], 2, 1)],
        "form string, pos string, lines array<string>, rank int, cnt bigint",
    )
    gated = A.gate(A.rule_edges(nodes), nodes)
    by = {(r.a, r.b): r.merge for r in gated.collect()}
    assert by[("ab", "abs")] is True and by[("as", "ax")] is False and by[("ab", "abb")] is False and by[("ab", "abt")] is None
    groups = {r.canonical: r for r in A.groups(nodes, gated).collect()}
    assert groups["ab"].variants == ["ab", "abs", "as"] and groups["ab"].cnt == 15 and groups["ab"].rank == 0
    held = {(r.a, r.b): r.reason for r in A.review(gated).collect()}
    assert held[("as", "ax")] == "differs" and held[("ab", "abt")] == "other_language"
    assert ("ab", "abb") not in held, "an edge without a gloss on a side has nothing to be reviewed"
    examples = nodes.sparkSession.createDataFrame([("ax", "prefix", "axe", 1), ("ax", "prefix", "axis", 2), ("zz", "prefix", "z", 1)], "form string, pos string, word string, n int")
    pos = gated.where("a = 'as' and b = 'ax'").first().pos
    shown = A.review(gated, examples.withColumn("pos", F.lit(pos))).where("b = 'ax'").first()
    assert list(shown.examples_a) == [] and list(shown.examples_b) == ["axe", "axis"]


def test_labels(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("q", "q")]
    got = {r.v: r.label for r in A.labels(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert A.labels(spark.createDataFrame([], "a string, b string")).count() == 0


def test_segment_frequencies(spark):
    cards = spark.createDataFrame([("w1", ["a", "b", "a"]), ("w2", ["c"])], "word string, segments array<string>")
    rules = spark.createDataFrame([("w1", ["z", "z"]), ("w3", ["q"]), ("w4", ["b", "a"])], "word string, segments array<string>")
    got = {r.seg: (r.cnt, r["first"], r["last"], r.middle) for r in etl.segment_frequencies(cards, rules).collect()}
    assert got == {"a": (2, 1, 1, 0), "b": (2, 1, 0, 1), "c": (1, 1, 0, 0)}


def test_affix_stripping(spark):
    words = spark.createDataFrame([("undoable",), ("zz",), ("doable",)], "word string")
    aff = spark.createDataFrame([("un", "p"), ("able", "s"), ("e", "s")], "affix string, kind string")
    lex = spark.createDataFrame([("do",), ("doable",), ("undo",)], "word string")
    got = {r.word: (r.prefix, r.stem, r.suffix) for r in X.strip_affixes(words, aff, lex).collect()}
    assert got == {"undoable": ("un", "do", "able"), "zz": (None, "zz", None), "doable": (None, "do", "able")}


def test_chains_stop_in_rings(spark):
    rev = spark.createDataFrame([("abc", "ab", "c", "s"), ("ab", "b", "a", "p"), ("x", "y", "1", "s"), ("y", "x", "2", "s")], "word string, base string, affix string, kind string")
    got = {r.word: (r.parts, r.depth) for r in X.chains(rev).collect()}
    assert got["abc"] == (["a", "b", "c"], 2) and got["ab"] == (["a", "b"], 1) and got["x"][1] == 10
