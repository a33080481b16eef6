import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions import strings
from lexiforge.llm import families, fusion, matching, queries


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] + [(10000 + i, 1000 + (i + 1) % 17) for i in range(17)] + [(5000, 5001 + i) for i in range(20)]
    edges += [(7000, 7001), (7001, 7002), (7002, 7000), (8000, 8001), (8001, 8000), (9, 9), (None, 3), (30000, 30001), (30001, 30002), (30002, 30000), (30000, 30003), (30003, 30004)]
    edges += [(rng.randrange(20000, 20060), rng.randrange(20000, 20060)) for _ in range(75)] + [(40000 + i, 40100 + j) for i in range(4) for j in range(4)]
    ids = sorted({x for e in edges for x in e if x is not None})
    new = dict(zip(ids, rng.sample(range(10**6), len(ids))))
    edges = [tuple(new.get(x) for x in e) for e in edges]
    got = families.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len({r.v for r in got}) and {r.v: r.label for r in got} == brute(edges)


def test_components_of_nothing(spark):
    assert families.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_family_links(spark):
    rows = [
        (1, "Ab-", "root", ["x"], ["pad"]), (2, "ab", "root", None, []), (3, "x", "root", ["y"], ["gate"]), (4, "y", "root", [], None), (5, "ab", "prefix", [None, ""], None),
        (6, "q", "root", ["X "], ["gate", None]), (7, None, "root", None, None), (8, "ab", None, None, None), (9, "AB", None, None, None),
    ]
    df = spark.createDataFrame(rows, "group_id bigint, canonical string, pos string, variants array<string>, edge_types array<string>")
    got = {r.group_id: r.cluster_id for r in families.families(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 8: 8, 9: 8}


def at(day):
    return datetime.datetime(2024, 1, day) if day else None


def fused(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, form string, kind string, text string, src string, at timestamp, k string")
    return fusion.fuse(df, [strings.bare_form(F.col("form")), F.col("kind")], "id", "text", "src", "at", **options)


def test_survivors(spark):
    rows = [
        (1, "-Ab", "x", "n/a", "manual", at(9)), (2, "ab ", "x", "to go", " Roots", at(1)), (3, "AB", "x", "go", "roots", at(2)),
        (4, "b", "x", None, None, None), (5, "b", "x", "", "corpus", None), (6, "c", "x", "one", "?", None), (7, "d", None, "t", "manual", None), (8, "d", None, "t", "MANUAL ", None),
        (9, "e", "x", "old", "corpus", at(1)), (10, "e", "x", "new", "corpus", at(1)), (11, "f", "x", "a", "zzz", at(3)), (12, "f", "x", "b", "corpus", None), (13, None, "x", "p", None, None), (14, None, "x", "q", None, at(1)),
    ]
    got = {r.k.k0: r.row_id for r in fused(spark, rows).collect()}
    assert got == {"ab": 3, "b": 5, "d": 7, "e": 9, "f": 12, None: 14}
    assert fused(spark, []).count() == 0


def test_copied_votes_are_discounted(spark):
    """Two sources that share false texts count as little more than one."""
    rng, rows, n = random.Random(4), [], 0
    for g in range(150):
        true, false = f"t{g}", f"f{g}"
        wrong = rng.random() < 0.6
        alone = [(x, true if rng.random() < 0.8 else f"{x}{g}") for x in ("fair", "good", "more")]
        for src, text in (*alone, ("bad", false if wrong else true), ("copy", false if wrong else true)):
            n += 1
            rows.append((n, f"k{g}", "x", text, src, at(1)))
    df = spark.createDataFrame(rows, "id bigint, form string, kind string, text string, src string, at timestamp")
    made = fusion.claims(df, [F.col("form")], "id", "text", "src", "at", ())
    accuracy, copying = fusion.estimate(fusion.patterns(made))
    assert accuracy["good"] > accuracy["bad"] and copying["bad\x1fcopy"] > 0.9 > 0.5 > copying["fair\x1fgood"]
    out = fused(spark, rows, trust=(), order=()).select(F.col("k.k0").alias("g"), "map_text", "text").collect()
    assert sum(r.map_text == r.text == "t" + r.g[1:] for r in out) > 0.9 * len(out)


def test_estimate_decides_where_the_prior_does_not(spark, monkeypatch):
    rows = [(1, "a", "x", "one", "corpus", at(2)), (2, "a", "x", "two", "roots", at(1)), (3, "a", "x", "three", "roots", at(1)), (4, "b", "x", "n/a", "corpus", at(1)), (5, "b", "x", "none", None, at(1))]
    for sure, want in (("x", 2), ("y", 3)):
        rows[1], rows[2] = (*rows[1][:4], "x", at(1)), (*rows[2][:4], "y", at(1))
        monkeypatch.setattr(fusion, "estimate", lambda p, sure=sure: ({sure: 0.9, "corpus": 0.1}, {}))
        got = {r.k.k0: r.row_id for r in fused(spark, rows, trust=(), order=()).collect()}
        assert got == {"a": want, "b": 4}
        assert {r.k.k0: r.row_id for r in fused(spark, rows, trust=("corpus",), order=("trust",)).collect()}["a"] == 1, "a prior no vote outweighs"
        assert {r.k.k0: r.row_id for r in fused(spark, rows, trust=(), order=("latest",)).collect()}["a"] == 1


def test_fields_are_chosen_one_by_one(spark):
    rows = [(1, "a", "x", "to go", None, at(5)), (2, "a", "x", "go", "zz", at(4)), (3, "a", "x", None, "manual", at(9)), (4, "b", "x", "go", None, at(9)), (5, "b", "x", "go", "Corpus ", at(1)), (6, "b", "x", "be", "", None)]
    got = {r.k.k0: (r.row_id, r.text, r.src) for r in fused(spark, rows).collect()}
    assert got == {"a": (1, "to go", None), "b": (5, "go", "Corpus ")}
    assert {r.k.k0: (r.row_id, r.src) for r in fused(spark, rows, order=("latest",)).collect()}["b"] == (4, "Corpus ")


def test_survivors_are_those_of_the_fusion(spark):
    rng = random.Random(3)
    texts, sources = ["go", "to go", "be", " ", "n/a", None, "x; y", "y, x"], ["manual", "Roots ", "corpus", "zz", "", None]
    rows = [(rng.choice([None, *range(90)]), rng.choice("abcdefghijkl"), rng.choice(["x", None]), rng.choice(texts), rng.choice(sources), at(rng.choice([None, 1, 2]))) for _ in range(160)]
    df = spark.createDataFrame(rows, "id bigint, form string, kind string, text string, src string, at timestamp")
    args = (df, [F.col("form"), F.col("kind")], "id", "text", "src", "at")
    for order in (fusion.ORDER, ("first",), ("latest", "first"), ("trust",), ()):
        got, want = (sorted(map(str, f(*args, order=order).select("k", "n", "row_id").collect())) for f in (fusion.survivors, fusion.fuse))
        assert got == want and len(got) > 10


def test_survivors_estimate_only_what_can_decide(spark, monkeypatch, tmp_path):
    rows = [(1, "-a", "x", "one", "zz", at(1)), (2, "A", "x", "two", "roots", at(1)), (3, "a", "x", "three", "roots", at(2)), (4, "b", "x", "n/a", "manual", at(9)), (5, "b", "x", "go", None, None), (6, "c", "x", "be", None, None)]
    for name, cols in (("allomorph_groups", ("group_id", "canonical", "pos", "gloss")), ("anki_highfreq", ("anki_id", "affix", "affix_type", "meaning"))):
        schema = "{} bigint, {} string, {} string, {} string, gloss_src string, updated_at timestamp".format(*cols)
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    asked = []
    monkeypatch.setattr(fusion, "estimate", lambda p: (asked.append(p), ({"roots": 0.9, "unknown": 0.1}, {}))[1])
    got = sorted(map(tuple, queries.p2_found(spark, str(tmp_path)).collect()))
    assert got == [(t, i) for t in ("allomorph_groups", "anki_highfreq") for i in (3, 5)] and not asked
    p = {(r.tbl, r.row_id): r.p for r in queries.p2_fused(spark, str(tmp_path)).collect()}
    assert sorted(p) == got and len(asked) == 2
    monkeypatch.setattr(fusion, "estimate", lambda p: ({"roots": 0.2, "unknown": 0.9}, {}))
    assert all(r.p < p[r.tbl, r.row_id] for r in queries.p2_fused(spark, str(tmp_path)).where("form = 'a'").collect())
    df = spark.createDataFrame(rows, "id bigint, form string, kind string, text string, src string, at timestamp")
    for sure, want in (("zz", 1), ("roots", 3)):
        monkeypatch.setattr(fusion, "estimate", lambda p, sure=sure: ({"zz": 0.1, "roots": 0.1, sure: 0.9}, {}))
        out = fusion.survivors(df, [strings.bare_form(F.col("form"))], "id", "text", "src", "at", trust=(), order=()).collect()
        assert {r.k.k0: r.row_id for r in out} == {"a": want, "b": 5}, "votes decide what the order leaves level"


def test_mixture_separates_and_takes_missing_values():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal([1, 0.9], 0.05, (300, 2)), rng.normal([0.9, 0.1], 0.05, (200, 2)), [[1.0, np.nan]]])
    p = matching.Mixture(x, (np.nan_to_num(x[:, 1], nan=0.5) > 0.5).astype(float), np.ones(len(x))).fit()
    assert (p[:300] > 0.9).all() and (p[300:500] < 0.1).all() and 0.2 < p[500] < 0.99


def test_matching(spark):
    rng = random.Random(7)
    senses = [(a + "e", a + "u") for a in (x + y + z for x in "bdfgh" for y in "aeo" for z in "lmrs")]
    roots, hf, aff, want = [], [], [], set()
    for i in range(900):
        form = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) + "xz"[i % 2]
        mine = rng.sample(senses, 3)
        say = lambda ss: "; ".join(rng.choice(s) for s in ss)
        roots.append((10000 + i, form, say(mine), say(mine), f'{{"{form}": {{}}, "{form}ic": {{"opt": 1}}}}'))
        if i % 3 == 0:
            hf.append((20000 + i, f"-{form[:3]}{form[4:]}" if i % 9 == 0 else f" {form.upper()}-", "prefix", say(mine)))
            want.add((10000 + i, 20000 + i))
        if i % 3 == 1:
            other = rng.sample([s for s in senses if s not in mine], 3)
            hf.append((20000 + i, form, None, say(other)))
        if i % 4 == 0:
            aff.append((30000 + i, f"-{form}ic-", say(mine)))
            want.add((10000 + i, 30000 + i))
            if i % 3 == 0:
                want.add((20000 + i, 30000 + i))
    hf += [(29000, None, None, "x"), (29001, "--", "", None)]
    aff += [(39000, None, None)]
    r = spark.createDataFrame([(*x, "clash") for x in roots], "entry_id bigint, base string, meaning string, ety_meaning string, forms string, tbl string")
    h = spark.createDataFrame(hf, "hf_id bigint, affix string, affix_type string, meaning string")
    a = spark.createDataFrame(aff, "affix_id bigint, roots string, meaning string")
    rows = matching.match(r, h, a).collect()
    got = {(x.id_a, x.id_b) for x in rows}
    assert len(got) == len(rows) and all(0.5 <= x.confidence <= 1 for x in rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def _crowd(n):
    """One form of ``n`` root classes and as many affixes of other senses, but for a few of the same, and some near it."""
    word = lambda i: "".join("bcdfghklmn"[int(c)] + "a" for c in f"{i:04d}")
    roots = [(10000 + i, "stato", word(i), word(5000 + i), '{"stato": {}, "statoric": {}}') for i in range(n)]
    hf = [(20000 + i, "-stato-", "root", word(i if i % 10 == 0 else 2000 + i)) for i in range(n)] + [(29000, "stat", "root", word(3)), (29001, "stato", None, None)]
    aff = [(30000 + i, "-statoric", word(i if i % 8 == 0 else 3000 + i)) for i in range(n // 2)] + [(39000, "statto", word(4)), (39001, "", "x")]
    return roots, hf, aff


def _frames(spark, roots, hf, aff):
    return (
        spark.createDataFrame(roots, "entry_id bigint, base string, meaning string, ety_meaning string, forms string"),
        spark.createDataFrame(hf, "hf_id bigint, affix string, affix_type string, meaning string"),
        spark.createDataFrame(aff, "affix_id bigint, roots string, meaning string"),
    )


@pytest.mark.parametrize("n", [40, 80])
def test_hot_and_cold_forms_give_the_same_candidates(spark, n):
    cls, _ = matching.classes(matching.all_records(*_frames(spark, *_crowd(n))))
    full = matching._expanded(cls, matching.learn_synonyms(cls))
    got = []
    for hot in (0, 10**9):
        pairs, unlike = matching.candidates(full, hot)
        got.append((sorted(map(str, pairs.collect())), sorted(map(str, unlike.collect()))))
    assert got[0] == got[1]
    pairs, unlike = matching.candidates(full, 0)
    alike = pairs.where("gs > 0").count()
    assert alike >= n // 10 + n // 2 // 8 and pairs.where("gs is null").count() > 0
    # with those counted, all pairs of a shared form are there
    whole = n * n + n * (n // 2)
    assert unlike.where("fs >= 0.7").agg(F.sum("n")).first()[0] + pairs.where("fs >= 0.7 and gs > 0").count() >= whole


def test_short_forms_one_edit_apart(spark):
    forms = spark.createDataFrame([(i, f, 3) for i, f in enumerate(("orin", "oran", "ico", "iko", "ab", "ac", "orni", "telere", "teler"))] + [(20, "zolan", 1), (21, "zolen", 1), (22, "zolin", 4)], "fid bigint, form string, mask int")
    got = {(r.form, r.other) for r in matching.near_forms(forms).collect()}
    assert got == {(a, b) for x, y in (("orin", "oran"), ("ico", "iko"), ("orin", "orni"), ("telere", "teler"), ("zolan", "zolin"), ("zolen", "zolin")) for a, b in ((x, y), (y, x))}


def test_chains_are_closed_over_any_table(spark):
    """A root without senses matches by form, an affix by near form and sense: the pair at the ends is found through the record between."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) + "x"
    sense = [f"{a}{b}{c}t" for a in "bdfgk" for b in "aeo" for c in "lmrs"]
    roots, hf, aff = [], [], []
    for i in range(300):
        form, mine = name(), "; ".join(rng.sample(sense, 3))
        roots.append((1000 + i, form, mine, mine, f'{{"{form}": {{}}}}'))
        hf.append((2000 + i, form, "root", mine))
        aff.append((3000 + i, f"-{form}-", mine))
    form, mine = "kolivarex", "balt; belt; bolt"
    roots.append((1, form, None, None, f'{{"{form}": {{}}}}'))
    hf.append((2, form, "root", mine))
    aff.append((3, "-kolvarex-", mine))
    got = {(r.id_a, r.id_b): r.confidence for r in matching.match(*_frames(spark, roots, hf, aff)).collect()}
    assert {(1, 2), (2, 3), (1, 3)} <= set(got)
    assert got[(1, 2)] * got[(2, 3)] <= got[(1, 3)] + 1e-3, "the constraint holds"
