import pytest

from lexiforge.operators import affixes, lexicon, segment


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def table(spark, **kinds):
    return spark.createDataFrame([(a, k) for k, xs in kinds.items() for a in xs], "affix string, kind string")


def test_affixes_of_any_length(spark):
    long = "pseudohyperultra"
    a = table(spark, p=[long, "re"], s=["ification" * 3])
    assert [(r.pre, r.rest) for r in affixes.prefix_splits(words(spark, long + "form", "re"), a).collect()] == [(long, "form")]
    assert [(r.rest, r.suf) for r in affixes.suffix_splits(words(spark, "class" + "ification" * 3), a).collect()] == [("class", "ification" * 3)]
    assert affixes.prefix_splits(words(spark, "redo"), a.where("kind = 's'")).count() == 0 and affixes.prefix_splits(words(spark, "redo").limit(0), a).count() == 0


def test_forms_of_any_length(spark):
    form = "abcde" * 5
    forms = spark.createDataFrame([(form,), ("ab",), ("a",)], "form string")
    got = sorted((r.start, r.form) for r in segment.substrings(words(spark, "x" + form, "a", ""), forms).collect())
    assert got == [(1 + 5 * i, "ab") for i in range(5)][:1] + [(1, form)] + [(1 + 5 * i, "ab") for i in range(1, 5)]
    assert segment.substrings(words(spark, "ab" * 10_000), forms).count() == 10_000


def test_first_inflection_with_a_suffix_stays(spark):
    rows = [("runs", "run", "s", 1), ("runs", "rune", "es", 2), ("geese", "geese", "", 1), ("geese", "goose", "", 2), ("geese", "gooses", None, 3), ("geese", "geese", "", 4), ("ox", "ox", "", 1), ("men", "man", "", 1), ("men", "me", "n", 5)]
    got = {r.form: (r.lemma, r.suffix) for r in affixes.inflections(spark.createDataFrame(rows, "form string, lemma string, suffix string, ord bigint")).collect()}
    assert got == {"runs": ("run", "s"), "geese": ("gooses", ""), "ox": ("ox", ""), "men": ("me", "n")}


@pytest.mark.parametrize(
    "word, want",
    [
        ("reite", ("re", "it", "", "e", 2 * 2 + 3 * 2 + 2 + 10)), ("reit", ("re", "it", "", "", 4 + 6 + 10)), ("graph", None), ("graphy", ("", "graph", "", "y", 15 + 2 + 10)),
        ("telegraph", ("", "tele", "graph", "", 8 + 15 + 15)), ("agraph", ("a", "graph", "", "", 2 + 15)), ("agraphy", ("a", "graph", "", "y", 2 + 15 + 2 + 10)), ("ait", None), ("xgraph", None),
    ],
)
def test_etymological_schemes(spark, word, want):
    roots = spark.createDataFrame([("it",), ("graph",), ("tele",), ("x",)], "root string")
    got = affixes.etym_analysis(words(spark, word), roots, table(spark, p=["re", "a"], s=["able"])).collect()
    assert [tuple(r)[1:] for r in got] == ([want] if want else [])


def test_etymological_variants(spark):
    etym = spark.createDataFrame([("-gen, =us, -Er, genit , ,x",), ("=a",), (None,), ("",)], "roots string")
    assert {r.root for r in affixes.etym_variants(etym).collect()} == {"gen", "genus", "gener", "genit"}


def test_analyses(spark):
    deriv = spark.createDataFrame([("unkindness", "unkind", "ness", "s", 1), ("unkind", "kind", "un", "p", 2), ("kindly", "kind", "ly", "s", 3)], "word string, base string, affix string, kind string, ord bigint")
    infl = spark.createDataFrame([("oxen", "ox", "en"), ("kindly", "kind", "ly")], "form string, lemma string, suffix string")
    known = words(spark, "kind", "friend")
    roots = spark.createDataFrame([("graph",)], "root string")
    a = table(spark, p=["un", "re"], s=["ly", "ness"])
    got = {r.word: r for r in affixes.analyze(words(spark, "unkindness", "unkind", "kindly", "oxen", "friendly", "regraphy", "zzz"), deriv, roots, a, known, infl).collect()}
    shown = {w: (r.strategy, list(r.parts), len(r.strategies)) for w, r in got.items()}
    assert shown == {
        "unkindness": ("combined", ["un", "kind", "ness"], 2), "unkind": ("derivation", ["un", "kind"], 1), "kindly": ("derivation", ["kind", "ly"], 1), "oxen": ("inflection", ["ox", "en"], 1),
        "friendly": ("rule", ["friend", "ly"], 1), "regraphy": ("etym", ["re", "graph", "y"], 1), "zzz": ("none", ["zzz"], 1),
    }


def test_chains_keep_finished_words_apart(spark):
    rows = [(f"w{i}", f"w{i - 1}", f"s{i}", "s") for i in range(1, 15)] + [("ring", "gnir", "x", "p"), ("gnir", "ring", "y", "p")]
    rev = spark.createDataFrame(rows, "word string, base string, affix string, kind string")
    got = {r.word: (r.base, r.depth) for r in affixes.chains(rev).collect()}
    assert got == {f"w{i}": (f"w{max(0, i - 10)}", min(i, 10)) for i in range(1, 15)} | {"ring": ("ring", 10), "gnir": ("gnir", 10)}
    few = affixes.chains(rev, words=words(spark, "w3", "nothing")).collect()
    assert [(r.word, r.base, list(r.parts)) for r in few] == [("w3", "w0", ["w0", "s1", "s2", "s3"])]


def test_index_is_built_once_and_again_for_other_files(spark, tmp_path):
    d = str(tmp_path)
    make = lambda text, mode: spark.createDataFrame([(1, text, None)], "doc_id bigint, text string, lang string").write.mode(mode).parquet(f"{d}/documents.parquet")
    make("a rose is a rose", "overwrite")
    first = lexicon.word_index(spark, d)
    assert [(r.word_lower, r.cnt, r.row_id) for r in first.orderBy("row_id").collect()] == [("a", 2, 1), ("rose", 2, 2), ("is", 1, 3)]
    assert lexicon.word_index(spark, d).inputFiles() == first.inputFiles()
    assert "PushedFilters: [IsNotNull(word_lower), EqualTo(word_lower,rose)]" in first.where("word_lower = 'rose'")._jdf.queryExecution().executedPlan().toString()
    make("tulip", "append")
    assert {r.word_lower for r in lexicon.word_index(spark, d).collect()} == {"a", "rose", "is", "tulip"}
    assert lexicon.word_index(spark, d, "en").count() == 0, "one language only, if it is asked for"
