import pytest
from pyspark.sql import functions as F

from lexiforge.functions import markup, strings


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, n", [("", 0), ("yes", 1), ("syllable", 3), ("queue", 1), ("rhythm", 1), ("y", 0), ("banana", 3)])
def test_syllables(spark, word, n):
    assert one(spark, strings.count_syllables(F.col("w")), w=word) == n


def test_affix_position(spark):
    got = [one(spark, strings.affix_position(F.col("w")), w=w) for w in ("-x-", "-x", "x-", "x", None)]
    assert got == ["root", "suffix", "prefix", None, None]


def test_secondary_score(spark):
    f = lambda n, m, o: spark.range(1).select(strings.secondary_score(F.lit(n).cast("double"), F.lit(m).cast("double"), F.lit(o)).alias("x")).first()["x"]
    assert f(3, None, False) == 0.5 and f(6, None, True) == 0.25 and f(1, 6, False) == 0.375 and f(None, 9, False) == 0.0


def test_highlights(spark):
    assert one(spark, strings.stem_highlight(F.col("w"), F.lit("FORT")), w="comfortable") == 'com<span class="stem">fort</span>able'
    assert one(spark, strings.stem_highlight(F.col("w"), F.lit("zz")), w="comfort") == "comfort"
    assert one(spark, strings.run_highlight(F.col("w"), ["om", "t"]), w="comfort") == 'c<span class="hit">om</span>for<span class="hit">t</span>'
    assert one(spark, strings.run_highlight(F.col("w"), ["t", "om"]), w="comfort") == "comfort"


def test_langs_and_overlap(spark):
    row = spark.range(1).select(
        strings.join_langs(F.array(F.lit("L"), F.lit("?"), F.lit("G"), F.lit("L"))).alias("a"),
        strings.join_langs(F.array(F.lit("?"))).alias("b"),
        strings.join_langs(F.array(F.lit(""))).alias("c"),
        strings.line_overlap(strings.line_tokens(F.lit("to bend; turn")), strings.line_tokens(F.lit("turn, or twist, bend"))).alias("d"),
        strings.line_overlap(strings.line_tokens(F.lit("turn")), strings.line_tokens(F.lit("转"))).alias("e"),
        strings.parse_segments(F.lit("re.[sp.ec].tive")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("G; L", "?", "", 1.0, None, ["re", "sp.ec", "tive"])


ENTRY = '<div class="gdc"><h2>x</h2><span class="ipa"> ˈab </span><div class="coca2">to <b>bend</b> (sth), turn</div><span class="dcn">弯；转</span><span class="frm">bent, , bends</span><div class="lemmas">bend[n] <i>bends[pl]</i></div></div>'


def test_markup(spark):
    get = lambda c, html=ENTRY: one(spark, c, h=html)
    h = F.col("h")
    assert get(markup.ipa(h)) == "ˈab" and get(markup.ipa(h), "none") == ""
    assert get(markup.definition(h)) == "to bend" and get(markup.definition(h, nested=False)) is None
    assert get(markup.definition_fallback(h)) == "弯" and get(markup.definition_fallback(h), "x") is None
    assert get(markup.verb_forms(h)) == ["bent", "bends"] and get(markup.noun_forms(h)) == ["bend", "bends"]
    assert get(markup.clean_html(h), "a&nbsp;<i>c</i>\n d &amp; e<br>f ") == "a c d & e f"
    assert get(markup.clean_html(h), "caf&eacute; &#233;&#xe9; &mdash;&notit; &amp;lt; &zzz; &") == "café éé —¬it; &lt; &zzz; &"
    assert get(markup.clean_html(h), None) is None
    assert get(markup.definition(h), None) is None and get(markup.verb_forms(h), "") == []
    assert get(markup.fix_resource_paths(h), "<img src='a.png'><img src=\"http://x/y\"><script src='/static/z.js'></script>") == '<img src="/static/a.png"><img src="http://x/y"><script src=\'/static/z.js\'></script>'


def test_inserted(spark):
    got = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(strings.inserted(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert tuple(got("abc", "abxc")) == ("abxc", 2, "x") and tuple(got("aab", "ab")) == ("aab", 1, "a") and tuple(got("", "q")) == ("q", 0, "q")
    assert got("abc", "abc") is None and got("abcd", "axb") is None and got("abc", "abcde") is None and got(None, "a") is None


def test_styles(spark):
    styles = F.create_map(F.lit("1"), F.struct(F.lit("<b>").alias("open"), F.lit("</b>").alias("close")))
    assert one(spark, markup.substitute_styles(F.col("t"), styles), t="a`1`b\n`9`c") == "a<b>b</b>\r\nc"
