import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiforge.llm import packing, plain_text, tokens, truncation
from lexiforge.runtime import cut


@pytest.mark.parametrize(
    "text, want",
    [
        ("to ѕteр", "to step"), ("еуе cf. лээя\t表示数", "eye cf. лээя\t表示数"), ("ｗａ­r；　x", "war; x"), ("é a​́", "é á"),
        ("toɡеtһer", "together"), ("ψήγάπή", "ψήγάπή"), ("“x”、•  y\n", "“x”、•  y\n"), ("​", ""), ("⼩ ﬁn", "小 fin"), ("ο и дом", "ο и дом"), ("", ""), (None, None),
        ("ꮪtone ⲟld Ꭼgg", "ꮪtone old Egg"), ("ᎠᎢᎺ and ⲁⲟⲣ", "ᎠᎢᎺ and ⲁⲟⲣ"),
    ],
)
def test_plain(text, want):
    assert plain_text.plain(text) == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abé́ｅ；　​­ёοψлﾊﾞ각각ᄀᅟ\n•小⼩ﬁ²"), max_size=14))
def test_plain_is_stable_and_composed(text):
    once = plain_text.plain(text)
    assert plain_text.plain(once) == once and unicodedata.is_normalized("NFC", once)


def test_segments_equal_whole_normalization():
    kept = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c))[0] in "LMN" and chr(c) not in plain_text.LOOK_ALIKES and chr(c) not in plain_text.HIDDEN]
    kept = [c for c in kept if not set(unicodedata.normalize("NFKD", c)) & set(plain_text.LOOK_ALIKES) and not unicodedata.normalize("NFKC", c).startswith(" ")]
    for i in range(0, len(kept) - 40, 37):
        text = "".join(kept[i : i + 40 : 3])
        assert plain_text.plain(text) == unicodedata.normalize("NFKC", text)


def test_changed_rows(spark):
    df = spark.createDataFrame([(1, "plain", "x"), (2, "ｗ", "x"), (3, None, "x"), (None, "​", "x")], "id bigint, m string, plain string")
    got = sorted(((r.row_id, r.plain) for r in plain_text.changed(df, "t", "id", "m").collect()), key=str)
    assert got == [(2, "w"), (None, "")]
    assert plain_text.changed(df.limit(0), "t", "id", "m").count() == 0


TEXTS = ["", None, " ", "the", "The cat's  hat\n\n x1234 ", "小 猫 éé 🙂🙂 ", "a" * 5000, "word " * 3000, "x 　\ty  "]


def test_encode_equals_the_library_and_decodes(spark):
    df = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, word string, ids array<int>")
    with open(tokens.vocabulary_path(), "rb") as f:
        enc = tokens.make_encoding(f.read())
    coded = cut(tokens.encode(df))
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokens.decode(coded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}


def test_encode_repeats_nulls_and_hot_words(spark):
    rows = [(1, "a b a"), (1, "a b a"), (1, "c"), (None, "d"), (None, None)] + [(i, "the the the") for i in range(10, 40)]
    got = tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 34 and len([r for r in got if r.doc_id == 1]) == 2
    assert {len(r.ids) for r in got if r.doc_id and r.doc_id >= 10} == {3}
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_frequent_words_are_spread(spark):
    texts = {i: "-" * 90 + f" w{i}" for i in range(60)} | {100: "=" * 200, 101: "x"}
    with open(tokens.vocabulary_path(), "rb") as f:
        enc = tokens.make_encoding(f.read())
    got = tokens.encode(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.ids for r in got} == {i: enc.encode_ordinary(t) for i, t in texts.items()} and len(got) == len(texts)


def test_fill_is_high(spark):
    rng = __import__("random").Random(2)
    sizes = [(i, int(rng.paretovariate(1.1) * 40)) for i in range(20_000)]
    got = packing.fill(packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"))).first()
    assert got.fill > 0.98 and got.fullest <= packing.CAPACITY and got.units == sum(n for _, n in sizes)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=80), st.integers(1, 6))
def test_packing_rules(sizes, open_bins):
    used = {}
    bins = packing.OpenBins(100, open_bins)
    for size, parts in zip(sizes, [list(packing.place(bins, size)) for size in sizes]):
        assert [p[2] for p in parts] == [0, *(p[3] for p in parts[:-1])] and parts[-1][3] == size
        assert len(parts) == max(1, -(-size // 100))
        for b, at, start, stop in parts:
            assert used.get(b, 0) == at and at + stop - start <= 100
            used[b] = at + stop - start


def test_packing_in_spark(spark):
    rows = [(i, i * 37 % 3000) for i in range(400)] + [(None, 10), (5, 185), (6, None), (7, -3)]
    packed = cut(packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")))
    assert packed.select("doc_id").distinct().count() == 401 and packed.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] == sum(max(0, n or 0) for _, n in rows)
    assert packing.fill(packed).first().fullest <= packing.CAPACITY
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0
    big = packing.pack(spark.createDataFrame([(2**60 + 1, 5), (None, 5)], "doc_id bigint, n_tokens bigint"))
    assert {r.doc_id for r in big.collect()} == {2**60 + 1, None}


def test_begun_values_equal_brute_force(spark):
    texts = ["a", "ab", "abc", "b", "bcd", "bcd", "b.", "b..", "zz", "ab c", "é", "éx", "x" * 5000, "x" * 5001, "𐐷a", "𐐷", "￿", "q", "q-", "q-1"]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").repartition(3)
    got = [r.value for r in truncation.begun_values(rows).collect()]
    assert set(got) == {a for a in texts if any(b.startswith(a) and any(map(str.isalnum, b[len(a) :])) for b in texts)}


def test_longer_copies(spark):
    """Every strict prefix of a longer text is found, however short and finished, but for stock sentences that stand elsewhere, too."""
    rng = __import__("random").Random(17)
    word = lambda: "".join(rng.choice("bdeglmnorst") for _ in range(rng.randint(4, 9)))
    prose = [" ".join(f"The {word()} of {word()} was long." for _ in range(5)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [(100 + i, t[: t.index(".", 40) + 1]) for i, t in enumerate(prose[:20])]  # cut at a sentence end, short
    rows += [(200 + i, t[: 50 + i]) for i, t in enumerate(prose[20:40])]
    rows += [(300, "Yes, it is."), (301, "Yes, it is. So they said."), (302, "Well now. Yes, it is. Or not."), (303, prose[50]), (None, prose[51][:70]), (305, "")]
    df = spark.createDataFrame([(*r, "s", "clash") for r in rows], "doc_id bigint, text string, source string, h string")
    narrow = truncation.prepare(df)
    got = {r._id for r in truncation.longer_copies(narrow, df).collect()}
    assert got == {*range(100, 120), *range(200, 220), None}
    why = {r.doc_id: r.why for r in truncation.truncated(df).collect()}
    assert {i for i, w in why.items() if w == "copy"} == got and not [i for i in why if i is not None and i < 100]


def test_begun_words(spark):
    rows = [(i, f"So theorem {i} holds again") for i in range(5)] + [(10, "It follows from theo"), (11, "It follows from a theorem"), (12, "So again"), (13, "Follows the zzz"), (14, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, source string")
    assert {r._id for r in truncation.begun_words(truncation.prepare(df), df).collect()} == {10}


def _corpus():
    rng = __import__("random").Random(3)
    word = lambda: "".join(rng.choice("bdeglmnorst") for _ in range(rng.randint(4, 9)))
    rows = []
    for i in range(300):
        text = " ".join(f"The {word()} of {word()} was long." for _ in range(rng.randint(2, 6)))
        rows.append((i, text + ("\nTags: " + word() if i % 10 == 0 else ""), "prose"))
    for i in range(300, 320):
        rows.append((i, rows[i - 300][1].split("\n")[0][: -rng.randint(4, 12)], "prose"))
    for i in range(400, 440):
        rows.append((i, " ".join(f"The {word()} of {word()} was long." for _ in range(9))[:99] + "x" if i % 4 else "The " + "x" * 86 + " was long.", "limited"))
    rows += [(500, None, "prose"), (501, "", "prose"), (502, "  ", None), (503, '<div class="a"><div>x</div>', "html"), (504, "<div><p>x</p></div>", "html"), (505, "cut �", None)]
    return rows


def test_truncation(spark):
    rows = _corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, source string, why string")
    got = {r.doc_id: r.why for r in truncation.truncated(df).collect()}
    want = set(range(300, 320)) | {i for i in range(400, 440) if i % 4} | {503, 505}
    assert want <= set(got) and not [i for i in got if i < 300 or i in (500, 501, 502, 504)]
    assert not [i for i in range(400, 440) if i % 4 == 0 and i in got], "a finished text that fills its field is whole"
    shares = {r.source: r for r in truncation.rates(df, truncation.truncated(df)).collect()}
    assert shares["limited"].cut == 30 and shares["limited"].documents == 40
    assert truncation.truncated(df.limit(0)).count() == 0


def test_dots_that_stand_for_the_rest(spark):
    rng = __import__("random").Random(5)
    word = lambda: "".join(rng.choice("bdeglmnorst") for _ in range(rng.randint(4, 9)))
    prose = lambda n: " ".join(f"The {word()} of {word()} was long." for _ in range(n))
    whole = [prose(rng.randint(2, 4))[:180].rsplit(".", 1)[0] + "." for _ in range(100)]
    rows = [(i, t, "sync") for i, t in enumerate(whole)]
    rows += [(200 + i, prose(12)[:197] + ("..." if i % 2 else "…  "), "sync") for i in range(12)]
    rows += [(300 + i, f"{prose(3)} And so it goes on...", "feed") for i in range(20)]
    rows += [(350, f"{whole[60]} And so it goes on...", "feed")]  # a longer copy of a finished text
    rows += [(400, whole[50][:33] + "...", "feed"), (401, "Well, we all went home.", "feed"), (402, "Well, we all went home...", "feed"), (403, "...", "feed"), (404, whole[51][:-1] + "...", "feed")]
    rows += [(405, "Some say it was li...", "feed"), (406, "Some say it was li", "feed"), (407, "Some say it was li!", "feed"), (408, "Some say it was lifted up.", "feed")]
    got = {r.doc_id: r.why for r in truncation.truncated(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert {i for i in got if 200 <= i < 300} == set(range(200, 212))
    assert {i for i in got if i < 200 or i >= 300} == {60, 400, 405, 406}


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_frequent_truncation_is_not_usual(spark, share):
    rng = __import__("random").Random(11)
    word = lambda: "".join(rng.choice("bdeglmnorst") for _ in range(rng.randint(4, 9)))
    texts = [" ".join(f"The {word()} of {word()} was long." for _ in range(rng.randint(2, 6))) for _ in range(200)]
    rows = [(i, t[: -rng.randint(4, 12)] if i < 200 * share else t, "prose") for i, t in enumerate(texts)]
    rows += [(1000 + i, f"The {word()} was a {word()}. {texts[i]}\nTags: {word()}", "tagged") for i in range(60)] + [(2000 + i, f"{word()}\n{word()}, {word()}", "cards") for i in range(60)]
    got = {r.doc_id: r.why for r in truncation.truncated(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert set(got) == set(range(int(200 * share)))


def test_limits_beside_longer_texts(spark):
    rng = __import__("random").Random(13)
    word = lambda: "".join(rng.choice("bdeglmnorst") for _ in range(rng.randint(4, 9)))
    prose = lambda n: " ".join(f"The {word()} of {word()} was long." for _ in range(n))
    at = lambda n, head="": (head + prose(20))[: n - 1] + "x"
    rows = [(i, prose(rng.randint(2, 12)), "old" if i % 2 else f"s{i % 10}") for i in range(600)] + [(999, prose(40), "old")]
    rows += [(1000 + i, at(120 if i % 2 else 200), "old") for i in range(20)]  # two limits, longer texts stand beside
    rows += [(1100 + i, at(150), f"s{i}") for i in range(0, 10, 2)]  # one of each source
    rows += [(1200 + i, at(n), None) for i, n in enumerate((120, 150, 200))]
    rows += [(1300 + i, "é" * 9 + at(141), "bytes") for i in range(12)] + [(1400, "é" * 9 + at(140), "bytes")]
    docs = truncation.prepare(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source")
    known = {(r.s, r.unit, r.size) for r in truncation.limits(docs).collect() if r.s != "\0"}
    assert {("old", "chars", 120), ("old", "chars", 200), ("*", "chars", 150), ("bytes", "octets", 159)} <= known
    got = {r._id for r in truncation.at_limits(docs).collect()}
    assert got == {i for i, *_ in rows if i >= 1000}
